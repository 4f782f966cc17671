"""Resource quantities such as ``10Gi``, ``1.5G`` or ``3e9`` as whole bytes.

There is one definition, a SQL expression; the Column form applies it to its argument.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.fixed_values import BINARY_SUFFIXES, DECIMAL_SUFFIXES, LONG_MAX
from ballast.functions.literals import map_sql

PATTERN = (
    r"^([+-]?)(?=\.?[0-9])([0-9]*)(?:\.([0-9]*))?"
    r"(Ki|Mi|Gi|Ti|Pi|Ei|n|u|m|k|M|G|T|P|E|[eE][+-]?[0-9]+|)$"
)
_BIG = "decimal(38,0)"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _decimal(part: str) -> str:
    """Digits with the point moved by string arithmetic. An exponent beyond an int moves it beyond any range."""
    far = f"if(startswith(substring({part}.suffix, 2), '-'), -2000000000, 2000000000)"
    ten = (
        f"cast(coalesce(try_element_at({map_sql(DECIMAL_SUFFIXES, 'int')}, {part}.suffix), "
        f"try_cast(regexp_extract({part}.suffix, '^[eE]([+-]?[0-9]+)$', 1) as int), {far}) as bigint)"
    )
    digits = f"ltrim('0', concat({part}.whole, {part}.frac))"
    point = f"char_length({part}.whole) + {ten} - (char_length({part}.whole) + char_length({part}.frac) - char_length(d))"
    size = (
        f"case when d = '' then cast(0 as {_BIG}) when p > 19 then cast({LONG_MAX} as {_BIG}) "
        f"when p <= 0 then cast(1 as {_BIG}) "
        f"else cast(rpad(substring(d, 1, cast(p as int)), cast(p as int), '0') as {_BIG}) "
        f"+ if(ltrim('0', substring(d, cast(p as int) + 1)) = '', 0, 1) end"
    )
    return _let(digits, "d", _let(point, "p", size))


def _binary(part: str) -> str:
    """The whole part times the unit, and the fraction times the unit by long multiplication from its last digit."""
    unit = f"element_at({map_sql({s: 1024**p for s, p in BINARY_SUFFIXES.items()}, 'decimal(20,0)')}, {part}.suffix)"
    product = f"cast(u * cast(substring({part}.frac, i, 1) as decimal(1,0)) + a.carry as decimal(22,0))"
    step = f"struct(cast(floor({product} / 10) as decimal(22,0)) as carry, a.rest or {product} % 10 > 0 as rest)"
    last = "cast(a.carry as decimal(38,0)) + if(a.rest, 1, 0)"
    start = "struct(cast(0 as decimal(22,0)) as carry, false as rest)"
    places = f"if({part}.frac = '', array(), sequence(char_length({part}.frac), 1, -1))"
    ceiling = f"aggregate({places}, {start}, (a, i) -> {step}, a -> {last})"
    whole = f"ltrim('0', {part}.whole)"
    size = (
        f"case when char_length(d) > 19 then cast({LONG_MAX} as {_BIG}) "
        f"else cast(cast(concat('0', d) as decimal(19,0)) * cast(u as decimal(19,0)) as {_BIG}) + {ceiling} end"
    )
    return _let(unit, "u", _let(whole, "d", size))


def quantity_sql(s: str) -> str:
    """SQL for the bytes of the quantity named ``s``."""
    group = [f"regexp_extract({s}, r'{PATTERN}', {g})" for g in range(5)]
    part = f"struct({group[1]} as sign, {group[2]} as whole, {group[3]} as frac, {group[4]} as suffix)"
    units = ", ".join(f"'{u}'" for u in BINARY_SUFFIXES)
    size = f"if(q.suffix in ({units}), {_binary('q')}, {_decimal('q')})"
    signed = f"if(q.sign = '-', -1, 1) * cast(least({size}, cast({LONG_MAX} as {_BIG})) as bigint)"
    return f"case when {s} rlike r'{PATTERN}' then {_let(part, 'q', signed)} end"


def parse_quantity(text: Column) -> Column:
    """Whole bytes of a quantity, fractions rounded away from zero, null when the text is not a quantity.

    Values beyond the range of a 64-bit integer are held at its limit. All arithmetic is exact, over all digits.
    """
    return F.get(F.call_function("transform", F.array(text), F.expr(f"s -> {quantity_sql('s')}")), F.lit(0))
