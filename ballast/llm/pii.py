"""Personal data by fixed patterns and a linear-chain conditional random field.

Four kinds have patterns of their own, which always count: e-mail and IP addresses, card and phone numbers. The field
adds spans that they miss: spelled or grouped in another way. It runs over the tokens (between blanks) of every line
that a span can come from: those with a digit, ``@``, ``(`` or the colons of an IPv6 address in letters, as no span
counts without one of them (``NEEDS``, ``_plausible``). Its features are the shapes of words, of their neighbours and of
their ends: capitals, small letters and digits by class, everything else as it stands. It is trained on a small
labelled table, ``labelled_lines``, and decoded by Viterbi's algorithm in numpy, many lines at a time. A decoded span
counts where it touches no pattern's span and holds what its kind cannot lack.

Tokens with equal shapes share their scores, which are looked up once for each shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ballast.llm.texts import annotate

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
PAD = "\x00"
STEPS = 150
RIDGE = 1e-3
CHUNK_CELLS = 1 << 17

# The patterns of the four kinds. Possessive marks and lookbehinds only save time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

RESULT = StructType(
    [
        *[StructField(f"n_{k}", LongType()) for k in KINDS],
        StructField(
            "base",
            ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])),
        ),
        StructField(
            "found",
            ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])),
        ),
    ]
)

# A labelled line marks its spans as [kind text]. Names and numbers are invented.
LINES = """
write to [email anna.berg@mail.example] before noon
mail [email j_smith+news@post.example.org] or call [phone +44 20 7946 0018]
my address is [email ben(at)work.example] thanks
reach me: [email li.wei@@corp.example.cn]
send it to [email <ops@site.example>] please
Contact [email m.rossi@posta-example] for 3 copies
sender [email kurt@host42] wrote 5 lines
login from [ip 10.0.0.7] at 09:15
host [ip 192.168.1.254:8080] refused 3 times
the server [ip fe80::1ff:fe23:4567:890a] answered in 20 ms
ping [ip 2001:db8::8a2e:370:7334] failed
address [ip 10-20-30-40] was blocked
gateway [ip 172.16.254.1/24] is up
paid with [card 4111 1111 1111 1111] on 12/05
card no. [card 5500-0000-0000-0004] expires 09/27
card [card 4012.8888.8888.1881] was declined
charged [card 4222_2222_2222_2224] twice
number [card 3782 822463 10005] is valid
call [phone +1 (212) 555-0143] after 5
phone [phone (415) 555-0178] or fax
tel [phone 555-0199] ext 12
ring [phone 030/901820] today
my number is [phone 212-555-0187] okay
call [phone 0049 30 901820] at 8
mobile [phone 07700 900461] any time
phone [phone 001-415-555-0132] now
Fax: [phone 212.555.0165] only
it costs 25 dollars and 99 cents
chapter 3 verse 16 of book 2
in 1999 there were 12 of 30 left
version 3.11 and 2.7.18 were out
the ratio is 3.14159 or 22/7
order 20240117 shipped on 2024-01-17
from 10:30 to 12:45 on 05.06.2021
room 204 on floor 2 is open
see section 4.2.1 and table 7
about 1,000,000 people in 50 states
token = "8b540ef2c226668020056c2469" was set
id 550e8400e29b41d4a716446655440000 of 7
sha a94a8fe5ccb19ba61c4c0873d391e987982fbbd3 in 1 file
isbn 978-3-16-148410-0 in print
won 3-2 and lost 1-4 in 2010
users @home and @work met at 9
look @ this 2 times
a 5 b 6 c 7 d 8
win64 and x86 and mp3 and h264 files
50% of 200 is 100
$19.99 or EUR 20
8 | 15 | 16 | 23 | 42
1. first 2. second 3. third
the 2nd and 3rd of May 1984
population 83,019,213 as of 2019
lat 52.5200 lon 13.4050 alt 34
pages 120-135 and 200-210
"""


def labelled_lines(spark: SparkSession) -> DataFrame:
    """(line, tokens, labels): the labelled table, a row for each line."""
    rows = [(i, *tokens_and_labels(line)) for i, line in enumerate(LINES.strip().split("\n"))]
    return spark.createDataFrame(rows, "line int, tokens array<string>, labels array<string>")


def tokens_and_labels(line: str) -> tuple[list[str], list[str]]:
    tokens, labels = [], []
    for part in re.findall(r"\[\w+ [^\]]*\]|[^\s\[]+", line):
        marked = re.fullmatch(r"\[(\w+) (.*)\]", part)
        own = (marked[2] if marked else part).split()
        tokens += own
        labels += [f"{'B' if i == 0 else 'I'}-{marked[1]}" for i in range(len(own))] if marked else ["O"] * len(own)
    return tokens, labels


# --- shapes and features ----------------------------------------------------------------------------------------------

_CLASS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "X" * 26 + "x" * 26 + "0" * 10)
_RUN = re.compile(r"(.)\1{4,}")
_HEX = re.compile(r"[0-9a-fA-F:]+")
MAX_SHAPE = 48


def shape_of(token: str) -> str:
    """The token by classes of characters, as its features, one to a line.

    Counts, marks and ends are those of the whole token. In the shape as a feature by itself, runs longer than four are
    written as five, as in ``00000``, and what goes beyond ``MAX_SHAPE`` characters is cut, so that the number of shapes
    stays small."""
    whole = "".join("x" if ord(c) > 127 else c for c in token.translate(_CLASS))
    if ":" in token and _HEX.fullmatch(token):
        whole = "h" * min(token.count(":"), 5) + ":"
    shape = _RUN.sub(lambda m: m[1] * 5, whole)
    digits, letters = whole.count("0"), whole.count("x") + whole.count("X")
    out = [f"s={shape if len(shape) <= MAX_SHAPE else f'{shape[:MAX_SHAPE]}~'}", f"c={coarse(shape)}"]
    out += [f"d={min(digits, 6)}", f"l={min(letters, 3)}", f"n={min(len(whole), 12) // 2}"]
    out += [f"has{c}" for c in sorted({c for c in whole if c not in "xX0"})]
    out += [f"many{c}{min(whole.count(c), 4)}" for c in "@.:-" if c in whole]
    return "\n".join([*out, f"first={whole[0]}", f"last={whole[-1]}"])


def coarse(shape: str) -> str:
    """The shape with every run as one character, at most eight of them."""
    return re.sub(r"(.)\1+", r"\1", shape)[:8]


def features_of(shape: str) -> list[str]:
    return ["edge"] if shape == PAD else shape.split("\n")


class Field:
    """Weights of a trained field, and scores of shapes by them."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, near: np.ndarray, step: np.ndarray):
        """``emit``: by feature of the token; ``near``: by feature of the token before (0) and after (1)."""
        self.index, self.emit, self.near = index, emit, near
        self.step = step + _forbidden()
        self.cache: dict[str, tuple[np.ndarray, ...]] = {}

    def scores(self, shape: str) -> tuple[np.ndarray, ...]:
        """Scores for the labels of the token itself, of the one after and of the one before."""
        got = self.cache.get(shape)
        if got is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            own = [self.index[f] for f in features_of(shape) if f in self.index]
            got = self.cache[shape] = (self.emit[own].sum(axis=0), self.near[0, own].sum(axis=0), self.near[1, own].sum(axis=0))
        return got

    def emissions(self, shapes: list[str]) -> np.ndarray:
        kinds = {s: i for i, s in enumerate(dict.fromkeys([PAD, *shapes]))}
        own, after, before = (np.stack(x) for x in zip(*[self.scores(s) for s in kinds]))
        at = np.array([0, *[kinds[s] for s in shapes], 0])
        return own[at[1:-1]] + after[at[:-2]] + before[at[2:]]

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The likeliest labels of each line of shapes. Lines of like length are decoded side by side."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(lines[order[end]]) <= CHUNK_CELLS:
                end += 1
            self._decode(lines, order[at:end], out)
            at = end
        return out

    def _decode(self, lines: list[list[str]], some: list[int], out: list[np.ndarray]) -> None:
        size = np.array([len(lines[i]) for i in some])
        longest = int(size.max(initial=0))
        if not longest:
            return
        flat = self.emissions([s for i in some for s in [*lines[i], PAD]])
        emit = np.zeros((len(some), longest, len(LABELS)))
        begin = np.cumsum(size + 1) - (size + 1)
        for j, (b, n) in enumerate(zip(begin, size)):
            emit[j, :n] = flat[b : b + n]
        score = emit[:, 0] + _start()
        back = np.zeros((longest, len(some), len(LABELS)), dtype=np.int8)
        for t in range(1, longest):
            through = score[:, :, None] + self.step
            back[t] = through.argmax(axis=1)
            live = (t < size)[:, None]
            score = np.where(live, through.max(axis=1) + emit[:, t], score)
        label = score.argmax(axis=1)
        rows = np.arange(len(some))
        path = np.zeros((len(some), longest), dtype=np.int64)
        for t in range(longest - 1, -1, -1):
            path[:, t] = label
            if t:
                label = np.where(t < size, back[t, rows, label], label)
        for j, i in enumerate(some):
            out[i] = path[j, : size[j]]


def _forbidden() -> np.ndarray:
    """Minus infinity, nearly, for an inside label behind anything but its own kind."""
    bad = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to.startswith("I-"):
            for i, label in enumerate(LABELS):
                if label[2:] != to[2:] or label == "O":
                    bad[i, j] = -1e9
    return bad


def _start() -> np.ndarray:
    return np.array([-1e9 if label.startswith("I-") else 0.0 for label in LABELS])


def train(lines: Iterable[tuple[list[str], list[str]]]) -> Field:
    """Maximise the lines' conditional likelihood by gradient steps over all lines, by forward and backward sums."""
    data = [([shape_of(t) for t in tokens], [LABELS.index(y) for y in labels]) for tokens, labels in lines if tokens]
    index: dict[str, int] = {}
    for shapes, _ in data:
        for s in [PAD, *shapes]:
            for f in features_of(s):
                index.setdefault(f, len(index))
    k, n, m = len(LABELS), len(index), max((len(s) for s, _ in data), default=1)
    size = np.array([len(s) for s, _ in data])
    x = np.zeros((len(data), m + 2, n), dtype=np.float32)
    gold = np.zeros((len(data), m), dtype=np.int64)
    for i, (shapes, labels) in enumerate(data):
        for t, s in enumerate([PAD, *shapes, PAD]):
            x[i, t, [index[f] for f in features_of(s)]] = 1
        gold[i, : len(labels)] = labels
    live = np.arange(m) < size[:, None]
    three = np.concatenate([x[:, 1:-1], x[:, :-2], x[:, 2:]], axis=2) * live[:, :, None]
    one = np.eye(k)[gold] * live[:, :, None]
    pairs = np.einsum("btk,btl->kl", one[:, :-1], one[:, 1:])
    w, step = np.zeros((3 * n, k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
    for it in range(1, STEPS + 1):
        emit = three @ w.astype(np.float32)
        trans = step + _forbidden()
        forward = np.full((len(data), m, k), -1e9)
        backward = np.zeros((len(data), m, k))
        forward[:, 0] = emit[:, 0] + _start()
        for t in range(1, m):
            forward[:, t] = emit[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + trans, axis=1)
        for t in range(m - 2, -1, -1):
            ahead = np.logaddexp.reduce(trans + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where((t + 1 < size)[:, None], ahead, 0.0)
        total = np.logaddexp.reduce(forward[np.arange(len(data)), size - 1], axis=1)
        chance = np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        expected = np.zeros((k, k))
        for t in range(1, m):
            both = forward[:, t - 1, :, None] + trans + (emit[:, t] + backward[:, t])[:, None, :] - total[:, None, None]
            expected += (np.exp(both) * live[:, t, None, None]).sum(axis=0)
        grad_w = np.einsum("btf,btk->fk", three, one - chance) / len(data) - 2 * RIDGE * w
        grad_s = (pairs - expected) / len(data) - 2 * RIDGE * step
        for g, a, b in ((grad_w, 0, 1), (grad_s, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
        rate = 0.1 * np.sqrt(1 - 0.99**it) / (1 - 0.9**it)
        w = w + rate * moments[0] / (np.sqrt(moments[1]) + 1e-8)
        step = step + rate * moments[2] / (np.sqrt(moments[3]) + 1e-8)
    return Field(index, w[:n], np.stack([w[n : 2 * n], w[2 * n :]]), step)


# --- patterns ---------------------------------------------------------------------------------------------------------


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches from one at sign to the next: a run of local characters, the sign, two or more labels."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        got = DOMAIN.match(text, at + 1) if begin < at else None
        if got:
            out.append((begin, got.end()))
            free = got.end()
        else:
            free = max(free, at)
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- the operator -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_ENDS = "\"'<>()[]{},;:!?.*&$%#"
# Digits and one of the marks that a kind cannot lack; an IPv6 address needs no digits.
NEEDS = {"email": (0, "@("), "ip": (4, ".:-"), "card": (12, ""), "phone": (6, "")}
# Some of it is in every plausible span: a kind without digits has its marks here, and letters alone need '::' or
# seven colons to be an IPv6 address.
_WANTED = re.compile(r"[0-9@(]|:[A-Fa-f]*:")


def candidate_lines(text: str) -> list[tuple[int, int]]:
    """Lines that hold what any plausible span holds."""
    out, at = [], 0
    while got := _WANTED.search(text, at):
        begin = text.rfind("\n", at, got.start()) + 1 or at
        end = text.find("\n", got.end())
        end = len(text) if end < 0 else end
        out.append((begin, end))
        at = end + 1
    return out


def _trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    while begin < end and text[begin] in _ENDS and not (text[begin] == "(" and ")" in text[begin:end]):
        begin += 1
    while end > begin and text[end - 1] in _ENDS:
        end -= 1
    return begin, end


def _ipv6(text: str) -> bool:
    try:
        return text.isascii() and bool(IPv6Address(text.partition("/")[0]))
    except AddressValueError:
        return False


def _plausible(kind: str, text: str) -> bool:
    digits, marks = NEEDS[kind]
    return len(_digits(text)) >= digits and (not marks or any(m in text for m in marks)) or kind == "ip" and _ipv6(text)


def find_spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """For each text the patterns' spans and, by kind and start, these and the field's."""
    lines, places, owner = [], [], []
    for i, text in enumerate(texts):
        for begin, end in candidate_lines(text):
            own = [m.span() for m in _TOKEN.finditer(text, begin, end)]
            lines.append([shape_of(text[a:b]) for a, b in own])
            places.append(own)
            owner.append(i)
    added: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for labels, own, i in zip(field.decode(lines), places, owner):
        n = len(own)
        for t in np.flatnonzero(labels % 2).tolist():  # odd labels begin a span
            last = t
            while last + 1 < n and labels[last + 1] == labels[t] + 1:
                last += 1
            kind = LABELS[labels[t]][2:]
            begin, end = _trimmed(texts[i], own[t][0], own[last][1])
            if _plausible(kind, texts[i][begin:end]):
                added[i].append((kind, begin, end))
    out = []
    for text, more in zip(texts, added):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken])
        ends = np.maximum.accumulate(np.array([b for _, b in taken])) if taken else starts
        free = []
        for kind, a, b in more:
            before = int(np.searchsorted(starts, b, "left"))
            if not before or ends[before - 1] <= a:
                free.append((kind, a, b))
        out.append((base, sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base`` (the patterns' spans) and ``found`` (all spans).

    Spans are structs of kind, start and end in code points, the end left out, sorted by kind as listed and start. The
    field's spans overlap no pattern's and none of its own. A null or empty text has none.
    """
    spark = docs.sparkSession
    rows = labelled_lines(spark).orderBy("line").collect()
    trained = train([(r.tokens, r.labels) for r in rows])
    shared = spark.sparkContext.broadcast((trained.index, trained.emit, trained.near, trained.step))
    field: list[Field] = []

    def run(part: pa.RecordBatch) -> list[pa.Array]:
        if not field:
            field.append(Field(*shared.value))
        found = find_spans(field[0], pc.fill_null(part.column(text), "").to_pylist())
        counts = [[sum(1 for s in base if s[0] == k) for base, _ in found] for k in KINDS]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def column(which: int) -> pa.Array:
            return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[which]] for f in found], kind)

        return [*[pa.array(c, pa.int64()) for c in counts], column(0), column(1)]

    return annotate(docs, RESULT, text, run)
