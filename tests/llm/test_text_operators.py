"""Decontamination, SimHash, line dedup, license scans and personal data against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, find, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballast.llm import components, decontamination, licenses, lines, pii, queries, simhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def edge_texts():
    rng = random.Random(5)
    prose = [" ".join(rng.choice("alpha beta gamma delta Été ÜBER o x9".split()) for _ in range(60)) for _ in range(8)]
    return [None, "", " \n\t ", "x", "É", *prose, prose[0], prose[0].upper(), prose[1] + " tail", "\n".join(prose), "long " * 30000]


@pytest.fixture(scope="module")
def edge_docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(edge_texts())] + [(None, "alpha beta"), (3, "x"), (3, "y")], SCHEMA)


# --- decontamination --------------------------------------------------------------------------------------------------


def brute_contamination(texts, items, window=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                got = patterns.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if got:
                    found |= got
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(12)] + ["Ä1", "b" * 70]
    make = lambda n: " ".join(rng.choice(voc) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 9, 10, 14, 30]))) for i in range(25)] + [(7, "w1 w2 w3"), (30, None), (31, "")]
    texts = [make(rng.choice([0, 1, 5, 200])) + " ".join(x[1] or "" for x in rng.sample(items, 3)) for _ in range(60)]
    texts += [None, "", "-- ,", "plain words only here", items[3][1].upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.decontaminate(docs, bench, block_bytes=block_bytes).orderBy("doc_id").collect()
    want = brute_contamination(texts, items)
    assert [(r.n_words, r.n_hit, r.item_ids) for r in got] == want
    for r in got:
        assert sum(b - a for a, b in zip(r.hit_spans[0::2], r.hit_spans[1::2])) == r.n_hit


def test_long_items_are_cut_into_overlapping_parts(spark):
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(rng.choices(voc, k=57))), (2, "w1 W2"), (3, None), (4, " ".join(rng.choices(voc, k=10)))]
    rows = spark.createDataFrame(items, "item string, body string")
    parts = [r.body.split() for r in decontamination.item_parts(rows, part_words=7).where("item = 1").collect()]
    assert max(map(len, parts)) <= 16
    own = items[0][1].split()
    assert sorted(tuple(p[i : i + 10]) for p in parts for i in range(len(p) - 9)) == sorted(
        tuple(own[i : i + 10]) for i in range(48)
    )
    others = decontamination.item_parts(rows, part_words=7).where("item <> 1").orderBy("item")
    assert [tuple(r) for r in others.collect()] == [("2", "w1 w2"), ("4", items[3][1])]


def test_pattern_index_takes_equal_windows_once():
    bodies = [" ".join(f"x{i}" for i in range(30)), " ".join(f"x{i}" for i in range(5, 40)), "x1", "x1"]
    long = {p.length: p for p in decontamination.patterns_of(bodies, 10)}
    assert sorted(long) == [1, 10]
    assert len(long[10].place) == 31 and len(long[10].item) == 21 + 26
    assert long[1].items_of(np.array([0])).tolist() == [2, 3]


def test_decontamination_edges(spark, edge_docs):
    bench = spark.createDataFrame([(None, "alpha beta"), (1, "gamma delta")], "item_id bigint, text string")
    extra = edge_docs.withColumn("n_hit", F.lit("clash")).withColumn("other", F.lit(1))
    out = decontamination.decontaminate(extra, bench)
    assert out.columns == ["doc_id", "text", "other", "n_words", "n_hit", "hit_spans", "item_ids"]
    assert out.count() == edge_docs.count()
    assert out.where("doc_id is null").first().item_ids == []
    assert decontamination.decontaminate(edge_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.decontaminate(edge_docs.limit(0), bench).count() == 0


# --- SimHash ----------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, bits=3):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[root(i)] = min(x, least.get(root(i), x))
    return [least.get(root(i)) for i in range(len(ids))]


def test_fingerprints_and_components(spark, edge_docs):
    rows = edge_docs.collect()
    got = simhash.near_duplicates(edge_docs).collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], [f"{p:016x}" for p in prints], brute_components([r.doc_id for r in rows], prints)), key=str)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert simhash.near_duplicates(edge_docs.limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [8192, 24])
def test_links_connect_as_brute_force(spark, group_rows):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base:
        for _ in range(rng.randrange(12)):
            for _ in range(rng.randrange(1, 5)):
                b ^= 1 << rng.randrange(64)
            prints.add(b)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), group_rows=group_rows))
    root = {s: s for s in signed} | {r.node: r.root for r in found.collect()}
    want = brute_components(list(range(len(prints))), prints)
    groups = lambda labels: sorted(sorted(i for i in range(len(labels)) if labels[i] == x) for x in set(labels))
    assert groups([root[s] for s in signed]) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(None, 5), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 300)}


# --- lines ------------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(UPPER)
    split = [(d, (t or "").split("\n")) for d, t in rows]
    holders = {}
    for d, own in split:
        for line in own:
            if d is not None and len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(d)
    out = []
    for d, own in split:
        keep = [x for x in own if d is None or len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == d]
        out.append((d, len(own), len(own) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize("batches,fanout", [(6, 3), (1, 3), (5, 2)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rng = random.Random(1)
    pool = [f"Line number {i} with enough characters É" for i in range(30)] + ["short", "", "  " + "x" * 20 + "\t", "ÉÉ" * 10, "éé" * 10]
    vary = lambda x: rng.choice([x, f" {x}\t", x.upper() if x.isascii() else x])
    rows = [(i, "\n".join(vary(rng.choice(pool)) for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    rows += [(None, rows[0][1]), (5, rows[7][1]), (5, rows[5][1]), (200, None), (201, ""), (202, "\n\n")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_lines", F.lit("clash"))
    got = lines.dedup_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    have = sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str)
    assert have == sorted(brute_lines(rows), key=str)
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# --- licenses ---------------------------------------------------------------------------------------------------------


def brute_base(text):
    w = words(text)
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = sorted(i for i, _ in places)
    return len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


def test_base_phrases_equal_brute_force(spark):
    rng = random.Random(2)
    voc = "cc by CC-BY general public license All rights reserved sa é byx xcc GENERAL, Public; LICENSE 4 ccKby KKby".split()
    texts = [" ".join(rng.choice(voc) for _ in range(rng.randrange(40))) for _ in range(200)] + edge_texts() + ["cc\nby", "cc by"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [brute_base(t) for t in texts]
    for r in got:
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def brute_detections(text):
    """Every rule without gates; a match stays unless a single other one of no larger rank holds it, all pairs compared."""
    body = f" {' '.join(WORD.findall((text or '').lower()))} "
    hits = []
    for rank, (label, pattern, _, _, weight) in enumerate(licenses.rules()):
        hits += [(m.start(), m.end(), rank, label, weight) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", body)]
    kept = [
        h for h in hits
        if not any(o is not h and o[0] <= h[0] and o[1] >= h[1] and o[2] <= h[2] for o in hits)
    ]
    return sorted(kept, key=lambda h: (h[0], -h[1], h[2]))


def test_texts_of_many_mentions(spark):
    """More detections than are gathered at a time, nested and not, in one text."""
    rng = random.Random(21)
    pieces = ["mit license", "licensed under the apache license version 2.0", "copyright 2019", "public domain", "copyleft", "word"]
    texts = [" ".join(rng.choice(pieces) for _ in range(n)) for n in (licenses.RUN, licenses.RUN + 1, 700)]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [[tuple(d) for d in r.detections] for r in got] == [brute_detections(t) for t in texts]
    assert len(got[2].detections) > 3 * licenses.RUN


def test_detections_equal_all_rules_without_gates(spark):
    rng = random.Random(4)
    pieces = [
        "Licensed under the Apache License, Version 2.0", "MIT License", "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License v2", "released under the terms of the Mozilla Public License 2.0", "public domain",
        "Copyright (c) 2019 2020 Foo", "All rights reserved", "CC-BY-NC-SA license", "plain prose", "license", "BSD 3-Clause License",
        "without warranty of any kind", "Redistribution and use in source", "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ]
    texts = [rng.choice([" ", ". ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(150)]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [[tuple(d) for d in r.detections] for r in got] == [brute_detections(t) for t in texts]
    assert len(licenses.rules()) > 200
    assert all(any(g in pattern for g in licenses.GATE) for _, pattern, _, _, _ in licenses.rules())


@settings(max_examples=400, deadline=None, database=None, suppress_health_check=list(HealthCheck))
@given(st.sampled_from(licenses.rules()).flatmap(lambda r: st.tuples(st.just(r), st.from_regex(r[1], fullmatch=True))))
def test_matches_hold_what_their_rule_is_gated_by(case):
    (_, _, word, keys, _), match = case
    assert word in match and any(k in match for k in keys) and any(g in match for g in licenses.GATE)


NOTICED = [
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl,gpl-3.0-or-later"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal with the Software without restriction", "ncsa"),
    ("Linking this library statically or dynamically with other modules is making a combined work based on this library. Thus, the terms", "classpath-exception"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa-4.0"),
    ("https://creativecommons.org/licenses/by-sa/4.0", "cc-by-sa"),
    ("This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself", "perl"),
    ("Reprinted with kind permission.", "with-permission"),
]


def test_notices_hold_their_shorter_mentions(spark):
    """A notice is one detection: the mentions inside it are suppressed. The base phrase of the second stays a label."""
    texts = [f"before\n{t} after" for t, _ in NOTICED]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [labels for _, labels in NOTICED]
    assert [[tuple(d) for d in r.detections] for r in got] == [brute_detections(t) for t in texts]
    assert all(len(r.detections) == 1 for r in got)


def test_detections_of_any_rules_matches(spark):
    """Texts made of matches of all rules, some cut short, against all rules without gates."""
    rng = random.Random(31)
    made = [find(st.from_regex(r[1], fullmatch=True), lambda _: True) for r in licenses.rules()]
    parts = made + [" ".join(m.split()[: len(m.split()) // 2]) for m in made]
    rng.shuffle(parts)
    texts = [" ".join(parts[i : i + 3]) for i in range(0, len(parts), 3)]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [[tuple(d) for d in r.detections] for r in got] == [brute_detections(t) for t in texts]


def test_detections_stay_unless_a_single_better_one_holds_them(spark):
    """All pairs of hits compared."""
    rng = random.Random(12)
    pieces = [
        "unauthorized use", "under", "mit license", "or", "gpl license", "prohibited", "copyleft", "released", "into the public domain",
        "licensed under the apache license version 2.0", "copyright 2019", "all rights reserved", "gnu general public license v2", "public domain",
    ]
    texts = ["unauthorized use under mit license or gpl license prohibited"]
    texts += [" ".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(200)]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert "gpl" in got[0].labels.split(",") and "mit" in got[0].labels.split(",")
    for r, text in zip(got, texts):
        body, hits = f" {' '.join(WORD.findall(text))} ", []
        for rank, (label, pattern, _, _, weight) in enumerate(licenses.rules()):
            hits += [(m.start(), m.end(), rank, label, weight) for m in re.finditer(f"(?<= )(?:{pattern})(?= )", body)]
        held = lambda h: any(k != h and k[0] <= h[0] and k[1] >= h[1] and k[2] <= h[2] for k in hits)  # noqa: B023, E731
        assert sorted(tuple(d) for d in r.detections) == sorted(h for h in hits if not held(h)), text


INTERNAL = ("own", "doc", "tag", "lines", "lost", "lost_doc", "id", "y", "raw", "model", "stats", "body", "_row", "_words", "_body", "_low", "key")


@pytest.mark.parametrize("operator", [licenses.scan_licenses, lines.dedup_lines, decontamination.item_parts])
def test_columns_with_internal_names_come_back(spark, operator):
    if operator is decontamination.item_parts:
        operator = lambda d: decontamination.decontaminate(d, spark.createDataFrame([(1, "gamma")], "item_id int, text string"))
    docs = spark.createDataFrame([(1, "mit license gamma"), (2, "other")], SCHEMA)
    got = operator(docs.withColumns({n: F.concat(F.lit(f"{n} "), "doc_id") for n in INTERNAL})).collect()
    assert len(got) == 2 and all(r[n] == f"{n} {r.doc_id}" for r in got for n in INTERNAL)


def test_lines_with_ids_of_strings(spark):
    rng = random.Random(8)
    pool = [f"a line that is long enough, number {i}" for i in range(12)]
    texts = ["\n".join(rng.choices(pool, k=4)) for _ in range(40)]
    numbers = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    names = numbers.withColumn("doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit(" é")))
    got = lines.dedup_lines(names, batches=4).orderBy("doc_id").collect()
    want = lines.dedup_lines(numbers, batches=4).orderBy("doc_id").collect()
    assert [(r.text, r.n_dropped) for r in got] == [(r.text, r.n_dropped) for r in want]


def test_license_edges(spark, edge_docs):
    out = licenses.scan_licenses(edge_docs.withColumn("score", F.lit("clash")).withColumn("other", F.lit(1)))
    assert out.columns[:3] == ["doc_id", "text", "other"] and dict(out.dtypes)["score"] == "double"
    assert out.count() == edge_docs.count()
    assert out.where("labels <> ''").count() == 0
    assert licenses.scan_licenses(edge_docs.limit(0)).count() == 0


# --- personal data ----------------------------------------------------------------------------------------------------


def brute_personal(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    pool = ["a.b@c.de", "@", "x@y", "1.2.3.4", "255.300.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0143", "+", " ", "é", "00010.1.2.3", "a@b.c@d.e", "7", ".", "-", "\n"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(14))) for _ in range(3000)] + edge_texts()
    for t in texts:
        assert pii.base_spans(t or "") == brute_personal(t), t
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for r, t in zip(pii.find_personal_data(docs).orderBy("doc_id").collect(), texts):
        base, found = [tuple(s) for s in r.base], [tuple(s) for s in r.found]
        assert base == brute_personal(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert set(base) <= set(found) and found == sorted(found, key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        more = [s for s in found if s not in base]
        assert all(a[2] <= b[1] or b[2] <= a[1] for a in more for b in found if a is not b)


def test_field_finds_what_patterns_miss(spark):
    texts = ["call 212-555-0199 after 5", "paid with 5105-1051-0510-5100 on 01/02", "in 1999 there were 12 of 30 left", "write to bob(at)home.example by 9"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = [[texts[r.doc_id][s.start : s.end] for s in r.found] for r in pii.find_personal_data(docs).orderBy("doc_id").collect()]
    assert got == [["212-555-0199"], ["5105-1051-0510-5100"], [], ["bob(at)home.example"]]


def test_field_sees_every_line_a_span_can_come_from(monkeypatch):
    """Each labelled span is found on a line of its own, and leaving lines out changes nothing."""
    field = pii.train([pii.tokens_and_labels(line) for line in pii.LINES.strip().split("\n")])
    found = lambda text: [(k, text[a:b]) for k, a, b in pii.find_spans(field, [text])[0][1]]
    for line in pii.LINES.strip().split("\n"):
        text = re.sub(r"\[\w+ ([^\]]*)\]", r"\1", line)
        for kind, span in re.findall(r"\[(\w+) ([^\]]*)\]", line):
            assert any(k == kind and s.strip("<>") in span for k, s in found(text)), line
    assert found("my address is ben(at)work.example thanks") == [("email", "ben(at)work.example")]
    assert found("write to bob(at)home.example") == [("email", "bob(at)home.example")]
    assert found("ping dead:beef::cafe failed") == [("ip", "dead:beef::cafe")]
    assert found("ping abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd failed") == [("ip", "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd")]
    rng = random.Random(8)
    pool = ["dead:beef::cafe", "a::b", "::", "abcd:" * 7 + "f", "x(at)y.example", "(", "@", "7", "555-0199", "see", "std::x", ":", "\n", "\n"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(20))) for _ in range(500)]
    some = pii.find_spans(field, texts)
    monkeypatch.setattr(pii, "candidate_lines", lambda text: [m.span() for m in re.finditer(r"[^\n]+", text)])
    assert pii.find_spans(field, texts) == some


def test_features_are_those_of_the_whole_token():
    path = "https://Ab.c1/" * 5
    for token in (f"{path}bob@host42", f"{path}call=555-0199", "1" * 30 + "@", "x" * 60 + "9"):
        got, bare = set(pii.features_of(pii.shape_of(token))), "".join(c for c in token if not c.isalnum())
        assert {f"has{c}" for c in bare} == {f for f in got if f.startswith("has")}
        assert {f"many{c}{min(token.count(c), 4)}" for c in "@.:-" if c in token} == {f for f in got if f.startswith("many")}
        digits, letters = sum(c.isdigit() for c in token), sum(c.isalpha() for c in token)
        last = "0" if token[-1].isdigit() else token[-1]
        assert {f"d={min(digits, 6)}", f"l={min(letters, 3)}", "n=6", f"last={last}"} <= got


def test_viterbi_equals_brute_force():
    import itertools

    import numpy as np

    field = pii.train([pii.tokens_and_labels(line) for line in pii.LINES.strip().split("\n")])
    shapes = [pii.shape_of(t) for t in "call +1 (212) 555-0143".split()]
    emit, k = field.emissions(shapes), len(pii.LABELS)

    def score(path):
        return pii._start()[path[0]] + emit[0, path[0]] + sum(field.step[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:])))

    best = max(itertools.product(range(k), repeat=len(shapes)), key=score)
    lines_ = [shapes, shapes[:1], [], shapes * 3]
    got = field.decode(lines_)
    assert tuple(got[0]) == best and [len(g) for g in got] == [len(x) for x in lines_]
    assert np.array_equal(field.decode([shapes])[0], got[0])


# --- registered queries -----------------------------------------------------------------------------------------------


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()


def test_op2_over_the_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    prints = [brute_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    got = queries.op2_simhash(spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(zip(ids, [f"{p:016x}" for p in prints], brute_components(ids, prints)))


def test_op7_over_the_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = queries.op7_licenses(spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [brute_base(r.text) for r in rows]
    assert [r.labels for r in got] == [
        ",".join(sorted({*filter(None, brute_base(r.text)[4].split(",")), *(d[3] for d in brute_detections(r.text))})) for r in rows
    ]


def test_op10_over_the_table(spark, sf_dir):
    rows = documents(spark, sf_dir)
    got = queries.op10_personal_data(spark, sf_dir).orderBy("doc_id").collect()
    for r, doc in zip(got, rows):
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_personal(doc.text))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


