"""Segmentation, token counts, classifiers, vector search and the pipeline."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ballast.llm import quality, queries, segmentation, token_counts, toxicity, vectors
from ballast.session import workspace

SCHEMA = "doc_id bigint, text string"


# --- segmentation -----------------------------------------------------------------------------------------------------


def all_segmentations(pieces, text):
    marked = "▁" + text.replace(" ", "▁")
    voc = {pieces.processor.id_to_piece(i): i for i in range(segmentation.FIRST_PIECE, pieces.processor.vocab_size())}

    def ways(at):
        if at == len(marked):
            yield (), 0.0
            return
        for end in range(at + 1, min(at + pieces.longest, len(marked)) + 1):
            i = voc.get(marked[at:end])
            if i is not None:
                for rest, weight in ways(end):
                    yield (i, *rest), weight + pieces.weight[i]

    found = dict(ways(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: v - total for k, v in found.items()}


def test_samples_follow_the_distribution():
    pieces = segmentation.pieces_of(segmentation.MODEL)
    text, n = "the cat sat", 3000
    want = all_segmentations(pieces, text)
    rows = segmentation.sample_slice(pieces, [text] * n, [str(i) for i in range(n)], 3, 1.0)
    first, weighted = {}, 0.0
    for own in rows:
        ids = [tuple(r[0].tolist()) for r in own]
        assert len(set(ids)) == 3 and all(abs(r[1] - want[i]) < 1e-9 for i, r in zip(ids, own))
        assert own[0][2] >= own[1][2] >= own[2][2]
        first[ids[0]] = first.get(ids[0], 0) + 1
        weighted += sum(math.exp(r[1]) / r[3] for r in own)
    for ids in sorted(want, key=want.get)[-4:]:
        p = math.exp(want[ids])
        assert abs(first.get(ids, 0) / n - p) < 4 * math.sqrt(p * (1 - p) / n)
    assert abs(weighted / n - 1) < 0.05  # inclusion probabilities make sums unbiased


def plain_samples(pieces, text, key, k):
    """The same draws, one text alone, every node that is left open weighed."""
    marked = "▁" + text.replace(" ", "▁")
    voc = {pieces.processor.id_to_piece(i): i for i in range(segmentation.FIRST_PIECE, pieces.processor.vocab_size())}
    arcs, rest = [[] for _ in marked], [0.0] * (len(marked) + 1)
    for at in reversed(range(len(marked))):
        for size in range(min(pieces.longest, len(marked) - at), 0, -1):
            i = voc.get(marked[at : at + size])
            if i is not None:
                arcs[at].append((size, (i,), pieces.weight[i] + rest[at + size]))
            elif size == 1:
                spelled = pieces.bytes[list(marked[at].encode())].tolist()
                arcs[at].append((1, tuple(spelled), len(spelled) * pieces.byte_weight + rest[at + 1]))
        rest[at] = np.logaddexp.reduce([a[2] for a in arcs[at]])

    def draw(seed, at, length):
        return float(segmentation._uniform(seed, np.array([at]), length)[0])

    nodes = [(-math.log(-math.log(draw(segmentation._seeds([key], -1), 0, 0))), 0.0, (), 0)]
    out = []
    while nodes and len(out) < k:
        best = max(nodes)
        nodes.remove(best)
        value, phi, ids, at = best
        seed = segmentation._seeds([key], len(out))
        while at < len(marked):
            u, below, taken = draw(seed, at, 0), 0.0, None
            for j, (_, _, score) in enumerate(arcs[at]):
                below += math.exp(score - rest[at])
                if taken is None and (u < below or j == len(arcs[at]) - 1):
                    taken = j
            for j, (size, own, score) in enumerate(arcs[at]):
                p = phi + score - rest[at]
                if j != taken:
                    g = p - math.log(math.exp(min(p - value, 700)) - math.log(draw(seed, at, size)))
                    nodes.append((g, p, ids + own, at + size))
            size, own, score = arcs[at][taken]
            phi, ids, at = phi + score - rest[at], ids + own, at + size
        out.append((ids, phi, value))
    return out


def test_samples_equal_a_plain_search_with_the_same_draws():
    pieces = segmentation.pieces_of(segmentation.MODEL)
    rng = np.random.default_rng(3)
    texts = ["a", " ", "naïve \U0001f600 ኣ\x00\n x  y", "word " * 60, "q" * 90, "".join(rng.choice(list("etaoin shrdlu,é."), 400))]
    assert len(texts[-1]) > 2 * segmentation.REACH  # most of its nodes are out of reach
    got = segmentation.sample_slice(pieces, ["", *texts, ""], [str(i) for i in range(len(texts) + 2)], 3, 1.0)
    assert [len(got[0]), len(got[-1])] == [1, 1]
    for i, text in enumerate(texts):
        want = plain_samples(pieces, text, str(i + 1), 3)
        assert [tuple(r[0].tolist()) for r in got[i + 1]] == [w[0] for w in want]
        assert np.allclose([r[1:3] for r in got[i + 1]], [w[1:] for w in want], rtol=1e-9, atol=1e-9)


def test_far_nodes_are_weighed_only_where_near_ones_are_too_few(monkeypatch):
    """The next sample of a long text leaves the one before near its beginning, so few of the nodes left open count."""
    pieces, rng = segmentation.pieces_of(segmentation.MODEL), np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(list("etaoinshrdlu"), 7)) for _ in range(300)) for _ in range(20)]
    weighed, siblings = [], segmentation._siblings

    def counted(*args):
        weighed.append(int(args[-1].sum()))
        return siblings(*args)

    monkeypatch.setattr(segmentation, "_siblings", counted)
    rows = segmentation.sample_slice(pieces, texts, [str(i) for i in range(20)], 2, 1.0)
    assert sum(weighed) < 0.5 * sum(len(r[0]) for own in rows for r in own)


def test_samples_decode_and_do_not_depend_on_neighbours(spark):
    texts = [None, "", "a", "  two  blanks\n\ttab ", "naïve \U0001f600 ኣ text\x00", "word " * 4000, "x" * 3000, "aa bb", "aa bb"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "aa bb")], SCHEMA).withColumn("ids", F.lit("clash"))
    out = segmentation.decode(segmentation.sample_encodings(docs, k=3)).collect()
    by_key = {}
    for r in out:
        assert r.text == ((texts[r.doc_id] if r.doc_id is not None else "aa bb") or "")
        assert 0 <= r.inclusion <= 1 and -math.inf < r.log_inclusion <= 0
        by_key.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert {k: len(v) for k, v in by_key.items()} == {0: 1, 1: 1, 2: 2, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 3, None: 3}
    assert all(len(set(v)) == len(v) for v in by_key.values())
    alone = segmentation.sample_encodings(docs.where("doc_id = 7"), k=3).orderBy("sample").collect()
    assert [tuple(r.ids) for r in alone] == by_key[7]
    assert segmentation.sample_encodings(docs.limit(0)).count() == 0


def test_spelling_equals_the_tokenizers_own_decoding():
    """Any ids at all, those of single bytes in order among them, not only ids of texts."""
    processor = segmentation.pieces_of(segmentation.MODEL).processor
    rng = np.random.default_rng(6)
    spoken = [i for i in range(processor.vocab_size()) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))]
    lists = [rng.choice(spoken, n).tolist() for n in (1, 2, 30, 0, 5, 200)]
    lists += [[processor.piece_to_id(p) for p in ps] for ps in (["▁"], ["▁", "▁", "a"], ["<0xF0>", "<0x9F>", "<0x98>", "<0x80>", "▁b"], ["a", "▁"])]
    flat = np.array([i for x in lists for i in x], dtype=np.int32)
    data, ends = segmentation.spelling_of(segmentation.MODEL).texts(flat, np.cumsum([len(x) for x in lists]))
    cuts = [0, *ends.tolist()]
    assert [data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])] == processor.decode(lists)
    none = segmentation.spelling_of(segmentation.MODEL).texts(np.zeros(0, np.int32), np.zeros(0, np.int64))
    assert [len(x) for x in none] == [0, 0]


def test_samples_are_decoded_where_they_are_drawn(spark):
    texts = [None, "", "a", "  two  blanks\n\ttab ", "naïve \U0001f600 ኣ text\x00", " ", "   ", "x" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("decoded", F.lit(1))
    rows = segmentation.sample_encodings(docs, k=3, decode_to=("decoded", "decoded_sha256")).collect()
    for r in rows:
        assert r.decoded == (texts[r.doc_id] or "")
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    with pytest.raises(ValueError, match="decode_to"):
        segmentation.sample_encodings(docs, decode_to=("text",))


def test_encode_and_decode_round_trip(spark):
    texts = [None, "", "Plain text.", " é\n\n x"]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    back = segmentation.decode(segmentation.encode(docs).drop("text")).orderBy("doc_id").collect()
    assert [r.text for r in back] == [t or "" for t in texts]


def test_op3_over_the_table(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = segmentation.decode(queries.op3_sentencepiece(spark, sf_dir)).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.text == docs[r.doc_id] for r in rows)


def test_op3_decodes_its_samples(spark, sf_dir):
    digest = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_sentencepiece(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(digest) and all(r.text_sha256 == digest[r.doc_id] for r in rows)


# --- token counts -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_tokens,file_tokens", [(1 << 20, 1 << 27), (7, 40)])
def test_token_counts_equal_direct_counts(spark, block_tokens, file_tokens):
    rng = random.Random(4)
    texts = [None, "", "one", "word " * 300, *[" ".join(rng.choice(["a", "Été", "12"]) for _ in range(rng.randrange(30))) for _ in range(30)]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "again here"), (None, "x")], SCHEMA).repartition(3)
    tokens = token_counts._tokenizer(token_counts.VOCABULARY)
    want = sorted([(i, len(tokens.encode_ordinary(t or ""))) for i, t in [*enumerate(texts), (2, "again here"), (None, "x")]], key=str)
    got = token_counts.document_tokens(docs, block_tokens=block_tokens, file_tokens=file_tokens).collect()
    assert sorted([(r.doc_id, r.n_tokens) for r in got], key=str) == want and all(r.ended for r in got)


def test_token_counts_edges(spark):
    docs = spark.createDataFrame([(1, "long " * 200000), (2, None)], SCHEMA)
    docs = docs.withColumns({n: F.lit("clash") for n in ("file", "ordinal", "first", "ended", "id")})
    got = {r.doc_id: r.n_tokens for r in token_counts.document_tokens(docs, block_tokens=1 << 12).collect()}
    assert got == {1: 200001, 2: 0}
    assert token_counts.document_tokens(docs.limit(0)).count() == 0


def test_separators_in_hand_made_files(spark, tmp_path):
    sep = token_counts.SEPARATOR
    files = {"a": [1, 2, sep, sep, 3, 4, 5, 6, 7, 8, 9, sep, 1], "b": [], "c": [sep], "d": [5] * 20, "e": [5, 5, 5, sep]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, dtype="<u2").tobytes())
    names = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "a"]], "file string")
    for block_tokens in (3, 4, 100):
        got = token_counts.count_tokens(names, str(tmp_path), block_tokens=block_tokens).collect()
        rows = sorted((r.file[-1], r.ordinal, r.first, r.n_tokens, r.ended) for r in got)
        assert rows == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 7, True), ("a", 3, 12, 1, False), ("c", 0, 0, 0, True), ("d", 0, 0, 20, False), ("e", 0, 0, 3, True)]


# --- vectors ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("query_batch,block_vectors", [(8192, 4096), (3, 16)])
def test_top_k_equals_brute_force(spark, query_batch, block_vectors):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(150)]
    rows += [(150, rows[3][1]), (151, rows[3][1]), (7, rows[9][1]), (160, None), (161, [1.0, None] * 3), (162, [float("nan")] * 6), (163, [float("inf")] * 6)]
    rows += [(164, [1.0, 2.0]), (165, [-1.0, 2.0]), (200, []), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    got = vectors.top_k(df.where("vec_id % 50 = 0 or vec_id = 164"), df, query_batch=query_batch, block_vectors=block_vectors).collect()
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0 or q == 164:
            ranked = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert vectors.top_k(df.limit(0), df).count() == 0 and vectors.top_k(df, df.limit(0)).count() == 0


# --- classifiers ------------------------------------------------------------------------------------------------------


def held_out_auc(rows, labels):
    pairs = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])


@pytest.mark.parametrize("query,label,folds,out", [("op4_toxicity", "toxic", 5, 0), ("op6_quality", "quality", 3, 1)])
def test_held_out_scores(spark, query, label, folds, out):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.REGISTRY[query](spark, sf_dir).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert held_out_auc(rows, labels) > 0.8


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifier_edges(spark, score):
    docs = spark.createDataFrame([(0, None), (1, ""), (1, "x " * 50000), (None, "idiot"), (2, "plain")], SCHEMA).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        got = score(docs, known).select("doc_id", "held_out", "score", "predicted").collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out is False for r in got if r.doc_id is None)
    assert score(docs.limit(0), labels).count() == 0


def brute_isotonic(weight, mean):
    average = lambda i, j: np.average(mean[i : j + 1], weights=weight[i : j + 1])
    n = len(mean)
    return [max(min(average(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]


def test_quality_equals_a_plain_fit(spark):
    rng = random.Random(12)
    words = ["the", "of", "Data", "click!!", "1234", "and", "table,", "BUY"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=rng.randrange(5, 40)))) for i in range(120)], SCHEMA)
    docs = docs.withColumns({n: F.lit("clash") for n in ("own", "id", "y", "raw", "model", "stats", "half")})
    labels = docs.select("doc_id", (F.col("text").contains("BUY") | (F.col("doc_id") % 7 == 0)).cast("int").alias("quality"))
    scored = quality.score_quality(docs, labels)
    got = {r.doc_id: r.score for r in scored.where("raw = 'clash' and stats = 'clash' and own = 'clash'").collect()}

    rows = quality.with_statistics(docs.withColumn("half", F.expr("pmod(xxhash64(doc_id), 2)")).drop("stats")).join(labels, "doc_id").collect()
    known = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    stats, y, half = (np.array([f(r) for r in known], dtype=float) for f in (lambda r: r.stats, lambda r: r.quality, lambda r: r.half))
    z_of = quality.Features(stats.mean(axis=0), stats.std(axis=0))
    ridge = np.r_[np.full(quality.FEATURES, quality.RIDGE), 0.0]

    def plain(own):
        z = z_of(stats[own])
        penalty = np.sqrt(np.where(ridge > 0, ridge * own.sum(), 1e-9))
        return np.linalg.lstsq(np.r_[z, np.diag(penalty)], np.r_[y[own], np.zeros(len(ridge))], rcond=None)[0]

    by_half = {h: plain(half != h) for h in (0, 1)}
    raw = np.array([z_of(s[None]) @ by_half[int(h)] for s, h in zip(stats, half)])[:, 0]
    bins = np.floor(np.clip(raw, -0.5, 1.5) * quality.BINS / 2)
    at = [bins == b for b in np.unique(bins)]
    levels = brute_isotonic(np.array([a.sum() for a in at]), np.array([y[a].mean() for a in at]))
    whole = z_of(np.array([r.stats for r in rows])) @ plain(np.ones(len(y), dtype=bool))
    want = 0.98 * np.interp(whole, [raw[a].mean() for a in at], levels) + 0.02 * np.clip(whole, 0, 1)
    assert len(got) == len(rows) == 120
    assert all(abs(got[r.doc_id] - w) < 1e-5 for r, w in zip(rows, want))


def test_toxicity_fit_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    size, n = 4, 40
    rows = [(sorted(rng.choice(size, rng.integers(0, size + 1), replace=False).tolist()), float(rng.integers(0, 2))) for _ in range(n)]
    swaps = [(i, [3], [2]) for i, (own, _) in enumerate(rows) if 3 in own and 2 not in own]
    x = np.array([[float(p in own) for p in range(size)] for own, _ in rows])
    y = np.array([r[1] for r in rows])
    other = np.array([x[i] - np.eye(size)[gone[0]] + np.eye(size)[new[0]] for i, gone, new in swaps])

    def loss(v):
        s = 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        t = 1 / (1 + np.exp(-(other @ v[:-1] + v[-1])))
        fit = -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
        return fit + toxicity.RIDGE * (v[:-1] ** 2).sum() + toxicity.PENALTY * np.mean((s[[i for i, _, _ in swaps]] - t) ** 2)

    v, step = np.zeros(size + 1), 1.0
    for _ in range(4000):  # plain descent on differences
        slope = np.array([(loss(v + e) - loss(v - e)) / 2e-6 for e in np.eye(size + 1) * 1e-6])
        while step > 1e-9 and loss(v - step * slope) > loss(v) - step * (slope @ slope) / 4:
            step /= 2
        v, step = v - step * slope, step * 1.5
    w, b = toxicity.train(rows, swaps, size, toxicity.PENALTY)
    assert loss(np.r_[w, b]) < loss(v) + 1e-3
    equal = np.abs(w[3] - w[2])
    assert equal < np.abs(np.subtract(*toxicity.train(rows, swaps, size, 0.0)[0][[3, 2]])) + 1e-6


def test_swapped_identities_score_alike():
    """Without the penalty a term that occurs with insults only is held against it; with it, much less."""
    names = ["idiot", "muslim", "christian"]
    rows = [([0, 1], 1.0)] * 12 + [([1], 1.0)] * 4 + [([2], 0.0)] * 12 + [([], 0.0)] * 12
    swaps = [(i, 1, 2) for i in range(16)] + [(i, 2, 1) for i in range(16, 28)]
    gap = {p: abs(np.subtract(*toxicity.train(rows, swaps, len(names), p)[0][1:])) for p in (0.0, 4.0)}
    assert gap[4.0] < gap[0.0] / 3
    assert toxicity.counterfactuals([["the", "men"], ["gay"]])[0] == ("men", "women")


def test_changes_equal_features_of_the_whole_counterfactual_text():
    texts = [
        "", "no term", "Muslim women.", "the MUSLIM met a muslim! muslims, christian. Muslim?\nchristians and jews",
        "men men men men. women! women men", "black 12 black white\n\nasian?!black", "women. " * 5 + "womens men",
    ]
    for text in texts:
        have, want = set(toxicity.features_of(text)), set()
        parts = re.split(r"([.!?\n]+)", text)
        for i in range(0, len(parts), 2):
            for a, b in toxicity.counterfactuals([toxicity.words_of(parts[i])]):
                swapped = re.sub(rf"(?i)(?<![a-z0-9]){a}(?![a-z0-9])", b, parts[i])
                other = set(toxicity.features_of("".join([*parts[:i], swapped, *parts[i + 1 :]])))
                want.add((tuple(sorted(have - other)), tuple(sorted(other - have))))
        assert {(tuple(gone), tuple(new)) for gone, new in toxicity.changes(text)} == want


def test_neutral_mentions_of_long_terms_are_not_toxic(spark):
    """Names that stand in toxic training rows mostly: their beginnings and counts must not carry what the name may not."""
    rng = random.Random(7)
    fill = "today people walked along river then cooked supper with friends while rain fell over town".split()
    rows = []
    for i in range(600):
        bad = i % 2
        few = ["muslim", "muslims"] if bad and rng.random() < 0.8 else ["christian", "christians", "jews", "jewish"]
        words = [*rng.choices(fill, k=8), rng.choice(few)] + ([rng.choice(["idiot", "moron"])] if bad and rng.random() < 0.6 else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) + f". note {i}", bad))
    neutral = "many {} walked along the river. The {} cooked supper"
    pairs = [("muslim", "christian"), ("muslims", "christians"), ("muslim", "jewish"), ("jews", "muslims")]
    ids = {t: 1000 + i for i, t in enumerate(sorted({t for p in pairs for t in p}))}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, neutral.replace("{}", t)) for t, i in ids.items()] + [(2000, "you idiot moron")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    for penalty in (0.0, toxicity.PENALTY):
        score = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, penalty=penalty).collect()}
        gaps = [abs(score[ids[a]] - score[ids[b]]) for a, b in pairs]
        assert score[2000] > 0.5
        if penalty:
            assert max(gaps) < 0.3 and all(score[i] < 0.5 for i in ids.values()), (gaps, score)
        else:
            assert max(gaps) > 0.6, gaps


def test_isotonic_pools_neighbours():
    assert quality.isotonic(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0.25, 2])).tolist() == pytest.approx([0, 0.5, 0.5, 2])


# --- the pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir):
    from ballast.session import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    rows, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, sf_dir))
        assert rows.columns == docs.columns
        kept.append(rows.count())
    assert docs.count() >= kept[0] == kept[1] >= kept[2] >= kept[3] > 0
    text = {r.doc_id: r.text for r in rows.collect()}
    out = segmentation.decode(corpus_pipeline.run(spark, sf_dir)).collect()
    assert {r.doc_id for r in out} == set(text) and all(r.text == text[r.doc_id] for r in out)


def test_simhash_stage_keeps_one_of_each_group(spark):
    """Clean documents stay, with or without an id; of a group one stays, even where ids are null or repeat."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "blue", "green"))
    rows = [(1, a), (2, a), (None, a), (None, b), (None, b), (3, c), (3, "a text of its own under a repeated id"), (3, c), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.simhash_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(1, a), (None, b), (3, c), (3, "a text of its own under a repeated id"), (4, None)]
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted(want, key=str)
    assert corpus_pipeline.simhash_stage(spark, docs.limit(0), "").count() == 0


def test_only_the_result_of_the_pipeline_stays(spark, sf_dir):
    with workspace(spark) as folder:
        out = corpus_pipeline.run(spark, sf_dir)
        held = {d for d, _, names in os.walk(folder) if names}
        assert held == {os.path.dirname(f).removeprefix("file://") for f in out.inputFiles()}
        assert out.count() > 0
