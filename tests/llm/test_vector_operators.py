"""Clustering, whitening and near-duplicates of embeddings against plain numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from ballast.llm import centroids, near_vectors, queries, whitening

ROWS = "vec_id bigint, embedding array<float>, label int"
CLASHING = "whole bigint, h1 string, h2 int, label_key int, dim string, n bigint, cluster string, u int, `class` int, block int"


def random_rows(rng, n, dim, labels=2):
    """Centres with near copies around them, exact copies, repeated ids and one label with most rows."""
    centres = rng.standard_normal((max(n // 6, 1), dim))
    out = []
    for i in range(n):
        x = centres[rng.integers(len(centres))] + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.25, 0.3])
        out.append((i, [float(np.float32(c)) for c in x], int(rng.integers(labels) if rng.random() < 0.5 else 0)))
    return out + [(3, out[3][1], out[3][2]), (3, out[4][1], out[4][2]), (n + 5, out[7][1], out[7][2])]


def odd_rows(dim):
    x = [0.5] * dim
    return [
        (901, None, 0), (902, [None, *x[1:]], 0), (903, [float("nan"), *x[1:]], 0), (904, [float("inf"), *x[1:]], 0),
        (905, [0.0] * dim, 0), (906, x, None), (907, x[1:], 0), (908, [], 0), (None, x, 1), (None, None, None),
    ]


def with_clashes(df):
    return df.selectExpr("*", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in CLASHING.split(", ")])


# --- clustering -------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, dim):
    kept = [
        (i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64))
        for i, v, _ in rows
        if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)
    ]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v.tolist()) for i, v in kept if i is not None)
    centres = [np.array(v) for _, v in named[:k]]

    def assign():
        gaps = [[int(((v - c) ** 2).sum()) for c in centres] for _, v in kept]
        return [int(np.argmin(g)) for g in gaps], [min(g) for g in gaps]

    for _ in range(rounds):
        at, _ = assign()
        for c in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centres[c] = np.array([int(s) // len(own) for s in np.sum(own, axis=0)])
    at, gaps = assign()
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    sums = [sum(g for g, a in zip(gaps, at) if a == c) for c in range(len(centres))]
    return sorted((str(i), a, g, sums[a], sum(gaps), digest[a]) for (i, _), a, g in zip(kept, at, gaps))


@pytest.mark.parametrize("k, dim", [(7, 5), (1, 3), (400, 4)])
def test_clusters_equal_brute_force(spark, k, dim):
    rows = random_rows(np.random.default_rng(k), 150, dim) + odd_rows(dim)
    got = centroids.cluster(with_clashes(spark.createDataFrame(rows, ROWS).repartition(5)), centroids=k, dim=dim)
    assert set(got.columns) == {*ROWS.replace(",", "").split()[::2], *[c.split()[0].strip("`") for c in CLASHING.split(", ")]} | set(
        centroids.ADDED.fieldNames()
    )
    found = sorted(
        (str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()
    )
    assert found == brute_clusters(rows, k, centroids.ROUNDS, dim)


def test_search_breaks_ties_by_number_and_skips_far_centroids():
    grid = np.array([[0, 0], [2, 0], [2, 0], [0, 2], [50, 50], [50, 52]], dtype=np.int64)
    x = np.array([[1, 0], [1, 1], [2, 0], [50, 51], [-9, -9]], dtype=np.int64)
    at, distance = centroids.Neighbours(grid).search(x)
    assert at.tolist() == [0, 0, 1, 4, 0] and distance.tolist() == [1, 2, 0, 1, 162]


def test_clusters_of_nothing_and_of_too_large_components(spark):
    empty = centroids.cluster(spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns[-5:] == centroids.ADDED.fieldNames()
    only_odd = spark.createDataFrame([(1, None, 0)], ROWS)
    assert centroids.cluster(only_odd).count() == 0
    large = spark.createDataFrame([(1, [1e9, 0.0], 0), (2, [-1e9, 0.0], 0)], ROWS)
    with pytest.raises(ValueError, match="too large"):
        centroids.cluster(large, dim=2)


# --- whitening --------------------------------------------------------------------------------------------------------


def test_whitening_equals_numpy(spark):
    dim = 6
    rng = np.random.default_rng(5)
    rows = random_rows(rng, 200, dim) + odd_rows(dim)
    out = whitening.whiten(with_clashes(spark.createDataFrame(rows, ROWS).repartition(4)), components=4).collect()
    own = [r for r in out if len(r.embedding) == dim]
    assert len(own) == 203 + 3  # the random rows, the zero vector, the one without a label, the one without an id
    x = np.floor(256 * np.array([r.embedding for r in own])).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    want = (x - s / n) @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    got = np.array([r.whitened for r in own])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-9
    assert np.abs(np.sign(got[0] * want[0]) * want - got).max() < 1e-9
    assert [int(r.deviation) for r in own] == ((n * x - s) ** 2).sum(axis=1).tolist()
    assert all(r.n == n and r.identity_error < 1e-9 for r in own)
    assert np.allclose(own[0].explained, values[::-1][:4] / values.sum(), rtol=1e-9)
    assert {len(r.whitened) for r in out if len(r.embedding) < dim} == {0}


def test_sums_of_squares_are_exact_at_any_size():
    rng = np.random.default_rng(3)
    small = rng.integers(-300, 300, (50, 4))
    n, rest = 50, [int(s) for s in small.sum(axis=0)]
    cov = whitening.covariance(n, rest, [int(s) for s in whitening.squares(small)])
    assert np.allclose(cov, np.cov(small.T, bias=True), rtol=1e-12)
    large = whitening._safe(small * (1 << 40))
    assert large.dtype == object
    assert [int(s) for s in whitening.squares(large)] == [int(s) << 80 for s in whitening.squares(small)]


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], ROWS)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)], ROWS)).collect()
    assert [(r.n, r.whitened, int(r.deviation)) for r in one] == [(1, [], 0)] * 2
    two = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.25, 1.0], 0)], ROWS)).collect()
    assert [len(r.whitened) for r in two] == [1, 1] and all(abs(abs(r.whitened[0]) - 1) < 1e-12 for r in two)
    wide = [(1, [3e7, 1.0], 0), (2, [-3e7, 1.0], 0), (3, [1.0, 2.0], 0)]
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(wide, ROWS)).collect()}
    x = np.floor(256 * np.array([np.float32(w[1]) for w in wide], dtype=np.float64)).astype(object)
    assert [int(got[i + 1].deviation) for i in range(3)] == ((3 * x - x.sum(axis=0)) ** 2).sum(axis=1).tolist()


# --- near-duplicates --------------------------------------------------------------------------------------------------


def brute_links(rows, cosine):
    n = len(rows)
    ok = [
        label is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)
        for _, v, label in rows
    ]
    links = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                links[i, j] = links[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            least = min([root[i], *[root[j] for j in np.flatnonzero(links[i])]])
            changed, root[i] = changed or least != root[i], least
    out = []
    for i, (own, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((str(own), int(links[i].sum()), str(least), own == least))
    return sorted(out)


@pytest.mark.parametrize("block_rows, dim", [(2048, 8), (16, 8), (5, 3)])
def test_near_duplicates_equal_brute_force(spark, block_rows, dim):
    rows = random_rows(np.random.default_rng(dim + block_rows), 160, dim) + odd_rows(dim)
    df = with_clashes(spark.createDataFrame(rows, ROWS).repartition(3))
    got = near_vectors.near_duplicates(df, block_rows=block_rows, window=4.0)
    assert got.columns == [*df.columns, "n_links", "component_id", "kept"]
    found = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got.collect())
    assert found == brute_links(rows, near_vectors.COSINE)
    assert sum(r[1] for r in found) > 100


def test_links_reach_their_recall_and_never_fall_below_the_cosine(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):  # pairs at the least similarity and a little beside it
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = near_vectors.COSINE + (i % 3 - 1) * 0.002 + 1e-4
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, ROWS), block_rows=300).collect()
    links = {r.vec_id: r.n_links for r in got}
    above = [links[2 * i] for i in range(600) if i % 3]
    assert sum(above) >= 0.99 * len(above)
    assert not any(links[2 * i] for i in range(600) if i % 3 == 0)


def test_count_is_calibrated():
    assert near_vectors.least_count(32, 2.5, 0.999) == 29
    assert near_vectors.least_count(32, 8.0, 0.999) == 32
    assert near_vectors.least_count(4, 0.1, 1.0) == 0


def test_near_duplicates_of_nothing(spark):
    got = near_vectors.near_duplicates(spark.createDataFrame([], ROWS))
    assert got.count() == 0 and got.columns[-3:] == ["n_links", "component_id", "kept"]


# --- the registered queries -------------------------------------------------------------------------------------------


def test_queries_over_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    whitened = queries.op12_whitening(spark, sf_dir).collect()
    assert len(whitened) == 4 * len(rows) and {r.component for r in whitened} == {1, 2, 3, 4}
    near = queries.op13_near_vectors(spark, sf_dir).collect()
    want = brute_links([(r.vec_id, r.embedding, r.label) for r in rows], near_vectors.COSINE)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near) == want
