"""The registered queries of this subpackage: each operator over its whole table, with its result's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import (
    centroids,
    decontamination,
    licenses,
    lines,
    near_vectors,
    pii,
    quality,
    segmentation,
    simhash,
    token_counts,
    toxicity,
    vectors,
    whitening,
)

QUERY_STEP = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(_texts(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segmentation.sample_encodings(_texts(spark, sf_dir), decode_to=("decoded_sha256",))
    return rows.withColumnRenamed("decoded_sha256", "text_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(_texts(spark, sf_dir)).select("doc_id", "n_tokens", "ended")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_texts(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_texts(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_texts(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.top_k(rows.where(F.col("vec_id") % QUERY_STEP == 0), rows)


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(_texts(spark, sf_dir))
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS],
        F.sha2(_digest("base"), 256).alias("base_sha256"),
        _digest("found").alias("spans"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroids.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.drop("embedding")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    rows = out.select("*", F.posexplode("whitened").alias("place", "value"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        "n",
        F.col("deviation").cast("bigint").alias("deviation"),
        F.col("value").alias("whitened"),
        F.col("explained")[F.col("place")].alias("explained"),
        "identity_error",
    )


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return out.select("vec_id", "n_links", "component_id", "kept")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_simhash,
        op3_sentencepiece,
        op4_toxicity,
        op5_token_counts,
        op6_quality,
        op7_licenses,
        op8_line_dedup,
        op9_top_k,
        op10_personal_data,
        op11_centroids,
        op12_whitening,
        op13_near_vectors,
    )
}

_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _centroid_sql() -> str:
    """Lloyd's rounds one after another, every vector against every centroid."""
    squared = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = {centroids.DIM} AND {_SOUND}
        ),
        named AS (SELECT sha256('{centroids.SALT}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
            FROM (SELECT * FROM named ORDER BY h, v LIMIT {centroids.CENTROIDS})
        )"""
    ]
    for i in range(centroids.ROUNDS + 1):
        parts.append(
            f"""
        a{i} AS MATERIALIZED (
            SELECT r, vec_id, v, struct_extract(least, 'd') AS d, struct_extract(least, 'c') AS c FROM (
                SELECT k.r, k.vec_id, k.v, min(struct_pack(d := {squared}, c := c.c)) AS least
                FROM kept k CROSS JOIN c{i} c GROUP BY k.r, k.vec_id, k.v
            )
        )"""
        )
        if i < centroids.ROUNDS:
            parts.append(
                f"""
        s{i} AS (
            SELECT c, i, sum(x) AS s, count(*) AS n
            FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i
        ),
        m{i} AS (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c
        ),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c AS c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)"""
            )
    last = centroids.ROUNDS
    return f"""
        WITH {",".join(parts)}
        SELECT vec_id, CAST(a.c AS INTEGER) AS "cluster", CAST(d AS BIGINT) AS distance,
            CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{last} a JOIN c{last} c ON a.c = c.c
    """


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))

SQL: dict[str, str] = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        b2 AS (SELECT item_id, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0 AND item_id IS NOT NULL),
        pattern AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words
            FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b2)
        ),
        place AS (
            SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
            FROM (
                SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                FROM d, (SELECT DISTINCT size FROM pattern) WHERE len(w) >= size
            )
        ),
        hit AS (SELECT doc_id, item_id, i, size FROM place JOIN pattern USING (size, words)),
        word AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hit) GROUP BY doc_id),
        item AS (
            SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(item.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(word.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
    "op8_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents
        ),
        k AS (
            SELECT doc_id, i, line,
                {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
            FROM l
        ),
        often AS (
            SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ),
        marked AS (
            SELECT k.doc_id, i, line, coalesce(keeper <> k.doc_id, false) AS dropped FROM k LEFT JOIN often USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT q.vec_id AS query_id,
            CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank,
            c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        QUALIFY rank <= 5
    """,
    "op11_centroids": _centroid_sql(),
}
