"""From raw documents to sampled encodings for training: five stages, each one operator of ``ballast.llm``.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before kept. All but the last return the columns of
``documents``; each stage's result is a table of its own before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm import decontamination, lines, segmentation, simhash, toxicity
from ballast.session import shared_dir, workspace, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    scored = toxicity.score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("predicted") == 0).select(COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others keep; ``n_chars`` follows the text."""
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id come last in their group, so one of them stays where a group has no other. Rows that share an id
    are told apart by their texts, and repeats of one row are one document.
    """
    key = F.struct(
        F.col("doc_id").isNull().alias("nameless"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"),
    )
    keyed = docs.withColumn("key", key)
    marked = simhash.near_duplicates(keyed.select("key", "text"), doc_id="key")
    first = marked.where(F.col("key") == F.col("component_id")).select("key").distinct()
    return keyed.join(first, "key", "left_semi").dropDuplicates(["key"]).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    marked = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.col("n_hit") == 0).select(COLUMNS)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Distinct sampled encodings of each document, with their inclusion probabilities and the text each decodes to."""
    return segmentation.sample_encodings(docs.select("doc_id", "text"), decode_to=("decoded",))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, as a table in the shared folder. Nothing else that the stages wrote stays there."""
    result = f"{shared_dir(spark)}/rows"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with workspace(spark):
        for i, (_, stage) in enumerate(STAGES):
            place = result if i == len(STAGES) - 1 else f"{shared_dir(spark)}/rows"
            with workspace(spark):
                rows = written(stage(spark, rows, sf_dir), place)
    return rows
