"""Exact deduplication of lines by levelled sorted runs of line hashes.

Lines are compared by two 64-bit hashes of their key: the line without blanks at its ends, A-Z lower-cased. Documents
are taken in batches of falling id. The state is a set of runs: tables of the keys seen so far, each bucketed and
sorted by hash, so that a batch is merged against a run without moving the run. For each batch

1. its keys are merge-anti-joined with every run: what is left is new, and belongs to the largest id that holds it;
2. the new keys become a run of the lowest level; ``fanout`` runs of a level are compacted into one of the next;
3. all other occurrences of its lines are repeats, and are written down.

A key's documents are its first holder and its repeats. Keys that reach ``min_docs`` lose their repeats. Texts are
moved once, to meet the positions they lose. Only DataFrame functions are used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import shared_dir, written

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 6
FANOUT = 3
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


class Runs:
    """Levels of sorted runs of keys in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _store(self, keys: DataFrame) -> tuple[str, str]:
        """Name and folder of a new table of these keys, bucketed and sorted by hash."""
        name = f"run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        writer = keys.repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("path", path).format("parquet").saveAsTable(name)
        return name, path

    def tables(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run holds."""
        self._compact()
        for name in self.tables():
            keys = keys.join(self.spark.table(name).hint("merge"), KEY, "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        """Store keys that no run holds as a run, and give them back as a table."""
        name, path = self._store(keys)
        self._put(0, name)
        return self.spark.read.schema(keys.schema).parquet(path)

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self) -> None:
        """Merge each level of ``fanout`` runs into a run of the next: when runs are read again, not as they are added."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged = None
                for run in self.levels[level]:
                    rows = self.spark.table(run)
                    merged = rows if merged is None else merged.unionByName(rows)
                higher, _ = self._store(merged)
                self._forget(level)
                self._put(level + 1, higher)
            level += 1

    def _forget(self, level: int) -> None:
        for run in self.levels[level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.levels[level] = []

    def close(self) -> None:
        for level in range(len(self.levels)):
            self._forget(level)


def _place(ids: DataFrame) -> Column:
    """A number that never falls along the ids in column ``doc``: of strings, their first seven bytes."""
    if dict(ids.dtypes)["doc"] not in ("string", "binary"):
        return F.col("doc")
    head = F.rpad(F.hex(F.substring(F.col("doc").cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("bigint")


def _boundaries(ids: DataFrame, batches: int) -> list[int]:
    """Numbers in column ``at`` that begin the batches, from the largest down."""
    shares = F.array(*[F.lit(i / batches) for i in range(1, batches)])
    cuts = ids.agg(F.percentile_approx("at", shares, F.lit(1000))).first()[0] if batches > 1 else None
    return sorted(set(cuts or []), reverse=True)


def repeats(lines: DataFrame, ids: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Rows of ``lines`` (doc, tag, pos, h1, h2) but those in the largest document that holds their key.

    Batches are cut along the ids in column ``doc`` of ``ids``.
    """
    spark = lines.sparkSession
    place = _place(ids)
    cuts = _boundaries(ids.select(place.alias("at")), batches)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        batch = F.when(place >= cut, F.lit(i)).otherwise(batch)
    table = f"{shared_dir(spark)}/lines"
    lines.withColumn("batch", batch).write.partitionBy("batch").parquet(table)
    stored = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lines.schema)}, batch int")
    stored = stored.parquet(table)
    runs, found = Runs(spark, fanout), None
    try:
        for i in range(len(cuts) + 1):
            own = stored.where(F.col("batch") == i).drop("batch")
            keys = own.groupBy(*KEY).agg(F.max("doc").alias("doc"))
            new = runs.add(runs.unseen(keys))
            again = written(own.join(new, [*KEY, "doc"], "left_anti"))
            found = again if found is None else found.unionByName(again)
    finally:
        runs.close()
    return found


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold from all of them but the one with the largest id.

    Keys under ``min_chars`` code points are left alone. The text column holds the lines that stay, joined by line
    feeds; ``n_lines`` and ``n_dropped`` count. A null or empty text is one empty line. A document without an id takes
    no part and stays whole. Rows with equal ids are one document when documents are counted, and each keeps its text.
    Ids may be of any type with an order. The input's other columns come back whatever they are called, the text behind
    them. A very long text is split where it is read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    tag = F.xxhash64(body)
    key = line_key(F.col("line"))
    lines = (
        docs.where(F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("doc"), tag.alias("tag"), F.posexplode(F.split(body, "\n", -1)).alias("pos", "line"))
        .select("doc", "tag", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))
    )
    ids = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"))
    again = repeats(lines, ids, batches, fanout)
    often = again.select(*KEY, "doc").distinct().groupBy(*KEY).count().where(F.col("count") >= min_docs - 1)
    lost = again.join(often.select(*KEY), KEY).groupBy("doc", "tag").agg(F.collect_set("pos").alias("lost"))
    lost = lost.withColumnsRenamed({"doc": "lost_doc", "tag": "lost_tag"})

    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_lines", "n_dropped")])
    whole = docs.select(own.alias("own"), F.col(doc_id).alias("doc"), tag.alias("tag"), F.split(body, "\n", -1).alias("lines"))
    joined = whole.join(lost, (F.col("doc") == F.col("lost_doc")) & (F.col("tag") == F.col("lost_tag")), "left")
    # The lines come from below the join, so reading one by its position does not split the text again.
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.col("lines")[i]))
    done = joined.select(
        "own",
        F.array_join(kept, "\n").alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
    return done.select("own.*", F.col("text").alias(text), "n_lines", "n_dropped")
