"""Token counts of documents in flat token files, by a separator scan.

A flat file is token ids of fixed width, end to end, each document ended by a separator id; no index tells where
documents lie. Files are cut into blocks of equal size whatever they hold. A task searches its blocks for the separator
with one vectorised comparison each and keeps, for each block, how many separators it has and where the last one is.
Two prefix scans over a file's blocks, a running count and a running maximum, then tell for every block which document
it begins in and where that document began, however many blocks it spans. With these, each block's counts are
differences of neighbouring separators.

The scans run over one small row for each block, with ``ballast.operators.blocks``, so no file is too long.

``write_token_files`` makes such files from texts: each task appends the tokens of its rows to files of its own in a
shared folder and returns which row is which document of which file. A task that runs again writes other files, and
only those named in the rows that were kept count.
"""

from __future__ import annotations

import base64
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.llm.texts import cached, slices, small_batches
from ballast.operators import blocks as scans
from ballast.session import shared_dir, written

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50256
WIDTH = "<u2"
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 27


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _tokenizer(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    separator: int = SEPARATOR, width: str = WIDTH, file_tokens: int = FILE_TOKENS, folder: str | None = None,
) -> DataFrame:
    """(file, ordinal, id): the tokens of every row, in files under ``folder``. A null text has no tokens.

    ``ordinal`` is the row's place among its file's documents, from 0. A file is closed once it holds ``file_tokens``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    target = folder or f"{shared_dir(spark)}/tokens"
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cached(f"tiktoken {vocabulary}", lambda: _tokenizer(vocabulary))
        system, base = _open(target)
        stream, path, ordinal, held = None, "", 0, 0
        try:
            for batch in batches:
                for part in slices(batch, text):
                    if stream is None or held >= file_tokens:
                        if stream is not None:
                            stream.close()
                        system.create_dir(base, recursive=True)
                        path = posixpath.join(base, f"{uuid.uuid4().hex}.bin")
                        stream, ordinal, held = system.open_output_stream(path), 0, 0
                    for body in pc.fill_null(part.column(text), "").to_pylist():
                        ids = np.array([*tokens.encode_ordinary(body), separator], dtype=width)
                        stream.write(ids.tobytes())
                        held += len(ids)
                    n = part.num_rows
                    places = pa.array(np.arange(ordinal, ordinal + n), pa.int64())
                    ordinal += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, pa.string()), places, part.column(doc_id)], names=["file", "ordinal", "id"]
                    )
        finally:
            if stream is not None:
                stream.close()

    return written(docs.select(doc_id, text).mapInArrow(run, f"file string, ordinal bigint, id {kind}"))


def file_blocks(files: DataFrame, folder: str, width: str = WIDTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, first, tokens) of every block of the files in column ``file``. Sizes are read in the tasks."""
    step = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _open(folder)[0]
        for batch in batches:
            paths = batch.column("file").to_pylist()
            sizes = [info.size // step for info in system.get_file_info(paths)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], names=["file", "size"])

    sized = files.select("file").mapInArrow(run, "file string, size bigint")
    last = F.greatest(F.floor((F.col("size") - 1) / block_tokens), F.lit(0)).cast("bigint")
    cut = sized.select("file", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
    first = F.col("block") * block_tokens
    return cut.select("file", "block", first.alias("first"), F.least(F.col("size") - first, F.lit(block_tokens)).alias("tokens"))


def _separators(blocks: DataFrame, folder: str, separator: int, width: str, added: str, row) -> DataFrame:
    """Rows that ``row`` makes of each block and the places in it at which separators stand."""
    step = np.dtype(width).itemsize
    names = [c.split()[0] for c in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = _open(folder)[0]
        for batch in batches:
            for block in batch.to_pylist():
                with system.open_input_file(block["file"]) as stream:
                    stream.seek(block["first"] * step)
                    ids = np.frombuffer(stream.read(block["tokens"] * step), dtype=width)
                columns = row(block, np.flatnonzero(ids == separator) + block["first"])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=names)

    return blocks.mapInArrow(run, added)


def count_tokens(
    files: DataFrame, folder: str, separator: int = SEPARATOR, width: str = WIDTH, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """(file, ordinal, first, n_tokens, ended): one row for each document of the files in column ``file``.

    ``first`` is the place of its first token, separators are not counted. Two separators side by side hold an empty
    document. Tokens behind a file's last separator are a document too, with ``ended`` false. An empty file has none.
    A file named twice is read once.
    """
    spark = files.sparkSession
    blocks = file_blocks(files.select("file").distinct(), folder, width, block_tokens).where(F.col("tokens") > 0)
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = written(blocks.repartition(spread, "file", "block"))

    def summary(block: dict, at: np.ndarray) -> list[tuple]:
        last = [int(at[-1])] if len(at) else [None]
        own = ([block["file"]], pa.string()), *((([block[c]], pa.int64())) for c in ("block", "first", "tokens"))
        return [*own, ([len(at)], pa.int64()), (last, pa.int64())]

    schema = "file string, block bigint, first bigint, tokens bigint, separators bigint, last bigint"
    summed = written(_separators(blocks, folder, separator, width, schema, summary))
    placed = scans.with_blocks(summed, ["file"], F.col("block"))
    placed = scans.running_sum(placed, ["file"], ["block"], {"upto": F.col("separators")})
    placed = scans.nearest(scans.settled(placed), ["file"], ["block"], {"before": F.col("last")})
    ends = summed.groupBy("file").agg(F.max("block").alias("final"))
    placed = scans.drop_blocks(placed).join(ends, "file")
    placed = placed.select(
        "file", "block", "first", "tokens", (F.col("upto") - F.col("separators")).alias("ordinal"),
        F.coalesce(F.col("before") + 1, F.lit(0)).alias("begun"), (F.col("block") == F.col("final")).alias("is_final"),
    )

    def documents(block: dict, at: np.ndarray) -> list[tuple]:
        end, done = at, np.ones(len(at), dtype=bool)
        tail = block["first"] + block["tokens"]
        begin = np.r_[block["begun"], at + 1][: len(at)]
        behind = int(at[-1]) + 1 if len(at) else block["begun"]
        if block["is_final"] and behind < tail:
            begin, end, done = np.r_[begin, behind], np.r_[end, tail], np.r_[done, False]
        n = len(begin)
        return [
            ([block["file"]] * n, pa.string()),
            (np.arange(block["ordinal"], block["ordinal"] + n), pa.int64()),
            (begin.astype(np.int64), pa.int64()),
            ((end - begin).astype(np.int64), pa.int64()),
            (done, pa.bool_()),
        ]

    schema = "file string, ordinal bigint, first bigint, n_tokens bigint, ended boolean"
    return _separators(written(placed.repartition(spread, "file", "block")), folder, separator, width, schema, documents)


def document_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
    block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """(doc_id, ordinal, first, n_tokens, ended): texts are written to flat token files, counted by the separator scan, and
    named again.

    One row for each row of ``docs``, repeats and null ids included; other columns are left out. A null or empty text has
    no tokens. A very long text may span any number of blocks. Both sides of the last join have a row for each document, so
    it is a sort-merge join whatever their size on disk: file names repeat, and shrink to nothing there alone.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens"
    named = write_token_files(docs, doc_id, text, vocabulary, file_tokens=file_tokens, folder=folder)
    counted = count_tokens(named, folder, block_tokens=block_tokens)
    return counted.join(named.hint("merge"), ["file", "ordinal"]).select(F.col("id").alias(doc_id), "ordinal", "first", "n_tokens", "ended")
