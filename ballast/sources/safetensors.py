"""Checkpoint files as a Spark data source.

``spark.read.format("safetensors").load(dir)`` reads only the headers: one row per tensor, in header order. With
``option("payload", "true")`` the data section comes back as rows of at most ``chunkBytes`` bytes; a large file is
cut into byte ranges read by separate tasks.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEADER_SCHEMA = (
    "path string, ordinal bigint, name string, dtype string, shape array<bigint>, "
    "begin bigint, end bigint, nbytes bigint"
)
PAYLOAD_SCHEMA = "path string, byte_start bigint, bytes binary"
MAX_HEADER_BYTES = 100 * 1000 * 1000


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def _open_fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _list(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    filesystem, base = _open_fs(path)
    info = filesystem.get_file_info(base)
    found = [info] if info.type == fs.FileType.File else filesystem.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(".safetensors"))


def _data_start(stream) -> int:
    raw = stream.read(8)
    if len(raw) != 8:
        raise ValueError("file too short for a header length")
    length = struct.unpack("<Q", raw)[0]
    if length > MAX_HEADER_BYTES:
        raise ValueError(f"header of {length} bytes")
    return 8 + length


class SafetensorsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.chunk = int(options.get("chunkbytes", options.get("chunkBytes", 4 << 20)))
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", 64)))
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", 256 << 20)))

    def partitions(self) -> list[InputPartition]:
        files = _list(self.root)
        if not self.payload:
            paths = [p for p, _ in files]
            return [Files(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)]
        step = max(self.chunk, self.task_bytes // self.chunk * self.chunk)
        return [ByteRange(p, at, at + step) for p, size in files for at in range(0, max(size, 1), step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        filesystem = _open_fs(self.root)[0]
        if isinstance(partition, ByteRange):
            yield from self._bytes(filesystem, partition)
            return
        for path in partition.paths:
            with filesystem.open_input_file(path) as stream:
                header = json.loads(stream.read(_data_start(stream) - 8))
            header.pop("__metadata__", None)
            for ordinal, (name, entry) in enumerate(header.items()):
                begin, end = entry["data_offsets"]
                yield path, ordinal, name, entry["dtype"], entry["shape"], begin, end, end - begin

    def _bytes(self, filesystem, part: ByteRange) -> Iterator[tuple]:
        with filesystem.open_input_file(part.path) as stream:
            base = _data_start(stream)
            size = stream.size() - base
            for at in range(part.start, min(part.end, size), self.chunk):
                stream.seek(base + at)
                yield part.path, at, stream.read(min(self.chunk, part.end - at, size - at))


class SafetensorsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return PAYLOAD_SCHEMA if self.options.get("payload", "false").lower() == "true" else HEADER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SafetensorsReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SafetensorsSource)
