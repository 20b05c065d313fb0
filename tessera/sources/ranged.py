"""Data source ``byte_ranges``: a file or HTTP resource as rows of byte ranges, read in parallel."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .locators import locate


class Range(InputPartition):
    def __init__(self, path: str, offset: int, length: int):
        super().__init__((path, offset))
        self.path, self.offset, self.length = path, offset, length


class ByteRanges(DataSource):
    """Options: ``path`` (several joined by commas) or ``paths`` (a JSON array, for paths that have commas), ``range_bytes`` (of
    one partition, 8 MiB), ``retries``."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, offset long, length long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path") and not options.get("paths"):
            raise ValueError("byte_ranges wants a path")
        self.paths = json.loads(options["paths"]) if options.get("paths") else [p.strip() for p in options["path"].split(",")]
        self.size = int(options.get("range_bytes", 8 << 20))
        if self.size < 1:
            raise ValueError("range_bytes is one at least")

    def partitions(self) -> list[Range]:
        out = []
        for p in self.paths:
            n = locate(p).access().length()
            out += [Range(p, o, min(self.size, n - o)) for o in range(0, n, self.size)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range):
        if partition.length:
            yield partition.path, partition.offset, partition.length, locate(partition.path).access().read(partition.offset, partition.length)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ByteRanges)
