"""Options for writing Parquet, and compression of files and shuffles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

CODECS = ("gzip", "snappy", "zstd", "lz4_raw", "uncompressed")


@dataclass(frozen=True)
class ParquetOptions:
    block_size: int = 128 << 20
    page_size: int = 1 << 20
    compression: str = "gzip"
    dictionary: bool = True

    def __post_init__(self) -> None:
        if self.compression not in CODECS:
            raise ValueError(f"compression is one of {CODECS}")

    def write(self, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
        w = df.write.mode(mode).option("compression", self.compression).option("parquet.block.size", self.block_size)
        w.option("parquet.page.size", self.page_size).option("parquet.enable.dictionary", str(self.dictionary).lower()).parquet(path)


#: Settings by which Spark's own blocks (shuffles, broadcasts) are compressed well rather than fast.
BLOCK_COMPRESSION = {"spark.io.compression.codec": "zstd", "spark.io.compression.zstd.bufferSize": "32k"}
