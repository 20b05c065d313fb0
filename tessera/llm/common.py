"""What the operators of this subpackage share: reading tables, shared folders, tokenizer files."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS = 1000
#: Megabytes of encoded chunks in a Python worker, where no setting says otherwise.
CACHE_MB = 300
#: Bytes of a row group of what is written for later steps; a writing task buffers one.
ROW_GROUP = 16 << 20


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Small Arrow batches: texts are long, and a batch is held whole.

    Frames are computed after the operator has returned, so this stays in the session. A value that the session has set
    already, other than by this function, is left alone.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = getattr(spark, "_tessera_rows", None)
    if spark.conf.get(name, None) in (None, own):
        spark.conf.set(name, str(rows))
        spark._tessera_rows = str(rows)


def cached_chunks(spark: SparkSession) -> int:
    """Chunks of text that a Python worker keeps encoded, about 256 bytes each, by the setting
    ``spark.tessera.chunkCacheMb``: megabytes for each worker, of which an executor has one for each core. More take memory,
    fewer take time; results are the same."""
    return max(1, int(spark.conf.get("spark.tessera.chunkCacheMb", str(CACHE_MB)))) << 12


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path (URI) in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Where that is unset and the master is local (tests, one machine) a temporary
    folder is made for the session; on a cluster that is an error, as driver and executors have disks of their own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark, "_tessera_shared", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark._tessera_shared = root
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _hadoop_path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def temporary(spark: SparkSession, uri: str) -> None:
    """What was written to ``uri`` goes when the session's driver ends, if nothing has deleted it before."""
    path, fs = _hadoop_path(spark, uri)
    fs.deleteOnExit(path)


def materialised(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: cuts the lineage, and lost
    executors cost nothing that was computed before. Tables that ``df`` names as its own (``reads``) are deleted then."""
    spark = df.sparkSession
    path = shared_folder(spark, kind)
    with clean_shuffles(spark):
        df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP).parquet(path)
    temporary(spark, path)
    for old in getattr(df, "_tessera_reads", ()):
        discard(old)
    made = spark.read.schema(df.schema).parquet(path)
    made._tessera_path = path
    return made


def reads(df: DataFrame, *made: DataFrame) -> DataFrame:
    """Notes that ``df`` reads these intermediate tables, and nothing else does."""
    df._tessera_reads = (*getattr(df, "_tessera_reads", ()), *made)
    return df


@contextlib.contextmanager
def clean_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")
    except Exception:  # an engine without the setting keeps files longer
        before = name
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        elif before != name:
            spark.conf.set(name, before)


def discard(made: DataFrame) -> None:
    """Delete what ``materialised`` wrote, when nothing will read it again."""
    path, fs = _hadoop_path(made.sparkSession, made._tessera_path)
    fs.delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI that every executor can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def tokenizer_path(name: str) -> str:
    """Path of a public vocabulary file; ``TESSERA_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("TESSERA_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
