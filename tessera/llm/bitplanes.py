"""Token ids in bit-plane shuffled files.

A file holds the ids of whole documents in order. Blocks of ``block`` ids are transposed into byte
planes (or bit planes), each plane is compressed with zstandard on its own, and the footer has the
chunk index: for each block its number of ids and the sizes of its planes, and for each document
its id and number of tokens. A reader can fetch any block alone.

Layout: magic, planes of block 0, planes of block 1, ..., index (zstandard), its size (8 bytes), magic.

Defined cases: null text is an empty text, which has the end id alone; rows of equal doc_ids keep their own ids, in
the order of a hash of their texts (so a task that runs again writes the same file); a null doc_id sorts first and is kept; texts of any
length are encoded whole; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import utf8, word_ids

MAGIC = b"TPLANES1"
BLOCK = 1 << 16


def split_planes(ids, kind: str) -> list[bytes]:
    """Planes of little-endian unsigned 32-bit ids: 4 of bytes, or 32 of bits."""
    import numpy as np

    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [p.tobytes() for p in raw.T]
    return [np.packbits(x).tobytes() for x in np.unpackbits(raw, axis=1, bitorder="little").T]


def join_planes(planes: list[bytes], n: int, kind: str):
    """The inverse of ``split_planes``."""
    import numpy as np

    if kind == "byte":
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class Writer:
    """Writes one file, block by block. Holds one block, and the index."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        if kind not in ("byte", "bit"):
            raise ValueError(f"planes are of byte or bit, not {kind!r}")
        self.sink, self.kind, self.block = sink, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held = bytearray(), 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[list[int]] = []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.held += ids
        while len(self.held) >= 4 * self.block:
            self._flush(self.block)

    def _flush(self, n: int) -> None:
        import numpy as np

        planes = [self.pack(p) for p in split_planes(np.frombuffer(bytes(self.held[: 4 * n]), "<u4"), self.kind)]
        del self.held[: 4 * n]
        for p in planes:
            self.sink.write(p)
        self.blocks.append([n, *map(len, planes)])

    def close(self) -> tuple[int, int]:
        """(documents, tokens) of the file."""
        if self.held:
            self._flush(len(self.held) // 4)
        index = self.pack(json.dumps({"kind": self.kind, "blocks": self.blocks, "doc_ids": self.doc_ids, "lengths": self.lengths}).encode())
        self.sink.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.sink.close()
        return len(self.lengths), sum(self.lengths)


def read_index(source, size: int) -> dict:
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a file of planes")
    import zstandard

    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - n)
    return json.loads(zstandard.ZstdDecompressor().decompress(source.read(n)))


def read_documents(source, size: int) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) in file order, holding one block and one document at a time."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    index = read_index(source, size)
    blocks, held = iter(index["blocks"]), bytearray()
    source.seek(len(MAGIC))
    for doc_id, n in zip(index["doc_ids"], index["lengths"]):
        while len(held) < 4 * n:
            k, *sizes = next(blocks)
            held += join_planes([unpack(source.read(s)) for s in sizes], k, index["kind"]).tobytes()
        yield doc_id, bytes(held[: 4 * n])
        del held[: 4 * n]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, kind: str = "byte", block: int = BLOCK) -> list:
    """Encodes every text, appends ``end_id``, and writes files in ascending doc_id order.

    One range shuffle of (doc_id, text); each task then streams its range into one file, written
    under a name of its attempt and renamed when whole, so that a task may run twice. Returns a row
    for each file: (part, path, n_docs, n_tokens), in order; as many as tasks.
    """

    limit = common.cached_chunks(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = word_ids(tokenizer, limit), end_id.to_bytes(4, "little")
        task = TaskContext.get()
        part, fs, w = task.partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            if w is None:
                fs, root = common.filesystem(folder)
                fs.create_dir(root, recursive=True)
                made, path = f"{root}/.part-{part:06d}-{task.taskAttemptId()}", f"{root}/part-{part:06d}.planes"
                w = Writer(fs.open_output_stream(made), kind, block)
            for doc, ids in zip(b.column(0).to_pylist(), encode(utf8(b.column(1)))):
                w.add(doc, ids + end)
        if w is not None:
            n_docs, n_tokens = w.close()
            fs.move(made, path)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/part-{part:06d}.planes"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    common.tune(docs.sparkSession)
    # a hash of the text parts rows of one doc_id, however many, and orders them
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return sorted(rows.mapInArrow(run, "part long, path string, n_docs long, n_tokens long").collect())


def read_tokens(spark: SparkSession, files: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ``start`` counts the ids of all before."""
    return _read(spark, files, lambda ids: ids, "ids binary")


def _read(spark: SparkSession, files: list, last, schema: str) -> DataFrame:
    schema = "doc_id long, start long, n_tokens long, " + schema
    if not files:
        return spark.createDataFrame([], schema)
    base, rows = 0, []
    for f in files:
        rows.append((f["path"], base))
        base += f["n_tokens"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", schema.rsplit(" ", 2)[1]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary() if schema.endswith("binary") else pa.int64()]
        for b in batches:
            for path, at in zip(*(c.to_pylist() for c in b.columns)):
                fs, p = common.filesystem(path)
                size = fs.get_file_info(p).size
                out: list[tuple] = []
                with fs.open_input_file(p) as source:
                    for doc, ids in read_documents(source, size):
                        out.append((doc, at, len(ids) // 4, last(ids)))
                        at += len(ids) // 4
                        if len(out) == common.BATCH_ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return spark.createDataFrame(rows, "path string, base long").repartition(len(rows)).mapInArrow(run, schema)


def op1_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place, length and checksum, from the files that were written."""
    folder = common.shared_folder(spark, "planes")
    files = write_tokens(common.documents(spark, sf_dir), folder, common.tokenizer_path("word_bpe_49k.json"))
    common.temporary(spark, folder)
    return _read(spark, files, zlib.crc32, "ids_crc32 long").select("doc_id", "start", "n_tokens", F.col("ids_crc32"))


QUERIES = {"op1_bit_plane_tokens": op1_bit_plane_tokens}
ORACLE: dict[str, str] = {}
