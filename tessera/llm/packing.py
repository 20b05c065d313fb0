"""Bounded-space online best-fit packing of token pieces into fixed-length sequences.

A worker keeps at most ``open_bins`` open sequences. Their free space is a key into a bitset (one
bit for each number of free tokens), so the tightest open sequence that takes a piece is the lowest
set bit at or above the piece's length. When one sequence too many is open, the fullest closes first. Pieces are placed
as they arrive, each once and for good.

Defined cases: null text is an empty text (one piece that holds the end id alone); a null doc_id is kept; a text of more
than ``capacity`` tokens, however long, is cut into full pieces, the first of which may be shorter; repeated rows
are packed as often as they come; an empty table gives no rows; other columns are ignored by ``pieces`` and kept by
``pack``, but those named ``sequence_id`` and ``offset`` are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import common
from .chunks import byte_ids, utf8

CAPACITY = 2048
OPEN_BINS = 1024
#: Texts in one Arrow batch; their chunks are in memory together.
TEXT_ROWS = 500
#: Pieces that one task packs, about.
TASK_PIECES = 60_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class BestFit:
    """Online best-fit with a bounded number of open bins. ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.next = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        got = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return got

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit in {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            got = self._take(free)
        else:
            free, got = self.capacity, self.next
            self.next += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(got)
            self.bits |= 1 << left
            self.n_open += 1
            if self.n_open > self.most:  # the fullest closes: no piece will be put there again
                self._take((self.bits & -self.bits).bit_length() - 1)
        return got, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, cached: int | None = None) -> DataFrame:
    """Token pieces of every text, ``end_id`` appended. ``cached``: chunks that a worker keeps encoded, by ``common.cached_chunks`` if not given."""
    cached = cached or common.cached_chunks(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = byte_ids(tokenizer, cached)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(b.column(0).to_pylist(), encode(utf8(b.column(1)))):
                ids += end
                view = memoryview(ids)
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    for column, x in zip(out, (doc, k, s, n, zlib.crc32(view[4 * s : 4 * (s + n)]))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 1 else pa.int64()) for i, x in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    common.tune(docs.sparkSession, TEXT_ROWS)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(of: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (any frame with a ``length``); task by task.

    Without a shuffle: neighbouring partitions are joined until a task has about ``task_pieces``
    pieces, so what bins stay part empty at the end of each task is a bounded share.
    """
    from pyspark.sql import types as T

    of = of.drop("sequence_id", "offset")
    n = of.count()
    of = of.coalesce(max(1, -(-n // task_pieces)))
    at = of.columns.index("length")
    schema = T.StructType([*of.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        fit = BestFit(capacity, open_bins)
        for b in batches:
            places = [fit.place(n) for n in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([base + p for p, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())], [*b.schema.names, "sequence_id", "offset"]
            )

    return of.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, cached: int | None = None) -> DataFrame:
    """Pieces are written to the shared folder first, so that packing is one light pass over them."""
    made = common.materialised(pieces(docs, tokenizer, end_id, capacity, cached), "pieces")
    return common.reads(pack(made, capacity, open_bins), made)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each piece of each document; see the module for the defined cases."""
    return pack_documents(common.documents(spark, sf_dir), common.tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLE: dict[str, str] = {}
