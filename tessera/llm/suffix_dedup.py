"""Removes every byte that lies in a string of ``DEPTH`` bytes which also starts anywhere else.

A suffix array of all texts would tell: a string is repeated if its suffix and a neighbour in the order
agree for 200 bytes. It is built here for the suffixes that can matter only, and blockwise:

1. In each string of 200 bytes, the 64-byte gram of the least hash (leftmost of equals) is its anchor: a
   function of the string's bytes alone, so equal strings have equal anchors at the same place in them. An
   anchor owns the neighbouring strings that chose it; those strings are its context. About one position in
   70 is an anchor.
2. Anchors are counted by their gram's hash. A string whose anchor occurs once is not repeated. If
   all contexts of a gram are the same, all their strings are repeated. So are those of any context that
   occurs twice.
   Contexts are told apart by 128-bit digests (XXH3) of their bytes.
3. For the other grams, each different context goes, once, to a block (by gram); there the suffixes of all
   strings are sorted bucket by bucket with a difference cover (``suffixes``), and the bytes of neighbours are
   compared. Hash collisions of grams only put strangers in a block.
4. A gram of more than ``GRAM_CONTEXTS`` different contexts is not given to one task: each of its
   strings is a bucket of its own, found by a 128-bit hash and counted with partial sums.
5. What is repeated returns to the documents, which are joined with their texts twice in all: to cut out
   contexts, and to remove. The documents are numbered once, and written with their numbers: however later passes split
   that table, and whatever is computed again, a number stays with its text.

Defined cases: null and empty texts have no strings; a text shorter than 200 bytes loses nothing; equal
texts of 200 bytes or more lose everything; rows with equal or null doc_ids are documents of their own; texts
of any length are read whole; an empty table gives no rows; other columns, whatever their names, are kept by ``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import utf8
from .suffixes import Block

DEPTH, GRAM = 200, 64
REACH = DEPTH - GRAM  # strings start at most so far before their anchor
PAD = 256
#: Positions in a stretch of text that is hashed at once.
STRETCH = 1 << 17
#: Different contexts of a gram that one block takes (11 MB), and contexts that are sorted together otherwise.
GRAM_CONTEXTS, BLOCK_CONTEXTS = 32_768, 8192
_A, _B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # odd multipliers (fixed values of the golden ratio and of XXH64)


def _mix(a, b):
    import numpy as np

    x = a * np.uint64(_A) + (b ^ (b >> np.uint64(32))) * np.uint64(_B)
    return x ^ (x >> np.uint64(29))


def _hashes(raw):
    """Hash of the 64 bytes from each position on."""
    import numpy as np

    n = len(raw) - GRAM + 1
    h = np.empty(len(raw) - 7, np.uint64)
    for k in range(8):
        m = (len(raw) - k) // 8
        h[k::8] = raw[k : k + 8 * m].view("<u8")
    for step in (8, 16, 32):
        h = _mix(h[:-step], h[step:])
    return h[:n]


def _least(keys, width: int):
    """Minimum of each ``width`` neighbours."""
    import numpy as np

    have = 1
    while 2 * have <= width:
        keys = np.minimum(keys[:-have], keys[have:])
        have *= 2
    return np.minimum(keys[: len(keys) - (width - have)], keys[width - have :]) if width > have else keys


def anchors(texts: list[bytes]):
    """(text, place, gram hash, lowest and highest distance of an owned string's start, both halves of the context's
    digest) arrays."""
    import numpy as np
    import xxhash

    out: list = []
    pad = b"\xff" * PAD  # in no UTF-8 text
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        parts, at, spans = [pad], PAD, []
        for i, skip, t in held:
            parts += (t, pad)
            spans.append((i, skip, at, len(t)))
            at += len(t) + PAD
        whole = b"".join(parts)
        raw = np.frombuffer(whole, np.uint8)
        h = _hashes(raw)
        ids, skips, starts, sizes = (np.array(x) for x in zip(*spans))
        order = _mix(h, h >> np.uint64(7)) & ~np.uint64((1 << 24) - 1) | np.arange(len(h), dtype=np.uint64)
        # strings that lie in a text
        n_strings = sizes - DEPTH + 1
        first = np.repeat(starts - (np.cumsum(n_strings) - n_strings), n_strings) + np.arange(n_strings.sum())
        pick = (_least(order, REACH + 1)[first] & np.uint64((1 << 24) - 1)).astype(np.int64)
        new = np.concatenate([[True], pick[1:] != pick[:-1]])
        head = np.flatnonzero(new)
        tail = np.concatenate([head[1:], [len(pick)]]) - 1
        p = pick[head]
        low, high = p - first[tail], p - first[head]
        of = np.searchsorted(starts, p, "right") - 1
        digest, view = xxhash.xxh3_128_digest, memoryview(whole)
        d = [digest(view[x:y], z) for x, y, z in zip((p - high).tolist(), (p - low + DEPTH).tolist(), (high << 8 | low).tolist())]
        g = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
        out.append((ids[of], p - starts[of] + skips[of], h[p].view(np.int64), low, high, g[:, 0], g[:, 1]))
        held.clear()

    n = 0
    step = 1 << 22  # longer texts are cut into stretches that share what a string may need
    for i, t in enumerate(texts):
        for skip in range(0, max(1, len(t) - DEPTH + 1), step):
            part = t[skip : skip + step + DEPTH - 1] if len(t) > step + DEPTH else t
            if len(part) >= DEPTH:
                held.append((i, skip, part))
                n += len(part) + PAD
            if n >= STRETCH:
                flush()
                n = 0
            if part is t:
                break
    if held:
        flush()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*out))


def context(text: bytes, place: int, low: int, high: int) -> bytes:
    """The bytes of an anchor's strings: the first starts ``high`` before it, the last ``low``."""
    return text[place - high : place - low + DEPTH]


# --- stages ---------------------------------------------------------------------------------------
# A place is packed with its distances: place << 16 | low << 8 | high. A context is (h, g, k): its gram's hash and its digest.

KEY = ["h", "g", "k"]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            uid = b.column(0).to_numpy()
            of, place, h, low, high, g, k = anchors(utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid[of] if len(of) else np.zeros(0, np.int64), place << 16 | low << 8 | high, h, g, k)], ["uid", "at", *KEY])

    return docs.select("uid", "text").mapInArrow(run, "uid long, at long, h long, g long, k long")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, g, k, hot, low, high, ctx) of wanted anchors (uid, at, h, g, k, hot)."""
    per = wanted.groupBy("uid").agg(F.collect_list(F.struct("at", *KEY, "hot")).alias("a"))
    rows = docs.select("uid", "text").join(per, "uid").select("text", "a")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
        for b in batches:
            out: list[tuple] = []
            for text, found in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                for x in found:
                    low, high = x["at"] >> 8 & 255, x["at"] & 255
                    out.append((x["h"], x["g"], x["k"], x["hot"], low, high, context(text, x["at"] >> 16, low, high)))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*KEY, "hot", "low", "high", "ctx"])

    return rows.mapInArrow(run, "h long, g long, k long, hot boolean, low int, high int, ctx binary")


def sort_contexts(contexts: list[bytes], low, high):
    """Which strings of which context are repeated: boolean (contexts, REACH + 1) by distance of the start."""
    import numpy as np

    block = Block(contexts)
    per = high - low + 1
    own = np.repeat(np.arange(len(contexts)), per)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(per) - per, per)
    found = block.repeated(block.starts[own] + inner, DEPTH)
    at = np.searchsorted(block.starts, found, "right") - 1
    hit = np.zeros((len(contexts), REACH + 1), bool)
    hit[at, high[at] - (found - block.starts[at])] = True
    return hit


def _sorted(contexts: DataFrame) -> DataFrame:
    """(h, g, k, mask): which strings of a context start elsewhere too, by blocks of whole grams."""
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(n, "h").sortWithinPartitions(*KEY).select(*KEY, "low", "high", "ctx")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def done(held: list):
            table = pa.Table.from_batches(held)
            h, g, k, low, high = (table.column(c).to_numpy().astype(np.int64) for c in range(5))
            hit = sort_contexts(table.column(5).to_pylist(), low, high)
            some = hit.any(1)
            masks = [m.tobytes() for m in np.packbits(hit[some], axis=1, bitorder="little")]
            return pa.RecordBatch.from_arrays([*(pa.array(x[some], pa.int64()) for x in (h, g, k)), pa.array(masks, pa.binary())], [*KEY, "mask"])

        held: list = []
        n, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            h = b.column(0).to_numpy()
            at = 0
            # grams are kept together; many small ones are sorted at once
            while at < len(h):
                if held and n >= BLOCK_CONTEXTS and h[at] != last:
                    yield done(held)
                    held, n = [], 0
                e = int(np.searchsorted(h[at:], h[min(len(h) - 1, at + max(0, BLOCK_CONTEXTS - n))], "right")) + at
                held.append(b.slice(at, e - at))
                n, last, at = n + e - at, h[e - 1], e
        if held:
            yield done(held)

    return dealt.mapInArrow(run, "h long, g long, k long, mask binary")


def _strings(contexts: DataFrame) -> DataFrame:
    """(s1, s2, h, g, k, d) of all strings of contexts: their 128-bit hashes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for h, g, k, low, high, ctx in zip(*(c.to_pylist() for c in b.columns)):
                ds = range(low, high + 1)
                found = [hashlib.blake2b(ctx[high - d : high - d + DEPTH], digest_size=16).digest() for d in ds]
                halves = [[int.from_bytes(x[i : i + 8], "little", signed=True) for x in found] for i in (0, 8)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*halves, [h] * len(ds), [g] * len(ds), [k] * len(ds), list(ds))], ["s1", "s2", *KEY, "d"])

    return contexts.select(*KEY, "low", "high", "ctx").mapInArrow(run, "s1 long, s2 long, h long, g long, k long, d long")


def repeats(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(uid, a): for each numbered document with repeated strings, their anchors (at, mask); a null mask is all. And the
    tables that this frame reads."""
    found = common.materialised(_anchor_rows(docs), "anchors")
    grams = found.groupBy("h").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}{i}") for c in ("g", "k") for i, f in ((1, F.min), (2, F.max)))).where("n > 1")
    differ = (F.col("g1") != F.col("g2")) | (F.col("k1") != F.col("k2"))
    grams = common.materialised(grams.select("h", F.when(differ, F.col("n")).alias("n")), "grams")
    again = common.materialised(found.join(grams, "h"), "again")  # n is null where all contexts are the same
    common.discard(found)
    # one occurrence stands for each different context
    several = again.where("n is not null")
    ones = several.groupBy(*KEY).agg(F.count("*").alias("c"), F.min(F.struct("uid", "at")).alias("o"), F.first("n").alias("n"))
    ones = common.materialised(ones.select(*KEY, "c", "o.uid", "o.at", "n"), "contexts")
    hot = ones.where(F.col("n") > GRAM_CONTEXTS).groupBy("h").agg(F.count("*").alias("many")).where(F.col("many") > GRAM_CONTEXTS)
    wanted = ones.join(hot.select("h", F.lit(True).alias("hot")), "h", "left").select("uid", "at", *KEY, F.coalesce("hot", F.lit(False)).alias("hot"))
    cut = common.materialised(_cut(docs, wanted), "cut")
    strings = _strings(cut.where("hot"))
    twice = common.materialised(strings.groupBy("s1", "s2").agg(F.count("*").alias("times")).where("times > 1").select("s1", "s2"), "twice")
    late = strings.join(twice, ["s1", "s2"]).groupBy(*KEY).agg(F.collect_set("d").alias("ds"))
    octet = f"transform(sequence(0, {REACH // 8}), b -> lpad(hex(aggregate(ds, 0L, (a, d) -> if(d div 8 = b, a | shiftleft(1L, cast(d % 8 as int)), a))), 2, '0'))"
    late = late.select(*KEY, F.expr(f"unhex(array_join({octet}, ''))").alias("mask"))
    copies = ones.where("c > 1").select(*KEY, F.lit(None).cast("binary").alias("mask"))
    masks = common.materialised(_sorted(cut.where("not hot")).unionByName(late).unionByName(copies), "masks")
    for old in (grams, ones, cut, twice):
        common.discard(old)
    marked = several.join(masks, KEY).select("uid", "at", "mask")
    marked = marked.unionByName(again.where("n is null").select("uid", "at", F.lit(None).cast("binary").alias("mask")))
    return marked.groupBy("uid").agg(F.collect_list(F.struct("at", "mask")).alias("a")), [again, masks]


def removed(n: int, at, masks: list):
    """Half-open runs of removed bytes of a text of n bytes, from its anchors' places and masks."""
    import numpy as np

    place, low, high = at >> 16, at >> 8 & 255, at & 255
    whole = np.array([m is None for m in masks], bool)
    begin, end = [(place - high)[whole]], [(place - low)[whole] + DEPTH]
    if not whole.all():
        bits = np.frombuffer(b"".join([m for m in masks if m is not None]), np.uint8).reshape(-1, REACH // 8 + 1)
        of, d = np.nonzero(np.unpackbits(bits, axis=1, bitorder="little"))
        place, low, high = place[~whole][of], low[~whole][of], high[~whole][of]
        starts = (place - d)[(d >= low) & (d <= high)]
        begin.append(starts)
        end.append(starts + DEPTH)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.concatenate(begin), 1)
    np.add.at(step, np.concatenate(end), -1)
    gone = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(gone))
    return edge.reshape(-1, 2)


def _runs(texts: list, column) -> Iterator:
    """For each text the runs that its anchors (a list column of at and mask; null for none) remove."""
    import numpy as np

    flat = column.flatten()
    at, masks = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("mask").to_pylist()
    ends = np.cumsum(np.array(column.value_lengths().fill_null(0), np.int64)).tolist()
    begin = 0
    for text, end in zip(texts, ends):
        yield removed(len(text), at[begin:end], masks[begin:end]).tolist() if end > begin else []
        begin = end


def _joined(docs: DataFrame) -> DataFrame:
    """The documents with their repeats in column ``a``."""
    common.tune(docs.sparkSession)
    docs = common.materialised(docs.withColumn("uid", F.monotonically_increasing_id()), "numbered", "zstd")
    found, read = repeats(docs)
    found = common.materialised(found, "repeats")
    for old in read:
        common.discard(old)
    return common.reads(docs.join(found, "uid", "left"), docs, found)


def op4_blockwise_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from each document, and the digest of what is left."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            texts = utf8(b.column(1))
            for doc, text, runs in zip(b.column(0).to_pylist(), texts, _runs(texts, b.column(2))):
                at, digest = 0, hashlib.sha256()
                for s, e in runs:
                    digest.update(text[at:s])
                    at = e
                digest.update(text[at:])
                out.append((doc, len(text), sum(e - s for s, e in runs), len(runs), digest.hexdigest()))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return _joined(docs).select("doc_id", "text", "a").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns, with repeated strings removed from the text. Code points that are cut lose their other
    bytes; a null text stays null; documents stay, if with less text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            texts = utf8(b.column(0))
            for t, raw, runs in zip(b.column(0).to_pylist(), texts, _runs(texts, b.column(1))):
                if runs:
                    at, kept = 0, []
                    for s, e in runs:
                        kept.append(raw[at:s])
                        at = e
                    t = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(2)], ["text", "row"])

    # the other columns travel as one, whatever their names
    others = [f"`{c}`" for c in docs.columns if c != text]
    spare = "_" * (1 + max(map(len, docs.columns)))  # a struct has one field at least
    packed = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.struct(*others, F.lit(0).alias(spare)).alias("row"))
    joined = _joined(packed)
    found = joined.select("text", "a", "row").mapInArrow(run, packed.schema)
    return common.reads(found.select(*(F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns)), *joined._tessera_reads)


QUERIES = {"op4_blockwise_suffix_dedup": op4_blockwise_suffix_dedup}
ORACLE: dict[str, str] = {}
