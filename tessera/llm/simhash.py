"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is 1 if more than half of the hashes of a text's word shingles have it. Fingerprints
that differ in at most ``radius`` bits are linked; groups are the components of the links.

Who is compared: fingerprints in a common block. With ``segments`` (small radius) the bits are cut
into segments of which two linked fingerprints must share some, so no link is lost: one of ``radius + 1``,
two of ``radius + 2``, and so on. Each step makes keys longer, and more of them; the number of fingerprints decides,
so that blocks of unlike ones stay small at any size. With
``minima`` (large radius) blocks are bands of the least shingle hashes; with the eight bands of the default, texts of
similarity 0.8 share one with a probability of 0.997. ``deduplicate`` takes more bands and a wider radius for candidates,
and links those whose sets of shingles have a similarity of 0.8 at least. Equal fingerprints are one node before anything is compared, and a
block of more than ``TILE_ROWS`` nodes is dealt out in parts that share pivots, so one task never has it whole.

How: 64 fingerprints of a block stand side by side as bit planes, a word for each bit position. Against a
fingerprint, each plane gives one bit of difference for 64 pairs at once; carry-save adders count eight
planes at a time into bitwise counters, and after every eight planes the tiles in which all 64 counts
exceed the radius are abandoned. A task links what it finds locally and emits one edge for each node at
most, never all pairs.

Defined cases: null and empty texts (and those of white space) have fingerprint zero and are linked like
any other; a text of fewer words than a shingle is one shingle; rows of equal doc_ids are documents of their own, each with
the component of its own text; a row with a null doc_id takes part, and its component is the smallest doc_id it reaches,
null if there is none; very long texts are hashed whole; empty tables give no rows; other columns, whatever their names, are
ignored by ``near_duplicates`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import utf8
from .components import components

SEED = 42
#: Nodes of a block that one task takes; larger blocks are dealt out in parts of half as many.
TILE_ROWS = 2048
#: Fingerprints in a block of segments, on average, if bits are even.
BLOCK_MEAN = 256
#: Tiles compared at once.
TILES = 1 << 14
#: Nodes of a large block that meet every part of it, about.
PIVOTS = 512
#: Odd multipliers that make further words of a fingerprint from a shingle's hash (fixed values of splitmix64).
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BANDS, BAND_ROWS = 8, 3


def shingle_hashes(text: bytes, size: int):
    """XXH64 of the shingles of a text, in order, repeats included."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def spread(h, k):
    """The k-th word made from hashes; the first is the hash itself. ``k``: a number, or an array that broadcasts."""
    import numpy as np

    x = h + np.uint64(MIX[0]) * np.asarray(k, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return np.where(np.asarray(k) == 0, h, x ^ (x >> np.uint64(31)))


def majority(h, words: int = 1) -> bytes:
    """The fingerprint of hashes: ``words`` big-endian words of 64 bits."""
    import numpy as np

    if not len(h):
        return bytes(8 * words)
    ones = np.zeros(64 * words, np.int64)
    step = max(1, (1 << 14) // words)
    for a in range(0, len(h), step):
        part = h[a : a + step, None]
        x = part if words == 1 else spread(part, np.arange(words))
        bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(part), 8 * words), axis=1)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h)).tobytes()


def minima_keys(h, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """A key for each band of least hashes. Hashes are dealt to bins by value; an empty bin takes the next full one's."""
    import numpy as np

    n = bands * rows
    least = np.full(n, np.iinfo(np.uint64).max)
    if len(h):
        np.minimum.at(least, (h % np.uint64(n)).astype(np.int64), spread(h, 7))
        full = np.flatnonzero(least != np.iinfo(np.uint64).max)
        least = least[full[np.searchsorted(full, np.arange(n)) % len(full)]] + np.arange(n, dtype=np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = spread(keys ^ least[k::rows], 1)
    return keys.view(np.int64).tolist()


def fingerprints(docs: DataFrame, size: int, words: int = 1, minima: bool = False) -> DataFrame:
    """(doc_id, fp binary, keys array<long>): keys are the bands of least hashes, or empty."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps, keys = [], []
            for t in utf8(b.column(1)):
                h = shingle_hashes(t, size)
                fps.append(majority(h, words))
                keys.append(minima_keys(h) if minima else [])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "keys"])

    common.tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp binary, keys array<long>")


def segment_scheme(n: int, radius: int, bits: int = 64) -> tuple[list[int], int]:
    """(cuts, k): edges of segments, of which fingerprints within the radius share k at least.

    The first scheme whose blocks have ``BLOCK_MEAN`` fingerprints at most if bits are even; four steps at most.
    """
    for more in range(5):
        m, k = radius + 1 + more, 1 + more
        if n >> (bits * k // m) <= BLOCK_MEAN or more == 4:
            return [bits * j // m for j in range(m + 1)], k
    raise AssertionError


# --- bit-sliced comparison ------------------------------------------------------------------------


def planes_of(rows):
    """Bit planes of fingerprints (n, words), n a multiple of 64: (bits, n / 64) words, lane j in bit j."""
    import numpy as np

    n, words = rows.shape
    bits = np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(n, 8 * words), axis=1)
    packed = np.packbits(bits.reshape(n // 64, 64, 64 * words).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def exceeds(counter: list, radius: int):
    """Lanes in which a bitwise counter (lowest bit first) is over the radius."""
    import numpy as np

    over, same = np.zeros_like(counter[0]), ~np.zeros_like(counter[0])
    for k in range(max(len(counter), radius.bit_length()) - 1, -1, -1):
        c = counter[k] if k < len(counter) else np.zeros_like(over)
        if radius >> k & 1:
            same &= c
        else:
            over |= same & c
            same &= ~c
    return over


def _add(a, b, c):
    """Full adder of three planes: (sum, carry)."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def compare(rows, planes, query, word, lanes, radius: int):
    """For tiles (query row, word of 64 lanes): lanes within the radius, of those in ``lanes``.

    Returns (tile, mask) of the tiles that have any.
    """
    import numpy as np

    n_bits = planes.shape[0]
    alive = np.arange(len(query))
    near = lanes.copy()
    size = (n_bits).bit_length()
    counter = [np.zeros(len(query), np.uint64) for _ in range(size)]
    for start in range(0, n_bits, 8):
        at, of = word[alive], query[alive]
        d = []
        for b in range(start, start + 8):
            own = (rows[of, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1)
            d.append(planes[b][at] ^ (np.uint64(0) - own))
        s1, c1 = _add(d[0], d[1], d[2])
        s2, c2 = _add(d[3], d[4], d[5])
        s3, c3 = _add(s1, s2, d[6])
        ones, c4 = _add(counter[0], s3, d[7])
        t1, f1 = _add(c1, c2, c3)
        twos, f2 = _add(counter[1], t1, c4)
        fours, carry = _add(counter[2], f1, f2)
        counter[:3] = ones, twos, fours
        for k in range(3, size):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        left = near & ~exceeds(counter, radius)
        keep = left != 0
        if not keep.all():
            alive, left, counter = alive[keep], left[keep], [c[keep] for c in counter]
        near = left
        if not len(alive):
            break
    return alive, near


def _labels(n: int, a, b):
    """Least index that each of n items reaches over pairs (a, b)."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    while (label[label] != label).any():
        label = label[label]
    return label


def alike(a, b) -> bool:
    """Whether two sets of hashes (sorted, distinct) have a Jaccard similarity of ``LEAST_ALIKE`` at least."""
    import numpy as np

    n, m = len(a), len(b)
    up, down = LEAST_ALIKE
    if down * min(n, m) < up * max(n, m):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return down * common >= up * (n + m - common)


def _verified(label, a, b, sets):
    """Of candidate pairs (a, b), those of like sets that join what isn't joined yet."""
    import numpy as np

    at = {}

    def find(x):
        while at.get(x, x) != x:
            at[x] = at.get(at[x], at[x])
            x = at[x]
        return x

    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y and alike(sets[i], sets[j]):
            at[max(x, y)] = min(x, y)
            keep.append(k)
    return a[keep], b[keep]


def link_groups(rows, nodes, sizes, radius: int, sets: list | None = None):
    """Star edges (u, v) among the nodes of each of the groups that stand one after another.

    With ``sets``, pairs within the radius are candidates, and those of like sets are linked.
    """
    import numpy as np

    if not len(sizes):
        return np.zeros((2, 0), np.int64)
    words = -(-sizes // 64)  # of each group
    first_row, first_word = np.cumsum(sizes) - sizes, np.cumsum(words) - words
    group = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(rows)) - first_row[group]
    slot = first_word[group] * 64 + lane
    n_words = int(words.sum())
    wide = np.zeros((n_words * 64, rows.shape[1]), np.uint64)
    wide[slot] = rows
    row_of = np.full(n_words * 64, -1)
    row_of[slot] = np.arange(len(rows))
    planes = planes_of(wide)
    filled = np.packbits((row_of >= 0).reshape(-1, 64), axis=1, bitorder="little").view("<u8")[:, 0]
    # a query meets the words from its own on, in its own the lanes above it
    own = first_word[group] + lane // 64
    per = first_word[group] + words[group] - own
    label, linked_any = np.arange(len(rows)), False
    ends = np.cumsum(per)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TILES, "right")))
        to = min(to, len(rows))
        query = np.repeat(np.arange(at, to), per[at:to])
        word = own[query] + np.arange(len(query)) - np.repeat(np.cumsum(per[at:to]) - per[at:to], per[at:to])
        if linked_any:  # tiles of which all lanes are linked with the query already tell nothing new
            of = np.where(row_of >= 0, label[row_of], -1).reshape(-1, 64)
            low, high = np.where(of < 0, len(rows), of).min(1), of.max(1)
            open_ = (low[word] != label[query]) | (high[word] != label[query])
            query, word = query[open_], word[open_]
        shift = (lane[query] % 64).astype(np.uint64)
        above = np.where(word == own[query], (~np.uint64(0) << shift) << np.uint64(1), ~np.uint64(0))
        tile, mask = compare(rows, planes, query, word, filled[word] & above, radius)
        if len(tile):
            linked_any = True
            t, j = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = query[tile[t]], row_of[word[tile[t]] * 64 + j]
            if sets is not None:
                a, b = _verified(label, a, b, sets)
            label = label[_labels(len(rows), label[a], label[b])]
            while (label[label] != label).any():
                label = label[label]
        at = to
    # the least node of each local group
    low = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(low, label, nodes)
    found = low[label]
    linked = found != nodes
    return np.stack([nodes[linked], found[linked]])


def _link_blocks(blocks: DataFrame, words: int, radius: int, size: int | None = None) -> DataFrame:
    """blocks: (block, fp, node), dealt and sorted by block; star edges of each. With ``size``, blocks have a
    ``text`` too, and what is within the radius is linked if the sets of shingles are alike."""
    most = 20_000 if size is None else 2 * TILE_ROWS

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def linked(held: list):
            block = np.concatenate([h[0] for h in held])
            rows = np.concatenate([h[1] for h in held])
            nodes = np.concatenate([h[2] for h in held])
            sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]))
            u, v = link_groups(rows, nodes, sizes, radius, None if size is None else [x for h in held for x in h[3]])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        held: list[tuple] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(0).to_numpy()
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").reshape(-1, words).astype(np.uint64)
            nodes = b.column(2).to_numpy()
            sets = [] if size is None else [np.unique(shingle_hashes(t, size)) for t in utf8(b.column(3))]
            # all but the last block of what has come is whole
            if n and block[0] != held[-1][0][-1] and n >= most:
                yield linked(held)
                held, n = [], 0
            starts = np.flatnonzero(np.diff(block)) + 1
            if n + len(block) >= most and len(starts):
                cut = int(starts[-1])
                yield linked([*held, (block[:cut], rows[:cut], nodes[:cut], sets[:cut])])
                held, n = [], 0
                block, rows, nodes, sets = block[cut:], rows[cut:], nodes[cut:], sets[cut:]
            held.append((block, rows, nodes, sets))
            n += len(block)
        if held:
            yield linked(held)

    return blocks.select("block", "fp", "node", *(() if size is None else ("text",))).mapInArrow(run, "u long, v long")


def links(nodes: DataFrame, words: int, radius: int, minima: bool) -> DataFrame:
    """Edges between nodes (fp, node, keys) that have a block in common and are within the radius."""
    if minima:
        keys = F.explode("keys")
    elif words == 1:
        cuts, k = segment_scheme(nodes.count(), radius)
        whole = F.lpad(F.conv(F.hex("fp"), 16, 2), 64, "0")
        parts = [whole.substr(a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
        keys = F.explode(F.array(*(F.xxhash64(F.lit(j), F.concat(*(parts[i] for i in of))) for j, of in enumerate(combinations(range(len(parts)), k)))))
    else:
        raise ValueError("segments are for fingerprints of one word")
    return _link_keyed(nodes.select("node", keys.alias("key")), nodes.select("fp", "node"), words, radius)


def _link_keyed(rows: DataFrame, nodes: DataFrame, words: int, radius: int, size: int | None = None) -> DataFrame:
    """Edges between the nodes (fp, node, and text with ``size``) of one key, by rows (node, key). Fingerprints and texts join
    what is dealt out, so those alone under their keys never move.

    A key of more than ``TILE_ROWS`` nodes is dealt into parts, and about ``PIVOTS`` of its nodes go to each part. That
    links most nodes of a group of like ones, through those, to one set; nothing inside it needs comparing any more. What
    is left meets all parts, so no link is lost, and the rows that are dealt out grow with the nodes and those left over.
    """
    half = TILE_ROWS // 2
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def linked(dealt: DataFrame) -> DataFrame:
        return _link_blocks(dealt.select("block", "node").join(nodes, "node").repartition(n, "block").sortWithinPartitions("block", "node"), words, radius, size)

    def part(salt: int, parts: str):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(parts)).cast("int")

    def all_of(parts: str):
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = common.materialised(sizes.select("key", "n", F.when(F.col("n") > TILE_ROWS, F.ceil(F.col("n") / half)).otherwise(1).cast("int").alias("parts")), "blocks")
    edges = linked(rows.join(sizes.where("parts = 1").select("key"), "key").withColumn("block", F.col("key")))
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return common.reads(edges, sizes)
    large = rows.join(large, "key")
    pivot = F.pmod(F.xxhash64("node", F.lit(2)), F.col("n")) < PIVOTS
    large = large.withColumn("own", part(1, "parts"))
    first = large.withColumn("part", F.col("own")).unionByName(large.where(pivot).withColumn("part", all_of("parts")).where("part <> own"))
    near = common.materialised(linked(first.withColumn("block", F.xxhash64("key", "part"))), "near")
    roots = components(near)
    labelled = large.select("key", "node").join(roots.toDF("node", "root"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("k"))
    most = counts.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("most"), (F.sum("k") - F.max("k")).alias("left")).where("left > 0")
    most = common.materialised(most.select("key", "most", F.ceil(F.col("left") / half).cast("int").alias("chunks")), "most")
    # those outside the largest set, in chunks, meet every part
    left = labelled.join(most, "key").where("label <> most").select("key", "node")
    every = large.join(most.select("key", "chunks"), "key")
    asked = every.join(left, ["key", "node"]).withColumn("chunk", part(3, "chunks")).withColumn("part", all_of("parts")).where("part <> own")
    asked = asked.unionByName(every.withColumn("chunk", all_of("chunks")).withColumn("part", F.col("own")))
    return common.reads(edges.union(near).union(linked(asked.withColumn("block", F.xxhash64("key", "part", "chunk")))), sizes, near, roots, most)


def near_duplicates(docs: DataFrame, size: int = 5, words: int = 1, radius: int = 4, minima: bool = False) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    found = common.materialised(fingerprints(docs, size, words, minima), "fingerprints")
    # texts of one fingerprint that have different least hashes are nodes of their own; nodes are numbered as they are written
    by = ["fp", "keys"] if minima else ["fp"]
    nodes = found.groupBy(*by).agg(F.min("doc_id").alias("least"))
    nodes = nodes.select("fp", F.monotonically_increasing_id().alias("node"), "least", F.col("keys") if minima else F.array().cast("array<long>").alias("keys"))
    nodes = common.materialised(nodes, "nodes")
    edges = links(nodes, words, radius, minima)
    if minima:  # equal fingerprints are linked whatever their blocks
        alike = nodes.groupBy("fp").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1")
        edges = common.reads(edges.unionByName(nodes.join(alike.select("fp", "v"), "fp").select(F.col("node").alias("u"), "v")), *edges._tessera_reads)
    roots = components(edges)
    of = nodes.join(roots.toDF("node", "root"), "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    of = of.join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root").groupBy("fp").agg(F.first("component_id").alias("component_id"))
    of = common.materialised(common.reads(of, nodes, roots), "roots")
    return common.reads(found.select("doc_id", "fp").join(of, "fp").select("doc_id", "fp", "component_id"), found, of)


#: For the pipeline: words of a fingerprint, and the most bits in which candidates differ. Texts that have a share of
#: 0.8 of their five-word shingles in common differ in 0.15 of the bits, and in up to 0.19 of them if they are short.
WIDE_WORDS, WIDE_RADIUS = 16, 256
#: Bands of least hashes that make candidates; at similarity 0.8 all differ with a probability of 0.488 ** 20.
WIDE_BANDS = 20
#: The least similarity of what is linked, as a fraction.
LEAST_ALIKE = (4, 5)


def _sets(docs: DataFrame, size: int, words: int) -> DataFrame:
    """(row, digest, fp, keys) of the set of shingles of each text of (row, text); the digest is null without any."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for b in batches:
            digests, fps, keys = [], [], []
            for t in utf8(b.column(1)):
                h = np.unique(shingle_hashes(t, size))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                fps.append(majority(h, words))
                keys.append(minima_keys(h, WIDE_BANDS) if len(h) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["row", "digest", "fp", "keys"])

    common.tune(docs.sparkSession)
    return docs.select("row", "text").mapInArrow(run, "row long, digest binary, fp binary, keys array<long>")


def deduplicate(docs: DataFrame, size: int = 5, words: int = WIDE_WORDS, radius: int = WIDE_RADIUS) -> DataFrame:
    """One row of each group of near-duplicates; the input's columns.

    Links join texts whose sets of shingles have a similarity of 0.8 at least: texts of a common band within the
    radius are candidates, and in each component of candidates the sets themselves (as 64-bit hashes) decide. Of a
    group the smallest doc_id stays, null last, and of equal ones the first row. Texts without words are one group,
    but those of a null doc_id, which have no text to lose and no name, all stay.
    """
    whole = common.materialised(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), "rows", "zstd")
    found = common.materialised(_sets(whole.select("row", "doc.text"), size, words), "sets")
    nodes = common.materialised(found.groupBy("digest").agg(F.min("row").alias("node"), F.min_by("fp", "row").alias("fp"), F.min_by("keys", "row").alias("keys")), "nodes")
    close = components(links(nodes, words, radius, True))
    # candidates with the least node of their component, itself included
    near = close.union(close.select("v", "v").distinct()).toDF("node", "key")
    texts = nodes.select("node", "fp").join(near, "node").join(whole.select(F.col("row").alias("node"), "doc.text"), "node")
    texts = common.materialised(common.reads(texts, close), "texts", "zstd")
    roots = components(_link_keyed(texts.select("node", "key"), texts.select("fp", "node", "text"), words, radius, size))
    of = nodes.select("digest", "node").join(roots.toDF("node", "root"), "node", "left").select("digest", F.coalesce("root", "node").alias("group"))
    grouped = found.select("row", F.coalesce("digest", F.lit(b"")).alias("d")).join(of.select(F.coalesce("digest", F.lit(b"")).alias("d"), "group"), "d")
    ranked = grouped.join(whole.select("row", "doc.doc_id"), "row").select("group", "d", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row").alias("r"))
    stay = ranked.groupBy("group").agg(F.min("r").alias("r")).select("r.row")
    bare = ranked.where((F.octet_length("d") == 0) & F.col("r.unnamed")).select("r.row")
    stay = common.materialised(common.reads(stay.union(bare).distinct(), found, nodes, texts, roots), "stay")
    return common.reads(whole.join(stay, "row", "left_semi").select("doc.*"), whole, stay)


def op5_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text"), size=4, words=1, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op5_bit_sliced_simhash": op5_bit_sliced_simhash}
ORACLE: dict[str, str] = {}
