"""Suffix deduplication and SimHash against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import simhash as H
from tessera.llm import suffix_dedup as D
from tessera.llm import suffixes as X
from tessera.llm.components import components

from .test_tokens import table

# --- suffixes


@pytest.mark.parametrize("period", [1, 2, 7, 16, 64])
def test_difference_cover(period):
    c = X.difference_cover(period)
    assert {(a - b) % period for a in c for b in c} == set(range(period))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=70, max_size=150), min_size=1, max_size=12), st.integers(0, 5), st.sampled_from([8, 16, 64]))
def test_block_finds_repeats(rows, copies, period):
    raw = [x.encode() for x in rows + rows[:copies]]
    block = X.Block(raw, period, tuple(X.difference_cover(period)))
    for depth in (64, 67, 70):
        places = [(k, i) for k, r in enumerate(raw) for i in range(len(r) - depth + 1)]
        count = collections.Counter(raw[k][i : i + depth] for k, i in places)
        got = block.repeated(np.array([block.starts[k] + i for k, i in places]), depth)
        assert sorted(got.tolist()) == [block.starts[k] + i for k, i in places if count[raw[k][i : i + depth]] > 1]


@pytest.mark.parametrize("bucket", [X.BUCKET, 50])
def test_buckets_are_suffix_order_whatever_the_residues(monkeypatch, bucket):
    monkeypatch.setattr(X, "BUCKET", bucket)
    r = random.Random(1)
    rows = [("ab" * 100)[: r.randint(70, 200)].encode() for _ in range(30)] + ["".join(r.choice("ab") for _ in range(100)).encode() for _ in range(9)] + [b"a" * 200] * 3
    block = X.Block(rows)
    whole = b"".join(x + b"\xff" + k.to_bytes(5, "big") for k, x in enumerate(rows)) + b"\1"
    places = np.array([block.starts[k] + i for k, x in enumerate(rows) for i in range(len(x))])
    got = np.concatenate([p for p, _ in block.buckets(np.array(r.sample(places.tolist(), len(places))))])
    assert got.tolist() == sorted(places.tolist(), key=lambda i: whole[i:])
    sample = sorted(block.sample.tolist(), key=lambda i: whole[i:])
    assert [block.ranks[i] for i in sample] == list(range(1, len(sample) + 1))


def test_long_ties_need_the_cover(monkeypatch):
    """Two equal stretches at different residues: without a shift that both share, ranks can't be compared."""
    with pytest.raises(ValueError, match="difference cover"):
        X.Block([b"x" * 100], cover=(0,))
    rows = [b"q" * k + b"the same words again and again " * 12 + bytes([97 + k]) * 90 for k in range(5)]
    whole = b"".join(x + b"\xff" + k.to_bytes(5, "big") for k, x in enumerate(rows)) + b"\1"

    def wrong(block):
        at = [int(s) + i for s, x in zip(block.starts, rows) for i in range(len(x) - 90)]
        ties = [(i, j) for i in at for j in at if i != j and whole[i : i + X.PERIOD] == whole[j : j + X.PERIOD]]
        assert len({(i - j) % X.PERIOD for i, j in ties}) > 10
        less = block._less(*np.array(ties).T)
        return sum(x != (whole[i:] < whole[j:]) for x, (i, j) in zip(less.tolist(), ties))

    assert wrong(X.Block(rows)) == 0
    # the same construction with a shift that takes only the first of the two to the sample
    alone = np.repeat((-np.arange(X.PERIOD) % X.PERIOD)[:, None], X.PERIOD, 1)
    monkeypatch.setattr(X, "shifts", lambda period, cover: alone)
    assert wrong(X.Block(rows, cover=(0,))) > 0


def test_passes_may_split_the_table_otherwise(spark, tmp_path, monkeypatch):
    """The numbered table is read with other partitions in each pass, as after executors are lost."""
    texts = removal_texts(6)
    d = table(spark, tmp_path, list(enumerate(texts)))
    plain = sorted(map(tuple, D.op4_blockwise_suffix_dedup(spark, d).collect()))
    real, passes = D.repeats, []

    def otherwise(docs):
        found, read = real(docs.repartition(7, "text"))
        passes.append(1)
        return found, read

    monkeypatch.setattr(D, "repeats", otherwise)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert sorted(map(tuple, D.op4_blockwise_suffix_dedup(spark, d).collect())) == plain and passes
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def brute_removal(texts):
    count = collections.Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] += 1
    out = []
    for b in raw:
        m = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                m[i : i + 200] = b"\1" * 200
        out.append((b, bytes(m)))
    return out


def removal_texts(seed):
    r = random.Random(seed)
    say = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    passage, base = say("abcdefgh é", 260), [say("klmnop  漢", r.randint(0, 1200)) for _ in range(30)]
    out = base + [say("qrstuv ", r.randint(0, 300)) + passage + say("qrs", r.randint(0, 300)) for _ in range(40)]
    for k in range(40):
        t = r.choice(base)
        a, n = r.randrange(max(1, len(t) - 400)), r.randint(150, 400)
        out.append(f"z{k} " + t[a : a + n] + f" y{k}" + r.choice(base)[: r.randint(0, 300)])
    out += [None, None, "", "x", "a" * 199, "a" * 200, "b" * 201, "b" * 1000, "ab" * 400, "abc" * 100 + "Q" + "abc" * 100, base[0], base[0], base[1], "é" * 150, "c" * 200, "c" * 200]
    return out + [f"x{k}" + "line of text here. " * r.randint(5, 40) for k in range(5)]


@pytest.mark.parametrize(("seed", "most"), [(1, D.GRAM_CONTEXTS), (2, D.GRAM_CONTEXTS), (3, 4)])
def test_op4(spark, tmp_path, monkeypatch, seed, most):
    """With small blocks too, where most grams take the way of the hot ones."""
    monkeypatch.setattr(D, "GRAM_CONTEXTS", most)
    texts = removal_texts(seed)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    got = D.op4_blockwise_suffix_dedup(spark, table(spark, tmp_path, rows)).collect()
    want = []
    for (i, _), (b, m) in zip(rows, brute_removal(texts)):
        runs = sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1]))
        want.append((str(i), len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_suffix_deduplicate(spark):
    """Input that isn't a file, other columns of any name, a column that isn't called text."""
    texts = removal_texts(4)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "uid long, body string, a int, row string").repartition(3)
    got = {r.uid: r for r in D.deduplicate(df, "body").collect()}
    assert D.deduplicate(df, "body").columns == df.columns and len(got) == len(texts)
    for i, (t, (b, m)) in enumerate(zip(texts, brute_removal(texts))):
        kept = bytes(x for x, y in zip(b, m) if not y).decode("utf-8", "ignore")
        assert got[i].body == (None if t is None else kept) and got[i].a == 1


def test_long_text_is_cut_into_stretches(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("abcdefg") for _ in range(6000)).encode()
    whole = D.anchors([text])
    part = D.anchors.__globals__
    monkeypatch.setitem(part, "STRETCH", 500)
    again = D.anchors([text, b"", text])
    assert again[1][again[0] == 0].tolist() == whole[1].tolist() and again[2][again[0] == 2].tolist() == whole[2].tolist()


def test_suffix_empty(spark, tmp_path):
    assert D.op4_blockwise_suffix_dedup(spark, table(spark, tmp_path, [])).count() == 0


# --- SimHash


def plain_fingerprint(t, size):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text("aB \n\té", max_size=60), st.integers(1, 5))
def test_fingerprint(text, size):
    assert int.from_bytes(H.majority(H.shingle_hashes(text.encode(), size)), "big") == plain_fingerprint(text, size)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0]
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest("é b c", 42)


@pytest.mark.parametrize(("words", "radius"), [(1, 0), (1, 4), (1, 20), (2, 9), (4, 46), (16, 174)])
def test_bit_sliced_links(words, radius):
    rng = np.random.default_rng(radius)
    sizes = np.array([1, 2, 70, 200, 64, 65, 5])
    n = int(sizes.sum())
    rows = rng.integers(0, 1 << 63, (n, words), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, words), dtype=np.uint64)
    for _ in range(n):
        a, b = rng.integers(0, n, 2)
        rows[b] = rows[a]
        for k in rng.integers(0, 64 * words, rng.integers(0, radius + 3)):
            rows[b, k // 64] ^= np.uint64(1) << np.uint64(k % 64)
    nodes = rng.permutation(n).astype(np.int64) + 1000
    got = set(zip(*H.link_groups(rows, nodes, sizes, radius).tolist()))
    want, at = set(), 0
    for s in sizes:
        d = np.bitwise_count(rows[at : at + s, None] ^ rows[None, at : at + s]).sum(2)
        root = {x: x for x in nodes[at : at + s]}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(d <= radius)):
            a, b = find(nodes[at + i]), find(nodes[at + j])
            root[max(a, b)] = min(a, b)
        want |= {(int(x), int(find(x))) for x in nodes[at : at + s] if find(x) != x}
        at += s
    assert got == want


def test_exceeds():
    rng = np.random.default_rng(1)
    counter = [rng.integers(0, 1 << 63, 5, dtype=np.uint64) for _ in range(4)]
    for radius in range(18):
        over = H.exceeds(counter, radius)
        for k in range(5):
            for lane in range(64):
                value = sum((int(c[k]) >> lane & 1) << b for b, c in enumerate(counter))
                assert (int(over[k]) >> lane & 1) == (value > radius)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.u: x.v for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_segment_scheme():
    got = [H.segment_scheme(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**12, 10**15)]
    assert [(len(c) - 1, k) for c, k in got] == [(5, 1), (5, 1), (6, 2), (7, 3), (8, 4), (9, 5)]
    assert all(c[0] == 0 and c[-1] == 64 for c, _ in got)


@pytest.mark.parametrize(("rows_of_a_tile", "mean"), [(2048, 256), (16, 256), (2048, 0)])
def test_op5(spark, tmp_path, monkeypatch, rows_of_a_tile, mean):
    """With tiny tiles too, where blocks are dealt out in parts; and with the keys of a huge table."""
    monkeypatch.setattr(H, "TILE_ROWS", rows_of_a_tile)
    monkeypatch.setattr(H, "BLOCK_MEAN", mean)
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(200)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 300))) for _ in range(120)]
    for _ in range(250):
        w = r.choice(texts[:120]).split() or ["x"]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
        texts.append(" ".join(w))
    texts += [None, "", "  ", "one", "One", "one two", "a b c d", "A b c d e", "a  b\nc d e"]
    ids = [i * 7 % 4001 for i in range(len(texts))]
    rows = [*zip(ids, texts), (ids[5], texts[5]), (None, "one"), (None, "never elsewhere")]
    got = H.op5_bit_sliced_simhash(spark, table(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    fp = [plain_fingerprint(t, 4) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least: dict = {}
    for i in range(len(texts)):
        least[find(i)] = min(ids[i], least.get(find(i), 10**9))
    want = {i: (f"{fp[k]:016x}", least[find(k)]) for k, i in enumerate(ids)}
    for x in got:
        if x.doc_id is not None:
            assert (x.fingerprint, x.component_id) == want[x.doc_id]
    one = want[ids[texts.index("one")]]
    assert {(x.fingerprint, x.component_id) for x in got if x.doc_id is None} == {one, (f"{plain_fingerprint('never elsewhere', 4):016x}", None)}


def test_deduplicate_catches_near_copies(spark):
    """Copies of similarity 0.8 or more go, different texts stay, also those that share a passage."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(r.randint(60, 300))] for _ in range(60)]
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    copies, alike = [], lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)))
    for k, w in enumerate(base[:40]):
        near = list(w)
        for _ in range(max(1, len(w) // 90)):
            near[r.randrange(len(near))] = word()
        if alike(w, near) >= 0.85:
            copies.append(100 + k)
            rows.append((100 + k, " ".join(near)))
    rows += [(200 + k, " ".join([word() for _ in range(80)] + passage + [word() for _ in range(80)])) for k in range(20)]
    rows += [(300, " ".join(base[50])), (None, " ".join(base[51])), (None, "of its own"), (301, None), (302, "")]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, fp string")
    got = H.deduplicate(df)
    kept = [x.doc_id for x in got.collect()]
    assert got.columns == df.columns
    assert not set(copies) & set(kept) and len(copies) > 30
    assert set(range(60)) <= set(kept) and set(range(200, 220)) <= set(kept)
    assert 300 not in kept and (301 in kept) != (302 in kept)


def test_simhash_empty(spark, tmp_path):
    d = table(spark, tmp_path, [])
    assert H.op5_bit_sliced_simhash(spark, d).count() == 0
    assert H.deduplicate(spark.read.parquet(d + "/documents.parquet")).count() == 0


def test_deduplicate_decides_by_exact_similarity(spark):
    """Short texts too: all pairs of 0.8 or more are linked, and none below."""
    fresh = iter(range(10**6))
    word = lambda: "w%d" % next(fresh)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    rows, gone = [], set()
    for n, more in [(10, 1), (8, 1), (24, 5), (24, 6), (24, 8), (24, 9), (104, 25), (104, 33), (304, 75), (304, 90)]:
        for _ in range(30):
            a = [word() for _ in range(n)]
            b = a + [word() for _ in range(more)]
            i = 2 * len(rows)
            rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
            if alike(a, b) >= 0.8:
                gone.add(i + 1)
    got = {x.doc_id for x in H.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(gone) > 100 and {i for i, _ in rows} - got == gone


def test_deduplicate_keeps_one_row_of_null_or_repeated_ids(spark):
    text = lambda k: " ".join("t%dw%d" % (k, i) for i in range(80))
    rows = [(1, text(1)), (None, text(1)), (2, text(2)), (2, text(2)), (None, text(3)), (None, text(3)), (4, text(4)), (4, text(5)), (None, text(6))]
    got = [(r.doc_id, r.text) for r in H.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, text(1)), (2, text(2)), (None, text(3)), (4, text(4)), (4, text(5)), (None, text(6))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_of_one_doc_id_and_ids_of_any_size(spark, tmp_path):
    """Ids that several texts share don't link them, and no id is too large."""
    texts = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven"]
    big = 2**63 - 5
    rows = [(1, texts[0]), (5, texts[0]), (2, texts[1]), (5, texts[1]), (5, "of its own kind indeed so"), (big, "a very large id has this text")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in H.op5_bit_sliced_simhash(spark, table(spark, tmp_path, rows)).collect()}
    fp = lambda t: f"{plain_fingerprint(t, 4):016x}"
    assert got == {(1, fp(texts[0])): 1, (5, fp(texts[0])): 1, (2, fp(texts[1])): 2, (5, fp(texts[1])): 2, (5, fp(rows[4][1])): 5, (big, fp(rows[5][1])): big}


def test_a_hot_block_is_dealt_out_in_proportion(spark, monkeypatch):
    """Fingerprints around one, and a few far from it, under one key: all links, and rows that grow with the nodes."""
    rng = np.random.default_rng(2)

    def nodes(n):
        rows = np.full(n, 0x123456789ABCDEF0, np.uint64)
        for _ in range(3):  # up to three bits of 32 from the centre
            rows ^= np.uint64(1) << rng.integers(0, 32, n).astype(np.uint64)
        rows = np.unique(rows)
        return np.concatenate([rows, rng.integers(1 << 40, 1 << 63, 40, dtype=np.uint64)])

    dealt: list[int] = []
    real = H._link_blocks

    def counted(blocks, *rest):
        dealt.append(blocks.count())
        return real(blocks, *rest)

    monkeypatch.setattr(H, "_link_blocks", counted)
    per_node = []
    for n in (3000, 14000):
        rows = nodes(n)
        dealt.clear()
        df = spark.createDataFrame([(int(k), bytearray(int(x).to_bytes(8, "big")), 7) for k, x in enumerate(rows)], "node long, fp binary, key long")
        label = {r.u: r.v for r in components(H._link_keyed(df.select("node", "key"), df.select("fp", "node"), 1, 4)).collect()}
        per_node.append(sum(dealt) / len(rows))
        root = list(range(len(rows)))

        def find(x, root=root):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i in range(len(rows)):
            for j in np.flatnonzero(np.bitwise_count(rows[i] ^ rows[:i]) <= 4).tolist():
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        assert {i: find(i) for i in range(len(rows)) if find(i) != i} == label
    assert per_node[1] < 1.5 * per_node[0] and per_node[1] < 4


def test_near_copies_of_one_text_in_a_hot_group(spark):
    """Several thousand different copies of one text, more than a task takes at once: recall of 0.9 at a similarity of 0.8."""
    r = random.Random(8)
    base = ["b%d" % k for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 3000):
        w = list(base)
        for _ in range(r.randint(1, 2)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
        rows.append((k, " ".join(w)))
    rows += [(10_000 + k, " ".join("own%dx%d" % (k, i) for i in range(60))) for k in range(100)]
    got = {x.doc_id for x in H.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(116)}
    first = sets(rows[0][1])
    near = [i for i, t in rows[1:3000] if len(first & sets(t)) / len(first | sets(t)) >= 0.8]
    assert len(near) > 2000 and len(set(near) - got) >= 0.9 * len(near)
    assert all(10_000 + k in got for k in range(100)) and 0 in got


def test_tables_between_steps_are_deleted(spark, tmp_path):
    from tessera.llm import common

    texts = removal_texts(7)
    df = spark.read.parquet(table(spark, tmp_path, list(enumerate(texts))) + "/documents.parquet")
    import os

    root = common.shared_folder(spark, "x").removeprefix("file://").rsplit("/", 1)[0]
    before = set(os.listdir(root))
    for f in (H.deduplicate, D.deduplicate, H.near_duplicates):
        made = common.materialised(f(df), "result")
        left = set(os.listdir(root)) - before
        assert [x.split("-")[0] for x in left] == ["result"], (f, left)
        common.discard(made)


def test_no_local_folder_on_a_cluster():
    from tessera.llm import common

    class Conf:
        def get(self, _):
            return None

    class Cluster:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Cluster()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_folder(Session(), "x")
