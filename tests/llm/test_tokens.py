"""Token operators against the tokenizers library."""

import bisect
import hashlib
import io
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tessera.llm import attribution as A
from tessera.llm import bitplanes as B
from tessera.llm import bpe_tree as T
from tessera.llm import common
from tessera.llm import packing as P
from tessera.llm.chunks import Chunked, byte_ids, load, word_ids

WORD, BYTE = common.tokenizer_path("word_bpe_49k.json"), common.tokenizer_path("byte_bpe_50k.json")
PARTS = ["the ", "Of, ", "\n", "é", "漢", " ", "'s", "'LL ", "12", "\t", ".", ",", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "x\x01y", "\x02", "\x04", "ſ", "İ", "Σς", "é", "́", "\xa0", "　", "\r\n", "👍", "ǅ", "²", "thatthtieror", "aab"]
TEXTS = [None, "", " ", "\n", "a\n\nb\n", " a  b   \n\n x<|endoftext|> y\t\n", "One two, three.", "One two, three.", "the end " * 3000, "a" * 5000, "\x00", "ünïcödé ßtraße"]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def table(spark, path, rows, schema="doc_id long, text string", parts=3):
    """Documents in files, with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).repartition(parts)
    df = df.withColumns({"uid": F.lit(1), "ids": F.lit("x"), "n_tokens": F.lit(2), "start": F.lit(3), "key": F.lit(None).cast("string"), "row": F.lit(5)})
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def word():
    return load(WORD)


@pytest.fixture(scope="module")
def byte():
    return load(BYTE)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=30).map("".join)))
def test_chunks_are_the_library(word, byte, text):
    raw = text.encode("utf-8", "surrogatepass").decode("utf-8", "replace").encode()
    for encode, t in ((word_ids(WORD), word), (byte_ids(BYTE), byte)):
        assert np.frombuffer(encode([raw])[0], "<u4").tolist() == t.encode(raw.decode(), add_special_tokens=False).ids


def test_cache_stays_bounded(word):
    calls = []
    c = Chunked(lambda xs: (calls.append(len(xs)), [x.encode() for x in xs])[1], [], limit=5)
    for k in range(50):
        got = c.look_up([[b"w%d" % k, b"same"]], bytes.decode)
        assert got == [[b"w%d" % k, b"same"]] and len(c.cache) <= 10


# --- op1


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 100, 1000])
def test_planes_round_trip(kind, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = B.split_planes(ids, kind)
    assert len(planes) == (4 if kind == "byte" else 32) and (B.join_planes(planes, n, kind) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_file_round_trip(kind):
    class Sink(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    rng = np.random.default_rng(1)
    docs = [(k if k % 5 else None, rng.integers(0, 50_000, n, dtype=np.uint32).tobytes()) for k, n in enumerate([0, 1, 63, 64, 65, 1000, 3, 0])]
    s = Sink()
    w = B.Writer(s, kind, block=64)
    for d in docs:
        w.add(*d)
    assert w.close() == (8, sum(len(x) // 4 for _, x in docs))
    assert list(B.read_documents(io.BytesIO(s.kept), len(s.kept))) == docs
    assert sum(b[0] for b in B.read_index(io.BytesIO(s.kept), len(s.kept))["blocks"]) == 1196
    with pytest.raises(ValueError):
        B.read_index(io.BytesIO(b"x" * 40), 40)
    with pytest.raises(ValueError):
        B.Writer(Sink(), "nibble")


def test_op1(spark, tmp_path, word):
    rows = [(i * 13 % 401, t) for i, t in enumerate(TEXTS + texts(150, 2))] + [(None, "null id"), (7, "again"), (7, "again")]
    got = B.op1_bit_plane_tokens(spark, table(spark, tmp_path, rows)).collect()
    encode = lambda t: np.array([*word.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((i is not None, i or 0, len(x := encode(t)) // 4, zlib.crc32(x)) for i, t in rows)
    at = 0
    order = sorted(got, key=lambda r: r.start)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in order][1:] == sorted(i for i, _ in rows if i is not None) and order[0].doc_id is None


def test_op1_read_tokens(spark, tmp_path, word):
    df = spark.read.parquet(table(spark, tmp_path, [(1, "a b"), (2, None)]) + "/documents.parquet")
    files = B.write_tokens(df, f"file://{tmp_path}/planes", WORD, kind="bit", block=2)
    got = B.read_tokens(spark, files).orderBy("doc_id").collect()
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got] == [[*word.encode("a b", add_special_tokens=False).ids, 1], [1]]


# --- op6


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=20).map("".join)))
def test_tree_bpe_is_the_library(word, text):
    text = text.encode("utf-8", "replace").decode()
    bpe = bpe_of()
    ids = word.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == ids and bpe.decode(ids) == word.decode(ids, skip_special_tokens=False)


_BPE = []


def bpe_of():
    if not _BPE:
        _BPE.append(T.TreeBpe(WORD))
    return _BPE[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=90), min_size=1, max_size=20), st.permutations(range(8)))
def test_forest_and_tree_are_greedy_merges(words, order):
    """Against plain repeated merging, with many ties and overlapping pairs."""
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1), (3, 0), (0, 3), (3, 3), (4, 2)]
    ranked = [(*pairs[k], 3 + k) for k in order]
    m = T.Merger([(a, b, c) for a, b, c in ranked], 12)

    def plain(s):
        while True:
            found = [(r, i) for r, (a, b, _) in enumerate(ranked) for i in range(len(s) - 1) if (s[i], s[i + 1]) == (a, b)]
            if not found:
                return s
            r, i = min(found)
            s = [*s[:i], ranked[r][2], *s[i + 2 :]]

    for w in words:
        s = ["abc".index(c) for c in w]
        want = plain(s)
        assert m.one(s) == want
        if len(s) > 1:
            width = 1 << (len(s) - 1).bit_length()
            row = m.forest(np.array([s + [-1] * (width - len(s))]))[0]
            assert row[row >= 0].tolist() == want


def test_op6(spark, tmp_path, word):
    rows = list(enumerate(TEXTS + texts(200, 3)))
    got = {r.doc_id: r for r in T.op6_segment_tree_bpe(spark, table(spark, tmp_path, rows)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for i, t in rows:
        ids = word.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(word.decode(ids, skip_special_tokens=False)))


# --- op7


@pytest.mark.parametrize("rule", A.RULES)
def test_op7_rules(spark, tmp_path, byte, rule):
    rows = list(enumerate(TEXTS + texts(150, 4)))
    df = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    got: dict = {}
    for r in A.token_counts(df, BYTE, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.start, r.end, r.n_tokens)
    for i, t in rows:
        t = t or ""
        edges = [0, *(k + 1 for k, c in enumerate(t) if c == "\n"), len(t)]
        if len(edges) > 2 and edges[-1] == edges[-2]:
            edges.pop()
        want = [0] * (len(edges) - 1)
        for s, e in byte.encode(t, add_special_tokens=False).offsets:
            last = max(e - 1, s)
            if rule == "most":
                held = [min(e, b) - max(s, a) for a, b in zip(edges, edges[1:])]
                k = held.index(max(held))
            else:
                k = min(len(want) - 1, bisect.bisect_right(edges, s if rule == "start" else last) - 1)
            want[k] += 1
        assert [got[i][k] for k in range(len(want))] == list(zip(edges, edges[1:], want)) and len(got[i]) == len(want)


def test_op7_query_and_given_edges(spark, tmp_path, byte):
    d = table(spark, tmp_path, [(1, "ab cd ef"), (2, None)])
    assert A.op7_token_attribution(spark, d).count() == 2
    df = spark.createDataFrame([(1, "ab cd ef", [0, 2, 8])], "doc_id long, text string, e array<long>")
    assert [(r.start, r.end) for r in A.token_counts(df, BYTE, edges="e").orderBy("section").collect()] == [(0, 2), (2, 8)]
    with pytest.raises(ValueError):
        A.token_counts(df, BYTE, "half")


# --- op10


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 10))
def test_best_fit_is_plain_best_fit(lengths, most):
    fit, bins, opened = P.BestFit(64, most), [], []
    for n in lengths:
        fits = [b for b in opened if 64 - bins[b] >= n]
        got, offset = fit.place(n)
        if fits:
            assert 64 - bins[got] == min(64 - bins[b] for b in fits) and got in fits
        else:
            assert got == len(bins)
            bins.append(0)
            opened.append(got)
        assert offset == bins[got]
        bins[got] += n
        if bins[got] == 64:
            opened.remove(got)
        elif len(opened) > most:
            fullest = max(bins[b] for b in opened)
            closed = next(b for b in opened if bins[b] == fullest and b not in {x for v in fit.by_free.values() for x in v})
            opened.remove(closed)
        assert len(opened) <= most


@given(st.integers(1, 9000))
def test_cut(n):
    got = P.cut(n, 2048)
    assert sum(x for _, x in got) == n and [s for s, _ in got] == [sum(x for _, x in got[:k]) for k in range(len(got))]
    assert all(x == 2048 for _, x in got[1:]) and 0 < got[0][1] <= 2048
    with pytest.raises(ValueError):
        P.BestFit(5, 1).place(6)


def test_op10(spark, tmp_path, byte):
    rows = [*enumerate(TEXTS + texts(150, 5)), (3, "again"), (None, "null id")]
    got = P.op10_best_fit_packing(spark, table(spark, tmp_path, rows)).collect()
    ids = {(i, t): [*byte.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces = sorted((str(i), k, s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for (i, _), x in ids.items() for k, (s, n) in enumerate(P.cut(len(x), 2048)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048
    assert len(by) <= -(-sum(p[3] for p in pieces) // 2048) + 2


def test_empty_tables(spark, tmp_path):
    d = table(spark, tmp_path, [])
    for f in (B.op1_bit_plane_tokens, T.op6_segment_tree_bpe, A.op7_token_attribution, P.op10_best_fit_packing):
        df = f(spark, d)
        assert df.count() == 0 and "doc_id" in df.columns


def test_op1_rows_of_one_doc_id_have_one_order(spark, tmp_path, word):
    rows = [(7, t) for t in texts(40, 9)] + [(None, "a b"), (None, None)] + [(k, "x") for k in range(20)]
    d = table(spark, tmp_path / "a", rows)
    e = table(spark, tmp_path / "b", rows[::-1])
    files = lambda x: [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in B.op1_bit_plane_tokens(spark, x).collect()]
    order = lambda x: sorted(x, key=lambda r: r[1])
    assert order(files(d)) == order(files(e))


def test_op7_edges_that_do_not_cover_the_text(spark, byte):
    df = spark.createDataFrame(
        [(1, "ab cd ef", [5, 2]), (2, "ab cd ef", []), (3, "ab\ncd", None), (4, "ab cd ef", [-3, 0, 2, 2, 8, 99, None]), (5, "", [1, 2]), (6, None, None), (None, "é漢x", [1])],
        "doc_id long, text string, e array<long>",
    )
    got: dict = {}
    for r in A.token_counts(df, BYTE, edges="e").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens))
    cuts = {k: [(s, e) for _, s, e, _ in sorted(v)] for k, v in got.items()}
    assert cuts == {1: [(0, 2), (2, 5), (5, 8)], 2: [(0, 8)], 3: [(0, 3), (3, 5)], 4: [(0, 2), (2, 8)], 5: [(0, 0)], 6: [(0, 0)], None: [(0, 1), (1, 3)]}
    for k, t in ((1, "ab cd ef"), (2, "ab cd ef"), (3, "ab\ncd"), (4, "ab cd ef"), (5, ""), (None, "é漢x")):
        offsets = byte.encode(t, add_special_tokens=False).offsets
        assert [n for *_, n in sorted(got[k])] == [sum(s <= o < e for o, _ in offsets) for s, e in cuts[k]]


def test_op10_columns_of_its_own_names_are_replaced(spark):
    df = spark.createDataFrame([(60, "a", 1.5), (5, "b", 2.5), (4, "c", 3.5)], "length long, sequence_id string, offset double").withColumn("__t", F.lit("x"))
    got = P.pack(df, capacity=64)
    assert got.columns == ["length", "__t", "sequence_id", "offset"] and sorted((r.length, r.offset, r["__t"]) for r in got.collect()) == [(4, 60, "x"), (5, 0, "x"), (60, 0, "x")]


def test_the_cache_follows_a_setting(spark):
    from tessera.llm import common

    assert common.cached_chunks(spark) == common.CACHE_MB * 4096
    spark.conf.set("spark.tessera.chunkCacheMb", "2")
    try:
        assert common.cached_chunks(spark) == 8192
    finally:
        spark.conf.unset("spark.tessera.chunkCacheMb")


def test_batch_sizes_of_the_session_are_left_alone(spark):
    from tessera.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, own = spark.conf.get(name, None), getattr(spark, "_tessera_rows", None)
    try:
        spark.conf.set(name, "123")
        spark._tessera_rows = None
        common.tune(spark)
        assert spark.conf.get(name) == "123"
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
        spark._tessera_rows = own
