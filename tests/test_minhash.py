import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import minhash as M


def java_hash(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def test_hash_family_is_the_jvms(spark):
    r = spark._jvm.java.util.Random(1)
    assert M.hash_family(20, 1) == [r.nextInt() for _ in range(20)]
    with pytest.raises(ValueError):
        M.hash_family(0, 1)


def test_shingles_and_signatures(spark):
    texts = ["", "a", "abcd", "abcde", "abcdef", "éàü漢字x", "the quick brown fox", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    seeds = M.hash_family(16, 3)
    native = {r.id: r for r in df.where("t is not null").select("id", M.shingle_hashes(F.col("t"), 5).alias("h"), M.signature(M.shingle_hashes(F.col("t"), 5), seeds).alias("s")).collect()}
    arrow = {r.id: r.sig for r in M.text_signatures(df, "id", "t", 5, seeds).collect()}
    for i, t in enumerate(texts[:-1]):
        want = [java_hash(t[k : k + 5]) for k in range(len(t) - 4)] or [java_hash(t)]
        assert native[i].h == want
        assert native[i].s == arrow[i] == [min(h ^ s for h in want) for s in seeds]
    assert arrow[7] == arrow[0]
    empty = df.limit(1).select(M.signature(F.array().cast("array<int>"), seeds).alias("s")).first().s
    assert empty == [M.INT_MAX] * 16


@pytest.mark.parametrize(("b", "sim"), [([0, 1, 2, 3], 1), ([0, 1, 2, 5], 0.75), ([1, 1, 2, 0], 0.5), ([1, 0, 0, 3], 0.25), ([3, 2, 1, 0], 0)])
def test_similarity(spark, b, sim):
    df = spark.createDataFrame([([0, 1, 2, 3], b)], "a array<int>, b array<int>")
    assert df.select(M.similarity(F.col("a"), F.col("b"))).first()[0] == sim


def test_bands(spark):
    df = spark.createDataFrame([([0, 1, 2, 3], [9, 9, 2, 3], [9, 9, 9, 9])], "a array<int>, b array<int>, c array<int>")
    assert [(x.band, x.keys) for x in df.select(M.bands(F.col("a"), 2, 4)).first()[0]] == [(0, [0, 1]), (1, [2, 3])]
    assert df.select(M.first_band(F.col("a"), F.col("b"), 2, 4)).first()[0] == 1
    assert df.select(M.first_band(F.col("a"), F.col("c"), 2, 4)).first()[0] == -1
    with pytest.raises(ValueError):
        M.bands(F.col("a"), 13, 500)


def test_exact_and_banded(spark):
    r = random.Random(0)
    text = "".join(r.choice("ACGT") for _ in range(2000))
    rows = [(k, text[100 * k : 100 * k + 1000]) for k in range(11)] + [(11, text[:1000])]
    seeds = M.hash_family(500, 1)
    sigs = M.text_signatures(spark.createDataFrame(rows, "id int, t string"), "id", "t", 15, seeds).persist()
    exact = {(x.id_a, x.id_b): x.sim for x in M.exact_pairs(sigs, "id").collect()}
    assert len(exact) == 144
    grams = [{t[i : i + 15] for i in range(len(t) - 14)} for _, t in rows]
    for (a, b), s in exact.items():
        assert abs(s - len(grams[a] & grams[b]) / len(grams[a] | grams[b])) < 0.1
    before = 10**9
    for n in (100, 50, 25, 20, 10):
        pairs = M.lsh_pairs(sigs, "id", n, 500).collect()
        assert len({(p.id_a, p.id_b) for p in pairs}) == len(pairs) <= before
        assert all(exact[p.id_a, p.id_b] == p.sim and p.id_a < p.id_b for p in pairs)
        before = len(pairs)
    assert {x.id: x.class_id for x in M.membership(sigs, "id").collect()}[11] == 0
    jac = {(x.id_a, x.id_b): x.jaccard for x in M.jaccard(spark.createDataFrame([(k, sorted(g)) for k, g in enumerate(grams)], "id int, s array<string>"), "id", "s").collect()}
    assert abs(jac[0, 1] - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < 1e-12


def test_dataset_signature(spark):
    seeds = M.hash_family(8, 1)
    df = spark.createDataFrame([(x,) for x in (5, -7, 123456)], "h int")
    assert M.dataset_signature(df, F.col("h"), seeds).first().sig == [min(h ^ s for h in (5, -7, 123456)) for s in seeds]
    assert all(x <= 0 for x in M.dataset_signature(df, F.col("h"), seeds, zero_init=True).first().sig)
    assert M.dataset_signature(df.limit(0), F.col("h"), seeds).first().sig == [M.INT_MAX] * 8
    assert M.dataset_signature(df, F.col("h"), seeds).select(M.to_vector(F.col("sig"))).first()[0].size == 8


def test_a_band_that_many_classes_share_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    rows = [(k, [1, 2, k % 7, k]) for k in range(60)] + [(100 + k, [9 + k, k, 3, 4]) for k in range(9)]
    df = spark.createDataFrame(rows, "id long, sig array<int>")
    got = sorted((x.id_a, x.id_b, x.sim) for x in M.lsh_pairs(df, "id", 2, 4).collect())
    want = []
    for i, a in rows:
        for j, b in rows:
            if i < j and (a[:2] == b[:2] or a[2:] == b[2:]):
                want.append((i, j, sum(x == y for x, y in zip(a, b)) / 4))
    assert got == sorted(want)
