"""Class n-grams: counts and base score by brute force, the clustering's likelihood, and a proper distribution."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import class_lm as L

from .test_tokens import TEXTS, table


def likelihood(m, of):
    n = max(of) + 1
    big = np.zeros((n, n))
    for a in range(len(m)):
        for b in range(len(m)):
            big[of[a], of[b]] += m[a, b]
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()
    return f(big.ravel()) - f(big.sum(0)) - f(big.sum(1))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exchange_raises_the_likelihood(seed):
    rng = np.random.default_rng(seed)
    m = rng.poisson(rng.gamma(0.3, 4.0, (12, 12))).astype(np.int64)
    fixed = [3, 4]
    of, big = L.exchange(m, 10, 3, fixed)
    start = [k % 3 for k in range(10)] + fixed
    assert likelihood(m, of) >= likelihood(m, start) - 1e-9
    assert of[10:].tolist() == fixed
    for w in range(10):  # no single move is better
        for c in range(3):
            other = of.copy()
            other[w] = c
            assert likelihood(m, other) <= likelihood(m, of) + 1e-6
    want = np.zeros_like(big)
    for a in range(12):
        for b in range(12):
            want[of[a], of[b]] += m[a, b]
    assert (big == want).all()


def test_exchange_finds_planted_classes():
    m = np.zeros((8, 8), np.int64)
    for a in range(8):
        for b in range(8):
            m[a, b] = 50 if (a < 4) != (b < 4) else 1
    of, _ = L.exchange(m, 8, 2, [])
    assert len(set(of[:4].tolist())) == 1 and len(set(of[4:].tolist())) == 1 and of[0] != of[7]


def test_ranks():
    got = L.classes_by_rank(1000, 10, 4)
    assert got[0][0] == 10 and got[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(got, got[1:])) and L.classes_by_rank(5, 5, 2) == []


def test_frequent_words(spark):
    df = spark.createDataFrame([(b"w%d" % k, k) for k in range(1, 200)], "word binary, c long")
    assert L.frequent_words(df, 1000) == [(b"w%d" % k, k) for k in range(199, 4, -1)]
    assert L.frequent_words(df, 10) == [(b"w%d" % k, k) for k in range(199, 189, -1)]
    assert L.frequent_words(df.limit(0), 10) == []


def corpus():
    r = random.Random(1)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    out = []
    for k in range(400):
        words = []
        for _ in range(r.randint(0, 25)):
            words += [r.choice(nouns).upper() if r.random() < 0.2 else r.choice(nouns), r.choice(verbs)]
        if r.random() < 0.5:
            words.append(f"rare{r.randrange(500)}")
        out.append(" \n".join(words))
    return out


@pytest.mark.parametrize("sizes", [{}, {"frequent": 20, "clustered": 12, "classes": 4}, {"frequent": 61, "clustered": 60, "classes": 2}])
def test_scores(spark, tmp_path, sizes):
    rows = [*enumerate(TEXTS + corpus()), (None, "n1 v1"), (3, "n1 V1")]
    df = spark.read.parquet(table(spark, tmp_path, rows) + "/documents.parquet")
    got = L.score(df, **sizes).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    c = collections.Counter(w for i, t in rows if not out(i) for w in words(t))
    ends = sum(not out(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = []
    for i, t in rows:
        w = words(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        want.append((str(i), out(i), len(w) + 1, sum(x in c for x in w) + 1, n, round(base, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    tokens = sum(r.n_tokens for r in got if r.held_out)
    model, base = (sum(getattr(r, k) for r in got if r.held_out) / tokens for k in ("score", "base_score"))
    assert all(r.score <= 0 for r in got)
    if sizes.get("clustered") == 60:  # two classes of words that take turns
        assert model > base + 0.2


def test_probabilities_add_up(spark, tmp_path):
    """Over all texts of at most one word: seen words, one unseen, and none; what is left is that of longer texts."""
    seen = {w for t in corpus() for w in t.lower().split()}
    texts = [*enumerate(corpus()), (10_000, "")] + [(10_001 + k, w) for k, w in enumerate(sorted(seen) + ["never seen".split()[0] + "x"])]
    train = [(i, t) for i, t in texts if i < 10_000]
    df = spark.read.parquet(table(spark, tmp_path, [(i if i < 10_000 else held(i), t) for i, t in texts]) + "/documents.parquet")
    got = {(r.doc_id): r.score for r in L.score(df, frequent=40, clustered=20, classes=4).collect()}
    short = sum(10 ** got[held(i)] for i, _ in texts if i >= 10_000)
    assert 0 < short < 1 and len(train) == 400


def held(i):
    """A number that is held out, for each i."""
    k = i * 1000
    while zlib.crc32(str(k).encode()) % 7 != 2:
        k += 1
    return k


def test_empty_and_untrained(spark, tmp_path):
    assert L.op3_class_ngram_lm(spark, table(spark, tmp_path / "a", [])).count() == 0
    (r,) = L.op3_class_ngram_lm(spark, table(spark, tmp_path / "b", [(held(1), "a b")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)


def test_words_beyond_the_seeds_are_clustered(spark, tmp_path):
    """Nouns and verbs take turns; most of them are no seeds, most not even in the dictionary."""
    df = spark.read.parquet(table(spark, tmp_path, list(enumerate(corpus()))) + "/documents.parquet")
    for sizes in ({"frequent": 61, "clustered": 12, "classes": 2}, {"frequent": 20, "clustered": 12, "classes": 2}):
        got = [r for r in L.score(df, **sizes).collect() if r.held_out]
        assert sum(r.score - r.base_score for r in got) / sum(r.n_tokens for r in got) > 0.2


def test_place_is_the_best_class():
    rng = np.random.default_rng(4)
    big = rng.poisson(9, (6, 6))
    out, inn = rng.poisson(3, 6), rng.poisson(3, 6)
    f = lambda x: (x[x > 0] * np.log(x[x > 0])).sum()

    def value(t):
        m = big.copy()
        m[t] += out
        m[:, t] += inn
        return f(m.ravel()) - f(big.sum(0) + inn.sum() * (np.arange(6) == t)) - f(big.sum(1) + out.sum() * (np.arange(6) == t))

    got = L.place(big.astype(float), 4, (np.arange(6), out.astype(float)), (np.arange(6), inn.astype(float)))
    assert got == max(range(4), key=value)


def test_exchange_of_all_words_is_the_best_single_move():
    """Against the likelihood itself, of a word taken out of its class; no word is beside itself."""
    rng = np.random.default_rng(7)
    n, k = 14, 5
    for _ in range(20):
        m = rng.poisson(rng.gamma(0.4, 4.0, (n, n)))
        np.fill_diagonal(m, 0)
        of = rng.integers(0, k, n)
        of[-1] = k  # the end
        big = np.zeros((k + 1, k + 1))
        np.add.at(big, (of[:, None], of[None]), m)
        owner, key, times = [], [], []
        for w in range(n - 1):
            for c in range(k + 1):
                for j, got in ((c, m[of == c, w].sum()), (c + k + 1, m[w, of == c].sum())):
                    if got:
                        owner.append(w), key.append(j), times.append(got)
        got = L.place_all(big, k, np.array(owner), np.array(key), np.array(times, float), n - 1, of[:-1])
        for w in range(n - 1):
            moved = lambda c: [*of[:w].tolist(), c, *of[w + 1 :].tolist()]  # noqa: E731, B023
            assert likelihood(m, moved(int(got[w]))) >= max(likelihood(m, moved(c)) for c in range(k)) - 1e-6


def test_exchange_moves_words_of_any_rank_and_lowers_perplexity(spark, tmp_path):
    """2,400 words of two kinds that take turns, of which 1,024 are seeds, and four in five of the others start elsewhere."""
    r = random.Random(9)
    words = [[f"{x}{k}" for k in range(1200)] for x in "nv"]
    texts = [" ".join(r.choice(words[j % 2]) for j in range(r.randint(2, 60))) for _ in range(1500)]
    df = spark.read.parquet(table(spark, tmp_path, list(enumerate(texts))) + "/documents.parquet")
    mean = {}
    for n in (0, 2):
        got = [x for x in L.score(df, classes=4, rounds=1, exchanges=n).collect() if x.held_out]
        assert all(abs(x.perplexity - 10 ** (-x.score / x.n_tokens)) <= 1e-6 * x.perplexity for x in got)
        mean[n] = sum(x.score for x in got) / sum(x.n_tokens for x in got)
    assert mean[2] >= mean[0]


@pytest.mark.parametrize("pairs", [1, 7, 1 << 15])
def test_rows_of_a_word_are_summed_wherever_batches_end(spark, monkeypatch, pairs):
    monkeypatch.setattr(L, "PAIRS", pairs)
    r = np.random.default_rng(3)
    big = r.poisson(9, (6, 6)).astype(float)
    rows, sums = [], collections.defaultdict(lambda: np.zeros(13))
    for _ in range(400):
        i = int(r.integers(-1, 12))
        word = b"w%d" % r.integers(0, 9) if i < 0 else None
        key = np.sort(r.choice(13, int(r.integers(1, 6)), False))
        n = r.integers(1, 5, len(key))
        sums[i, word][key] += n
        packed = np.empty(len(key), L.PAIR)
        packed["key"], packed["n"] = key, n
        rows.append((i, word, int(n[(key < 6) | (key == 12)].sum()), bytearray(packed.tobytes())))

    class Sent:
        value = (big, np.arange(12) % 4)

    df = spark.createDataFrame(rows, "id long, word binary, c long, pairs binary")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(x.id, x.word and bytes(x.word)): (x.c, x["class"]) for x in L._placed(df, 4, Sent, 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for (i, word), s in sums.items():
        c = int(s[:6].sum() + s[12])
        if c >= 3:
            key = np.flatnonzero(s[:12])
            want[i, word] = (c, int(L.place_all(big, 4, np.zeros(len(key), np.int64), key, s[key], 1, np.array([i % 4 if i >= 0 else -1]))[0]))
    assert got == want
