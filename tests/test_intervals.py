import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import intervals as algebra
from tessera.operators.intervals import IntervalFrame

FIVE = [(10, 15, 1), (9, 12, 0), (100, 150, 4), (80, 95, 2), (80, 110, 3)]
SCHEMA = "start long, end long, v int"


def frame(spark, rows, schema=SCHEMA, **columns):
    return IntervalFrame.from_rows(spark, rows, schema, **columns)


def test_order_width_length(spark):
    f = frame(spark, FIVE)
    assert [r.v for r in f.sorted().collect()] == [0, 1, 2, 3, 4]
    assert f.max_width().first()[0] == 50 and f.count() == 5 and f.first().v == 0


@pytest.mark.parametrize(("s", "e", "found"), [(10, 12, {0, 1}), (90, 105, {2, 3, 4}), (130, 140, {4}), (2, 5, set()), (21, 22, set()), (500, 675, set())])
def test_overlap(spark, s, e, found):
    assert set(frame(spark, FIVE).values(s, e, "v")) == found


@pytest.mark.parametrize(("rows", "s", "e", "n"), [([], 11, 12, 0), ([(1, 200, 0), (1, 10, 1), (18, 24, 2), (28, 32, 3), (32, 40, 4), (40, 60, 5)], 20, 30, 3), ([(r, r + 1, r) for r in range(99, -1, -1)], 0, 20, 20), ([(v, v + 10, v) for v in range(1000)], 1020, 2000, 0), ([(v, v + 1, v) for v in range(0, 100, 2)], 80, 100, 10)])
def test_overlap_sizes(spark, rows, s, e, n):
    assert frame(spark, rows).overlapping(s, e).count() == n


def test_searches_that_lose_matches_elsewhere(spark):
    assert frame(spark, [(1, 10, 0), (1, 200, 1), (18, 24, 2), (28, 32, 3), (32, 40, 4), (40, 60, 5)]).values(150, 160, "v") == [1]
    assert set(frame(spark, [(1, 200, 0), (5, 10, 1), (100, 120, 2), (130, 140, 3)]).values(110, 115, "v")) == {0, 2}


def test_chained_filters_put_and_map(spark):
    f = frame(spark, [(0, 99, 2), (0, 99, 3), (100, 199, 500), (100, 199, 700), (150, 300, 900), (350, 700, 250)])
    assert f.overlapping(0, 200).overlapping(0, 160).count() == 5
    assert f.filter("v < 300").overlapping(0, 200).count() == 2
    assert f.map_values(v=F.col("v") + 300).filter("v < 400").count() == 2
    assert f.put((100, 199, 7)).put((100, 199, 7)).overlapping(100, 101).count() == 4
    assert f.merge(f).count() == 12 and f.multiput([(1, 2, 1)]).count() == 7 and f.count() == 6
    with pytest.raises(ValueError):
        f.map_values(start=F.lit(1))


def test_partitioned_and_views(spark):
    f = frame(spark, [(v, v + 2, v) for v in range(100)])
    assert f.partitioned(5).count() == 100 and f.partitioned(5).df.rdd.getNumPartitions() == 5
    sizes = [r.n for r in f.partitioned(5).partition_sizes().collect()]
    assert sum(sizes) == 100 and max(sizes) < 60
    f.named("iv_view")
    assert spark.sql("select count(*) from iv_view").first()[0] == 100
    f.persist().unpersist()


@pytest.mark.parametrize("plane", [None, "p"])
@pytest.mark.parametrize("seed", [1, 2])
def test_join_is_brute_force(spark, plane, seed):
    r = random.Random(seed)

    def some(n):
        out = []
        for k in range(n):
            s = r.randint(-300, 300)
            out.append((s, s + r.choice([0, 0, 1, 3, 7, 40, 400, 3000]), k, r.randint(0, 2)))
        return [*out, (None, 5, n, 0), (5, None, n + 1, 0)]

    a, b = some(150), some(120)
    schema = "start long, end long, v int, p int"
    got = frame(spark, a, schema, plane=plane).join(frame(spark, b, schema, plane=plane)).select("a.v", "b.v").collect()
    want = {(x[2], y[2]) for x in a for y in b if None not in (x[0], x[1], y[0], y[1]) and x[0] < y[1] and y[0] < x[1] and (plane is None or x[3] == y[3])}
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_join_of_empty_sides(spark):
    assert frame(spark, []).join(frame(spark, FIVE)).count() == 0
    assert frame(spark, FIVE).overlap_counts(frame(spark, [(0, 1, 7), (10, 12, 8)]), "v").orderBy("v").collect() == [(7, 0), (8, 2)]


@pytest.mark.parametrize("mode", ["nearest", "floor"])
def test_nearest_is_brute_force(spark, mode):
    r = random.Random(4)
    schema = "start long, end long, v int, p int"
    rows = [(s := r.randint(-5000, 5000), s + r.choice([0, 1, 5, 60]), k, r.randint(0, 2)) for k in range(120)]
    asked = [(s := r.randint(-6000, 6000), s + r.choice([1, 5, 60]), k, r.randint(0, 3)) for k in range(150)]
    got = {x.v: x for x in frame(spark, rows, schema, plane="p").nearest(frame(spark, asked, schema, plane="p"), "v", mode).collect()}
    assert len(got) == len(asked)
    for qs, qe, k, p in asked:
        own = sorted((s, e) for s, e, _, q in rows if q == p)
        hit = [x for x in own if x[0] < qe and qs < x[1]]
        if not own:
            assert got[k].found is None
            continue
        if mode == "nearest":
            gap = lambda x: max(x[0] - qe, qs - x[1], 0)
            want = hit[0] if hit else min(own, key=lambda x: (gap(x), x))
            assert (got[k].gap) == gap(want)
        else:
            want = hit[0] if hit else max([x for x in own if x <= (qs, qe)], default=own[0])
        assert (got[k].found.s, got[k].found.e) == want, (qs, qe, p)


@pytest.mark.parametrize(("s", "e", "floor", "near"), [(2, 5, 0, 0), (21, 22, 1, 1), (500, 675, 4, 4), (70, 75, 1, 2), (10, 12, 0, 0)])
def test_nearest_of_five(spark, s, e, floor, near):
    f, q = frame(spark, FIVE), frame(spark, [(s, e, 9)])
    assert f.nearest(q, "v", "floor").first().found.v.v == floor
    assert f.nearest(q, "v", "nearest").first().found.v.v == near
    assert frame(spark, []).nearest(q, "v").first().found is None


def test_algebra(spark):
    row = spark.range(1)
    one = lambda c: row.select(c).first()[0]
    i = lambda *x: tuple(F.lit(y) for y in x)
    assert not one(algebra.overlaps(i(0, 5), i(5, 9))) and one(algebra.overlaps(i(0, 10), i(5, 5))) and not one(algebra.overlaps(i(0, 5), i(0, 0)))
    assert one(algebra.covers(i(0, 5, 1, "+"), i(1, 2, 1, "-"))) and not one(algebra.overlaps(i(0, 5, 1, "+"), i(1, 2, 1, "-")))
    assert one(algebra.distance(i(0, 5), i(5, 9))) == 0 and one(algebra.distance(i(0, 5), i(8, 9))) == 3
    assert one(algebra.distance(i(0, 5, 1), i(8, 9, 2))) is None
    assert one(algebra.compare(i(0, 5), i(0, 6))) == -1 and one(algebra.compare(i(1, 5), i(0, 6))) == 1 and one(algebra.compare(i(1, 5), i(1, 5))) == 0


def test_stream(spark, tmp_path):
    from tessera.streaming import join_batches, overlapping

    frame(spark, FIVE).df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = overlapping(stream, 90, 105).writeStream.format("memory").queryName("near").start()
    q.processAllAvailable()
    q.stop()
    assert {r.v for r in spark.table("near").collect()} == {2, 3, 4}
    seen = []
    q = join_batches(stream, frame(spark, [(0, 11, 7)]), lambda df, k: seen.extend(df.select("a.v", "b.v").collect())).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(x) for x in seen} == {(1, 7), (0, 7)}


def brute_look_ups(entries, queries):
    """Hits, lowest start, nearest and floor of (start, end, plane) lists, by comparing all."""
    out = {}
    for k, (qs, qe, p) in queries.items():
        known = [x for x in entries if None not in x and x[2] == p] if p is not None else []
        fine = [x for x in known if x[0] <= x[1]]
        bound = None not in (qs, qe)
        hit = [x for x in fine if bound and qs <= qe and x[0] < qe and qs < x[1]]
        gap = lambda x: max(x[0] - qe, qs - x[1], 0)
        near = min(hit)[:2] if hit else None
        if bound and not hit:
            left = [x for x in known if x[1] <= qs]
            right = [x for x in known if x[0] >= qe]
            a = max(left, key=lambda x: (x[1], -x[0]))[:2] if left else None
            b = min(right)[:2] if right else None
            near = a if a and (not b or qs - a[1] <= b[0] - qe) else b
        before = [x[:2] for x in known if bound and x[:2] <= (qs, qe)]
        floor = (min(hit)[:2] if hit else max(before) if before else min(known)[:2] if known else None) if bound else None
        out[k] = (len(hit), min(hit)[0] if hit else None, near, floor)
    return out


@pytest.mark.parametrize("parts", [(50_000, 1000), (40, 7)])
def test_look_ups_along_the_line(spark, monkeypatch, parts):
    from tessera.operators import intervals

    monkeypatch.setattr(intervals, "NEAR_ROWS", parts[0])
    monkeypatch.setattr(intervals, "NEAR_CUTS", parts[1])
    r = random.Random(4)
    at = lambda: r.choice([r.randint(-60, 60), 7])

    def interval():
        a = at()
        return (a, a + r.choice([0, 0, 1, 2, 5, 40]), r.choice([1, 1, 1, 2, 3]))

    entries = [interval() for _ in range(400)] + [(None, 3, 1), (3, None, 1), (1, 4, None), (9, 2, 2)]
    queries = dict(enumerate([*(interval() for _ in range(300)), *([(7, 12, 1)] * 50), (None, 3, 1), (3, None, 1), (1, 4, None), (9, 2, 4), (1, 4, 9)]))
    frame = IntervalFrame.from_rows(spark, entries, "start long, end long, plane long", plane="plane")
    asked = IntervalFrame.from_rows(spark, [(k, *q) for k, q in queries.items()], "k long, start long, end long, plane long", plane="plane")
    want = brute_look_ups(entries, queries)
    got = {x.k: (x.hits, x.first_start) for x in frame.overlap_counts(asked, "k", first=True).collect()}
    assert got == {k: w[:2] for k, w in want.items()}
    for mode, j in (("nearest", 2), ("floor", 3)):
        found = {x.k: (x.found.s, x.found.e) if x.found else None for x in frame.nearest(asked, "k", mode).collect()}
        assert found == {k: w[j] for k, w in want.items()}, mode


def test_counts_of_no_entries_no_queries_and_one_key(spark):
    none = IntervalFrame.from_rows(spark, [], "k long, start long, end long")
    some = IntervalFrame.from_rows(spark, [(1, 0, 5), (1, 2, 3), (None, 4, 9)], "k long, start long, end long")
    assert none.overlap_counts(none, "k").count() == none.nearest(none, "k").count() == 0
    assert sorted(map(tuple, none.overlap_counts(some, "k").collect()), key=str) == [(1, 0), (1, 0), (None, 0)]
    assert sorted(map(tuple, some.overlap_counts(some, "k").collect()), key=str) == [(1, 5), (1, 5), (None, 2)]
    assert all(x.found is None and x.gap is None for x in none.nearest(some, "k").collect())
