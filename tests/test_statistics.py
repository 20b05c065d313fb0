import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import statistics as T
from tessera.operators.mixture import Component, PoissonMixture


def test_mean_variance_z(spark):
    df = spark.createDataFrame([(float(x),) for x in (3, 4, 5, 4, 5, 3, 2, 6)], "v double")
    assert tuple(T.mean_variance(df, "v").first()) == (4.0, 1.5)
    same = spark.createDataFrame([(3.0,)] * 5, "v double")
    assert T.mean_variance(same, "v").first().variance == 0 and T.z_score(same, "v").first().z is None
    z = T.z_score(spark.createDataFrame([(-2.0, 1), (0.0, 2), (0.0, 3), (2.0, 4)], "v double, p int"), "v").orderBy("p").collect()
    assert [round(r.z, 9) for r in z] == [round(x, 9) for x in (-math.sqrt(2), 0, 0, math.sqrt(2))]
    groups = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0)], "g string, v double")
    assert sorted(r.z for r in T.z_score(groups, "v", ["g"]).collect()) == [-1.0, -1.0, 1.0, 1.0]
    assert T.z_score(df.limit(0), "v").count() == 0


def test_assign(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 5, 6, 10, 100)], "v double")
    assert [r[0] for r in df.select(T.assign(F.col("v"), [0.0, 10.0])).collect()] == [0, 0, 1, 1, 1]
    got = {r.cluster: r for r in T.cluster_stats(df, "v", [0.0, 10.0]).collect()}
    assert got[0].n == 2 and abs(got[0].sigma - math.sqrt(12.5)) < 1e-9 and got[1].weight == 0.6
    with pytest.raises(ValueError):
        T.assign(F.col("v"), [2.0, 1.0])


def test_m_step(spark):
    rows = spark.createDataFrame([([1.0, 0.0, 0.0], 1, 1), ([0.0, 1.0, 0.0], 2, 1), ([0.0, 0.0, 1.0], 3, 1), ([float("nan"), 0.0, 0.0], 9, 1)], "m array<double>, value long, cnt long")
    got = PoissonMixture().m_step(rows, 3)
    assert [c.rate for c in got] == [1, 2, 3] and all(abs(c.weight - 1 / 3) < 1e-12 for c in got)


def test_fit(spark):
    r = random.Random(4321)
    rows = [(max(0, int(r.gauss(m, 1))),) for m in (5, 50) for _ in range(5000)]
    got = PoissonMixture().fit(spark.createDataFrame(rows, "v int"), "v", 2, 25)
    assert abs(got[0].rate - 5) <= 1 and abs(got[1].rate - 50) <= 1 and abs(got[0].weight - 0.5) < 0.05
    with pytest.raises(ValueError):
        PoissonMixture().fit(spark.createDataFrame([], "v int"), "v", 2, start=[Component(1.0, 1.0)])


def test_e_step(spark):
    model = PoissonMixture()
    hist = model.histogram(spark.createDataFrame([(3,), (3,), (None,), (0,)], "v int"), "v")
    got = {r.value: r for r in model.e_step(hist, [Component(2.0, 0.25), Component(6.0, 0.75)]).collect()}
    assert got[3].cnt == 2 and len(got) == 2
    p = [w * math.exp(-x) * x**3 / 6 for x, w in ((2.0, 0.25), (6.0, 0.75))]
    assert abs(got[3].m[0] - p[0] / sum(p)) < 1e-12
    assert abs(got[3].ecll - sum(q / sum(p) * math.log(q) for q in p)) < 1e-9


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    d = lambda x: F.lit(float(x))
    for a, b, same in ((0, 0, True), (1e-6, 1e-7, True), (1e-6, 0, True), (1, 0, False), (1e-6, 1e6, False), (1e-5, 0, False)):
        assert one(S.fp_equals(d(a), d(b))) is same
    assert one(S.fp_equals(d("nan"), d("nan"))) is False and one(S.fp_equals(d("inf"), d("inf"))) is False
    assert [one(S.factorial(F.lit(x))) for x in (5, 1, 0, -3, 20, 21)] == [120, 1, 1, 1, math.factorial(20), None]
    assert abs(one(S.safe_log(d(2))) - math.log(2)) < 1e-12 and one(S.safe_log(d(0), 0.0)) == 0 and one(S.safe_log(d("nan"))) == -1e5 and one(S.safe_log(d("inf"))) == -1e5
    arr = lambda *x: F.array(*map(d, x))
    assert one(S.add_arrays(arr(0, 1, 2), arr(1, -1, -3))) == [1, 0, -1]
    assert one(S.normalise(arr(3, 2, 5, 0))) == [0.3, 0.2, 0.5, 0] and one(S.normalise(arr(0, 0))) == [None, None]
    assert one(S.scale_array(2, arr(0, 1, -2))) == [0, 2, -4]
    hot = spark.createDataFrame([([1.0 if i == k else 0.0 for i in range(20)],) for k in range(20)], "a array<double>")
    assert S.sum_arrays(hot, "a").first().total == [1.0] * 20
    for v in (0, 1, 2, 10):
        assert abs(one(S.poisson_log_pmf(F.lit(v), 3.0)) - (v * math.log(3) - 3 - math.lgamma(v + 1))) < 1e-9


def test_log_factorial_of_any_size(spark):
    values = [0, 1, 2, 10, 63, 64, 65, 200, 10**6, 10**9, 10**15]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long").withColumn("f", S.log_factorial(F.col("v")))
    got = {r.v: r.f for r in df.collect()}
    assert all(abs(got[v] - math.lgamma(v + 1)) <= 1e-12 * max(1, math.lgamma(v + 1)) for v in values) and got[None] is None


def test_values_far_from_all_components_take_part(spark):
    model = PoissonMixture()
    hist = model.histogram(spark.createDataFrame([(3,), (5000,)], "v int"), "v")
    (far,) = [r for r in model.e_step(hist, [Component(2.0, 0.5), Component(6.0, 0.5)]).collect() if r.value == 5000]
    log = lambda x: 5000 * math.log(x) - x - math.lgamma(5001) + math.log(0.5)
    assert far.m[1] > 1 - 1e-9 and abs(far.ecll - log(6.0)) < 1e-6 * abs(log(6.0))
    got = model.m_step(model.e_step(hist, [Component(2.0, 0.5), Component(6.0, 0.5)]), 2)
    assert got[1].rate > 2500
    (none,) = [r for r in model.e_step(hist, [Component(0.0, 1.0)]).collect() if r.value == 3]
    assert none.m == [None]  # not possible under the model
