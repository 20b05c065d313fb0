"""Every query of the library against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x + 0.0 if isinstance(x, float) else x
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(catalogue.ORACLE[name])
    want = rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_overlap_filter_reaches_the_scan(spark):
    plan = catalogue.orders(spark, SF).overlapping(10, 20).df.select("start")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_kmeans_and_fit(spark):
    first = catalogue.QUERIES["mx_kmeans_init"](spark, SF).collect()
    assert first == catalogue.QUERIES["mx_kmeans_init"](spark, SF).collect() and len(first) == 3
    assert abs(sum(r.weight for r in first) - 1) < 1e-6 and [r.rate for r in first] == sorted(r.rate for r in first)
    assert catalogue.QUERIES["mx_fit"](spark, SF).count() == 2


def test_global_join_counts_every_interval(spark, con):
    got = sum(r.hits for r in catalogue.QUERIES["iv_overlap_join_global_rows"](spark, SF).collect())
    (want,) = con.execute(f'SELECT count(*) FROM {catalogue.ORD_SQL} o JOIN {catalogue.SHIP_SQL} s ON s."start" < o."end" AND o."start" < s."end"').fetchone()
    assert got == want > sum(r.hits for r in catalogue.QUERIES["iv_overlap_join_global"](spark, SF).collect())
