"""Queries over the whole test tables, and the SQL (DuckDB) that gives the same rows.

``ship`` and ``ord`` are interval views of lineitem and orders, in days since 1992-01-01. Doubles are rounded on
both sides, since the order of sums differs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as algebra
from ..functions import scalars
from ..operators import minhash, mixture, statistics
from ..operators.intervals import IntervalFrame

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- intervals --------------------------------------------------------------------------------------

EPOCH = "DATE '1992-01-01'"
SHIP_SQL = f"""(SELECT date_diff('day', {EPOCH}, l_shipdate::DATE) AS "start", date_diff('day', {EPOCH}, l_shipdate::DATE) + l_quantity::BIGINT AS "end",
  l_suppkey AS plane, l_returnflag AS sub, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)"""  # fmt: skip
ORD_SQL = f"""(SELECT date_diff('day', {EPOCH}, o_orderdate::DATE) AS "start", date_diff('day', {EPOCH}, o_orderdate::DATE) + 1 + o_custkey % 90 AS "end",
  o_custkey % 10 AS plane, o_orderkey, o_custkey FROM orders)"""  # fmt: skip


def _days(c: str) -> Column:
    return F.datediff(F.to_date(c), F.expr(EPOCH)).cast("long")


def ship(spark: SparkSession, sf_dir: str) -> IntervalFrame:
    df = table(spark, sf_dir, "lineitem")
    df = df.select(_days("l_shipdate").alias("start"), (_days("l_shipdate") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_suppkey").alias("plane"), F.col("l_returnflag").alias("sub"), "l_orderkey", "l_linenumber", "l_extendedprice")
    return IntervalFrame(df, plane="plane")


def orders(spark: SparkSession, sf_dir: str) -> IntervalFrame:
    df = table(spark, sf_dir, "orders")
    df = df.select(_days("o_orderdate").alias("start"), (_days("o_orderdate") + 1 + F.col("o_custkey") % 90).alias("end"), (F.col("o_custkey") % 10).alias("plane"), "o_orderkey", "o_custkey")
    return IntervalFrame(df, plane="plane")


@query(f'SELECT plane, greatest(max("end" - "start"), 0) AS max_width, min("end" - "start") AS min_width, round(avg("end" - "start"), 6) AS avg_width FROM {SHIP_SQL} GROUP BY plane')
def iv_width_stats(spark, sf_dir):
    w = algebra.width(F.col("start"), F.col("end"))
    return ship(spark, sf_dir).df.groupBy("plane").agg(F.greatest(F.max(w), F.lit(0)).alias("max_width"), F.min(w).alias("min_width"), F.round(F.avg(w), 6).alias("avg_width"))


@query(f'SELECT greatest(coalesce(max("end" - "start"), 0), 0)::BIGINT AS max_width FROM {SHIP_SQL}')
def iv_max_width(spark, sf_dir):
    return ship(spark, sf_dir).max_width()


@query(f'SELECT "start", "end", plane, l_orderkey, l_linenumber FROM {SHIP_SQL} WHERE "start" < 1530 AND "end" > 1500')
def iv_overlap_filter(spark, sf_dir):
    return ship(spark, sf_dir).overlapping(1500, 1530).df.select("start", "end", "plane", "l_orderkey", "l_linenumber")


@query(f'SELECT "start", "end", plane, l_orderkey FROM {SHIP_SQL} WHERE "start" < 1600 AND "end" > 1500 AND "start" < 1520 AND "end" > 1400 AND plane = 3')
def iv_overlap_filter_chained(spark, sf_dir):
    return ship(spark, sf_dir).overlapping(1500, 1600).overlapping(1400, 1520, plane=3).df.select("start", "end", "plane", "l_orderkey")


@query(f"""SELECT l_orderkey, count(*) AS n_covers, count(*) FILTER (sub = 'R') AS n_overlaps FROM
  (SELECT s.* FROM {SHIP_SQL} s JOIN {ORD_SQL} o ON s.l_orderkey = o.o_orderkey AND s."start" < o."end" AND o."start" < s."end") GROUP BY l_orderkey""")  # fmt: skip
def iv_covers_vs_overlaps(spark, sf_dir):
    s, o = ship(spark, sf_dir).df.drop("plane"), orders(spark, sf_dir).df.drop("plane")
    a = (F.col("s.start"), F.col("s.end"), F.col("l_orderkey"), F.col("sub"))
    b = (F.col("o.start"), F.col("o.end"), F.col("o_orderkey"), F.lit("R"))
    both = s.alias("s").join(o.alias("o"), F.col("l_orderkey") == F.col("o_orderkey"))
    both = both.where(algebra.covers(a, b)).select("l_orderkey", algebra.overlaps(a, b).alias("o"))
    return both.groupBy("l_orderkey").agg(F.count("*").alias("n_covers"), F.count_if("o").alias("n_overlaps"))


@query(f"""SELECT l_orderkey, l_linenumber, s."start", s."end", CASE WHEN s.plane % 10 = o.plane THEN greatest(o."start" - s."end", s."start" - o."end", 0) ELSE -1 END AS gap,
  CASE WHEN (s.plane % 10, s."start", s."end") < (o.plane, o."start", o."end") THEN -1 WHEN (s.plane % 10, s."start", s."end") > (o.plane, o."start", o."end") THEN 1 ELSE 0 END AS cmp
  FROM {SHIP_SQL} s JOIN {ORD_SQL} o ON l_orderkey = o_orderkey""")  # fmt: skip
def iv_distance(spark, sf_dir):
    s, o = ship(spark, sf_dir).df, orders(spark, sf_dir).df
    a, b = (F.col("s.start"), F.col("s.end"), F.col("s.plane") % 10), (F.col("o.start"), F.col("o.end"), F.col("o.plane"))
    return s.alias("s").join(o.alias("o"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "s.start", "s.end", F.coalesce(algebra.distance(a, b), F.lit(-1)).alias("gap"), algebra.compare(a, b).alias("cmp"))


@query(f'SELECT l_orderkey, l_linenumber, s."start", s."end", s.plane, o_orderkey FROM {SHIP_SQL} s JOIN {ORD_SQL} o ON s.plane = o.plane AND s."start" < o."end" AND o."start" < s."end"')
def iv_overlap_join_plane(spark, sf_dir):
    both = ship(spark, sf_dir).join(orders(spark, sf_dir))
    return both.select("a.l_orderkey", "a.l_linenumber", "a.start", "a.end", "a.plane", "b.o_orderkey")


@query(f"""WITH pairs AS (SELECT o_orderkey, s."start" FROM {ORD_SQL} o JOIN (SELECT DISTINCT "start", "end" FROM {SHIP_SQL}) s ON s."start" < o."end" AND o."start" < s."end")
  SELECT o_orderkey, count(*) AS hits, min("start") AS first_start FROM pairs GROUP BY o_orderkey""")  # fmt: skip
def iv_overlap_join_global(spark, sf_dir):
    extents = IntervalFrame(ship(spark, sf_dir).df.select("start", "end").distinct())
    return extents.overlap_counts(IntervalFrame(orders(spark, sf_dir).df.drop("plane")), "o_orderkey", first=True).where("hits > 0")


@query(f"""SELECT o_orderkey, count(*) AS hits, min(s."start") AS first_start FROM {ORD_SQL} o JOIN {SHIP_SQL} s ON s."start" < o."end" AND o."start" < s."end" GROUP BY o_orderkey""")
def iv_overlap_join_global_rows(spark, sf_dir):
    """As iv_overlap_join_global, over all intervals."""
    entries = IntervalFrame(ship(spark, sf_dir).df.drop("plane"))
    return entries.overlap_counts(IntervalFrame(orders(spark, sf_dir).df.drop("plane")), "o_orderkey", first=True).where("hits > 0")


@query(f"""SELECT o_orderkey, count(s.plane) AS hits FROM {ORD_SQL} o LEFT JOIN {SHIP_SQL} s ON s.plane = o.plane AND s."start" < o."end" AND o."start" < s."end" GROUP BY o_orderkey""")
def iv_overlap_counts(spark, sf_dir):
    return ship(spark, sf_dir).overlap_counts(orders(spark, sf_dir), "o_orderkey")


_NEAR = f"""WITH s AS (SELECT "start" AS s, "end" AS e, plane, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM {SHIP_SQL} GROUP BY ALL),
  o AS (SELECT "start" AS qs, "end" AS qe, plane, o_orderkey FROM {ORD_SQL}),"""


@query(_NEAR + """ p AS (SELECT o_orderkey, s, e, greatest(s - qe, qs - e, 0) AS gap, row_number() OVER (PARTITION BY o_orderkey ORDER BY greatest(s - qe, qs - e, 0), NOT (s < qe AND qs < e), s, e) AS k
  FROM o JOIN s ON o.plane = s.plane) SELECT o.o_orderkey, p.s AS found_start, p.e AS found_end, p.gap FROM o LEFT JOIN (SELECT * FROM p WHERE k = 1) p ON o.o_orderkey = p.o_orderkey""")  # fmt: skip
def iv_nearest_distance(spark, sf_dir):
    found = ship(spark, sf_dir).nearest(orders(spark, sf_dir), "o_orderkey", "nearest")
    return found.select("o_orderkey", F.col("found.s").alias("found_start"), F.col("found.e").alias("found_end"), "gap")


@query(_NEAR + """ hit AS (SELECT o_orderkey, min((s, e)) AS x FROM o JOIN s ON o.plane = s.plane AND s < qe AND qs < e GROUP BY o_orderkey),
  before AS (SELECT o_orderkey, max((s, e)) AS x FROM o JOIN s ON o.plane = s.plane AND (s, e) <= (qs, qe) GROUP BY o_orderkey),
  first AS (SELECT plane, min((s, e)) AS x FROM s GROUP BY plane)
  SELECT o.o_orderkey, coalesce(h.x, b.x, f.x)[1] AS found_start, coalesce(h.x, b.x, f.x)[2] AS found_end
  FROM o LEFT JOIN hit h ON o.o_orderkey = h.o_orderkey LEFT JOIN before b ON o.o_orderkey = b.o_orderkey LEFT JOIN first f ON o.plane = f.plane""")  # fmt: skip
def iv_nearest_floor(spark, sf_dir):
    found = ship(spark, sf_dir).nearest(orders(spark, sf_dir), "o_orderkey", "floor")
    return found.select("o_orderkey", F.col("found.s").alias("found_start"), F.col("found.e").alias("found_end"))


@query(f"""SELECT plane, count(*) AS n, sum("end" - "start")::BIGINT AS total FROM (SELECT "start", "end", plane FROM {ORD_SQL} UNION ALL SELECT 1000, 1010, 3) GROUP BY plane""")
def iv_put(spark, sf_dir):
    base = orders(spark, sf_dir)
    base = IntervalFrame(base.df.select("start", "end", "plane"), plane="plane")
    return base.put((1000, 1010, 3)).df.groupBy("plane").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"))


@query(f"""SELECT "start", "end", plane, count(*) AS n FROM (SELECT "start", "end", plane FROM {ORD_SQL} UNION ALL SELECT * FROM (VALUES (1000, 1010, 3), (1000, 1010, 3), (5, 6, 1))) GROUP BY ALL""")
def iv_multiput(spark, sf_dir):
    base = IntervalFrame(orders(spark, sf_dir).df.select("start", "end", "plane"), plane="plane")
    return base.multiput([(1000, 1010, 3), (1000, 1010, 3), (5, 6, 1)]).df.groupBy("start", "end", "plane").agg(F.count("*").alias("n"))


@query(f"""SELECT plane, count(*) AS n, max("end" - "start") AS max_width FROM (SELECT "start", "end", plane FROM {ORD_SQL} UNION ALL SELECT "start", "end", plane FROM {SHIP_SQL}) GROUP BY plane""")
def iv_merge_counts(spark, sf_dir):
    both = IntervalFrame(orders(spark, sf_dir).df.select("start", "end", "plane"), plane="plane").merge(ship(spark, sf_dir).df.select("start", "end", "plane"))
    return both.df.groupBy("plane").agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("max_width"))


@query(f"""SELECT l_orderkey, l_linenumber, "start", "end" FROM {SHIP_SQL} WHERE sub = 'R' AND l_extendedprice < 20000 AND "start" < 1700 AND "end" > 1600""")
def iv_filter_pred(spark, sf_dir):
    found = ship(spark, sf_dir).filter((F.col("sub") == "R") & (F.col("l_extendedprice") < 20000)).overlapping(1600, 1700)
    return found.df.select("l_orderkey", "l_linenumber", "start", "end")


@query(f"""SELECT l_orderkey, "start", "end", round(l_extendedprice * 1.1, 4) AS price, sub || '_mapped' AS sub FROM {SHIP_SQL} WHERE "start" < 1520 AND "end" > 1510""")
def iv_map_values(spark, sf_dir):
    mapped = ship(spark, sf_dir).map_values(price=F.round(F.col("l_extendedprice") * 1.1, 4), sub=F.concat("sub", F.lit("_mapped")))
    return mapped.overlapping(1510, 1520).df.select("l_orderkey", "start", "end", "price", "sub")


@query(f'SELECT "start", "end", plane, "end" - "start" AS width FROM {ORD_SQL}')
def iv_map_partitions(spark, sf_dir):
    def widths(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pc.subtract(b.column("end"), b.column("start"))], [*b.schema.names, "width"])

    base = IntervalFrame(orders(spark, sf_dir).df.select("start", "end", "plane"), plane="plane")
    return base.map_partitions(widths, "start long, end long, plane long, width long").df


@query(f"SELECT count(*) AS n FROM {SHIP_SQL}")
def iv_count(spark, sf_dir):
    return ship(spark, sf_dir).df.agg(F.count("*").alias("n"))


@query(f'SELECT "start", "end", plane FROM {SHIP_SQL} ORDER BY plane, "start", "end" LIMIT 1')
def iv_first(spark, sf_dir):
    return ship(spark, sf_dir).sorted().df.limit(1).select("start", "end", "plane")


@query(f"""SELECT plane, "start", "end", n, (sum(n) OVER (PARTITION BY plane ORDER BY "start", "end"))::BIGINT AS until
  FROM (SELECT plane, "start", "end", count(*) AS n FROM {SHIP_SQL} GROUP BY ALL)""")  # fmt: skip
def iv_sorted_rank(spark, sf_dir):
    per = ship(spark, sf_dir).df.groupBy("plane", "start", "end").agg(F.count("*").alias("n"))
    return per.withColumn("until", F.sum("n").over(Window.partitionBy("plane").orderBy("start", "end")))


@query(f'SELECT "start", "end", plane, o_orderkey FROM {ORD_SQL} WHERE plane = 4 AND "start" < 1400 AND "end" > 1300')
def iv_roundtrip(spark, sf_dir):
    """Laid out by ranges, written by plane, read back and filtered: other planes' folders aren't read."""
    path = _scratch(spark)
    orders(spark, sf_dir).partitioned(4).save(path, by_plane=True)
    found = IntervalFrame.load(spark, path, plane="plane").overlapping(1300, 1400, plane=4)
    return found.df.select("start", "end", F.col("plane").cast("long").alias("plane"), "o_orderkey")


@query(f'SELECT count(*) AS n, count(DISTINCT plane) AS planes FROM {SHIP_SQL}')
def iv_partitioned(spark, sf_dir):
    """Nothing is lost by a new layout."""
    return ship(spark, sf_dir).partitioned(10).df.agg(F.count("*").alias("n"), F.countDistinct("plane").alias("planes"))


# --- MinHash ----------------------------------------------------------------------------------------

K, LENGTH, BANDS, SEED = 5, 32, 8, 1
SEEDS = minhash.hash_family(LENGTH, SEED)
_POWERS = [pow(31, K - 1 - j) for j in range(K)]
_CODES = "list_transform(range(1, length(text) + 1), lambda i: unicode(substring(text, i, 1)))"


def _sql_signatures(name: str, key: str) -> str:
    """DuckDB SQL for (key, sig) of a table of texts, without lambdas over seeds."""
    seeds = ", ".join(f"({i}, {s})" for i, s in enumerate(SEEDS))
    gram = " + ".join(f"c[i + {j + 1}]::BIGINT * {p}" for j, p in enumerate(_POWERS))
    return rf"""
      codes AS (SELECT {key} AS id, list_transform(string_split(text, ''), lambda x: unicode(x)) AS c FROM {name}),
      gram AS (SELECT id, CASE WHEN len(c) >= {K} THEN {gram} ELSE list_reduce(list_prepend(0::BIGINT, list_transform(c, lambda x: x::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) END AS g
               FROM (SELECT id, c, unnest(range(greatest(len(c) - {K} + 1, 1))) AS i FROM codes)),
      hashed AS (SELECT DISTINCT id, ((((g + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)::INTEGER AS h FROM gram),
      sigs AS (SELECT id, list(m ORDER BY p) AS sig FROM (SELECT id, p, min(xor(h, s::INTEGER)) AS m FROM hashed, (VALUES {seeds}) AS f(p, s) GROUP BY id, p) GROUP BY id)"""  # fmt: skip


def signatures(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    return minhash.text_signatures(table(spark, sf_dir, name), key, "text", K, SEEDS)


_SAME = f"list_sum(list_transform(range(1, {LENGTH + 1}), lambda i: (a.sig[i] = b.sig[i])::INTEGER))::DOUBLE / {LENGTH}"
_FIRST = f"coalesce(list_position(list_transform(range({BANDS}), lambda i: a.sig[i * {LENGTH // BANDS} + 1 : (i + 1) * {LENGTH // BANDS}] = b.sig[i * {LENGTH // BANDS} + 1 : (i + 1) * {LENGTH // BANDS}]), true), 0) - 1"


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {s})" for i, s in enumerate(minhash.hash_family(500, 1))) + ") AS f(position, seed)")
def mh_hash_family(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(minhash.hash_family(500, 1))), "position int, seed int")


@query(f"WITH {_sql_signatures('documents', 'doc_id')} SELECT id AS doc_id, array_to_string(sig, ',') AS sig FROM sigs")
def mh_signature(spark, sf_dir):
    return signatures(spark, sf_dir).select("doc_id", F.array_join(F.transform("sig", lambda x: x.cast("string")), ",").alias("sig"))


@query(f"WITH {_sql_signatures('benchmark', 'item_id')} SELECT id AS item_id, array_to_string(sig, ',') AS sig FROM sigs")
def mh_signature_native(spark, sf_dir):
    """The same by built-in expressions alone."""
    df = table(spark, sf_dir, "benchmark")
    sig = minhash.signature(minhash.shingle_hashes(F.col("text"), K), SEEDS)
    return df.select("item_id", F.array_join(F.transform(sig, lambda x: x.cast("string")), ",").alias("sig"))


@query(f"""WITH {_sql_signatures('documents', 'doc_id')} SELECT b AS band, array_to_string(sig[b * {LENGTH // BANDS} + 1 : (b + 1) * {LENGTH // BANDS}], ',') AS keys, count(*) AS n
  FROM sigs, range({BANDS}) AS r(b) GROUP BY ALL""")  # fmt: skip
def mh_buckets(spark, sf_dir):
    rows = signatures(spark, sf_dir).select(F.explode(minhash.bands(F.col("sig"), BANDS, LENGTH)).alias("b"))
    keys = F.array_join(F.transform("b.keys", lambda x: x.cast("string")), ",")
    return rows.groupBy(F.col("b.band").cast("long").alias("band"), keys.alias("keys")).agg(F.count("*").alias("n"))


@query(f"""WITH {_sql_signatures('benchmark', 'item_id')} SELECT a.id AS id_a, b.id AS id_b, ({_FIRST})::INTEGER AS band FROM sigs a JOIN sigs b ON a.id < b.id""")
def mh_first_bucket(spark, sf_dir):
    sigs = signatures(spark, sf_dir, "benchmark", "item_id")
    return minhash.all_pairs(sigs, "item_id").where("id_a < id_b").select("id_a", "id_b", minhash.first_band(F.col("sig_a"), F.col("sig_b"), BANDS, LENGTH).alias("band"))


@query(f"WITH {_sql_signatures('benchmark', 'item_id')} SELECT a.id AS id_a, b.id AS id_b, {_SAME} AS sim FROM sigs a, sigs b")
def mh_exact_pairs(spark, sf_dir):
    return minhash.exact_pairs(signatures(spark, sf_dir, "benchmark", "item_id"), "item_id")


@query(f"""WITH {_sql_signatures('documents', 'doc_id')}, reps AS (SELECT sig, min(id) AS id FROM sigs GROUP BY sig),
  keys AS (SELECT id, sig, b, sig[b * {LENGTH // BANDS} + 1 : (b + 1) * {LENGTH // BANDS}] AS k FROM reps, range({BANDS}) AS r(b)),
  met AS (SELECT DISTINCT x.id AS p, y.id AS q FROM keys x JOIN keys y ON x.b = y.b AND x.k = y.k AND x.id < y.id)
  SELECT p AS id_a, q AS id_b, {_SAME} AS sim FROM met JOIN reps a ON a.id = p JOIN reps b ON b.id = q""")  # fmt: skip
def mh_lsh_pairs(spark, sf_dir):
    return minhash.lsh_pairs(signatures(spark, sf_dir), "doc_id", BANDS, LENGTH)


@query(f"WITH {_sql_signatures('documents', 'doc_id')} SELECT id AS doc_id, min(id) OVER (PARTITION BY sig) AS class_id FROM sigs")
def mh_membership(spark, sf_dir):
    return minhash.membership(signatures(spark, sf_dir), "doc_id")


def _dataset_sql(wrap: str) -> str:
    return "SELECT p AS position, " + wrap.format("min(xor((event_id % 2147483647)::INTEGER, s::INTEGER))") + " AS least FROM events, (VALUES " + ", ".join(f"({i}, {s})" for i, s in enumerate(SEEDS)) + ") AS f(p, s) GROUP BY p"


def _dataset(spark, sf_dir, zero: bool) -> DataFrame:
    hashes = (F.col("event_id") % (2**31 - 1)).cast("int")
    sig = minhash.dataset_signature(table(spark, sf_dir, "events"), hashes, SEEDS, zero)
    return sig.select(F.posexplode("sig").alias("position", "least"))


@query(_dataset_sql("{}"))
def mh_dataset_signature(spark, sf_dir):
    return _dataset(spark, sf_dir, False)


@query(_dataset_sql("least({}, 0)"))
def mh_dataset_signature_zero(spark, sf_dir):
    return _dataset(spark, sf_dir, True)


@query(f"WITH {_sql_signatures('documents', 'doc_id')} SELECT id AS doc_id, list_sum(sig)::DOUBLE AS total, sig[1]::DOUBLE AS first, len(sig)::INTEGER AS n FROM sigs")
def mh_vector(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    v = vector_to_array(minhash.to_vector(F.col("sig")))
    return signatures(spark, sf_dir).select("doc_id", v.alias("v")).select("doc_id", scalars.array_total(F.col("v")).alias("total"), F.get("v", F.lit(0)).alias("first"), F.size("v").alias("n"))


# --- statistics -------------------------------------------------------------------------------------


@query("SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, round(var_pop(c_acctbal), 4) AS variance FROM customer GROUP BY c_mktsegment")
def st_mean_var(spark, sf_dir):
    found = statistics.mean_variance(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"])
    return found.select("c_mktsegment", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@query("SELECT o_orderkey, round((o_totalprice - avg(o_totalprice) OVER ()) / nullif(stddev_pop(o_totalprice) OVER (), 0), 6) AS z FROM orders")
def st_zscore(spark, sf_dir):
    return statistics.z_score(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("z", 6).alias("z"))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def st_zscore_grouped(spark, sf_dir):
    return statistics.z_score(table(spark, sf_dir, "customer"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", F.round("z", 6).alias("z"))


CENTROIDS = [5.0, 20.0, 40.0]
_ASSIGN = "CASE WHEN l_quantity <= 12.5 THEN 0 WHEN l_quantity <= 30 THEN 1 ELSE 2 END"


@query(f"SELECT l_quantity AS value, {_ASSIGN} AS cluster, count(*) AS n FROM lineitem GROUP BY ALL")
def mx_assign(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("value"), statistics.assign(F.col("l_quantity"), CENTROIDS).alias("cluster")).agg(F.count("*").alias("n"))


@query(f"""SELECT cluster, count(*) AS n, round(sqrt(avg(power(v - [5.0, 20.0, 40.0][cluster + 1], 2))), 6) AS sigma, round(count(*) / sum(count(*)) OVER (), 9) AS weight
  FROM (SELECT l_quantity AS v, {_ASSIGN} AS cluster FROM lineitem) GROUP BY cluster""")  # fmt: skip
def mx_cluster_stats(spark, sf_dir):
    found = statistics.cluster_stats(table(spark, sf_dir, "lineitem"), "l_quantity", CENTROIDS)
    return found.select("cluster", "n", F.round("sigma", 6).alias("sigma"), F.round("weight", 9).alias("weight"))


# --- mixtures ---------------------------------------------------------------------------------------

START = [mixture.Component(10.0, 0.5), mixture.Component(40.0, 0.5)]
STEPS = 5
_HIST = "hist AS (SELECT l_quantity::BIGINT AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)"
_PMF = "exp(-{0} + v * ln({0}) - lgamma(v + 1))"


def _em_sql(steps: int) -> str:
    """Expectation maximisation of two Poissons, unrolled; p0 .. p<steps> are one-row tables of parameters."""
    parts = [_HIST, f"p0 AS (SELECT {START[0].rate} AS a, {START[1].rate} AS b, {START[0].weight} AS wa, {START[1].weight} AS wb)"]
    for k in range(steps):
        joint = f"SELECT v, n, wa * {_PMF.format('a')} AS x, wb * {_PMF.format('b')} AS y FROM hist, p{k}"
        parts.append(f"p{k + 1} AS (SELECT sum(n * v * x / (x + y)) / sum(n * x / (x + y)) AS a, sum(n * v * y / (x + y)) / sum(n * y / (x + y)) AS b, sum(n * x / (x + y)) / sum(n) AS wa, sum(n * y / (x + y)) / sum(n) AS wb FROM ({joint}))")
    return "WITH " + ", ".join(parts)


def _hist(spark, sf_dir):
    model = mixture.PoissonMixture()
    return model, model.histogram(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(f"WITH {_HIST} SELECT v AS value, round({_PMF.format(10.0)}, 9) AS p10, round({_PMF.format(40.0)}, 9) AS p40 FROM hist")
def mx_poisson_pmf(spark, sf_dir):
    model, hist = _hist(spark, sf_dir)
    return hist.select("value", *(F.round(F.exp(model.log_pmf(F.col("value"), r)), 9).alias(f"p{r:.0f}") for r in (10.0, 40.0)))


@query(_em_sql(0) + f""", j AS (SELECT v, wa * {_PMF.format('a')} AS x, wb * {_PMF.format('b')} AS y FROM hist, p0)
  SELECT v AS value, round(x / (x + y), 8) AS m0, round(y / (x + y), 8) AS m1, round(x / (x + y) * ln(x) + y / (x + y) * ln(y), 6) AS ecll FROM j""")  # fmt: skip
def mx_e_step(spark, sf_dir):
    model, hist = _hist(spark, sf_dir)
    return model.e_step(hist, START).select("value", F.round(F.get("m", F.lit(0)), 8).alias("m0"), F.round(F.get("m", F.lit(1)), 8).alias("m1"), F.round("ecll", 6).alias("ecll"))


def _components(spark, found: list) -> DataFrame:
    return spark.createDataFrame([(j, round(c.rate, 6), round(c.weight, 8)) for j, c in enumerate(found)], "component int, rate double, weight double")


_PARAMETERS = "SELECT 0 AS component, round(a, 6) AS rate, round(wa, 8) AS weight FROM p{0} UNION ALL SELECT 1, round(b, 6), round(wb, 8) FROM p{0}"


@query(f"{_em_sql(1)} {_PARAMETERS.format(1)}")
def mx_m_step(spark, sf_dir):
    model, hist = _hist(spark, sf_dir)
    return _components(spark, model.m_step(model.e_step(hist, START), 2))


@query(f"{_em_sql(STEPS)} {_PARAMETERS.format(STEPS)}")
def mx_em_fixed(spark, sf_dir):
    model, hist = _hist(spark, sf_dir)
    hist, found = hist.persist(), START
    for _ in range(STEPS):
        found = model.m_step(model.e_step(hist, found), 2)
    hist.unpersist()
    return _components(spark, found)


@query()
def mx_kmeans_init(spark, sf_dir):
    model, hist = _hist(spark, sf_dir)
    return _components(spark, model.initialise(hist, 3, seed=7))


@query()
def mx_fit(spark, sf_dir):
    return _components(spark, mixture.PoissonMixture().fit(table(spark, sf_dir, "lineitem"), "l_quantity", 2, seed=7))


def _fit_sql(most: int) -> str:
    """The steps of a whole fit, and of them the first that the expected log likelihood falls at, or the last."""
    ecll = f"SELECT sum(n * (x / (x + y) * ln(x) + y / (x + y) * ln(y))) AS e FROM (SELECT n, wa * {_PMF.format('a')} AS x, wb * {_PMF.format('b')} AS y FROM hist, p{{0}})"
    steps = _em_sql(most).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    all_of = " UNION ALL ".join(f"SELECT {k} AS k, a, b, wa, wb, ({ecll.format(k)}) AS e FROM p{k}" for k in range(most + 1))
    return f"""{steps}, every AS MATERIALIZED ({all_of}), fell AS (SELECT k, e < lag(e) OVER (ORDER BY k) AS less FROM every),
      got AS (SELECT * FROM every WHERE k = coalesce((SELECT min(k) FROM fell WHERE less AND k < {most}), {most}))
      SELECT 0 AS component, round(a, 5) AS rate, round(wa, 6) AS weight FROM got UNION ALL SELECT 1, round(b, 5), round(wb, 6) FROM got"""


@query(_fit_sql(11))
def mx_fit_from_start(spark, sf_dir):
    """A whole fit, with its stopping rule, from given components."""
    found = mixture.PoissonMixture().fit(table(spark, sf_dir, "lineitem"), "l_quantity", 2, max_iterations=10, start=START)
    return spark.createDataFrame([(j, round(c.rate, 5), round(c.weight, 6)) for j, c in enumerate(found)], "component int, rate double, weight double")


# --- functions --------------------------------------------------------------------------------------


@query("SELECT DISTINCT p_size - 25 AS i, CASE WHEN p_size - 25 <= 1 THEN 1 WHEN p_size - 25 <= 20 THEN factorial(p_size - 25)::BIGINT ELSE -1 END AS f FROM part")
def fn_factorial(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_size") - 25).alias("i")).distinct().select("i", F.coalesce(scalars.factorial(F.col("i")), F.lit(-1)).alias("f"))


@query("SELECT l_orderkey, l_linenumber, l_tax, abs(l_discount - l_tax) <= 1e-6 AS eq, abs(l_discount - l_tax) <= 0.02 AS near FROM lineitem")
def fn_fp_equals(spark, sf_dir):
    a, b = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", scalars.fp_equals(a, b).alias("eq"), scalars.fp_equals(a, b, 0.02).alias("near"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) ELSE -100000.0 END, 9) AS v FROM customer")
def fn_safe_log(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.safe_log(F.col("c_acctbal")), 9).alias("v"))


_EMB = "list_transform(embedding, lambda x: abs(x)::DOUBLE)"


def _embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.abs(x).cast("double")).alias("e"))


@query(f"SELECT vec_id, i AS pos, round(e[i + 1] / list_sum(e), 9) AS v FROM (SELECT vec_id, {_EMB} AS e, unnest(range(len(embedding)))::INTEGER AS i FROM embeddings)")
def fn_normalise(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.posexplode(scalars.normalise(F.col("e"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 9).alias("v"))


@query(f"SELECT vec_id, i AS pos, round(e[i + 1] * 2.5, 9) AS v FROM (SELECT vec_id, {_EMB} AS e, unnest(range(len(embedding)))::INTEGER AS i FROM embeddings)")
def fn_scale_array(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.posexplode(scalars.scale_array(2.5, F.col("e"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 9).alias("v"))


@query(f"SELECT label, i AS pos, round(sum(e[i + 1]), 6) AS v FROM (SELECT label, {_EMB} AS e, unnest(range(len(embedding)))::INTEGER AS i FROM embeddings) GROUP BY label, i")
def fn_sum_arrays(spark, sf_dir):
    return scalars.sum_arrays(_embeddings(spark, sf_dir), "e", ["label"]).select("label", F.posexplode("total").alias("pos", "v")).select("label", "pos", F.round("v", 6).alias("v"))


# --- sources ----------------------------------------------------------------------------------------


@query(r"""SELECT page_id, CASE WHEN regexp_matches(url, '^(.*)/([^/]+/?)$') THEN regexp_extract(url, '^(.*)/([^/]+/?)$', 1) END AS parent,
  CASE WHEN regexp_matches(url, '^(.*)/([^/]+/?)$') THEN regexp_extract(url, '^(.*)/([^/]+/?)$', 2) END AS leaf FROM pages""")  # fmt: skip
def io_parse_slash(spark, sf_dir):
    from ..sources.locators import split_path_column

    return table(spark, sf_dir, "pages").select("page_id", split_path_column(F.col("url")).alias("x")).select("page_id", "x.parent", "x.leaf")


@query("SELECT doc_id, hex(encode(text)[101:120]) AS part, octet_length(encode(text)) AS n_bytes FROM documents")
def io_read_range(spark, sf_dir):
    """Twenty bytes of each text by the byte access of this library, which gives fewer at the end."""

    def read(batches):
        import pyarrow as pa

        from ..sources.locators import MemoryLocator

        for b in batches:
            found = [None if t is None else MemoryLocator(t.encode()).access() for t in b.column(1).to_pylist()]
            parts, sizes = [a and a.read(100, 20).hex().upper() for a in found], [a and a.length() for a in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "part", "n_bytes"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, n_bytes long")


@query()
def io_ranged_source(spark, sf_dir):
    """The bytes of a table's file, or of each of its part files, by ranges; tested against the files.

    Local, HTTP, and whatever Hadoop's file systems read; what can't be read is an error.
    """
    from ..sources import ranged

    path = f"{sf_dir}/customer.parquet"
    if path.startswith(("http://", "https://")):
        files = [path]
    else:
        files = _files(spark, path)
        if not all(f.startswith("file:") for f in files):
            return _hadoop_ranges(spark, files, 65536)
        files = [f.removeprefix("file://").removeprefix("file:") for f in files]
    ranged.register(spark)
    rows = spark.read.format("byte_ranges").option("paths", json.dumps(files)).option("range_bytes", 65536).load()
    return rows.select("offset", "length", F.crc32("data").alias("crc"))


def _files(spark: SparkSession, path: str) -> list[str]:
    """A file itself, or the data files of a folder and its folders, without those Spark hides; by name."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.getFileStatus(at)  # raises if there is none
    out, folders = [], []
    (folders if top.isDirectory() else out).append(top.getPath())
    while folders:
        for x in fs.listStatus(folders.pop()):
            name = x.getPath().getName()
            if not name.startswith((".", "_")) or "=" in name:
                (folders if x.isDirectory() else out).append(x.getPath())
    if not out:
        raise FileNotFoundError(f"no files in {path}")
    return sorted(f.toString() for f in out)


def _hadoop_ranges(spark: SparkSession, files: list[str], size: int) -> DataFrame:
    """(offset, length, crc) of files that Spark reads, each whole in one task (2 GB at most, or Spark fails)."""
    content = spark.read.format("binaryFile").load(files).select("content", "length")
    offsets = content.where("length > 0").select("content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("offset"))
    part = F.substring("content", F.col("offset").cast("int") + 1, F.lit(size))
    return offsets.select("offset", F.octet_length(part).cast("long").alias("length"), F.crc32(part).alias("crc"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def io_parquet_roundtrip(spark, sf_dir):
    """Written with the options of this library, and read back."""
    from ..sources.parquet import ParquetOptions

    path = _scratch(spark)
    ParquetOptions(block_size=32 << 20).write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path)
    return spark.read.parquet(path)


def _scratch(spark: SparkSession) -> str:
    import tempfile
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/roundtrip-{uuid.uuid4().hex}"


