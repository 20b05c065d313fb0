"""Collections keyed by intervals, as DataFrames.

The overlap join of two collections is an equality join. Widths fall into levels, each four times as wide as
the one before; an interval lies in at most two cells of its own level and of every wider one. Two
intervals that overlap share a cell of the wider one's level, so that is where the pair is looked for: once, in the
first cell that both have. Long intervals cost no more rows than short ones, and Spark's joins sort,
spill, and split skewed cells.

Counts and nearest look-ups make no pairs: they are running sums and extremes along the line, which is cut into parts of
about equal numbers of bounds, and cost in proportion to the intervals, however many overlap.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 2  # bits between levels
#: Bounds that one task runs along, about, and the most parts of a line.
NEAR_ROWS, NEAR_CUTS = 2_000_000, 1000


class IntervalFrame:
    """A DataFrame with interval columns; immutable, every operation returns a new one."""

    def __init__(self, df: DataFrame, start: str = "start", end: str = "end", plane: str | None = None):
        self.df, self.start, self.end, self.plane = df, start, end, plane

    # --- construction and layout
    def _with(self, df: DataFrame) -> IntervalFrame:
        return IntervalFrame(df, self.start, self.end, self.plane)

    @property
    def order(self) -> list[str]:
        return [*([self.plane] if self.plane else []), self.start, self.end]

    @staticmethod
    def from_rows(spark, rows: list, schema: str, **columns) -> IntervalFrame:
        return IntervalFrame(spark.createDataFrame(rows, schema), **columns)

    def partitioned(self, n: int) -> IntervalFrame:
        """Dealt out by ranges of (plane, start) and sorted in each: files written so can be skipped by bounds."""
        return self._with(self.df.repartitionByRange(n, *self.order).sortWithinPartitions(*self.order))

    def save(self, path: str, by_plane: bool = False, mode: str = "errorifexists") -> None:
        """Parquet of the rows; ``by_plane`` makes a folder for each plane, so that planes can be pruned."""
        w = self.df.write.mode(mode)
        (w.partitionBy(self.plane) if by_plane and self.plane else w).parquet(path)

    @staticmethod
    def load(spark, path: str, **columns) -> IntervalFrame:
        return IntervalFrame(spark.read.parquet(path), **columns)

    def partition_sizes(self) -> DataFrame:
        """(partition, n) of the partitions that have rows."""
        return self.df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))

    def sorted(self) -> IntervalFrame:
        return self._with(self.df.orderBy(*self.order))

    def named(self, name: str) -> IntervalFrame:
        self.df.createOrReplaceTempView(name)
        return self

    def persist(self, *level) -> IntervalFrame:
        return self._with(self.df.persist(*level))

    def unpersist(self, blocking: bool = True) -> IntervalFrame:
        return self._with(self.df.unpersist(blocking))

    # --- aggregates and access
    def max_width(self) -> DataFrame:
        """One row: the greatest width, 0 at least."""
        return self.df.agg(F.greatest(F.coalesce(F.max(F.col(self.end) - F.col(self.start)), F.lit(0)), F.lit(0)).cast("long").alias("max_width"))

    def count(self) -> int:
        return self.df.count()

    def first(self):
        """The first row in (plane, start, end) order, None if empty."""
        return self.df.orderBy(*self.order).first()

    def collect(self) -> list:
        return self.df.collect()

    # --- filters and projections
    def _meets(self, start, end, plane=None) -> Column:
        met = (F.col(self.start) < end) & (F.col(self.end) > start)
        return met & (F.col(self.plane) == plane) if plane is not None else met

    def overlapping(self, start: int, end: int, plane=None) -> IntervalFrame:
        """Entries that overlap one interval; a plain filter, pushed to the scan."""
        return self._with(self.df.where(self._meets(F.lit(start), F.lit(end), plane)))

    def values(self, start: int, end: int, value: str, plane=None) -> list:
        return [r[0] for r in self.overlapping(start, end, plane).df.select(value).collect()]

    def filter(self, predicate: Column | str) -> IntervalFrame:
        return self._with(self.df.where(predicate))

    def map_values(self, **columns: Column) -> IntervalFrame:
        """New or replaced value columns; the key columns stay."""
        if set(columns) & set(self.order):
            raise ValueError("key columns can't be mapped")
        return self._with(self.df.withColumns(columns))

    def map_partitions(self, function: Callable, schema) -> IntervalFrame:
        """A function over iterators of Arrow batches."""
        return self._with(self.df.mapInArrow(function, schema))

    # --- additions: bag union
    def put(self, *rows) -> IntervalFrame:
        return self.multiput(list(rows))

    def multiput(self, rows: list) -> IntervalFrame:
        return self.merge(self.df.sparkSession.createDataFrame(rows, self.df.schema))

    def merge(self, other: DataFrame | IntervalFrame) -> IntervalFrame:
        return self._with(self.df.unionByName(other.df if isinstance(other, IntervalFrame) else other))

    # --- joins
    def _celled(self, side: str, levels: int) -> DataFrame:
        s, e = F.col(self.start).cast("long"), F.col(self.end).cast("long")
        last = F.greatest(e - 1, s)
        bits = lambda k: f"cast({k} * {STEP} as int)"
        level = F.expr(f"cast(ceil(length(bin(greatest(`{self.end}` - `{self.start}` - 1, 0))) / {STEP}.0) as int)")
        df = self.df.where(s.isNotNull() & e.isNotNull() & (e >= s))
        out = df.select(F.struct("*").alias(side), *([F.col(self.plane).alias("plane")] if self.plane else []), s.alias(f"{side}s"), e.alias(f"{side}e"), last.alias("last"), F.least(level, F.lit(levels)).alias(f"{side}l"))
        out = out.withColumn("level", F.explode(F.sequence(F.col(f"{side}l"), F.lit(levels))))
        first, until = F.expr(f"shiftright({side}s, {bits('level')})"), F.expr(f"shiftright(last, {bits('level')})")
        return out.withColumn(f"{side}f", first).withColumn("cell", F.explode(F.sequence(first, until))).drop("last")

    def join(self, other: IntervalFrame, levels: int | None = None) -> DataFrame:
        """All overlapping pairs, as structs ``a`` (of this) and ``b``; on equal planes if both have one."""
        if bool(self.plane) != bool(other.plane):
            raise ValueError("both sides or none have a plane")
        if levels is None:
            widest = max(self.max_width().union(other.max_width()).agg(F.max("max_width")).first()[0], 1)
            levels = -(-(widest - 1).bit_length() // STEP)
        a, b = self._celled("a", levels), other._celled("b", levels)
        on = [*(["plane"] if self.plane else []), "level", "cell"]
        met = (F.col("as") < F.col("be")) & (F.col("bs") < F.col("ae"))
        once = (F.col("level") == F.greatest("al", "bl")) & (F.col("cell") == F.greatest("af", "bf"))
        return a.join(b, on).where(met & once).select("a", "b")

    # --- look-ups that make no pairs
    def _entries(self) -> DataFrame:
        """(plane, s, e, x) of the entries with bounds, and a plane if there are planes; x: a struct of bounds and values."""
        own = [c for c in self.df.columns if c not in (self.start, self.end)]
        s, e = F.col(self.start).cast("long"), F.col(self.end).cast("long")
        plane = F.col(self.plane) if self.plane else F.lit(0)
        x = F.struct(s.alias("s"), e.alias("e"), F.struct(*own).alias("v")).alias("x")
        return self.df.where(s.isNotNull() & e.isNotNull() & plane.isNotNull()).select(plane.alias("plane"), s.alias("s"), e.alias("e"), x)

    def _asked(self, key: str) -> DataFrame:
        """(key, plane, qs, qe) of all rows."""
        plane = F.col(self.plane) if self.plane else F.lit(0)
        return self.df.select(F.col(key).alias("key"), plane.alias("plane"), F.col(self.start).cast("long").alias("qs"), F.col(self.end).cast("long").alias("qe"))

    def overlap_counts(self, queries: IntervalFrame, key: str, first: bool = False) -> DataFrame:
        """(key, hits) for each query, zero included; with ``first`` also the lowest start of an overlapping entry.

        Hits are the entries that start before the query's end, less those that end before its start: two running
        counts along the line, and no pairs. A null or inverted interval overlaps nothing; rows of one key share their sum.
        """
        if bool(self.plane) != bool(queries.plane):
            raise ValueError("both sides or none have a plane")
        entries = self._entries().where("e >= s")
        asked = queries._asked(key)
        extents = asked.where("qe >= qs and plane is not null").select("plane", "qs", "qe").distinct()
        cuts = _cuts(entries, extents)
        # at one place of the line: query ends, entry ends, starts of empty queries, ends of empty entries, query starts, entry starts
        events = F.explode(F.array(F.struct(F.col("s").alias("r1"), F.lit(5).alias("r2")), F.struct(F.col("e").alias("r1"), F.when(F.col("s") == F.col("e"), 3).otherwise(1).alias("r2")))).alias("at")
        events = entries.select("plane", events).select("plane", "at.r1", "at.r2").groupBy("plane", "r1", "r2").agg(F.count("*").alias("n"))
        events = events.select("plane", "r1", "r2", F.when(F.col("r2") == 5, F.col("n")).otherwise(0).alias("begun"), F.when(F.col("r2") == 5, 0).otherwise(F.col("n")).alias("ended"))
        points = F.explode(F.array(F.struct(F.col("qe").alias("r1"), F.lit(0).alias("r2")), F.struct(F.col("qs").alias("r1"), F.when(F.col("qs") == F.col("qe"), 2).otherwise(4).alias("r2")))).alias("at")
        points = extents.select("plane", "qs", "qe", points).select("plane", "qs", "qe", "at.r1", "at.r2")
        seen = _running(events, points, {"begun": F.sum, "ended": F.sum}, cuts)
        hits = seen.groupBy("plane", "qs", "qe").agg(F.sum(F.when(F.col("r2") == 0, F.col("begun")).otherwise(-F.col("ended"))).alias("hits"))
        if first:
            hits = self._lowest(entries.select("plane", "e", F.struct("s").alias("x")), hits, cuts).select("plane", "qs", "qe", "hits", F.col("hit.s").alias("first_start"))
        per = asked.join(hits, ["plane", "qs", "qe"], "left")
        out = per.groupBy("key").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), *([F.min("first_start").alias("first_start")] if first else []))
        out = out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        return out.select(F.col("key").alias(key), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), *(["first_start"] if first else []))

    @staticmethod
    def _lowest(entries: DataFrame, extents: DataFrame, cuts: list) -> DataFrame:
        """``extents`` with ``hit``: the least x of the entries (plane, e, x) that overlap, by x.s first.

        The least of all that end after the query's start overlaps it, if any does.
        """
        ends = entries.groupBy("plane", F.expr("-e").alias("r1")).agg(F.min("x").alias("x")).withColumn("r2", F.lit(0))
        asked = extents.withColumns({"r1": F.expr("-qs - 1"), "r2": F.lit(1)})
        found = _running(ends, asked, {"x": F.min}, [-c for c in reversed(cuts)]).drop("r1", "r2")
        return found.withColumn("hit", F.when((F.col("x.s") < F.col("qe")) & (F.col("qs") <= F.col("qe")), F.col("x"))).drop("x")

    # --- nearest
    def nearest(self, queries: IntervalFrame, key: str, mode: str = "nearest") -> DataFrame:
        """(key, found, gap) for each query: a struct of an entry on the query's plane, null if the plane has none.

        ``nearest``: least distance, then the lowest (start, end). ``floor``: of the overlapping entries the lowest; if none
        overlaps, the greatest in (start, end) order before the query, else the first of the plane. Equal queries are looked
        up once; what overlaps, and what is before and after, are extremes along the line, so no pairs are made. A query
        with a null bound finds nothing.
        """
        if mode not in ("nearest", "floor"):
            raise ValueError(mode)
        entries, asked = self._entries(), queries._asked(key)
        extents = asked.where("qs is not null and qe is not null and plane is not null").select("plane", "qs", "qe").distinct()
        cuts = _cuts(entries, extents)
        back = [-c for c in reversed(cuts)]
        found = self._lowest(entries.where("e >= s").select("plane", "e", "x"), extents, cuts)
        if mode == "floor":
            found = _previous(entries, found, ("s", "e"), ("qs", "qe"), cuts, "before")
            ends = entries.groupBy("plane").agg(F.min("x").alias("first"))
            out = found.join(ends, "plane").select("plane", "qs", "qe", F.coalesce("hit", "before", "first").alias("found"))
        else:
            far = str((1 << 62) - 1)
            found = _previous(entries, found, ("e", "-s"), ("qs", far), cuts, "left", low_ties=True)
            found = _previous(entries, found, ("-s", "-e"), ("-qe", far), back, "right", low_ties=True)
            a, b = F.col("qs") - F.col("left.e"), F.col("right.s") - F.col("qe")
            side = F.when(F.col("left").isNull(), F.col("right")).when(F.col("right").isNull() | (a <= b), F.col("left")).otherwise(F.col("right"))
            out = found.select("plane", "qs", "qe", F.coalesce("hit", side).alias("found"))
        out = asked.join(out, ["plane", "qs", "qe"], "left")
        gap = F.greatest(F.col("found.s") - F.col("qe"), F.col("qs") - F.col("found.e"), F.lit(0).cast("long"))
        return out.select(F.col("key").alias(key), "found", F.when(F.col("found").isNotNull(), gap).alias("gap"))


def _cuts(entries: DataFrame, extents: DataFrame) -> list[float]:
    """Cuts of the line between about equal numbers of bounds: one for each ``NEAR_ROWS``, ``NEAR_CUTS`` at most."""
    bounds = entries.select(F.explode(F.array("s", "e")).alias("r")).unionByName(extents.select(F.explode(F.array("qs", "qe")).alias("r")))
    n = 2 * (entries.count() + extents.count())
    parts = min(NEAR_CUTS + 1, -(-n // NEAR_ROWS))
    if parts < 2:
        return []
    found = bounds.agg(F.percentile_approx("r", [k / parts for k in range(1, parts)], 10 * NEAR_CUTS)).first()[0]
    return sorted({float(c) for c in found})


def _running(entries: DataFrame, asked: DataFrame, values: dict[str, Callable], cuts: list[float]) -> DataFrame:
    """``asked`` with each value summed up (sum, min or max) over the entries at or before (r1, r2), on the plane.

    Both have plane, r1 and r2. They are put side by side in the parts of the line between ``cuts``, so no task needs
    a whole plane; what a part inherits is found over one row for each part.
    """
    columns = asked.columns
    kinds = {c: entries.schema[c].dataType for c in values}
    row = asked.select("plane", "r1", "r2", *(F.lit(None).cast(k).alias(c) for c, k in kinds.items()), F.struct(*columns).alias("row"))
    both = entries.select("plane", "r1", "r2", *values, F.lit(None).cast(row.schema["row"].dataType).alias("row")).unionByName(row)
    if cuts:
        from pyspark.ml.feature import Bucketizer

        edges = [-math.inf, *cuts, math.inf]
        both = Bucketizer(splits=edges, inputCol="at", outputCol="part").transform(both.withColumn("at", F.col("r1").cast("double"))).drop("at")
    else:
        both = both.withColumn("part", F.lit(0.0))
    before = Window.partitionBy("plane", "part").orderBy("r1", "r2", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.select("plane", "part", "row", *(f(c).over(before).alias(c) for c, f in values.items())).where("row is not null")
    if cuts:
        tops = both.groupBy("plane", "part").agg(*(f(c).alias(c) for c, f in values.items()))
        earlier = Window.partitionBy("plane").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.select("plane", "part", *(f(c).over(earlier).alias(f"{c}_before") for c, f in values.items()))
        seen = seen.join(carried, ["plane", "part"])
    joint = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}
    both_of = lambda c, f: joint[f](F.col(c), F.col(f"{c}_before") if cuts else F.lit(None).cast(kinds[c]))
    return seen.select(*(F.col(f"row.{c}").alias(c) for c in columns), *(both_of(c, f).alias(c) for c, f in values.items()))


def _previous(entries: DataFrame, extents: DataFrame, rank: tuple[str, str], at: tuple[str, str], cuts: list[float], name: str, low_ties: bool = False) -> DataFrame:
    """``extents`` with the entry of the greatest rank (a pair) not above ``at``, on the plane. Of equal ranks, the
    greatest entry, or the least with ``low_ties``."""
    pick = F.min if low_ties else F.max
    ranked = entries.select("plane", F.expr(rank[0]).alias("r1"), F.expr(rank[1]).alias("r2"), "x").groupBy("plane", "r1", "r2").agg(pick("x").alias("x"))
    ranked = ranked.select("plane", "r1", "r2", F.struct("r1", "r2", "x").alias("top"))
    asked = extents.withColumns({"r1": F.expr(at[0]).cast("long"), "r2": F.expr(at[1]).cast("long")})
    return _running(ranked, asked, {"top": F.max}, cuts).drop("r1", "r2").withColumn(name, F.col("top.x")).drop("top")
