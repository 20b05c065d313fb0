"""Numeric and array functions, as column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def factorial(i: Column) -> Column:
    """i! as a long: 1 for i <= 1, null above 20, where a long is too small."""
    return F.when(i <= 1, F.lit(1).cast("long")).otherwise(F.factorial(i.cast("int")))


def fp_equals(a: Column, b: Column, tol: float = 1e-6) -> Column:
    """|a - b| <= tol; false if that difference isn't a number."""
    d = F.abs(a - b)
    return (d <= tol) & ~F.isnan(d)


def safe_log(v: Column, floor: float = -100_000.0) -> Column:
    """Natural logarithm, or ``floor`` where that isn't finite (zero, negative, NaN, infinite)."""
    v = v.cast("double")
    return F.when(v.isNull(), F.lit(None).cast("double")).when((v > 0) & ~F.isnan(v) & (v != float("inf")), F.ln(v)).otherwise(F.lit(float(floor)))


def array_total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    """Each element over the array's sum; null elements where the sum is zero."""
    total = array_total(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), total))


def scale_array(s: Column | float, a: Column) -> Column:
    s = s if isinstance(s, Column) else F.lit(s)
    return F.transform(a, lambda x: x * s)


def add_arrays(a: Column, b: Column) -> Column:
    """Element by element, over the length of the first; what the second lacks counts as zero."""
    return F.transform(a, lambda x, i: x + F.coalesce(F.get(b, i), F.lit(0)))


def sum_arrays(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Element-wise sum of an array column over all rows (of a group): partial sums by position, then one array."""
    by = by or []
    keys = [F.col(c) for c in by]
    parts = df.select(*keys, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.sum("x").alias("x"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("total")
    return parts.groupBy(*by).agg(whole)


def log_factorial(v: Column) -> Column:
    """ln v! of a whole number; zero for v < 2. Summed below 64; from there on Stirling's series, whose error is below 1e-15."""
    small = F.sequence(F.lit(2).cast("long"), F.least(v.cast("long"), F.lit(64).cast("long")))
    summed = F.aggregate(F.when(v < 2, F.array().cast("array<long>")).otherwise(small), F.lit(0.0), lambda s, x: s + F.ln(x.cast("double")))
    x = v.cast("double")
    series = (x + 0.5) * F.ln(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(v < 64, summed).otherwise(series)


def poisson_log_pmf(v: Column, rate: float, ln_fact: Column | None = None) -> Column:
    """ln P(v) of a Poisson distribution; v a whole number of zero or more."""
    return v * F.lit(math.log(rate)) - F.lit(float(rate)) - (log_factorial(v) if ln_fact is None else ln_fact)
