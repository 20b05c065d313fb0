"""Mean, variance, z-scores, and assignment to centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_variance(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(mean, variance) of the population, of each group; null for no rows."""
    return df.groupBy(*(by or [])).agg(F.avg(column).alias("mean"), F.var_pop(column).alias("variance"))


def z_score(df: DataFrame, column: str, by: list[str] | None = None, to: str = "z") -> DataFrame:
    """Adds (x - mean) / population deviation, null where that is zero.

    One aggregation and a join with its result: one row for the whole, or one for each group. Not a window, which would
    bring a group, or all rows, into one task.
    """
    by = by or []
    stats = df.groupBy(*by).agg(F.avg(column).alias("__mu"), F.stddev_pop(column).alias("__sigma"))
    if by:
        for c in by:
            stats = stats.withColumnRenamed(c, f"__{c}")
        same = [df[c].eqNullSafe(stats[f"__{c}"]) for c in by]
        joined = df.join(stats, same, "left")
    else:
        joined = df.join(F.broadcast(stats))  # one row
    return joined.withColumn(to, F.try_divide(F.col(column) - F.col("__mu"), F.nullif(F.col("__sigma"), F.lit(0.0)))).select(*df.columns, to)


def assign(value: Column, centroids: list[float]) -> Column:
    """Index of the nearest of ascending centroids; of equally near ones the lower."""
    if list(centroids) != sorted(centroids) or not centroids:
        raise ValueError("centroids ascend, and there is one at least")
    d = F.transform(F.array(*(F.lit(float(c)) for c in centroids)), lambda c: F.abs(value.cast("double") - c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def cluster_stats(df: DataFrame, column: str, centroids: list[float]) -> DataFrame:
    """(cluster, n, sigma, weight): deviation about the centroid, and the share of all rows."""
    c = F.array(*(F.lit(float(x)) for x in centroids))
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), assign(F.col(column), centroids).alias("cluster"))
    per = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("v") - F.get(c, F.col("cluster")), 2))).alias("sigma"))
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("cluster", "n", "sigma", (F.col("n") / F.col("total")).alias("weight"))
