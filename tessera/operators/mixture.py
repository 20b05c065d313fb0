"""Mixtures of discrete distributions, fitted by k-means and expectation maximisation.

Values are whole numbers, so the data are first counted by value, once; every step of the fit is then one
aggregation over that histogram. Values of probability zero under the model are left out of a step.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import log_factorial, poisson_log_pmf


@dataclass(frozen=True)
class Component:
    rate: float
    weight: float


class Mixture(ABC):
    """The steps of a family of distributions: a log probability, what starts it, and what is estimated."""

    @abstractmethod
    def log_pmf(self, value: Column, parameter: float) -> Column: ...

    @abstractmethod
    def start(self, mean: float, sigma: float) -> float: ...

    def histogram(self, df: DataFrame, column: str) -> DataFrame:
        """(value, cnt, ln_fact), nulls left out."""
        v = F.col(column)
        return df.where(v.isNotNull()).groupBy(v.cast("long").alias("value")).agg(F.count("*").alias("cnt")).withColumn("ln_fact", log_factorial(F.col("value")))

    def e_step(self, hist: DataFrame, model: list[Component]) -> DataFrame:
        """Adds ``m``, the membership of each component, and ``ecll``, the expected log likelihood of a value."""
        logs = F.array(*(self.log_pmf(F.col("value"), c.rate).cast("double") + F.lit(math.log(c.weight) if c.weight > 0 else -math.inf) for c in model))
        df = hist.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
        # relative to the likeliest component, so that values far from all of them don't vanish
        df = df.withColumn("joint", F.when(F.col("top") > -math.inf, F.transform("logs", lambda x: F.exp(x - F.col("top")))).otherwise(F.transform("logs", lambda x: F.lit(0.0))))
        total = F.aggregate("joint", F.lit(0.0), lambda s, x: s + x)
        df = df.withColumn("m", F.transform("joint", lambda x: F.try_divide(x, total)))
        sums = F.aggregate(F.zip_with("m", "logs", lambda p, q: F.when(p == 0, 0.0).otherwise(p * q)), F.lit(0.0), lambda s, x: s + x)
        return df.withColumn("ecll", sums).drop("joint", "logs", "top")

    def m_step(self, memberships: DataFrame, k: int) -> list[Component]:
        """New components, from (value, cnt, m): means and shares weighted by membership."""
        fine = F.forall("m", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        got = memberships.where(fine).agg(*(e for j in range(k) for e in (F.sum(F.col("cnt") * F.get("m", F.lit(j))).alias(f"w{j}"), F.sum(F.col("cnt") * F.col("value") * F.get("m", F.lit(j))).alias(f"x{j}")))).first()
        weights = [got[f"w{j}"] or 0.0 for j in range(k)]
        total = sum(weights)
        if not total:
            raise ValueError("no value has a probability under the model")
        return [Component((got[f"x{j}"] or 0.0) / w if w else 0.0, w / total) for j, w in enumerate(weights)]

    def initialise(self, hist: DataFrame, k: int, seed: int = 1, max_iterations: int = 20) -> list[Component]:
        """k-means over the histogram, by weight; centroids ascend."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        from .statistics import assign

        points = hist.select(array_to_vector(F.array(F.col("value").cast("double"))).alias("features"), F.col("cnt").cast("double").alias("cnt"))
        found = KMeans(k=k, seed=seed, maxIter=max_iterations, weightCol="cnt").fit(points)
        centroids = sorted(float(c[0]) for c in found.clusterCenters())
        if len(centroids) < k:
            raise ValueError(f"{k} clusters asked for, {len(centroids)} found")
        c = F.array(*(F.lit(x) for x in centroids))
        rows = hist.withColumn("j", assign(F.col("value"), centroids)).groupBy("j").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * F.pow(F.col("value") - F.get(c, F.col("j")), 2)).alias("d")).collect()
        n = {r["j"]: (r["n"], math.sqrt(r["d"] / r["n"])) for r in rows}
        total = sum(x for x, _ in n.values())
        if len(n) < k:
            raise ValueError("a cluster is empty")
        return [Component(self.start(x, n[j][1]), n[j][0] / total) for j, x in enumerate(centroids)]

    def fit(self, df: DataFrame, column: str, k: int, max_iterations: int = 25, seed: int = 1, start: list[Component] | None = None) -> list[Component]:
        """Expectation maximisation until the expected log likelihood falls, or after ``max_iterations`` more steps."""
        hist = self.histogram(df, column).persist()
        try:
            model = start or self.initialise(hist, k, seed)
            last = -math.inf
            for _ in range(max_iterations + 1):
                memberships = self.e_step(hist, model)
                now = memberships.agg(F.sum(F.col("cnt") * F.coalesce("ecll", F.lit(0.0)))).first()[0]
                if now is None:
                    raise ValueError("no values")
                if now < last:
                    break
                last, model = now, self.m_step(memberships, k)
            return model
        finally:
            hist.unpersist()


class PoissonMixture(Mixture):
    def log_pmf(self, value: Column, parameter: float) -> Column:
        if parameter <= 0:
            return F.when(value == 0, F.lit(0.0)).otherwise(F.lit(-math.inf))
        return poisson_log_pmf(value, parameter, F.col("ln_fact"))

    def start(self, mean: float, sigma: float) -> float:
        return mean
