"""Reproducible resampling, reliability and matrix statistics on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIME = 2147483647


def draws(iterations: int, slots: DataFrame, seed: int = 42) -> DataFrame:
    """``b`` (0..iterations-1) for every row of ``slots`` (``a, k, n``) and the drawn index ``i`` in 0..n-1.

    Fifth powers modulo a prime mix iteration, slot and stream without overflow, so any
    engine with 64-bit integers draws the same numbers.
    """
    def power(x: str) -> Column:
        square = F.col(x) * F.col(x) % PRIME
        return square * square % PRIME * F.col(x) % PRIME

    grid = slots.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint"))))
    grid = grid.withColumn("x0", (F.col("b") * 48271 + F.col("k") * 69621 + F.col("a") * 40692 + seed * 16807 + 1) % PRIME)
    grid = grid.withColumn("x1", power("x0")).withColumn("x2", (F.col("x1") * 48271 + 11) % PRIME)
    return grid.withColumn("i", (power("x2") % F.col("n"))).drop("x0", "x1", "x2")


def bootstrap_means(scores: DataFrame, value: str, iterations: int, seed: int = 42) -> DataFrame:
    """``agent, b, m``: means of resampled runs; ``scores`` has ``agent, run`` and the value (a few runs an agent)."""
    ordered = scores.select("agent", F.col(value).alias("v"), (F.row_number().over(Window.partitionBy("agent").orderBy("run")) - 1).cast("bigint").alias("k"), F.count("*").over(Window.partitionBy("agent")).alias("n"))
    streams = scores.select("agent").distinct().withColumn("a", (F.row_number().over(Window.orderBy("agent")) - 1).cast("bigint"))
    drawn = draws(iterations, ordered.join(streams, "agent").select("agent", "a", "k", "n"), seed)
    values = ordered.select("agent", F.col("k").alias("i"), "v")
    return drawn.join(values, ["agent", "i"]).groupBy("agent", "b").agg(F.avg("v").alias("m"))


def interval(value: str) -> list[Column]:
    return [F.percentile(value, F.lit(p)).alias(n) for p, n in ((0.025, "lo"), (0.975, "hi"))]


def benjamini_hochberg(tests: DataFrame, p: str = "p", q: str = "q") -> DataFrame:
    """Adds step-up adjusted values; null p stay null.  One window over all tests: features, never raw rows."""
    order = Window.orderBy(F.asc_nulls_last(p), *[c for c in tests.columns if c != p][:1])
    ranked = tests.withColumn("__i", F.row_number().over(order))
    adjusted = ranked.withColumn("__a", F.col(p) * F.count(p).over(Window.partitionBy()) / F.col("__i"))
    least = F.min("__a").over(Window.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0))
    return adjusted.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("__i", "__a")


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays, 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def mean_vector(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Component-wise mean per group, as ``vector``; partial sums are combined before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s.x).alias(vector))


def average_rank(value: str, group: list[str], descending: bool = False) -> Column:
    """Ranks within a group, ties at their average."""
    order = F.desc(value) if descending else F.asc(value)
    return F.rank().over(Window.partitionBy(*group).orderBy(order)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2.0


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation of a group; null where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def share(part: Column, whole: Column) -> Column:
    """A quotient that is null where the whole is 0."""
    return F.try_divide(part, whole)
