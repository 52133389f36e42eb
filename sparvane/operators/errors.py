"""Error tables: what resampling says about means, differences and reproducibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvane.operators.stats import cosine, draws, mean_vector

EQUIVALENT = 2.0


def resampled(rows: DataFrame, keys: list[str], order: list[str], value: str, iterations: int, seed: int = 42) -> DataFrame:
    """``keys, b, m, s``: mean and deviation of each draw of a group's values, with the same numbers for every group (a few values each)."""
    within = Window.partitionBy(*keys)
    slots = rows.select(*keys, F.col(value).cast("double").alias("v"), (F.row_number().over(within.orderBy(*order)) - 1).cast("bigint").alias("k"), F.count("*").over(within).alias("n"))
    drawn = draws(iterations, slots.select(*keys, F.lit(0).cast("bigint").alias("a"), "k", "n"), seed)
    values = slots.select(*keys, F.col("k").alias("i"), "v")
    return drawn.join(values, [*keys, "i"]).groupBy(*keys, "b").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))


def _limits(value: str, prefix: str) -> list[Column]:
    return [F.percentile(value, F.lit(p)).alias(f"{prefix}_{n}") for p, n in ((0.025, "lo"), (0.975, "hi"))]


def error_stats(rows: DataFrame, keys: list[str], order: list[str], value: str, iterations: int) -> DataFrame:
    """Per group mean, deviation and error, the robust ones, those of its resampled means, and relative errors in percent (null for a mean of 0)."""
    v = F.col(value)
    quartile = lambda p: F.percentile(v, F.lit(p))
    stats = rows.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), quartile(0.5).alias("median"), (quartile(0.75) - quartile(0.25)).alias("iqr"))
    mads = rows.join(stats.select(*keys, "median"), keys).groupBy(*keys).agg(F.percentile(F.abs(v - F.col("median")), F.lit(0.5)).alias("mad"))
    boot = resampled(rows, keys, order, value, iterations).groupBy(*keys).agg(F.avg("m").alias("bootstrap_mean"), F.stddev_samp("m").alias("bootstrap_sd"), *_limits("m", "ci95"))
    of_mean = lambda c: F.try_divide(F.col(c), F.nullif(F.col("mean"), F.lit(0.0))) * 100
    out = stats.join(mads, keys).join(boot, keys).withColumns({"sem": F.col("sd") / F.sqrt("n_runs"), "robust_absolute_error": 1.4826 * F.col("mad") / F.sqrt("n_runs")})
    return out.withColumns({"relative_error_pct": of_mean("bootstrap_sd"), "cv_pct": of_mean("sd")})


def reproducibility_errors(sims: DataFrame, runs: DataFrame, iterations: int) -> DataFrame:
    """``scope, agent`` and errors: within producers the mean similarity of their runs' pairs, their reproducibility (1 less the variation of a draw, 0 at least) and their compactness; between producers the mean cosine of their centroids; and the silhouette of all runs.

    ``sims``: ``agent_a, run_a, agent_b, run_b, s`` of all pairs of ``runs`` (``agent, run, embedding``).
    """
    own = sims.filter("agent_a = agent_b").select(F.col("agent_a").alias("agent"), "run_a", "run_b", "s")
    index = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.col("s"), F.nullif(F.col("m"), F.lit(0.0))), F.lit(0.0)))
    boot = resampled(own, ["agent"], ["run_a", "run_b"], "s", iterations).withColumn("index", index)
    similar = boot.groupBy("agent").agg(*_limits("m", "within_sim_ci95"), F.stddev_samp("m").alias("within_sim_bootstrap_sd"), F.avg("index").alias("reproducibility_index"), *_limits("index", "repro_ci95"))
    middle = mean_vector(runs, ["agent"], "embedding").withColumnRenamed("embedding", "centre")
    away = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    far = runs.join(middle, "agent").select("agent", "run", away.alias("d"))
    spread = resampled(far, ["agent"], ["run"], "d", iterations).groupBy("agent").agg(*_limits("m", "compactness_ci95"))
    within = own.groupBy("agent").agg(F.avg("s").alias("mean_within_similarity")).join(similar, "agent", "full").join(far.groupBy("agent").agg(F.avg("d").alias("centroid_compactness")).join(spread, "agent"), "agent", "full")
    x, y = (middle.select(F.col("agent").alias(f"agent_{i}"), F.col("centre").alias(f"centre_{i}")) for i in "xy")
    between = x.join(y, F.col("agent_x") < F.col("agent_y")).agg(F.avg(cosine("centre_x", "centre_y")).alias("mean_within_similarity"))
    both = sims.select(F.col("agent_a").alias("agent"), F.col("run_a").alias("run"), F.col("agent_b").alias("other"), "s").unionByName(sims.select(F.col("agent_b").alias("agent"), F.col("run_b").alias("run"), F.col("agent_a").alias("other"), "s"))
    means = both.groupBy("agent", "run", "other").agg((1 - F.avg("s")).alias("d"))
    is_own = F.col("agent") == F.col("other")
    sides = means.groupBy("agent", "run").agg(F.min(F.when(is_own, F.col("d"))).alias("a"), F.min(F.when(~is_own, F.col("d"))).alias("b"))
    width = F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    silhouette = sides.agg(F.avg(width).alias("mean_within_similarity"))
    named = within.withColumns({"scope": F.lit("within_agent"), "agent": F.col("agent").cast("string")})
    whole = [r.withColumns({"scope": F.lit(scope), "agent": F.lit(name)}).filter("mean_within_similarity is not null") for r, scope, name in ((between, "between_agent", "ALL_PAIRS"), (silhouette, "global_silhouette", "ALL"))]
    return named.unionByName(whole[0], allowMissingColumns=True).unionByName(whole[1], allowMissingColumns=True)
