"""What reports show beside scores: themes that fire by rules, and the numbers behind box plots and error bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvane.operators.names import normal_form


def themes(enrichment: DataFrame, hits: DataFrame, rules: DataFrame, alpha: float = 0.05, strong: float = 0.10, least: int = 3) -> DataFrame:
    """``theme, n_enriched, n_strong, n_direct, fallen, fires`` for each theme of ``rules``.

    ``rules`` are rows ``theme, kind, name``: a ``pathway`` counts if it is enriched (q below
    ``alpha``) or strong (``least`` hits and p below ``strong``), a ``metabolite`` if it is among
    the hits, by their normal forms; a theme with ``falls`` rules names those of these
    metabolites that are hits with a negative change, and fires only if there is one.  Other
    themes fire on a pathway or a metabolite.  ``enrichment``: ``pathway, hits, p, q``; ``hits``: ``metabolite, log2fc``.
    """
    tested = enrichment.select(F.col("pathway").alias("name"), (F.col("q") < alpha).alias("enriched"), ((F.col("hits") >= least) & (F.col("p") < strong)).alias("strong")).filter("enriched or strong")
    paths = rules.filter("kind = 'pathway'").join(tested, "name").groupBy("theme").agg(F.count_if("enriched").alias("n_enriched"), F.count_if("strong").alias("n_strong"))
    known = hits.select(normal_form(F.col("metabolite")).alias("form"), "metabolite", "log2fc")
    named = rules.filter("kind <> 'pathway'").select("theme", "kind", normal_form(F.col("name")).alias("form")).distinct().join(known, "form")
    fallen = F.when((F.col("kind") == "falls") & (F.col("log2fc") < 0), F.col("metabolite"))
    direct = named.groupBy("theme").agg(F.count_distinct("form").alias("n_direct"), F.array_join(F.array_sort(F.collect_set(fallen)), ", ").alias("fallen"))
    every = rules.groupBy("theme").agg(F.count_if(F.col("kind") == "falls").alias("wanted"))
    rows = every.join(paths, "theme", "left").join(direct, "theme", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_enriched", "n_strong", "n_direct")} | {"fallen": F.coalesce("fallen", F.lit(""))})
    reason = (F.col("n_enriched") + F.col("n_strong") + F.col("n_direct")) > 0
    return rows.withColumn("fires", reason & ((F.col("wanted") == 0) | (F.col("fallen") != ""))).drop("wanted")


def _quartiles(rows: DataFrame, key: str, value: str) -> DataFrame:
    q = {n: F.percentile(value, F.lit(p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *q.values())


def _reach(side: str) -> Column:
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    return F.col("q1") - wide if side == "low" else F.col("q3") + wide


def boxes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, n, mean, q1, median, q3, whisker_lo, whisker_hi, n_outliers``: whiskers end at the furthest value within one and a half box lengths, and at the box if there is none beyond it."""
    stats = _quartiles(rows, key, value)
    v = F.col(value)
    ends = rows.join(stats.select(key, "q1", "q3"), key).groupBy(key).agg(
        F.min(F.when(v >= _reach("low"), v)).alias("lo"), F.max(F.when(v <= _reach("high"), v)).alias("hi"), F.count_if((v < _reach("low")) | (v > _reach("high"))).alias("n_outliers")
    )
    out = stats.join(ends, key)
    return out.select(key, "n", "mean", "q1", "median", "q3", F.least("lo", "q1").alias("whisker_lo"), F.greatest("hi", "q3").alias("whisker_hi"), "n_outliers")


def box_outliers(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows beyond the whiskers."""
    v = F.col(value)
    return rows.join(_quartiles(rows, key, value).select(key, "q1", "q3"), key).filter((v < _reach("low")) | (v > _reach("high"))).drop("q1", "q3")


def agent_summary(runs: DataFrame, score: str, means: DataFrame) -> DataFrame:
    """Per producer of ``agent, run, score_type`` and a score: mean, deviation, error, the interval of its bootstrap ``means`` (``agent, m``), the error bars from these, the commonest kind of score (ties: the first by name) and the whole part of its average rank."""
    from pyspark.sql import Window

    sd = F.coalesce(F.stddev_samp(score), F.lit(0.0))
    stats = runs.groupBy("agent").agg(F.count("*").alias("n_runs"), F.avg(score).alias("mean_score"), sd.alias("sd_score"), F.mode("score_type", True).alias("score_type"))
    limits = means.groupBy("agent").agg(*(F.percentile("m", F.lit(p)).alias(n) for p, n in ((0.025, "ci95_lo"), (0.975, "ci95_hi"))))
    rows = stats.join(limits, "agent").withColumn("sem_score", F.col("sd_score") / F.sqrt("n_runs"))
    bar = lambda x: F.greatest(x, F.lit(0.0))
    mean = F.bround("mean_score", 9)
    rank = F.rank().over(Window.orderBy(F.desc("by"))) + (F.count("*").over(Window.partitionBy("by")) - 1) / 2.0
    rows = rows.withColumns({"err_lo": bar(F.col("mean_score") - F.col("ci95_lo")), "err_hi": bar(F.col("ci95_hi") - F.col("mean_score")), "by": mean})
    return rows.withColumn("rank", F.floor(rank).cast("bigint")).drop("by")
