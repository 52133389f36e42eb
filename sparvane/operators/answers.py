"""Tables of questions and of claims: each row states a method, a key result in words and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = ("Question", "Method", "Key_result", "Interpretation", "Limitation")
CLAIM = ("Claim", "Validation_method", "Key_quantitative_result", "Verdict")


def listed(agent: str, *text: Column | str) -> Column:
    """Texts of all rows of a group, by producer, parted by semicolons."""
    said = F.concat(F.col(agent).cast("string"), *(F.lit(t) if isinstance(t, str) else t for t in text))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(agent).alias("a"), said.alias("t")))), lambda x: x["t"]), "; ")


def fixed(value: str, places: int = 2) -> Column:
    """A number with so many decimal places; halves go to the even neighbour, and a negative one that rounds to nothing keeps its sign."""
    rounded = F.bround(value, places)
    lost = (F.col(value) < 0) & (rounded == 0)  # Spark rounds decimals, which have no negative zero
    return F.concat(F.when(lost, "-").otherwise(""), F.format_string(f"%.{places}f", rounded))


def _row(names: tuple, frame: DataFrame, *values: Column | str) -> DataFrame:
    return frame.select(*((F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(names, values)))


def _either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, yes).otherwise(no)


def scoring_answers(volume: DataFrame, ranks: DataFrame, errors: DataFrame, differences: DataFrame, repro: DataFrame, score_type: DataFrame) -> DataFrame:
    """The scoring validation's questions from ``metric, spearman_rho``; ``agent, expected_rank, switch_probability``; :func:`error_stats` by ``agent``; ``diff_ci95_lo, diff_ci95_hi``; :func:`reproducibility_errors`; and one ``score_type``.  A question without rows isn't asked."""
    # The texts of questions, methods, interpretations and limitations.
    size = F.abs("spearman_rho")
    top = volume.filter("spearman_rho is not null").agg(F.min(F.struct((-size).alias("less"), "metric")).alias("t"), F.count("*").alias("n")).filter("n > 0").select((-F.col("t.less")).alias("rho"), "t.metric")
    first = ranks.agg(F.min(F.struct("expected_rank", "agent", "switch_probability")).alias("f"), F.count("*").alias("n")).filter("n > 0").select("f.*")
    each = errors.agg(listed("agent", ": ±", fixed("bootstrap_sd")).alias("absolute"), listed("agent", ": ", fixed("relative_error_pct", 1), "%").alias("relative"), F.count("*").alias("n")).filter("n > 0")
    apart = differences.agg(F.count_if(F.col("diff_ci95_lo") * F.col("diff_ci95_hi") > 0).alias("k"), F.count("*").alias("n")).filter("n > 0")
    within = repro.filter("scope = 'within_agent'").agg(listed("agent", ": ", fixed("mean_within_similarity"), "[", fixed("within_sim_ci95_lo"), ",", fixed("within_sim_ci95_hi"), "]").alias("t"), F.count("*").alias("n")).filter("n > 0")
    rows = [
        _row(ANSWER, top, "Is AgentScore correlated with output volume?", "Spearman correlation (score vs volume metrics)", F.concat(F.lit("max |ρ|="), fixed("rho"), F.lit(" ("), "metric", F.lit(")")), _either(F.col("rho") > 0.5, "Possible volume sensitivity", "Weak volume sensitivity"), "n_runs small; correlation unstable"),
        _row(ANSWER, first, "Does the top-ranked agent remain stable after output-volume diagnostics / bootstrap?", "Bootstrap ranking (rank-switch probability)", F.concat("agent", F.lit(" switch prob="), fixed("switch_probability")), _either(F.col("switch_probability") < 0.25, "Stable", "Unstable"), "Only 8 real runs per agent"),
        _row(ANSWER, each, "What is the absolute error of each agent-level score?", "Bootstrap SD of the agent mean AgentScore", F.col("absolute"), "Descriptive uncertainty", "Bootstrap over 8 runs only"),
        _row(ANSWER, each, "What is the relative error of each agent-level score?", "absolute_error / mean_score × 100", F.col("relative"), "Descriptive uncertainty", "Unstable when mean is small"),
        _row(ANSWER, apart, "Are pairwise score differences larger than their bootstrap uncertainty?", "Bootstrap 95% CI of pairwise difference excludes 0", F.format_string("%d/%d pairs separated", "k", "n"), _either(F.col("k") < F.col("n"), "Some/most pairs overlap", "Pairs separated"), "Practical equivalence band |Δ|<2"),
        _row(ANSWER, within, "Are reproducibility estimates robust to run-level resampling?", "Bootstrap CI of within-agent similarity", F.col("t"), "Descriptive reproducibility", "Few pairwise comparisons"),
        _row(ANSWER, score_type, "Are scores manual or proxy-estimated?", "Score source flag", F.concat(F.lit("score_type = "), F.col("score_type")), _either(F.col("score_type") != "manual", "Proxy = exploratory until expert-validated", "Manual scores used as primary"), "Proxy scores are not ground truth"),
    ]
    return reduce(DataFrame.unionByName, rows)


def claims(within: DataFrame, between: DataFrame, ranks: DataFrame, consistency: DataFrame) -> DataFrame:
    """The claims that a study makes and how far its numbers bear them out: ``reproducibility, cv_pct``; ``centroid_cosine_sim``; ``agent, rank, p``; and one ``kendall_w``."""
    # The texts of claims, methods and verdicts.
    inside = within.agg(F.avg("reproducibility").alias("r"), F.avg("cv_pct").alias("cv"), F.count("*").alias("n")).filter("n > 0")
    across = between.agg(F.avg("centroid_cosine_sim").alias("c"), F.count("*").alias("n")).filter("n > 0")
    first = ranks.filter("rank = 1").agg(listed("agent", ": P(rank1)=", fixed("p")).alias("t"), F.count("*").alias("n")).filter("n > 0")
    w = F.when(F.col("kendall_w").isNull(), "Insufficient data").otherwise(F.concat(F.lit("Kendall W = "), fixed("kendall_w", 3)))
    rows = [
        _row(CLAIM, inside, "Within-agent runs are reproducible (CV < 10%)", "Bootstrap pairwise cosine similarity CV", F.concat(F.lit("Mean reproducibility index = "), fixed("r", 3), F.lit("; Mean CV = "), fixed("cv", 1), F.lit("%")), _either(F.col("r") > 0.8, "Supported descriptively", "Partially supported")),
        _row(CLAIM, across, "Agents produce semantically distinct outputs", "Centroid cosine similarity between agent pairs", F.concat(F.lit("Mean between-agent cosine similarity = "), fixed("c", 3)), _either(F.col("c") < 0.9, "Supported descriptively", "Not supported")),
        _row(CLAIM, first, "Ranking is stable across bootstrap resampling", "Bootstrap ranking probability (n=10000)", F.col("t"), "Descriptive-only"),
        _row(CLAIM, consistency, "Run scores are internally consistent", "Kendall's W across agent run vectors", w, "Descriptive-only (n_runs limited)"),
        _row(CLAIM, consistency, "Proxy scores approximate expert judgment", "Structural feature keywords (no ground-truth labels)", "N/A — proxy scores are keyword-count-based", "Requires external validation"),
        _row(CLAIM, consistency, "MC satellite points characterise uncertainty, not real observations", "Design: bootstrap centroids and Gaussian samples", "By construction", "Supported descriptively"),
    ]
    return reduce(DataFrame.unionByName, rows)
