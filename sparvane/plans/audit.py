"""Registered queries: does the score follow output volume, and does the ranking hold under other definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.functions import special
from sparvane.operators import robust
from sparvane.operators import scoring as S
from sparvane.operators import stats as T
from sparvane.operators.settled import settled
from sparvane.plans import catalogue as C
from sparvane.plans import resampling as R
from sparvane.plans.catalogue import query

RHO_DRAWS = 2000
METRICS = ("n", "purchases", "errors")

_RANKS = """l AS (SELECT agent, run, score, unnest(['n', 'purchases', 'errors']) AS metric, unnest([n, purchases, errors]) AS x FROM sc),
r AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY score) + (count(*) OVER (PARTITION BY metric, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY metric ORDER BY x) + (count(*) OVER (PARTITION BY metric, x) - 1) / 2.0 AS rx FROM l),
rho AS (SELECT metric, count(*) AS n, covar_pop(CAST(rs AS DOUBLE), CAST(rx AS DOUBLE)) / nullif(stddev_pop(CAST(rs AS DOUBLE)) * stddev_pop(CAST(rx AS DOUBLE)), 0) AS rho FROM r GROUP BY metric)"""
_T = "(rho * sqrt((n - 2) / (1 - rho * rho)))"
# Resamples of runs: slot k of draw b takes run i; a resample in which either side is constant is skipped.
_SPEAR = f"""{R.EV}, {_RANKS}, slot AS (SELECT *, row_number() OVER (ORDER BY agent, run) - 1 AS k, count(*) OVER () AS cnt FROM sc),
g0 AS (SELECT cnt, b, (b * 48271 + k * 69621 + 42 * 16807 + 1) % 2147483647 AS x0 FROM slot, (SELECT unnest(generate_series(0, {RHO_DRAWS - 1})) AS b)),
g1 AS (SELECT cnt, b, {R._P5.format(x='x0')} AS x1 FROM g0), g2 AS (SELECT cnt, b, (x1 * 48271 + 11) % 2147483647 AS x2 FROM g1), g3 AS (SELECT b, ({R._P5.format(x='x2')}) % cnt AS i FROM g2),
bl AS (SELECT b, score, unnest(['n', 'purchases', 'errors']) AS metric, unnest([n, purchases, errors]) AS x FROM g3 JOIN slot ON i = k),
br AS (SELECT b, metric, rank() OVER (PARTITION BY b, metric ORDER BY score) + (count(*) OVER (PARTITION BY b, metric, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY b, metric ORDER BY x) + (count(*) OVER (PARTITION BY b, metric, x) - 1) / 2.0 AS rx FROM bl),
bq AS (SELECT metric, b, covar_pop(CAST(rs AS DOUBLE), CAST(rx AS DOUBLE)) / nullif(stddev_pop(CAST(rs AS DOUBLE)) * stddev_pop(CAST(rx AS DOUBLE)), 0) AS q FROM br GROUP BY ALL),
ci AS (SELECT metric, quantile_cont(q, 0.025) AS lo, quantile_cont(q, 0.975) AS hi FROM bq WHERE q IS NOT NULL GROUP BY metric)"""


def score_volume(runs: DataFrame, score: str, metrics: tuple[str, ...], draws: int = RHO_DRAWS) -> DataFrame:
    """``metric, spearman_rho, p_value, rho_ci95_lo, rho_ci95_hi, n_runs`` of a score and volume metrics over runs (a few hundred rows).

    Null below three runs or where either side is constant; no interval below four runs.
    """
    long = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics)))

    def rho(rows: DataFrame, *keys: str) -> DataFrame:
        ranks = rows.select(*keys, T.average_rank("score", list(keys)).alias("rs"), T.average_rank("x", list(keys)).alias("rx"))
        return ranks.groupBy(*keys).agg(F.count("*").alias("n"), T.correlation("rs", "rx").alias("rho"))

    scored = runs.select("agent", "run", F.col(score).alias("score"), *metrics)
    whole = rho(scored.select("score", long), "metric")
    order = Window.orderBy("agent", "run")
    slots = scored.withColumn("k", (F.row_number().over(order) - 1).cast("bigint")).withColumn("cnt", F.count("*").over(Window.partitionBy()))
    drawn = T.draws(draws, slots.select(F.lit(0).cast("bigint").alias("a"), "k", F.col("cnt").alias("n"))).select("b", F.col("i").alias("k"))
    resampled = rho(drawn.join(F.broadcast(slots.drop("cnt")), "k").select("b", "score", long), "metric", "b").filter("rho is not null")
    limits = resampled.groupBy("metric").agg(*(F.percentile("rho", F.lit(p)).alias(n) for p, n in ((0.025, "lo"), (0.975, "hi"))))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    enough = lambda n, x: F.when(F.col("n") >= n, x)
    return whole.join(limits, "metric", "left").select("metric", enough(3, F.col("rho")).alias("spearman_rho"), enough(3, special.t_two_sided(t, (F.col("n") - 2).cast("double"))).alias("p_value"), enough(4, F.col("lo")).alias("rho_ci95_lo"), enough(4, F.col("hi")).alias("rho_ci95_hi"), F.col("n").alias("n_runs"))


@query(f"""WITH {_SPEAR} SELECT rho.metric, round_even(rho, 6) AS spearman_rho, round_even({special.t_two_sided_sql(_T, "CAST(n - 2 AS DOUBLE)")}, 6) AS p_value, round_even(lo, 6) AS rho_ci95_lo, round_even(hi, 6) AS rho_ci95_hi, n AS n_runs FROM rho LEFT JOIN ci ON rho.metric = ci.metric""")
def score_volume_correlation(spark, sf):
    rows = score_volume(R.event_scores(spark, sf), "score", METRICS)
    return rows.withColumns({c: F.bround(c, 6) for c in rows.columns[1:-1]})


# Definitions: proxy score, rubric, reproducibility, depth, process quality and the score without volume features.
DEFINITIONS = ["A_proxy_agentscore", "B_domain_score", "C_reproducibility", "D_interpretation_depth", "E_process_quality", "G_no_volume_features"]
_REPRO = "repro AS (SELECT 'src' || agent_a AS agent, greatest(0, 1 - coalesce(stddev_samp(s), 0) / abs(avg(s))) AS v FROM sims WHERE agent_a = agent_b GROUP BY agent_a)"
_MEANS = {"A_proxy_agentscore": "SELECT agent, avg(AgentScore) AS v FROM scores GROUP BY agent", "B_domain_score": "SELECT agent, avg(DomainScore) AS v FROM graded GROUP BY agent", "C_reproducibility": "SELECT agent, v FROM repro", "D_interpretation_depth": "SELECT agent, avg(D) AS v FROM scores GROUP BY agent", "E_process_quality": "SELECT agent, avg(P) AS v FROM scores GROUP BY agent", "G_no_volume_features": "SELECT agent, avg(AgentScore) AS v FROM less GROUP BY agent"}
SENS = f"{C.PARTS}{C.scores_sql('scores')}{C.scores_sql('less', S.VOLUME)}{C.graded_sql(C._TERM_SQL, S.TRANSCRIPTS)}, {C.VEC}, {_REPRO}, defs AS (" + " UNION ALL ".join(f"SELECT '{d}' AS definition, agent, round_even(CAST(v AS DOUBLE), 6) AS v FROM ({q})" for d, q in _MEANS.items()) + "), sens AS (SELECT definition, agent, round_even(v, 3) AS mean_value, rank() OVER (PARTITION BY definition ORDER BY v DESC) AS rank FROM defs)"


def means(spark: SparkSession, sf: str, penalised: bool = False) -> DataFrame:
    """``definition, agent, v``: each definition's mean by agent; ``penalised`` adds F, which SQL can't state."""
    features = settled(C.run_features_frame(spark, sf))  # read by every definition
    parts = S.components(features)
    scores, less = S.run_scores(parts), S.run_scores(parts, S.VOLUME)
    sims = C.run_similarities(spark, sf).filter("agent_a = agent_b").groupBy(F.concat(F.lit("src"), "agent_a").alias("agent"))
    repro = sims.agg(F.greatest(F.lit(0.0), 1 - F.try_divide(F.coalesce(F.stddev_samp("s"), F.lit(0.0)), F.abs(F.avg("s")))).alias("v"))
    mean = lambda rows, c: rows.groupBy("agent").agg(F.avg(c).alias("v"))
    by = dict(zip(DEFINITIONS, (mean(scores, "AgentScore"), mean(S.rubric(features), "DomainScore"), repro, mean(scores, "D"), mean(scores, "P"), mean(less, "AgentScore"))))
    if penalised:
        volume = ["n_files", "n_chars", "n_tables", "n_images"]
        by["F_volume_penalized"] = mean(robust.volume_penalised(scores.join(features.select("agent", "run", *volume), ["agent", "run"]), "AgentScore", volume), "AgentScore_volume_penalized")
    frames = [rows.select(F.lit(d).alias("definition"), "agent", F.bround(F.col("v").cast("double"), 6).alias("v")) for d, rows in by.items()]
    out = frames[0]
    for rows in frames[1:]:
        out = out.unionByName(rows)
    return out


def sensitivity(spark: SparkSession, sf: str, penalised: bool = False) -> DataFrame:
    ranks = F.rank().over(Window.partitionBy("definition").orderBy(F.desc("v"))).cast("bigint")
    return means(spark, sf, penalised).select("definition", "agent", F.bround("v", 3).alias("mean_value"), ranks.alias("rank"))


@query(f"WITH {SENS} SELECT * FROM sens")
def ranking_sensitivity(spark, sf):
    return sensitivity(spark, sf)


@query(None)
def ranking_sensitivity_with_penalty(spark, sf):
    """All seven definitions; F is a robust regression's residual (no SQL twin: see the tests of its optimality)."""
    return sensitivity(spark, sf, penalised=True)


@query(f"WITH {SENS} SELECT agent, " + ", ".join(f"max(rank) FILTER (definition = '{d}') AS {d}" for d in DEFINITIONS) + ", count(DISTINCT rank) > 1 AS changes FROM sens GROUP BY agent")
def sensitivity_pivot(spark, sf):
    wide = sensitivity(spark, sf).groupBy("agent").pivot("definition", DEFINITIONS).agg(F.first("rank"))
    return wide.withColumn("changes", F.size(F.array_distinct(F.array_compact(F.array(*DEFINITIONS)))) > 1)


@query(f"""WITH {SENS}, w AS (SELECT definition, min(agent) AS winner FROM sens WHERE rank = 1 GROUP BY definition)
SELECT winner, count(*) AS wins, count(*) / 6.0::DOUBLE AS share FROM w GROUP BY winner""")
def winner_share(spark, sf):
    winners = sensitivity(spark, sf).filter("rank = 1").groupBy("definition").agg(F.min("agent").alias("winner"))
    return winners.groupBy("winner").agg(F.count("*").alias("wins"), (F.count("*") / float(len(DEFINITIONS))).alias("share"))


@query(f"""WITH {SENS}, m AS (SELECT agent, max(v) FILTER (definition = 'A_proxy_agentscore') AS p, max(v) FILTER (definition = 'B_domain_score') AS d, max(v) FILTER (definition = 'G_no_volume_features') AS g FROM defs GROUP BY agent HAVING p IS NOT NULL AND d IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rd, rank() OVER (ORDER BY g) + (count(*) OVER (PARTITION BY g) - 1) / 2.0 AS rg FROM m),
w AS (SELECT definition, min(agent) AS winner FROM sens WHERE rank = 1 GROUP BY definition), c AS (SELECT winner, count(*) AS n FROM w GROUP BY winner), top AS (SELECT winner, n FROM c ORDER BY n DESC, winner LIMIT 1)
SELECT 'proxy_vs_domain_rank_correlation' AS diagnostic, printf('%.3f', covar_pop(CAST(rp AS DOUBLE), CAST(rd AS DOUBLE)) / (stddev_pop(CAST(rp AS DOUBLE)) * stddev_pop(CAST(rd AS DOUBLE)))) AS value, 'Spearman of agent-mean scores' AS detail FROM r
UNION ALL SELECT 'top_agent_stability', printf('%.2f', n / (SELECT count(*) FROM w)::DOUBLE), 'most_common_top=' || winner || '; distinct_winners=' || (SELECT count(*) FROM c) FROM top
UNION ALL SELECT 'agents_changing_rank_without_volume', CAST(count_if(rp <> rg) AS VARCHAR), 'score without output-volume features' FROM r""")
def score_audit(spark, sf):
    """Diagnostics of the ranking: agreement of the two scores, the most common winner, ranks that change without volume features."""
    rows = means(spark, sf)
    pick = lambda d: F.max(F.when(F.col("definition") == d, F.col("v")))
    wide = rows.groupBy("agent").agg(pick("A_proxy_agentscore").alias("p"), pick("B_domain_score").alias("d"), pick("G_no_volume_features").alias("g")).filter("p is not null and d is not null")
    ranks = wide.select(*(T.average_rank(c, []).alias(f"r{c}") for c in "pdg"))
    first = ranks.agg(T.correlation("rp", "rd").alias("rho"), F.count_if(F.col("rp") != F.col("rg")).alias("changed"))  # one row
    winners = rows.withColumn("r", F.rank().over(Window.partitionBy("definition").orderBy(F.desc("v")))).filter("r = 1").groupBy("definition").agg(F.min("agent").alias("winner"))
    wins = winners.groupBy("winner").agg(F.count("*").alias("n"))
    top = wins.agg(F.max_by("winner", F.struct("n", F.lit(0))).alias("any"), F.min(F.struct(-F.col("n"), F.col("winner"))).alias("best"), F.sum("n").alias("all"), F.count("*").alias("distinct"))  # one row
    diagnostics = F.array(
        F.struct(F.lit("proxy_vs_domain_rank_correlation").alias("diagnostic"), F.format_string("%.3f", "rho").alias("value"), F.lit("Spearman of agent-mean scores").alias("detail")),
        F.struct(F.lit("top_agent_stability").alias("diagnostic"), F.format_string("%.2f", -F.col("best.col1") / F.col("all")).alias("value"), F.concat(F.lit("most_common_top="), F.col("best.winner"), F.lit("; distinct_winners="), F.col("distinct")).alias("detail")),
        F.struct(F.lit("agents_changing_rank_without_volume").alias("diagnostic"), F.col("changed").cast("string").alias("value"), F.lit("score without output-volume features").alias("detail")),
    )
    return first.crossJoin(top).select(F.inline(diagnostics))
