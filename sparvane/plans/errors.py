"""Registered queries: error tables over definitions of scores, and of reproducibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparvane.operators import errors as E
from sparvane.plans import catalogue as C
from sparvane.plans import resampling as R
from sparvane.plans.catalogue import query

DRAWS = 2000


def boot_sql(name: str, source: str, key: list[str], order: str, value: str) -> str:
    """CTEs of resampled means and deviations of a group's values, with the same numbers for every group."""
    keys, same = ", ".join(key), " AND ".join(f"d.{k} = s.{k}" for k in key)
    return f"""{name}s AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS k, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
{name}0 AS (SELECT {keys}, n, b, (b * 48271 + k * 69621 + 42 * 16807 + 1) % 2147483647 AS x0 FROM {name}s, (SELECT unnest(generate_series(0, {DRAWS - 1})) AS b)), {name}1 AS (SELECT {keys}, n, b, {R._P5.format(x='x0')} AS x1 FROM {name}0),
{name}2 AS (SELECT {keys}, n, b, (x1 * 48271 + 11) % 2147483647 AS x2 FROM {name}1), {name}3 AS (SELECT {keys}, b, ({R._P5.format(x='x2')}) % n AS i FROM {name}2),
{name} AS (SELECT {", ".join("d." + k for k in key)}, b, avg(v) AS m, stddev_samp(v) AS s FROM {name}3 d JOIN {name}s s ON {same} AND d.i = s.k GROUP BY ALL)"""


# Six measures of runs stand for the definitions of a score.
DEFINITIONS = {"A_mean_value": "score", "B_volume": "n", "C_purchases": "purchases", "D_errors": "errors", "E_purchase_share": "purchases / n", "F_error_share": "errors / n"}
_STATS = ("mean", "sd", "sem", "median", "iqr", "mad", "robust_absolute_error", "bootstrap_mean", "bootstrap_sd", "ci95_lo", "ci95_hi", "relative_error_pct", "cv_pct")
_DEFS = " UNION ALL ".join(f"SELECT '{d}' AS definition, agent, run, CAST({v} AS DOUBLE) AS v FROM sc" for d, v in DEFINITIONS.items())
SUMMARY = f"""{R.EV}, defs AS ({_DEFS}), {boot_sql('bt', 'defs', ['definition', 'agent'], 'run', 'v')}, bs AS (SELECT definition, agent, avg(m) AS bootstrap_mean, stddev_samp(m) AS bootstrap_sd, quantile_cont(m, 0.025) AS ci95_lo, quantile_cont(m, 0.975) AS ci95_hi FROM bt GROUP BY ALL),
st AS (SELECT definition, agent, count(*) AS n_runs, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, median(v) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM defs GROUP BY ALL),
md AS (SELECT st.definition, st.agent, median(abs(v - median)) AS mad FROM defs JOIN st ON st.definition = defs.definition AND st.agent = defs.agent GROUP BY ALL),
al AS (SELECT st.*, mad, sd / sqrt(n_runs) AS sem, 1.4826::DOUBLE * mad / sqrt(n_runs) AS robust_absolute_error, bootstrap_mean, bootstrap_sd, ci95_lo, ci95_hi, bootstrap_sd / nullif(mean, 0) * 100 AS relative_error_pct, sd / nullif(mean, 0) * 100 AS cv_pct
  FROM st JOIN md ON md.definition = st.definition AND md.agent = st.agent JOIN bs ON bs.definition = st.definition AND bs.agent = st.agent)"""


@query(f"WITH {SUMMARY} SELECT definition, agent, n_runs, " + ", ".join(f"round_even({c}, 5) AS {c}" for c in _STATS) + " FROM al")
def score_error_summary(spark, sf):
    """Errors of producers' means by each definition of a score, with 2,000 resampled means each."""
    runs = R.event_scores(spark, sf)
    rows = runs.select("agent", "run", F.inline(F.array(*(F.struct(F.lit(d).alias("definition"), F.expr(v).cast("double").alias("v")) for d, v in DEFINITIONS.items()))))
    found = E.error_stats(rows, ["definition", "agent"], ["run"], "v", DRAWS)
    return found.select("definition", "agent", "n_runs", *(F.bround(c, 5).alias(c) for c in _STATS))


_REPRO = ("mean_within_similarity", "within_sim_ci95_lo", "within_sim_ci95_hi", "within_sim_bootstrap_sd", "reproducibility_index", "repro_ci95_lo", "repro_ci95_hi", "centroid_compactness", "compactness_ci95_lo", "compactness_ci95_hi")
REPRO = f"""{C.VEC}, win AS (SELECT agent_a AS agent, run_a, run_b, s FROM sims WHERE agent_a = agent_b), {boot_sql('bw', 'win', ['agent'], 'run_a, run_b', 's')}, bi AS (SELECT *, greatest(0.0, 1 - coalesce(s / nullif(m, 0), 0)) AS ix FROM bw),
ws AS (SELECT agent, quantile_cont(m, 0.025) AS a1, quantile_cont(m, 0.975) AS a2, stddev_samp(m) AS a3, avg(ix) AS a4, quantile_cont(ix, 0.025) AS a5, quantile_cont(ix, 0.975) AS a6 FROM bi GROUP BY agent), wm AS (SELECT agent, avg(s) AS a0 FROM win GROUP BY agent),
cen AS (SELECT agent, d, avg(x) AS x FROM runv GROUP BY ALL), fr AS (SELECT r.agent, r.run, sqrt(sum((r.x - c.x) * (r.x - c.x))) AS dist FROM runv r JOIN cen c ON c.agent = r.agent AND c.d = r.d GROUP BY ALL), {boot_sql('bf', 'fr', ['agent'], 'run', 'dist')},
cs AS (SELECT agent, quantile_cont(m, 0.025) AS c1, quantile_cont(m, 0.975) AS c2 FROM bf GROUP BY agent), cm AS (SELECT agent, avg(dist) AS c0 FROM fr GROUP BY agent),
pr AS (SELECT sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) AS c FROM cen a JOIN cen b ON a.d = b.d AND a.agent < b.agent GROUP BY a.agent, b.agent),
two AS (SELECT agent_a AS agent, run_a AS run, agent_b AS other, s FROM sims UNION ALL SELECT agent_b, run_b, agent_a, s FROM sims), mo AS (SELECT agent, run, other, 1 - avg(s) AS d FROM two GROUP BY ALL), ab AS (SELECT agent, run, min(d) FILTER (agent = other) AS a, min(d) FILTER (agent <> other) AS b FROM mo GROUP BY ALL),
al AS (SELECT 'within_agent' AS scope, CAST(wm.agent AS VARCHAR) AS agent, a0 AS v0, a1 AS v1, a2 AS v2, a3 AS v3, a4 AS v4, a5 AS v5, a6 AS v6, c0 AS v7, c1 AS v8, c2 AS v9 FROM wm JOIN ws ON wm.agent = ws.agent JOIN cs ON cs.agent = wm.agent JOIN cm ON cm.agent = wm.agent
 UNION ALL SELECT 'between_agent', 'ALL_PAIRS', avg(c), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM pr UNION ALL SELECT 'global_silhouette', 'ALL', avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ab)"""


@query(f"WITH {REPRO} SELECT scope, agent, " + ", ".join(f"round_even(v{i}, 6) AS {c}" for i, c in enumerate(_REPRO)) + " FROM al")
def reproducibility_errors(spark, sf):
    """Errors of similarity, reproducibility and compactness of each producer, and of all of them."""
    found = E.reproducibility_errors(C.run_similarities(spark, sf), C.run_vectors(spark, sf), DRAWS)
    return found.select("scope", "agent", *(F.bround(c, 6).alias(c) for c in _REPRO))


@query(f"""WITH {R.EV}, {boot_sql('bt', 'sc', ['agent'], 'run', 'score')}, ob AS (SELECT agent, avg(score) AS m FROM sc GROUP BY agent), d AS (SELECT x.agent AS agent_a, y.agent AS agent_b, x.m - y.m AS d FROM bt x JOIN bt y ON x.b = y.b AND x.agent < y.agent)
SELECT agent_a, agent_b, round_even(any_value(p.m - q.m), 5) AS mean_difference, round_even(stddev_samp(d), 5) AS bootstrap_sd_difference, round_even(quantile_cont(d, 0.025), 5) AS diff_ci95_lo, round_even(quantile_cont(d, 0.975), 5) AS diff_ci95_hi, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_diff_gt_0,
 avg(CASE WHEN abs(d) < 2 THEN 1.0::DOUBLE ELSE 0 END) AS p_practical_equivalence, round_even(CASE WHEN abs(any_value(p.m - q.m)) > 1e-9 THEN stddev_samp(d) / abs(any_value(p.m - q.m)) * 100 END, 4) AS relative_error_difference_pct
FROM d JOIN ob p ON p.agent = agent_a JOIN ob q ON q.agent = agent_b GROUP BY agent_a, agent_b""")
def difference_errors(spark, sf):
    """Errors of differences between producers' means, absolute and relative to the observed difference."""
    runs = R.event_scores(spark, sf)
    boot = E.resampled(runs, ["agent"], ["run"], "score", DRAWS)
    seen = runs.groupBy("agent").agg(F.avg("score").alias("o"))
    x, y = (boot.join(seen, "agent").select("b", F.col("agent").alias(f"agent_{i}"), F.col("m").alias(f"m_{i}"), F.col("o").alias(f"o_{i}")) for i in "ab")
    d, share = F.col("m_a") - F.col("m_b"), lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    rows = x.join(y, "b").filter("agent_a < agent_b").withColumns({"d": d, "o": F.col("o_a") - F.col("o_b")})
    found = rows.groupBy("agent_a", "agent_b").agg(F.max("o").alias("o"), F.stddev_samp("d").alias("sd"), F.percentile("d", F.lit(0.025)).alias("lo"), F.percentile("d", F.lit(0.975)).alias("hi"), share(F.col("d") > 0).alias("p_diff_gt_0"), share(F.abs("d") < E.EQUIVALENT).alias("p_practical_equivalence"))
    relative = F.when(F.abs("o") > 1e-9, F.col("sd") / F.abs("o") * 100)
    r = lambda c, n: F.bround(c, 5).alias(n)
    return found.select("agent_a", "agent_b", r("o", "mean_difference"), r("sd", "bootstrap_sd_difference"), r("lo", "diff_ci95_lo"), r("hi", "diff_ci95_hi"), "p_diff_gt_0", "p_practical_equivalence", F.bround(relative, 4).alias("relative_error_difference_pct"))
