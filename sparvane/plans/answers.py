"""Registered queries: what reports answer and claim, from the tables of other queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparvane.operators import answers as A
from sparvane.operators.stats import cosine
from sparvane.plans import audit, errors, montecarlo, report, resampling
from sparvane.plans import catalogue as C
from sparvane.plans.catalogue import ORACLE, query

_SIDES = {"vol": "score_volume_correlation", "rk": "rank_entropy", "es": "score_error_summary", "df": "difference_errors", "rp": "reproducibility_errors", "sm": "agent_summary"}
ANSWERS = ", ".join(f"{name} AS ({ORACLE[of]})" for name, of in _SIDES.items())


@query(f"""WITH {ANSWERS}, e AS (SELECT * FROM es WHERE definition = 'A_mean_value'), w AS (SELECT * FROM rp WHERE scope = 'within_agent'), t AS (SELECT CASE WHEN count_if(score_type = 'manual') > count_if(score_type = 'proxy') THEN 'manual' ELSE 'proxy' END AS score_type FROM sm)
SELECT 'Is AgentScore correlated with output volume?' AS Question, 'Spearman correlation (score vs volume metrics)' AS Method, printf('max |ρ|=%.2f (%s)', round_even(abs(spearman_rho), 2), metric) AS Key_result, CASE WHEN abs(spearman_rho) > 0.5 THEN 'Possible volume sensitivity' ELSE 'Weak volume sensitivity' END AS Interpretation, 'n_runs small; correlation unstable' AS Limitation
 FROM (SELECT * FROM vol WHERE spearman_rho IS NOT NULL ORDER BY abs(spearman_rho) DESC, metric LIMIT 1)
UNION ALL SELECT 'Does the top-ranked agent remain stable after output-volume diagnostics / bootstrap?', 'Bootstrap ranking (rank-switch probability)', printf('%s switch prob=%.2f', agent, round_even(switch_probability, 2)), CASE WHEN switch_probability < 0.25 THEN 'Stable' ELSE 'Unstable' END, 'Only 8 real runs per agent' FROM (SELECT * FROM rk ORDER BY expected_rank, agent LIMIT 1)
UNION ALL SELECT 'What is the absolute error of each agent-level score?', 'Bootstrap SD of the agent mean AgentScore', string_agg(agent || ': ±' || printf('%.2f', round_even(bootstrap_sd, 2)), '; ' ORDER BY agent), 'Descriptive uncertainty', 'Bootstrap over 8 runs only' FROM e
UNION ALL SELECT 'What is the relative error of each agent-level score?', 'absolute_error / mean_score × 100', string_agg(agent || ': ' || printf('%.1f', round_even(relative_error_pct, 1)) || '%', '; ' ORDER BY agent), 'Descriptive uncertainty', 'Unstable when mean is small' FROM e
UNION ALL SELECT 'Are pairwise score differences larger than their bootstrap uncertainty?', 'Bootstrap 95% CI of pairwise difference excludes 0', printf('%d/%d pairs separated', count_if(diff_ci95_lo * diff_ci95_hi > 0), count(*)), CASE WHEN count_if(diff_ci95_lo * diff_ci95_hi > 0) < count(*) THEN 'Some/most pairs overlap' ELSE 'Pairs separated' END, 'Practical equivalence band |Δ|<2' FROM df
UNION ALL SELECT 'Are reproducibility estimates robust to run-level resampling?', 'Bootstrap CI of within-agent similarity', string_agg(agent || ': ' || printf('%.2f[%.2f,%.2f]', round_even(mean_within_similarity, 2), round_even(within_sim_ci95_lo, 2), round_even(within_sim_ci95_hi, 2)), '; ' ORDER BY agent), 'Descriptive reproducibility', 'Few pairwise comparisons' FROM w
UNION ALL SELECT 'Are scores manual or proxy-estimated?', 'Score source flag', 'score_type = ' || score_type, CASE WHEN score_type <> 'manual' THEN 'Proxy = exploratory until expert-validated' ELSE 'Manual scores used as primary' END, 'Proxy scores are not ground truth' FROM t""")
def scoring_validation(spark, sf):
    """The scoring validation's questions over the runs' scores and vectors."""
    kind = report.agent_summary(spark, sf).agg(F.when(F.count_if(F.col("score_type") == "manual") > F.count_if(F.col("score_type") == "proxy"), "manual").otherwise("proxy").alias("score_type"))
    stats = errors.score_error_summary(spark, sf).filter("definition = 'A_mean_value'")
    return A.scoring_answers(audit.score_volume_correlation(spark, sf), resampling.rank_entropy(spark, sf), stats, errors.difference_errors(spark, sf), errors.reproducibility_errors(spark, sf), kind)


@query(f"""WITH {C.VEC}, win AS (SELECT agent_a AS agent, avg(s) AS m, coalesce(stddev_samp(s), 0) AS sd FROM sims WHERE agent_a = agent_b GROUP BY agent_a), cen AS (SELECT agent, d, avg(x) AS x FROM runv GROUP BY ALL),
pr AS (SELECT sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) AS c FROM cen a JOIN cen b ON a.d = b.d AND a.agent < b.agent GROUP BY a.agent, b.agent), rk AS ({ORACLE["rank_probabilities"]}), kw AS ({ORACLE["kendall_w"]})
SELECT 'Within-agent runs are reproducible (CV < 10%)' AS Claim, 'Bootstrap pairwise cosine similarity CV' AS Validation_method, printf('Mean reproducibility index = %.3f; Mean CV = %.1f%%', round_even(avg(greatest(0.0, 1 - sd / abs(m))), 3), round_even(avg(sd / abs(m) * 100), 1)) AS Key_quantitative_result, CASE WHEN avg(greatest(0.0, 1 - sd / abs(m))) > 0.8 THEN 'Supported descriptively' ELSE 'Partially supported' END AS Verdict FROM win
UNION ALL SELECT 'Agents produce semantically distinct outputs', 'Centroid cosine similarity between agent pairs', printf('Mean between-agent cosine similarity = %.3f', round_even(avg(c), 3)), CASE WHEN avg(c) < 0.9 THEN 'Supported descriptively' ELSE 'Not supported' END FROM pr
UNION ALL SELECT 'Ranking is stable across bootstrap resampling', 'Bootstrap ranking probability (n=10000)', string_agg(agent || ': P(rank1)=' || printf('%.2f', round_even(p, 2)), '; ' ORDER BY agent), 'Descriptive-only' FROM rk WHERE rank = 1
UNION ALL SELECT 'Run scores are internally consistent', 'Kendall''s W across agent run vectors', coalesce(printf('Kendall W = %.3f', round_even(kendall_w, 3)), 'Insufficient data'), 'Descriptive-only (n_runs limited)' FROM kw
UNION ALL SELECT 'Proxy scores approximate expert judgment', 'Structural feature keywords (no ground-truth labels)', 'N/A — proxy scores are keyword-count-based', 'Requires external validation' FROM kw
UNION ALL SELECT 'MC satellite points characterise uncertainty, not real observations', 'Design: bootstrap centroids and Gaussian samples', 'By construction', 'Supported descriptively' FROM kw""")
def validation_claims(spark, sf):
    """What a study claims of its producers, and what the numbers say."""
    sd = F.coalesce(F.stddev_samp("s"), F.lit(0.0))
    cv = F.try_divide(sd, F.abs(F.avg("s")))
    within = C.run_similarities(spark, sf).filter("agent_a = agent_b").groupBy("agent_a").agg(F.greatest(F.lit(0.0), 1 - cv).alias("reproducibility"), (cv * 100).alias("cv_pct"))
    x, y = (montecarlo.centroids(spark, sf).select(F.col("agent").alias(f"agent_{i}"), F.col("centroid").alias(f"c_{i}")) for i in "xy")
    between = x.join(y, F.col("agent_x") < F.col("agent_y")).select(cosine("c_x", "c_y").alias("centroid_cosine_sim"))
    return A.claims(within, between, resampling.rank_probabilities(spark, sf), resampling.kendall_w(spark, sf))
