"""Registered queries: ranking, resampling, reliability, audits and fairness over run scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.operators import stats as T
from sparvane.plans.catalogue import query, table

DRAWS = 10_000

# Events stand for artifacts of 4 agents with 8 runs each.
EV = """ev AS (SELECT 'agent' || event_id % 4 AS agent, CAST(1 + (event_id // 4) % 8 AS INTEGER) AS run, event_type, value FROM events),
sc AS (SELECT agent, run, round_even(avg(value), 6) AS score, count(*) AS n, count_if(event_type = 'purchase') AS purchases, count_if(event_type = 'error') AS errors FROM ev GROUP BY ALL)"""


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.concat(F.lit("agent"), F.col("event_id") % 4).alias("agent"), (1 + F.floor(F.col("event_id") / 4) % 8).cast("int").alias("run"), "event_type", "value")
    return rows.groupBy("agent", "run").agg(F.bround(F.avg("value"), 6).alias("score"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"))


_P5 = "(((({x} * {x}) % 2147483647) * (({x} * {x}) % 2147483647)) % 2147483647) * {x} % 2147483647"
BOOT = EV + f""", slot AS (SELECT agent, score, row_number() OVER (PARTITION BY agent ORDER BY run) - 1 AS k, count(*) OVER (PARTITION BY agent) AS n, dense_rank() OVER (ORDER BY agent) - 1 AS a FROM sc),
g0 AS (SELECT agent, n, b, (b * 48271 + k * 69621 + a * 40692 + 42 * 16807 + 1) % 2147483647 AS x0 FROM slot, (SELECT unnest(generate_series(0, {DRAWS - 1})) AS b)),
g1 AS (SELECT agent, n, b, {_P5.format(x='x0')} AS x1 FROM g0), g2 AS (SELECT agent, n, b, (x1 * 48271 + 11) % 2147483647 AS x2 FROM g1),
g3 AS (SELECT agent, b, ({_P5.format(x='x2')}) % n AS i FROM g2),
boot AS (SELECT g3.agent, b, round_even(avg(score), 9) AS m FROM g3 JOIN slot ON g3.agent = slot.agent AND i = k GROUP BY ALL),
ranked AS (SELECT agent, b, m, row_number() OVER (PARTITION BY b ORDER BY m DESC, agent) AS r FROM boot)"""


def bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return T.bootstrap_means(event_scores(spark, sf), "score", DRAWS).withColumn("m", F.bround("m", 9))


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("m"), "agent")))


@query(f"WITH {BOOT} SELECT agent, round_even(avg(m), 6) AS mean, round_even(quantile_cont(m, 0.025), 6) AS lo, round_even(quantile_cont(m, 0.975), 6) AS hi FROM boot GROUP BY agent")
def bootstrap_mean_ci(spark, sf):
    return bootstrap(spark, sf).groupBy("agent").agg(F.bround(F.avg("m"), 6).alias("mean"), *(F.bround(F.percentile("m", F.lit(p)), 6).alias(n) for n, p in (("lo", 0.025), ("hi", 0.975))))


@query(f"WITH {BOOT} SELECT agent, r AS rank, count(*) / {DRAWS}.0::DOUBLE AS p FROM ranked GROUP BY ALL")
def rank_probabilities(spark, sf):
    return ranked(spark, sf).groupBy("agent", F.col("r").cast("bigint").alias("rank")).agg((F.count("*") / float(DRAWS)).alias("p"))


@query(f"WITH {BOOT} SELECT x.agent AS agent_a, y.agent AS agent_b, avg(CASE WHEN x.m > y.m THEN 1.0::DOUBLE ELSE 0 END) AS p_a_beats_b, 1 - avg(CASE WHEN x.m > y.m THEN 1.0::DOUBLE ELSE 0 END) AS p_b_beats_a FROM boot x JOIN boot y ON x.b = y.b AND x.agent < y.agent GROUP BY ALL")
def pairwise_win(spark, sf):
    boot = bootstrap(spark, sf)
    x, y = (boot.select("b", F.col("agent").alias(f"agent_{s}"), F.col("m").alias(f"m_{s}")) for s in "ab")
    wins = F.avg(F.when(F.col("m_a") > F.col("m_b"), 1.0).otherwise(0.0))
    return x.join(y, "b").filter("agent_a < agent_b").groupBy("agent_a", "agent_b").agg(wins.alias("p_a_beats_b"), (1 - wins).alias("p_b_beats_a"))


@query(f"""WITH {BOOT}, d AS (SELECT x.agent AS agent_a, y.agent AS agent_b, x.m - y.m AS d FROM boot x JOIN boot y ON x.b = y.b AND x.agent < y.agent)
SELECT agent_a, agent_b, round_even(avg(d), 6) AS mean_diff, round_even(stddev_samp(d), 6) AS sd, round_even(quantile_cont(d, 0.025), 6) AS lo, round_even(quantile_cont(d, 0.975), 6) AS hi, avg(CASE WHEN d > 0 THEN 1.0::DOUBLE ELSE 0 END) AS p_positive, avg(CASE WHEN abs(d) < 2 THEN 1.0::DOUBLE ELSE 0 END) AS p_equivalent FROM d GROUP BY ALL""")
def pairwise_diff_error(spark, sf):
    boot = bootstrap(spark, sf)
    x, y = (boot.select("b", F.col("agent").alias(f"agent_{s}"), F.col("m").alias(f"m_{s}")) for s in "ab")
    rows = x.join(y, "b").filter("agent_a < agent_b").withColumn("d", F.col("m_a") - F.col("m_b"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy("agent_a", "agent_b").agg(F.bround(F.avg("d"), 6).alias("mean_diff"), F.bround(F.stddev_samp("d"), 6).alias("sd"), F.bround(F.percentile("d", F.lit(0.025)), 6).alias("lo"), F.bround(F.percentile("d", F.lit(0.975)), 6).alias("hi"), share(F.col("d") > 0).alias("p_positive"), share(F.abs("d") < 2).alias("p_equivalent"))


@query(f"""WITH {BOOT}, p AS (SELECT agent, r, count(*) / {DRAWS}.0::DOUBLE AS p FROM ranked GROUP BY ALL),
e AS (SELECT agent, round_even(-sum(p * log2(p)), 6) AS entropy_bits, round_even(1 - max(p), 6) AS switch_probability FROM p GROUP BY agent)
SELECT r.agent, round_even(avg(r), 6) AS expected_rank, round_even(stddev_samp(r), 6) AS sd_rank, CAST(floor(quantile_cont(CAST(r AS DOUBLE), 0.025)) AS BIGINT) AS lo, CAST(floor(quantile_cont(CAST(r AS DOUBLE), 0.975)) AS BIGINT) AS hi, any_value(entropy_bits) AS entropy_bits, any_value(switch_probability) AS switch_probability FROM ranked r JOIN e ON r.agent = e.agent GROUP BY r.agent""")
def rank_entropy(spark, sf):
    rows = ranked(spark, sf)
    shares = rows.groupBy("agent", "r").agg((F.count("*") / float(DRAWS)).alias("p")).groupBy("agent").agg(F.bround(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy_bits"), F.bround(1 - F.max("p"), 6).alias("switch_probability"))
    low, high = (F.floor(F.percentile(F.col("r").cast("double"), F.lit(p))).cast("bigint").alias(n) for n, p in (("lo", 0.025), ("hi", 0.975)))
    return rows.groupBy("agent").agg(F.bround(F.avg("r"), 6).alias("expected_rank"), F.bround(F.stddev_samp("r"), 6).alias("sd_rank"), low, high).join(shares, "agent")


@query(f"""WITH {EV}, q AS (SELECT agent, quantile_cont(score, 0.25) AS q1, median(score) AS med, quantile_cont(score, 0.75) AS q3, avg(score) AS mean, stddev_samp(score) AS sd, count(*) AS n FROM sc GROUP BY agent),
m AS (SELECT sc.agent, median(abs(score - med)) AS mad FROM sc JOIN q ON sc.agent = q.agent GROUP BY sc.agent)
SELECT q.agent, n, round_even(mean, 4) AS mean, round_even(med, 4) AS median, round_even(q3 - q1, 4) AS iqr, round_even(mad, 4) AS mad, round_even(1.4826::DOUBLE * mad / sqrt(n), 4) AS robust_se, round_even(sd / sqrt(n), 4) AS sem FROM q JOIN m ON q.agent = m.agent""")
def agent_error_stats(spark, sf):
    runs = event_scores(spark, sf)
    stats = runs.groupBy("agent").agg(F.percentile("score", F.lit(0.25)).alias("q1"), F.percentile("score", F.lit(0.5)).alias("med"), F.percentile("score", F.lit(0.75)).alias("q3"), F.avg("score").alias("avg"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"))
    mads = runs.join(stats.select("agent", "med"), "agent").groupBy("agent").agg(F.percentile(F.abs(F.col("score") - F.col("med")), F.lit(0.5)).alias("raw_mad"))
    r = lambda c: F.bround(c, 4)
    return stats.join(mads, "agent").select("agent", "n", r("avg").alias("mean"), r("med").alias("median"), r(F.col("q3") - F.col("q1")).alias("iqr"), r("raw_mad").alias("mad"), r(1.4826 * F.col("raw_mad") / F.sqrt("n")).alias("robust_se"), r(F.col("sd") / F.sqrt("n")).alias("sem"))


@query(f"""WITH {EV}, q AS (SELECT *, quantile_cont(score, 0.25) OVER w AS q1, quantile_cont(score, 0.75) OVER w AS q3, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd, count(*) OVER w AS c FROM sc WINDOW w AS (PARTITION BY agent)),
f AS (SELECT agent, run, score, c >= 4 AND (score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS iqr, coalesce(abs((score - m) / nullif(sd, 0)) > 2.5, false) AS z FROM q)
SELECT agent, run, iqr OR z AS flagged, concat_ws('+', CASE WHEN iqr THEN 'IQR' END, CASE WHEN z THEN 'Z' END) AS reason FROM f""")
def outlier_runs(spark, sf):
    runs = event_scores(spark, sf)
    stats = runs.groupBy("agent").agg(F.percentile("score", F.lit(0.25)).alias("q1"), F.percentile("score", F.lit(0.75)).alias("q3"), F.avg("score").alias("m"), F.stddev_samp("score").alias("sd"), F.count("*").alias("c"))
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    rows = runs.join(stats, "agent").withColumn("iqr", (F.col("c") >= 4) & ((F.col("score") < F.col("q1") - wide) | (F.col("score") > F.col("q3") + wide)))
    rows = rows.withColumn("z", F.coalesce(F.abs(F.try_divide(F.col("score") - F.col("m"), F.col("sd"))) > 2.5, F.lit(False)))
    return rows.select("agent", "run", (F.col("iqr") | F.col("z")).alias("flagged"), F.concat_ws("+", F.when(F.col("iqr"), "IQR"), F.when(F.col("z"), "Z")).alias("reason"))


@query(f"""WITH {EV}, r AS (SELECT agent, run, rank() OVER (PARTITION BY agent ORDER BY score DESC) + (count(*) OVER (PARTITION BY agent, score) - 1) / 2.0 AS r FROM sc),
t AS (SELECT run, sum(r) AS t FROM r GROUP BY run), k AS (SELECT count(DISTINCT agent) AS m, count(DISTINCT run) AS n FROM sc)
SELECT round_even(CAST(12 * sum((t - mean) * (t - mean)) / (max(m) * max(m) * (max(n) * max(n) * max(n) - max(n))) AS DOUBLE), 6) AS kendall_w FROM (SELECT t, avg(t) OVER () AS mean FROM t), k""")
def kendall_w(spark, sf):
    runs = event_scores(spark, sf)
    totals = runs.select("run", T.average_rank("score", ["agent"], True).alias("r")).groupBy("run").agg(F.sum("r").alias("t"))
    sizes = runs.agg(F.count_distinct("agent").alias("m"), F.count_distinct("run").alias("n"))
    spread = totals.agg((F.var_pop("t") * F.count("*")).alias("s"))
    return spread.crossJoin(sizes).select(F.bround(F.try_divide(12 * F.col("s"), F.col("m") * F.col("m") * (F.col("n") * F.col("n") * F.col("n") - F.col("n"))), 6).alias("kendall_w"))  # one row each


@query(f"""WITH {EV}, i AS (SELECT sum(v) AS items, count(*) AS k FROM (SELECT agent, var_samp(score) AS v FROM sc GROUP BY agent)), t AS (SELECT var_samp(s) AS total FROM (SELECT run, sum(score) AS s FROM sc GROUP BY run))
SELECT round_even(CASE WHEN k >= 3 THEN k / (k - 1.0) END * (1 - items / nullif(total, 0)), 6) AS cronbach_alpha FROM i, t""")
def cronbach_alpha(spark, sf):
    runs = event_scores(spark, sf)
    items = runs.groupBy("agent").agg(F.var_samp("score").alias("v")).agg(F.sum("v").alias("items"), F.count("*").alias("k"))
    total = runs.groupBy("run").agg(F.sum("score").alias("s")).agg(F.var_samp("s").alias("total"))
    return items.crossJoin(total).select(F.bround(F.when(F.col("k") >= 3, F.try_divide(F.col("k"), F.col("k") - 1.0)) * (1 - F.try_divide("items", "total")), 6).alias("cronbach_alpha"))  # one row each


@query(f"WITH {EV} SELECT round_even(regr_slope(score, n), 6) AS slope, round_even(regr_intercept(score, n), 4) AS intercept, count(*) AS n_runs FROM sc")
def linear_fit(spark, sf):
    return event_scores(spark, sf).agg(F.bround(F.regr_slope("score", "n"), 6).alias("slope"), F.bround(F.regr_intercept("score", "n"), 4).alias("intercept"), F.count("*").alias("n_runs"))


# Registry: who was given metadata; manual scores: a part of the runs.
REG = EV + """, reg AS (SELECT agent, run, lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 't') AS metadata FROM (SELECT agent, run, CASE (run + length(agent) + ascii(right(agent, 1))) % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'no' WHEN 2 THEN ' t ' ELSE '' END AS flag FROM sc WHERE run <> 8)),
mrg AS (SELECT sc.*, coalesce(metadata, false) AS metadata FROM sc LEFT JOIN reg ON sc.agent = reg.agent AND sc.run = reg.run)"""


@query(f"""WITH {REG} SELECT agent, bool_or(metadata) AS any_metadata, count(*) AS n_runs, round_even(avg(score), 6) AS mean, round_even(coalesce(stddev_samp(score), 0), 6) AS sd, NULL::DOUBLE AS contrast FROM mrg GROUP BY agent
UNION ALL SELECT '__GROUP_CONTRAST__', NULL, count(*), NULL, NULL, round_even(avg(score) FILTER (metadata) - avg(score) FILTER (NOT metadata), 6) FROM mrg""")
def fairness_summary(spark, sf):
    runs = event_scores(spark, sf)
    code = (F.col("run") + F.length("agent") + F.ascii(F.right("agent", F.lit(1)))) % 4
    flags = F.when(code == 0, "YES").when(code == 1, "no").when(code == 2, " t ").otherwise("")
    registry = runs.filter("run <> 8").select("agent", "run", F.lower(F.trim(flags)).isin("1", "true", "yes", "y", "t").alias("metadata"))
    merged = runs.join(registry, ["agent", "run"], "left").withColumn("metadata", F.coalesce("metadata", F.lit(False)))
    per = merged.groupBy("agent").agg(F.bool_or("metadata").alias("any_metadata"), F.count("*").alias("n_runs"), F.bround(F.avg("score"), 6).alias("mean"), F.bround(F.coalesce(F.stddev_samp("score"), F.lit(0.0)), 6).alias("sd"))
    groups = merged.agg(F.count("*").alias("n_runs"), F.bround(F.avg(F.when(F.col("metadata"), F.col("score"))) - F.avg(F.when(~F.col("metadata"), F.col("score"))), 6).alias("contrast"))
    return per.unionByName(groups.withColumn("agent", F.lit("__GROUP_CONTRAST__")), allowMissingColumns=True)


@query(f"""WITH {EV}, man0 AS (SELECT upper(agent) AS agent, run, purchases * 1.0::DOUBLE AS manual, 0 AS pos FROM sc WHERE run % 2 = 1 UNION ALL SELECT upper(agent), run, 1000, 1 FROM sc WHERE run = 3),
man AS (SELECT lower(agent) AS agent, run, arg_min(manual, pos) AS manual FROM man0 GROUP BY ALL)
SELECT sc.agent, sc.run, coalesce(manual, score) AS score, CASE WHEN manual IS NULL THEN 'proxy' ELSE 'manual' END AS score_type,
 rank() OVER (ORDER BY score DESC) AS proxy_rank, rank() OVER (ORDER BY coalesce(manual, score) DESC) AS final_rank,
 abs(rank() OVER (ORDER BY score DESC) - rank() OVER (ORDER BY coalesce(manual, score) DESC)) > 4 AS disagrees FROM sc LEFT JOIN man ON sc.agent = man.agent AND sc.run = man.run""")
def manual_vs_proxy(spark, sf):
    runs = event_scores(spark, sf)
    manual = runs.filter("run % 2 = 1").select(F.upper("agent").alias("agent"), "run", F.col("purchases").cast("double").alias("manual"), F.lit(0).alias("pos")).unionByName(runs.filter("run = 3").select(F.upper("agent").alias("agent"), "run", F.lit(1000.0).alias("manual"), F.lit(1).alias("pos")))
    manual = manual.groupBy(F.lower("agent").alias("agent"), "run").agg(F.min_by("manual", "pos").alias("manual"))  # the first row given for a run counts
    rows = runs.join(manual, ["agent", "run"], "left").withColumn("final", F.coalesce("manual", "score"))
    proxy, final = F.rank().over(Window.orderBy(F.desc("score"))).cast("bigint"), F.rank().over(Window.orderBy(F.desc("final"))).cast("bigint")
    return rows.select("agent", "run", F.col("final").alias("score"), F.when(F.col("manual").isNull(), "proxy").otherwise("manual").alias("score_type"), proxy.alias("proxy_rank"), final.alias("final_rank"), (F.abs(proxy - final) > 4).alias("disagrees"))


@query(f"""WITH {EV}, m AS (SELECT agent, avg(score) AS mean, stddev_samp(score) AS sd, count(*) AS n FROM sc GROUP BY agent), r AS (SELECT *, row_number() OVER (ORDER BY mean DESC, agent) AS r FROM m)
SELECT a.agent AS first, b.agent AS second, round_even(a.mean - b.mean, 6) AS difference, round_even(sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n), 6) AS pooled_error FROM r a JOIN r b ON a.r = 1 AND b.r = 2""")
def top_two_difference(spark, sf):
    means = event_scores(spark, sf).groupBy("agent").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("*").alias("n"))
    top = means.orderBy(F.desc("mean"), "agent").limit(2).withColumn("r", F.row_number().over(Window.orderBy(F.desc("mean"), "agent")))
    a, b = (top.filter(f"r = {i}").select(*(F.col(c).alias(f"{c}_{i}") for c in ("agent", "mean", "sd", "n"))) for i in (1, 2))
    error = F.sqrt(F.col("sd_1") * F.col("sd_1") / F.col("n_1") + F.col("sd_2") * F.col("sd_2") / F.col("n_2"))
    return a.crossJoin(b).select(F.col("agent_1").alias("first"), F.col("agent_2").alias("second"), F.bround(F.col("mean_1") - F.col("mean_2"), 6).alias("difference"), F.bround(error, 6).alias("pooled_error"))
