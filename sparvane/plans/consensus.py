"""Registered queries: how close runs are to what all producers say, and how far they stand apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.operators import stats as T
from sparvane.operators.settled import settled
from sparvane.plans import catalogue as C
from sparvane.plans import resampling as R
from sparvane.plans.catalogue import query

DRAWS = 2000
# Vectors of run r of label l stand for those of run r + 1 of source l.
_NEAR = f"""{C.VEC}, g AS (SELECT d, avg(x) AS x FROM runv GROUP BY d),
near AS (SELECT 'src' || r.agent AS agent, CAST(r.run + 1 AS INTEGER) AS run, sum(r.x * g.x) / sqrt(sum(r.x * r.x)) / sqrt(sum(g.x * g.x)) AS cos FROM runv r JOIN g ON r.d = g.d GROUP BY r.agent, r.run)"""
_TERMS = """per AS (SELECT family, term, agent, count_if(cnt > 0) AS w, count(*) AS n, round_even(avg(cnt), 3) AS freq FROM long GROUP BY ALL),
core AS (SELECT family, term, bool_and(w > 0) AS strict, count_if(w * 2 >= n) >= 2 AS robust, count_if(w > 0) = 1 AS specific, max(agent) FILTER (w > 0) AS owner FROM per GROUP BY family, term)"""
ALIGN = f"""{C.LONG}, {_NEAR}, {_TERMS},
sets AS (SELECT count(DISTINCT term) FILTER (strict AND family IN ('kw', 'bio')) AS ns, count(DISTINCT term) FILTER (robust AND family IN ('kw', 'bio')) AS nr FROM core),
hits AS (SELECT agent, run, count_if(cnt > 0 AND term IN (SELECT term FROM core WHERE strict AND family IN ('kw', 'bio'))) AS s, count_if(cnt > 0 AND term IN (SELECT term FROM core WHERE robust AND family IN ('kw', 'bio'))) AS r FROM long GROUP BY ALL),
al0 AS (SELECT near.agent, near.run, cos, CASE WHEN ns > 0 THEN coalesce(s, 0) / ns::DOUBLE ELSE 0 END AS so, CASE WHEN nr > 0 THEN coalesce(r, 0) / nr::DOUBLE ELSE 0 END AS ro FROM near LEFT JOIN hits ON hits.agent = near.agent AND hits.run = near.run, sets),
al AS (SELECT agent, run, round_even(cos, 4) AS cosine_sim_to_global, round_even(so, 4) AS strict_term_overlap, round_even(ro, 4) AS robust_term_overlap, round_even(round_even(40 * (cos + 1) / 2 + 30 * so + 30 * ro, 6), 2) AS score FROM al0)"""
APART = f"""{C.LONG}, {_NEAR}, {_TERMS}, own AS (SELECT owner AS agent, count(DISTINCT term) AS k FROM core WHERE specific GROUP BY owner),
h AS (SELECT l.agent, l.run, count_if(cnt > 0) AS present, count_if(cnt > 0 AND term IN (SELECT term FROM core WHERE strict)) AS strict, count_if(cnt > 0 AND (l.agent, term) IN (SELECT owner, term FROM core WHERE specific)) AS spec FROM long l GROUP BY ALL),
ap0 AS (SELECT near.agent, near.run, 1 - (cos + 1) / 2 AS far, coalesce(spec, 0) AS spec, coalesce(spec / nullif(k, 0)::DOUBLE, 0) AS sf, CASE WHEN coalesce(present, 0) > 0 THEN 1 - strict / present::DOUBLE ELSE 0.5 END AS nf
  FROM near LEFT JOIN h ON h.agent = near.agent AND h.run = near.run LEFT JOIN own ON own.agent = near.agent),
ap AS (SELECT agent, run, round_even(far, 4) AS cosine_dist_to_global, spec AS agent_specific_terms_present, round_even(sf, 4) AS agent_specific_term_frac, round_even(nf, 4) AS nonconsensus_frac, round_even(round_even(40 * far + 30 * sf + 30 * nf, 6), 2) AS score FROM ap0)"""


def boot_sql(source: str, draws: int = DRAWS) -> str:
    """CTE ``boot`` (agent, b, m): means of resampled runs of a table with agent, run and score."""
    return f"""slot AS (SELECT agent, score, row_number() OVER (PARTITION BY agent ORDER BY run) - 1 AS k, count(*) OVER (PARTITION BY agent) AS n, dense_rank() OVER (ORDER BY agent) - 1 AS a FROM {source}),
g0 AS (SELECT agent, n, b, (b * 48271 + k * 69621 + a * 40692 + 42 * 16807 + 1) % 2147483647 AS x0 FROM slot, (SELECT unnest(generate_series(0, {draws - 1})) AS b)),
g1 AS (SELECT agent, n, b, {R._P5.format(x='x0')} AS x1 FROM g0), g2 AS (SELECT agent, n, b, (x1 * 48271 + 11) % 2147483647 AS x2 FROM g1), g3 AS (SELECT agent, b, ({R._P5.format(x='x2')}) % n AS i FROM g2),
boot AS (SELECT g3.agent, b, avg(score) AS m FROM g3 JOIN slot ON g3.agent = slot.agent AND i = k GROUP BY ALL)"""


def error_sql(source: str, name: str) -> str:
    return f"""{boot_sql(source)}, e AS (SELECT agent, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS err FROM boot GROUP BY agent),
m AS (SELECT agent, avg(score) AS mean, coalesce(stddev_samp(score), 0) AS sd, count(*) AS n FROM {source} GROUP BY agent)
SELECT m.agent, round_even(round_even(mean, 6), 3) AS {name}, round_even(sd, 3) AS sd, round_even(sd / sqrt(n), 3) AS sem, round_even(lo, 3) AS ci95_lo, round_even(hi, 3) AS ci95_hi, round_even(err, 3) AS absolute_error, round_even(err / nullif(mean, 0) * 100, 3) AS relative_error_pct, n AS n_runs FROM m JOIN e ON m.agent = e.agent"""


def run_errors(runs: DataFrame, name: str, draws: int = DRAWS) -> DataFrame:
    """Per agent the mean of ``agent, run, score`` with deviation, standard error, bootstrap interval and error."""
    boot = T.bootstrap_means(runs.select("agent", "run", "score"), "score", draws)
    limits = boot.groupBy("agent").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"), F.stddev_samp("m").alias("err"))
    means = runs.groupBy("agent").agg(F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.count("*").alias("n_runs"))
    r = lambda c: F.bround(c, 3)
    return means.join(limits, "agent").select("agent", r(F.bround("mean", 6)).alias(name), r(F.col("sd")).alias("sd_"), r(F.col("sd") / F.sqrt("n_runs")).alias("sem"), r("lo").alias("ci95_lo"), r("hi").alias("ci95_hi"), r("err").alias("absolute_error"), r(F.try_divide("err", "mean") * 100).alias("relative_error_pct"), "n_runs").withColumnRenamed("sd_", "sd")


def nearness(spark: SparkSession, sf: str) -> DataFrame:
    """``agent, run, cos``: runs' cosines with the mean of all run vectors."""
    runs = C.run_vectors(spark, sf)
    centre = T.mean_vector(runs.withColumn("all", F.lit(1)), ["all"], "embedding").select(F.col("embedding").alias("g"))  # one row
    return runs.crossJoin(F.broadcast(centre)).select(F.concat(F.lit("src"), "agent").alias("agent"), (F.col("run") + 1).cast("int").alias("run"), T.cosine("embedding", "g").alias("cos"))


def term_roles(terms: DataFrame) -> DataFrame:
    """``family, term, strict, robust, specific, owner``: in all agents; in half the runs of two agents; in one agent only, and which."""
    per = terms.groupBy("family", "term", "agent").agg(F.count_if(F.col("cnt") > 0).alias("w"), F.count("*").alias("n"))
    return per.groupBy("family", "term").agg(F.bool_and(F.col("w") > 0).alias("strict"), (F.count_if(F.col("w") * 2 >= F.col("n")) >= 2).alias("robust"), (F.count_if(F.col("w") > 0) == 1).alias("specific"), F.max(F.when(F.col("w") > 0, F.col("agent"))).alias("owner"))


def _score(value: Column) -> Column:
    return F.bround(F.bround(value, 6), 2)


def alignment(spark: SparkSession, sf: str) -> DataFrame:
    """``agent, run``, cosine, overlaps with the strict and the robust terms of methods and biology, and the score they make.

    Terms are a few hundred: they are broadcast.
    """
    terms = C.long_terms(spark, sf)
    roles = term_roles(terms).filter("family in ('kw', 'bio') and (strict or robust)").groupBy("term").agg(F.bool_or("strict").alias("strict"), F.bool_or("robust").alias("robust"))
    sizes = roles.agg(F.count_if("strict").alias("ns"), F.count_if("robust").alias("nr"))  # one row
    present = terms.filter("cnt > 0").join(F.broadcast(roles), "term").groupBy("agent", "run").agg(F.count_if("strict").alias("s"), F.count_if("robust").alias("r"))
    share = lambda x, n: F.coalesce(F.try_divide(F.col(x), F.col(n)), F.lit(0.0))
    rows = nearness(spark, sf).join(present, ["agent", "run"], "left").crossJoin(F.broadcast(sizes)).withColumns({"so": share("s", "ns"), "ro": share("r", "nr")})
    return rows.select("agent", "run", F.bround("cos", 4).alias("cosine_sim_to_global"), F.bround("so", 4).alias("strict_term_overlap"), F.bround("ro", 4).alias("robust_term_overlap"), _score(40 * (F.col("cos") + 1) / 2 + 30 * F.col("so") + 30 * F.col("ro")).alias("score"))


def distinctiveness(spark: SparkSession, sf: str, runs: DataFrame | None = None) -> DataFrame:
    """``agent, run``, distance from all, terms of this agent alone, share of terms that not all have, and the score they make."""
    terms = C.long_terms(spark, sf, runs)
    roles = term_roles(terms)
    strict = F.broadcast(roles.filter("strict").select("term").distinct().withColumn("strict", F.lit(True)))
    own = roles.filter("specific").select(F.col("owner").alias("agent"), "term").distinct()
    present = terms.filter("cnt > 0").join(strict, "term", "left").join(F.broadcast(own.withColumn("spec", F.lit(True))), ["agent", "term"], "left")
    counts = present.groupBy("agent", "run").agg(F.count("*").alias("present"), F.count("strict").alias("strict"), F.count("spec").alias("spec"))
    rows = nearness(spark, sf).join(counts, ["agent", "run"], "left").join(F.broadcast(own.groupBy("agent").agg(F.count("*").alias("k"))), "agent", "left")
    rows = rows.withColumns({"far": 1 - (F.col("cos") + 1) / 2, "spec": F.coalesce("spec", F.lit(0)), "sf": F.coalesce(F.try_divide("spec", "k"), F.lit(0.0)), "nf": F.coalesce(1 - F.try_divide("strict", "present"), F.lit(0.5))})
    return rows.select("agent", "run", F.bround("far", 4).alias("cosine_dist_to_global"), F.col("spec").alias("agent_specific_terms_present"), F.bround("sf", 4).alias("agent_specific_term_frac"), F.bround("nf", 4).alias("nonconsensus_frac"), _score(40 * F.col("far") + 30 * F.col("sf") + 30 * F.col("nf")).alias("score"))


@query(f"WITH {ALIGN} SELECT agent, run, cosine_sim_to_global, strict_term_overlap, robust_term_overlap, score AS consensus_alignment_score FROM al")
def consensus_alignment(spark, sf):
    return alignment(spark, sf).withColumnRenamed("score", "consensus_alignment_score")


@query(f"WITH {ALIGN}, {error_sql('al', 'mean_consensus_alignment')}")
def consensus_alignment_error(spark, sf):
    return run_errors(alignment(spark, sf), "mean_consensus_alignment")


@query(f"WITH {APART}{C.parts_sql(C._TERM_SQL, C.S.TRANSCRIPTS)}{C.scores_sql('scores')} SELECT ap.agent, ap.run, cosine_dist_to_global, agent_specific_terms_present, agent_specific_term_frac, nonconsensus_frac, score AS distinctiveness_score, round_even(AgentScore, 6) AS AgentScore FROM ap LEFT JOIN scores ON scores.agent = ap.agent AND scores.run = ap.run")
def distinctiveness_scores(spark, sf):
    runs = settled(C.run_features_frame(spark, sf))  # for terms and scores alike
    scores = C.S.run_scores(C.S.components(runs)).select("agent", "run", F.bround("AgentScore", 6).alias("AgentScore"))
    return distinctiveness(spark, sf, runs).withColumnRenamed("score", "distinctiveness_score").join(scores, ["agent", "run"], "left")


@query(f"WITH {APART}, {error_sql('ap', 'mean_distinctiveness')}")
def distinctiveness_error(spark, sf):
    return run_errors(distinctiveness(spark, sf), "mean_distinctiveness")


@query(f"WITH {C.LONG}, {_TERMS} SELECT owner AS agent, family, count(*) AS n_terms FROM core WHERE specific GROUP BY ALL")
def agent_specific_terms(spark, sf):
    return term_roles(C.long_terms(spark, sf)).filter("specific").groupBy(F.col("owner").alias("agent"), "family").agg(F.count("*").alias("n_terms"))


@query(f"""WITH {C.LONG}, {_TERMS}, k AS (SELECT count(DISTINCT agent) AS agents FROM long), t AS (SELECT family, term, count_if(w > 0) AS a FROM per GROUP BY ALL)
SELECT family, count_if(a = agents) AS shared_all, count_if(a >= 2 AND a < agents) AS shared_2plus_only, count_if(a = 1) AS agent_specific FROM t, k WHERE a > 0 GROUP BY family""")
def shared_term_counts(spark, sf):
    terms = C.long_terms(spark, sf)
    per = terms.groupBy("family", "term").agg(F.count_distinct(F.when(F.col("cnt") > 0, F.col("agent"))).alias("a")).filter("a > 0")
    agents = terms.agg(F.count_distinct("agent").alias("agents"))  # one row
    return per.crossJoin(F.broadcast(agents)).groupBy("family").agg(F.count_if(F.col("a") == F.col("agents")).alias("shared_all"), F.count_if((F.col("a") >= 2) & (F.col("a") < F.col("agents"))).alias("shared_2plus_only"), F.count_if(F.col("a") == 1).alias("agent_specific"))


# Sets of terms whose count is above the mean of all runs (standardised above 0): the reference's measure.
_STD = ", ".join(f"list_value(CASE WHEN \"{n}\" > avg(\"{n}\") OVER () AND stddev_pop(\"{n}\") OVER () > 0 THEN '{n}' END)" for n in C._TERM_SQL if n.startswith(("kw_", "bio_")))


@query(f"""WITH {C.RUNS}, s AS (SELECT agent, run, list_filter(flatten([{_STD}]), lambda x: x IS NOT NULL) AS t FROM runs), f AS (SELECT agent, run, list_filter(t, lambda x: starts_with(x, 'kw_')) AS kw, list_filter(t, lambda x: starts_with(x, 'bio_')) AS bio FROM s)
SELECT a.agent AS agent_a, a.run AS run_a, b.agent AS agent_b, b.run AS run_b, """ + ", ".join(f"round_even(CASE WHEN len(a.{c}) + len(b.{c}) = 0 THEN 1.0 ELSE len(list_intersect(a.{c}, b.{c})) / len(list_distinct(list_concat(a.{c}, b.{c})))::DOUBLE END, 6) AS jaccard_{c}" for c in ("kw", "bio")) + " FROM f a JOIN f b ON (a.agent, a.run) < (b.agent, b.run)")
def jaccard_above_mean(spark, sf):
    """Jaccard of the method and biology terms that runs have more often than the mean run (quirk Q1)."""
    runs = C.run_features_frame(spark, sf)
    names = [n for n in C._TERM_SQL if n.startswith(("kw_", "bio_"))]
    stats = runs.agg(*(f(F.col(f"`{n}`")).alias(f"{n}{x}") for n in names for x, f in (("__m", F.avg), ("__s", F.stddev_pop))))  # one row
    above = lambda n: F.when((F.col(f"`{n}`") > F.col(f"`{n}__m`")) & (F.col(f"`{n}__s`") > 0), F.lit(n))
    sets = runs.crossJoin(F.broadcast(stats)).select("agent", "run", *(F.array_compact(F.array(*(above(n) for n in names if n.startswith(f + "_")))).alias(f) for f in ("kw", "bio")))
    a, b = (sets.select(*(F.col(c).alias(f"{c}_{x}") for c in sets.columns)) for x in "ab")

    def jaccard(c: str) -> Column:
        either = F.size(F.array_union(f"{c}_a", f"{c}_b"))
        return F.bround(F.when(either == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(f"{c}_a", f"{c}_b")), either)), 6).alias(f"jaccard_{c}")

    return a.join(b, F.struct("agent_a", "run_a") < F.struct("agent_b", "run_b")).select("agent_a", "run_a", "agent_b", "run_b", jaccard("kw"), jaccard("bio"))
