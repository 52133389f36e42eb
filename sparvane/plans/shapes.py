"""Registered queries: distances between runs, report shapes and further tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.functions import special
from sparvane.functions.omics import MODALITIES
from sparvane.operators import matrix as M
from sparvane.operators import stats as T
from sparvane.plans import catalogue as C
from sparvane.plans import matrix as X
from sparvane.plans import resampling as R
from sparvane.plans.catalogue import query, table

# Structural features of runs, standardised by their mean and population deviation.
STD = C.RUNS + ", std AS (SELECT agent, run, " + ", ".join(f"coalesce((\"{n}\" - avg(\"{n}\") OVER ()) / nullif(stddev_pop(\"{n}\") OVER (), 0), 0) AS {n}" for n in C.STRUCT) + " FROM runs)"


@query(f"""WITH {STD} SELECT a.agent AS agent_a, a.run AS run_a, b.agent AS agent_b, b.run AS run_b, round_even(sqrt({" + ".join(f"(a.{n} - b.{n}) * (a.{n} - b.{n})" for n in C.STRUCT)}), 6) AS euclidean FROM std a JOIN std b ON (a.agent, a.run) < (b.agent, b.run)""")
def euclidean_features(spark, sf):
    files = C.corpus(spark, sf)
    runs = files.select("agent", "run", *(c.alias(n) for n, c in C.L.structure(F.col("text")).items())).groupBy("agent", "run").agg(*(F.sum(n).alias(n) for n in C.STRUCT))
    stats = runs.agg(*(f(n).alias(f"{n}_{s}") for n in C.STRUCT for s, f in (("m", F.avg), ("s", F.stddev_pop))))  # one row
    z = runs.crossJoin(stats).select("agent", "run", F.array(*(F.coalesce(F.try_divide(F.col(n) - F.col(f"{n}_m"), F.col(f"{n}_s")), F.lit(0.0)) for n in C.STRUCT)).alias("z"))
    a, b = (z.select(*(F.col(c).alias(f"{c}_{x}") for c in z.columns)) for x in "ab")
    far = F.sqrt(F.aggregate(F.zip_with("z_a", "z_b", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    return a.join(b, F.struct("agent_a", "run_a") < F.struct("agent_b", "run_b")).select("agent_a", "run_a", "agent_b", "run_b", F.bround(far, 6).alias("euclidean"))


@query(f"""WITH {C.VEC}, two AS (SELECT agent_a AS agent, run_a AS run, agent_b AS other, 1 - s AS d FROM sims UNION ALL SELECT agent_b, run_b, agent_a, 1 - s FROM sims),
m AS (SELECT agent, run, other, avg(d) AS d FROM two GROUP BY ALL), ab AS (SELECT agent, run, min(d) FILTER (agent = other) AS a, min(d) FILTER (agent <> other) AS b FROM m GROUP BY ALL)
SELECT agent, round_even(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette, count(*) AS n_runs FROM ab GROUP BY agent""")
def silhouette(spark, sf):
    sims = C.run_similarities(spark, sf)
    two = sims.select(F.col("agent_a").alias("agent"), F.col("run_a").alias("run"), F.col("agent_b").alias("other"), (1 - F.col("s")).alias("d")).unionByName(sims.select(F.col("agent_b").alias("agent"), F.col("run_b").alias("run"), F.col("agent_a").alias("other"), (1 - F.col("s")).alias("d")))
    means = two.groupBy("agent", "run", "other").agg(F.avg("d").alias("d"))
    sides = means.groupBy("agent", "run").agg(F.min(F.when(F.col("agent") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("agent") != F.col("other"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return sides.groupBy("agent").agg(F.bround(F.avg(value), 6).alias("silhouette"), F.count("*").alias("n_runs"))


@query(f"""WITH {C.VEC}, g AS (SELECT d, avg(x) AS x FROM runv GROUP BY d)
SELECT agent, round_even(avg(c), 8) AS alignment FROM (SELECT r.agent, r.run, (sum(r.x * g.x) / sqrt(sum(r.x * r.x)) / sqrt(sum(g.x * g.x)) + 1) / 2 AS c FROM runv r JOIN g ON r.d = g.d GROUP BY ALL) GROUP BY agent""")
def centroid_alignment(spark, sf):
    runs = C.run_vectors(spark, sf)
    centre = T.mean_vector(runs.withColumn("all", F.lit(1)), ["all"], "embedding").select(F.col("embedding").alias("g"))  # one row
    return runs.crossJoin(centre).groupBy("agent").agg(F.bround(F.avg((T.cosine("embedding", "g") + 1) / 2), 8).alias("alignment"))


@query(f"WITH {C.VEC} SELECT agent_a, run_a, agent_b, run_b, round_even(s, 8) AS s FROM (SELECT agent_a, run_a, agent_b, run_b, s FROM sims UNION ALL SELECT agent_b, run_b, agent_a, run_a, s FROM sims UNION ALL SELECT DISTINCT agent, run, agent, run, 1.0 FROM runv)")
def similarity_matrix(spark, sf):
    sims = C.run_similarities(spark, sf)
    turned = sims.select(F.col("agent_b").alias("agent_a"), F.col("run_b").alias("run_a"), F.col("agent_a").alias("agent_b"), F.col("run_a").alias("run_b"), "s")
    own = C.run_vectors(spark, sf).select(F.col("agent").alias("agent_a"), F.col("run").alias("run_a"), F.col("agent").alias("agent_b"), F.col("run").alias("run_b"), F.lit(1.0).alias("s"))
    return sims.unionByName(turned).unionByName(own).withColumn("s", F.bround("s", 8))


@query(f"""WITH {X.PATH}, t AS (SELECT CAST(count(DISTINCT metabolite) AS INTEGER) AS n FROM mem), s AS (SELECT CAST(count(*) AS INTEGER) AS g FROM hit),
k AS (SELECT pathway, CAST(count(*) AS INTEGER) AS size, CAST(count(hit.metabolite) AS INTEGER) AS hits FROM mem LEFT JOIN hit ON mem.metabolite = hit.metabolite GROUP BY pathway),
i AS (SELECT pathway, n, g, size, unnest(generate_series(hits, least(size, g))) AS i FROM k, t, s)
SELECT pathway, round_even(least(1.0, sum(CASE WHEN g - i > n - size THEN 0 ELSE exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma(g - i + 1) - lgamma(n - size - g + i + 1) - lgamma(n + 1) + lgamma(g + 1) + lgamma(n - g + 1)) END)), 8) AS p FROM i GROUP BY pathway""")
def fisher_enrichment(spark, sf):
    rows = X.members(spark, sf)
    hits = rows.select("metabolite").distinct().filter(F.regexp_extract("metabolite", r"(\d+)", 1).try_cast("int") % 2 == 0)
    return M.over_representation(rows, hits).select("pathway", F.bround(M.hypergeometric_tail("hits", "size", "significant", "background"), 8).alias("p"))


@query(f"""WITH {X.TESTS}, p AS (SELECT a.feature, b.l - a.l AS d FROM lg a JOIN lg b ON a.feature = b.feature AND a.sample + 4 = b.sample)
SELECT feature, count(*) AS n, round_even(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 5) AS t, round_even(avg(d) / nullif(stddev_samp(d), 0), 5) AS d FROM p GROUP BY feature""")
def paired_tests(spark, sf):
    logged = X.normalised(spark, sf).select("feature", "sample", M.log("v", "log2").alias("l"))
    case = logged.select("feature", (F.col("sample") - 4).alias("sample"), F.col("l").alias("l1"))
    pairs = logged.join(case, ["feature", "sample"]).withColumn("x", F.col("l1") - F.col("l"))
    t = F.try_divide(F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count("*")))
    return pairs.groupBy("feature").agg(F.count("*").alias("n"), F.bround(t, 5).alias("t"), F.bround(F.try_divide(F.avg("x"), F.stddev_samp("x")), 5).alias("d"))


@query(f"WITH {X.RANKED} SELECT feature, u, round_even(p_nonparam, 8) AS p_nonparam FROM np")
def mann_whitney(spark, sf):
    return M.rank_test(X.normalised(spark, sf)).select("feature", "u", F.bround("p_nonparam", 8).alias("p_nonparam"))


# At most four pairs: the sum of positive ranks by the ways to give them signs; with ties the normal approximation, corrected for them.
_SIGNED_TIES = special.normal_two_sided_sql("((greatest(w, n * (n + 1) / 2.0::DOUBLE - w) - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0::DOUBLE))")


@query(f"""WITH {X.TESTS}, p AS (SELECT a.feature, b.l - a.l AS x FROM lg a JOIN lg b ON a.feature = b.feature AND a.sample + 4 = b.sample),
r AS (SELECT feature, x, rank() OVER (PARTITION BY feature ORDER BY abs(x)) + (count(*) OVER (PARTITION BY feature, abs(x)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, abs(x)) AS same FROM p WHERE x <> 0),
w AS (SELECT feature, CAST(coalesce(sum(r) FILTER (x > 0), 0) AS DOUBLE) AS w, count(*) AS n, CAST(sum(same * same - 1) AS DOUBLE) AS ties FROM r GROUP BY feature),
s AS (SELECT m, list_sum(list_transform(generate_series(0, 3), lambda i: ((m >> i) & 1) * (i + 1))) AS s FROM (SELECT unnest(generate_series(0, 15)) AS m))
SELECT feature, w, CASE WHEN ties = 0 THEN least(1.0, 2 * count_if(m < 2 ** n AND s >= greatest(w, n * (n + 1) / 2 - w)) / 2.0::DOUBLE ** n) ELSE {_SIGNED_TIES} END AS p FROM w, s GROUP BY feature, w, n, ties""")
def signed_ranks(spark, sf):
    logged = X.normalised(spark, sf).select("feature", "sample", M.log("v", "log2").alias("l"))
    case = logged.select("feature", (F.col("sample") - 4).alias("sample"), F.col("l").alias("l1"))
    return M.signed_rank_test(logged.join(case, ["feature", "sample"]).select("feature", (F.col("l1") - F.col("l")).alias("x")))


@query("""WITH l AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels ON documents.doc_id = labels.doc_id), g AS (SELECT score, count_if(y = 1) AS p, count_if(y = 0) AS n FROM l GROUP BY score)
SELECT score, round_even(sum(p) OVER w / sum(p) OVER (), 8) AS tpr, round_even(sum(n) OVER w / sum(n) OVER (), 8) AS fpr FROM g WINDOW w AS (ORDER BY score DESC)""")
def roc_points(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")).join(table(spark, sf, "labels"), "doc_id")
    counts = rows.groupBy("score").agg(F.count_if(F.col("quality") == 1).alias("p"), F.count_if(F.col("quality") == 0).alias("n"))
    down, every = Window.orderBy(F.desc("score")), Window.partitionBy()
    return counts.select("score", *(F.bround(F.try_divide(F.sum(c).over(down), F.sum(c).over(every)), 8).alias(a) for c, a in (("p", "tpr"), ("n", "fpr"))))


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(coalesce(CAST(floor((value - lo) / nullif(hi - lo, 0) * 40) AS BIGINT), 0), 39) AS bin, count(*) AS n FROM events, r GROUP BY bin""")
def value_histogram(spark, sf):
    events = table(spark, sf, "events").select("value")
    limits = events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # one row
    place = F.coalesce(F.floor(F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")) * 40), F.lit(0))  # one value alone is in the first bin
    return events.crossJoin(F.broadcast(limits)).groupBy(F.least(place, F.lit(39)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {R.EV}, c AS (SELECT agent, avg(score) AS mx, avg(n) AS my, var_samp(score) AS a, var_samp(n) AS d, covar_samp(score, n) AS b FROM sc GROUP BY agent)
SELECT agent, round_even(mx, 6) AS x, round_even(my, 6) AS y, round_even(2 * sqrt((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b)), 5) AS major, round_even(2 * sqrt(greatest(0, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b))), 4) AS minor FROM c""")
def covariance_ellipse(spark, sf):
    c = R.event_scores(spark, sf).groupBy("agent").agg(F.avg("score").alias("mx"), F.avg("n").alias("my"), F.var_samp("score").alias("a"), F.var_samp("n").alias("d"), F.covar_samp("score", "n").alias("b"))
    half, root = (F.col("a") + F.col("d")) / 2, F.sqrt((F.col("a") - F.col("d")) * (F.col("a") - F.col("d")) / 4 + F.col("b") * F.col("b"))
    return c.select("agent", F.bround("mx", 6).alias("x"), F.bround("my", 6).alias("y"), F.bround(2 * F.sqrt(half + root), 5).alias("major"), F.bround(2 * F.sqrt(F.greatest(F.lit(0.0), half - root)), 4).alias("minor"))


def _modality(name: str) -> None:
    """Registers a modality's term counts in long form, its components, scores, ranking and rubric."""
    lexicons, scheme = MODALITIES[name], C.S.SCHEMES[name]
    terms = {f"{x.family}_{t}": x.sql(t, "t") for x in lexicons for t in x.terms}
    runs = C.runs_sql(terms, scheme.entity)
    parts = runs + C.parts_sql(terms, scheme)
    scores, graded = parts + C.scores_sql("scores", scheme=scheme), runs + C.graded_sql(terms, scheme)
    long = " UNION ALL ".join(f"SELECT agent, run, '{n.partition('_')[0]}' AS family, '{n.partition('_')[2]}' AS term, \"{n}\" AS cnt FROM runs" for n in terms)

    def register(kind: str, sql: str, build) -> None:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return build(C.run_features_frame(spark, sf, lexicons, scheme.entity))

        run.__name__ = f"{name}_{kind}"
        query(f"WITH {sql}")(run)

    def in_long_form(rows: DataFrame) -> DataFrame:
        pairs = (F.struct(F.lit(n.partition("_")[0]).alias("family"), F.lit(n.partition("_")[2]).alias("term"), F.col(f"`{n}`").alias("cnt")) for n in terms)
        return rows.select("agent", "run", F.inline(F.array(*pairs)))

    def scored(rows: DataFrame) -> DataFrame:
        return C.S.run_scores(C.S.components(rows, scheme), scheme=scheme)

    register("terms", f"{runs} {long}", in_long_form)
    register("components", f"{parts} SELECT * FROM parts", lambda rows: C.S.components(rows, scheme))
    register("scores", f"{scores} SELECT agent, run, R, P, D, round_even(AgentScore, 6) AS AgentScore FROM scores", lambda rows: scored(rows).withColumn("AgentScore", F.bround("AgentScore", 6)))
    register("ranking", f"{scores} {C.summary_sql('scores', 'AgentScore')}", lambda rows: C.S.summary(scored(rows), "AgentScore"))
    register("rubric", f"{graded} SELECT * FROM graded", lambda rows: C.S.rubric(rows, scheme))


for _name in MODALITIES:
    _modality(_name)
