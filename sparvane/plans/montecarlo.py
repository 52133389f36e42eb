"""Registered queries: moments of vectors, and Monte Carlo clouds about producers' run vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.operators import moments as M
from sparvane.operators import montecarlo as Q
from sparvane.operators import stats as T
from sparvane.plans import catalogue as C
from sparvane.plans import resampling as R
from sparvane.plans.catalogue import query, table

# Draws of run slots, with the same numbers for each producer; how often each run is drawn.
CLOUD = C.VEC + f""", cent0 AS (SELECT agent, d, avg(x) AS x FROM runv GROUP BY ALL), slot AS (SELECT agent, run, row_number() OVER (PARTITION BY agent ORDER BY run) - 1 AS k, count(*) OVER (PARTITION BY agent) AS n FROM (SELECT DISTINCT agent, run FROM runv)),
g0 AS (SELECT agent, n, b, (b * 48271 + k * 69621 + 42 * 16807 + 1) % 2147483647 AS x0 FROM slot, (SELECT unnest(generate_series(0, {Q.DRAWS - 1})) AS b)),
g1 AS (SELECT agent, n, b, {R._P5.format(x='x0')} AS x1 FROM g0), g2 AS (SELECT agent, n, b, (x1 * 48271 + 11) % 2147483647 AS x2 FROM g1),
cnt AS (SELECT agent, b, n, ({R._P5.format(x='x2')}) % n AS k, count(*) AS w FROM g2 GROUP BY ALL)"""
SPREAD = CLOUD + """, pts AS (SELECT c.agent, b, d, sum(w * x) / any_value(c.n) AS x FROM cnt c JOIN slot s ON c.agent = s.agent AND c.k = s.k JOIN runv r ON r.agent = s.agent AND r.run = s.run GROUP BY ALL),
spread AS (SELECT agent, d, avg(x) AS mean, stddev_pop(x) AS sd, quantile_cont(x, 0.025) AS lo, quantile_cont(x, 0.975) AS hi FROM pts GROUP BY ALL)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def bootstrap_cloud(spark: SparkSession, sf: str) -> DataFrame:
    return Q.clouds(C.run_vectors(spark, sf), "embedding", "bootstrap")


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return T.mean_vector(C.run_vectors(spark, sf), ["agent"], "embedding").withColumnRenamed("embedding", "centroid")


@query("""WITH x AS (SELECT vec_id, unnest(generate_series(1, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT d, avg(x) AS m, nullif(stddev_pop(x), 0) AS s FROM x GROUP BY d), z AS (SELECT vec_id, x.d, coalesce((x - m) / s, 0) AS z FROM x JOIN m ON x.d = m.d)
SELECT CAST(a.d AS INTEGER) AS i, CAST(b.d AS INTEGER) AS j, round_even(avg(a.z * b.z), 8) AS r FROM z a JOIN z b ON a.vec_id = b.vec_id AND a.d <= b.d GROUP BY ALL""")
def vector_covariance(spark, sf):
    """The covariance of all standardised vectors, from which the reduction for Monte Carlo takes its components."""
    m = M.moments(vectors(spark, sf), "embedding")
    cov = m.covariance()
    spread = np.sqrt(np.diag(cov))
    r = cov / np.outer(np.where(spread == 0, 1, spread), np.where(spread == 0, 1, spread))
    return spark.createDataFrame([(i + 1, j + 1, round(float(r[i, j]), 8)) for i in range(len(r)) for j in range(i, len(r))], "i int, j int, r double")  # width x width


@query(None)
def components_needed(spark, sf):
    """The reduction for Monte Carlo: components of the standardised vectors, their shares, the running share, and whether they are among those that explain 95 % (no SQL twin: an eigen-decomposition; see the tests)."""
    m = M.moments(vectors(spark, sf), "embedding")
    most = max(1, min(m.n - 1, len(m.mean), 50))
    shares = M.Axes.fit(m, most, scaled=True).shares
    k = M.enough(shares, 0.95, most)
    return spark.createDataFrame([(i + 1, float(s), float(c), i < k) for i, (s, c) in enumerate(zip(shares, np.cumsum(shares)))], "component int, share double, cumulative double, kept boolean")


@query(f"WITH {SPREAD} SELECT agent, CAST(d AS INTEGER) AS d, round_even(mean, 8) AS mean, round_even(sd, 8) AS sd, round_even(lo, 8) AS lo, round_even(hi, 8) AS hi FROM spread")
def bootstrap_centroids(spark, sf):
    """10,000 bootstrap centroids a producer: each coordinate's mean, deviation and interval."""
    return Q.spread(bootstrap_cloud(spark, sf)).select("agent", "d", *(F.bround(c, 8).alias(c) for c in ("mean", "sd", "lo", "hi")))


@query(f"WITH {SPREAD} SELECT agent, {Q.DRAWS} AS n_mc, round_even(sqrt(sum(mean * mean)), 7) AS mean_norm, round_even(avg(sd), 7) AS mean_sd, round_even(sqrt(sum(lo * lo)), 7) AS ci95_lo_norm, round_even(sqrt(sum(hi * hi)), 7) AS ci95_hi_norm FROM spread GROUP BY agent")
def bootstrap_cloud_summary(spark, sf):
    return _summary(bootstrap_cloud(spark, sf))


@query(None)
def gaussian_cloud_summary(spark, sf):
    """The same of Gaussian satellites in the space of each producer's components; they stay standardised (no SQL twin: a decomposition a producer; see the tests)."""
    return _summary(Q.clouds(C.run_vectors(spark, sf), "embedding", "gaussian"))


def _summary(points: DataFrame) -> DataFrame:
    return Q.cloud_summary(points).withColumns({c: F.bround(c, 7) for c in ("mean_norm", "mean_sd", "ci95_lo_norm", "ci95_hi_norm")})


# Two measures a run: fewer than runs, so the Gaussian needs no reduction and its factor is a formula.
_U = f"({R._P5.format(x='x2')} + 0.5::DOUBLE) / 2147483647"
NORMAL = R.EV + f""", n0 AS (SELECT b, k, (b * 48271 + k * 69621 + 43 * 16807 + 1) % 2147483647 AS x0 FROM (SELECT unnest(generate_series(0, {Q.DRAWS - 1})) AS b), (SELECT unnest(generate_series(0, 3)) AS k)),
n1 AS (SELECT b, k, {R._P5.format(x='x0')} AS x1 FROM n0), n2 AS (SELECT b, k, (x1 * 48271 + 11) % 2147483647 AS x2 FROM n1), n3 AS (SELECT b, k, {_U} AS u FROM n2),
z AS (SELECT b, k // 2 AS d, sqrt(-2 * ln(max(u) FILTER (k % 2 = 0))) * cos(2 * pi() * max(u) FILTER (k % 2 = 1)) AS z FROM n3 GROUP BY ALL)"""


@query(f"""WITH {NORMAL}, c AS (SELECT agent, avg(score) AS mx, avg(n) AS my, var_samp(score) + {Q.RIDGE}::DOUBLE AS a, var_samp(n) + {Q.RIDGE}::DOUBLE AS e, covar_samp(score, n) AS b FROM sc GROUP BY agent),
p AS (SELECT agent, mx + sqrt(a) * z0.z AS x, my + b / sqrt(a) * z0.z + sqrt(e - b * b / a) * z1.z AS y FROM c, (SELECT b AS i, z FROM z WHERE d = 0) z0 JOIN (SELECT b AS i, z FROM z WHERE d = 1) z1 ON z0.i = z1.i)
SELECT agent, count(*) AS n, round_even(avg(x), 6) AS mean_x, round_even(avg(y), 6) AS mean_y, round_even(var_pop(x), 5) AS var_x, round_even(var_pop(y), 5) AS var_y, round_even(covar_pop(x, y), 5) AS cov_xy FROM p GROUP BY agent""")
def gaussian_satellites(spark, sf):
    """10,000 satellites a producer about its runs' score and number of events."""
    runs = R.event_scores(spark, sf).select("agent", "run", F.array(F.col("score").cast("double"), F.col("n").cast("double")).alias("v"))
    points = Q.clouds(runs, "v", "gaussian").select("agent", F.col("point")[0].alias("x"), F.col("point")[1].alias("y"))
    r = lambda c, n, name: F.bround(c, n).alias(name)
    return points.groupBy("agent").agg(F.count("*").alias("n"), r(F.avg("x"), 6, "mean_x"), r(F.avg("y"), 6, "mean_y"), r(F.var_pop("x"), 5, "var_x"), r(F.var_pop("y"), 5, "var_y"), r(F.covar_pop("x", "y"), 5, "cov_xy"))


_ERRORS = {"mean_satellite_distance": 6, "sd_satellite_distance": 6, "distance_ci95_lo": 6, "distance_ci95_hi": 6, "nearest_centroid_overlap": 6}
# Squared distances from the inner products of runs and centroids, so that no draw has coordinates.
DISTANCES = CLOUD + """, rk AS (SELECT r.agent, s.k, r.d, r.x FROM runv r JOIN slot s ON r.agent = s.agent AND r.run = s.run), gram AS (SELECT p.agent, p.k AS k1, q.k AS k2, sum(p.x * q.x) AS g FROM rk p JOIN rk q ON p.agent = q.agent AND p.d = q.d GROUP BY ALL),
h AS (SELECT p.agent, p.k, c.agent AS other, sum(p.x * c.x) AS h FROM rk p JOIN cent0 c ON p.d = c.d GROUP BY ALL), c2 AS (SELECT agent AS other, sum(x * x) AS c2 FROM cent0 GROUP BY agent),
own2 AS (SELECT p.agent, p.b, sum(p.w * q.w * g) / (any_value(p.n) * any_value(p.n)) AS q FROM cnt p JOIN cnt q ON p.agent = q.agent AND p.b = q.b JOIN gram ON gram.agent = p.agent AND k1 = p.k AND k2 = q.k GROUP BY ALL),
cross2 AS (SELECT c.agent, c.b, other, sum(w * h) / any_value(n) AS h FROM cnt c JOIN h ON h.agent = c.agent AND h.k = c.k GROUP BY ALL),
dist AS (SELECT o.agent, o.b, x.other, sqrt(greatest(0, q - 2 * h + c2)) AS d FROM own2 o JOIN cross2 x ON o.agent = x.agent AND o.b = x.b JOIN c2 ON c2.other = x.other),
near AS (SELECT agent, b, min(d) FILTER (other = agent) AS own, min(d) FILTER (other <> agent) AS other FROM dist GROUP BY ALL)"""


@query(f"""WITH {DISTANCES} SELECT agent, round_even(avg(own), 6) AS mean_satellite_distance, round_even(stddev_samp(own), 6) AS sd_satellite_distance, round_even(quantile_cont(own, 0.025), 6) AS distance_ci95_lo, round_even(quantile_cont(own, 0.975), 6) AS distance_ci95_hi,
 round_even(avg(CASE WHEN other < own THEN 1.0::DOUBLE ELSE 0 END), 6) AS nearest_centroid_overlap, count(*) AS n_satellites FROM near GROUP BY agent""")
def cloud_errors(spark, sf):
    """How far bootstrap centroids are from their producer's centroid, and how many are nearer to another's."""
    found = Q.cloud_errors(Q.centroid_distances(bootstrap_cloud(spark, sf), centroids(spark, sf)))
    return found.withColumns({c: F.bround(c, n) for c, n in _ERRORS.items()})


@query(f"""WITH {DISTANCES}, l AS (SELECT agent, min(own) AS lo, max(own) AS hi FROM near GROUP BY agent) SELECT near.agent, least(CAST(floor(round_even((own - lo) / nullif(hi - lo, 0) * 40, 6)) AS BIGINT), 39) AS bin, count(*) AS n FROM near JOIN l ON near.agent = l.agent GROUP BY ALL""")
def cloud_distance_bins(spark, sf):
    """The distances of :func:`cloud_errors` in 40 bins a producer."""
    near = Q.centroid_distances(bootstrap_cloud(spark, sf), centroids(spark, sf))
    limits = near.groupBy("agent").agg(F.min("own").alias("lo"), F.max("own").alias("hi"))
    place = F.floor(F.bround(F.try_divide(F.col("own") - F.col("lo"), F.col("hi") - F.col("lo")) * 40, 6))
    return near.join(limits, "agent").groupBy("agent", F.least(place, F.lit(39)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@query(None)
def cloud_first_component(spark, sf):
    """Each bootstrap cloud along the first principal component of all of them: mean, deviation and interval (no SQL twin; see the tests)."""
    points = bootstrap_cloud(spark, sf)
    axes = M.Axes.fit(M.moments(points, "point"), 1)
    x = M.project(points, "point", axes).select("agent", F.col("coordinates")[0].alias("x"))
    return x.groupBy("agent").agg(*(F.bround(c, 6).alias(n) for n, c in (("centroid_pca1_mean", F.avg("x")), ("centroid_pca1_sd", F.stddev_pop("x")), ("centroid_pca1_ci95_lo", F.percentile("x", F.lit(0.025))), ("centroid_pca1_ci95_hi", F.percentile("x", F.lit(0.975))))))


@query(None)
def satellite_views(spark, sf, most: int = 2000):
    """Runs, producers' centroids and evenly spaced bootstrap centroids on three common axes of the unscaled vectors (no SQL twin; see the tests)."""
    runs = C.run_vectors(spark, sf).select("agent", F.lit("run").alias("kind"), F.col("run").cast("long").alias("number"), F.col("embedding").alias("point"))
    sampled = bootstrap_cloud(spark, sf).filter(Q.evenly("b", Q.DRAWS, most)).select("agent", F.lit("bootstrap").alias("kind"), F.col("b").alias("number"), "point")
    axes = M.Axes.fit(M.moments(runs.unionByName(sampled), "point"), 3)
    middle = T.mean_vector(runs, ["agent"], "point").select("agent", F.lit("centroid").alias("kind"), F.lit(0).cast("long").alias("number"), "point")
    shown = M.project(runs.unionByName(sampled).unionByName(middle), "point", axes)
    return shown.select("agent", "kind", "number", *(F.bround(F.try_element_at("coordinates", F.lit(i + 1)), 6).alias(f"pc{i + 1}") for i in range(3)))
