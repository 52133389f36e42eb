"""Registered queries: tables that reports and their figures show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.functions import special
from sparvane.operators import matrix as M
from sparvane.operators import report as P
from sparvane.operators import stats as T
from sparvane.operators.settled import fresh_folder
from sparvane.plans import catalogue as C
from sparvane.plans import matrix as X
from sparvane.plans import resampling as R
from sparvane.plans.catalogue import query, table
from sparvane.sources import results

# Pathways are part types by size, metabolites are brands; those of even number are hits.  Each type is a theme of its pathways; some have metabolites of their own.
NAMED = [("PROMO", "metabolite", "brand#5"), ("SMALL", "metabolite", " Brand#4 "), ("charge", "falls", "Brand#2"), ("charge", "falls", "Brand#8"), ("charge", "falls", "Brand#11"), ("charge", "falls", "Brand#20"), ("silent", "metabolite", "Brand#7")]
_NAMED_SQL = ", ".join(f"('{t}', '{k}', '{n}')" for t, k, n in NAMED)
THEMES = f"""{X.TESTS}, mem AS (SELECT DISTINCT p_type || ' ' || p_size AS pathway, p_type AS kind, p_brand AS metabolite FROM part), even AS (SELECT DISTINCT metabolite FROM mem WHERE TRY_CAST(regexp_extract(metabolite, '(\\d+)', 1) AS INTEGER) % 2 = 0),
hit AS (SELECT e.metabolite, log2fc FROM even e LEFT JOIN st ON st.feature = e.metabolite), tot AS (SELECT CAST(count(DISTINCT metabolite) AS INTEGER) AS n FROM mem), sg AS (SELECT CAST(count(*) AS INTEGER) AS g FROM even),
k AS (SELECT pathway, CAST(count(*) AS INTEGER) AS size, CAST(count(even.metabolite) AS INTEGER) AS hits FROM mem LEFT JOIN even ON mem.metabolite = even.metabolite GROUP BY pathway), i AS (SELECT pathway, hits, n, g, size, unnest(generate_series(hits, least(size, g))) AS i FROM k, tot, sg),
enr AS (SELECT pathway AS feature, hits, round_even(least(1.0, sum(CASE WHEN g - i > n - size THEN 0 ELSE exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma(g - i + 1) - lgamma(n - size - g + i + 1) - lgamma(n + 1) + lgamma(g + 1) + lgamma(n - g + 1)) END)), 10) AS p FROM i GROUP BY ALL),
q AS ({X.bh_sql('enr', 'p', 'q')}), tested AS (SELECT feature AS name, q < 0.05 AS enriched, hits >= 3 AND p < 0.10 AS strong FROM q WHERE q < 0.05 OR (hits >= 3 AND p < 0.10)),
rules AS (SELECT DISTINCT kind AS theme, 'pathway' AS kind, pathway AS name FROM mem UNION ALL SELECT * FROM (VALUES {_NAMED_SQL}) t(theme, kind, name)),
pth AS (SELECT theme, count_if(enriched) AS n_enriched, count_if(strong) AS n_strong FROM rules JOIN tested USING (name) WHERE kind = 'pathway' GROUP BY theme),
drc AS (SELECT theme, count(DISTINCT {X._form_sql('name')}) AS n_direct, coalesce(string_agg(DISTINCT metabolite, ', ' ORDER BY metabolite) FILTER (kind = 'falls' AND log2fc < 0), '') AS fallen FROM rules JOIN hit ON {X._form_sql('name')} = {X._form_sql('metabolite')} WHERE kind <> 'pathway' GROUP BY theme),
evr AS (SELECT theme, count_if(kind = 'falls') AS wanted FROM rules GROUP BY theme)"""


@query(f"""WITH {THEMES} SELECT evr.theme, coalesce(n_enriched, 0) AS n_enriched, coalesce(n_strong, 0) AS n_strong, coalesce(n_direct, 0) AS n_direct, coalesce(fallen, '') AS fallen,
 coalesce(n_enriched, 0) + coalesce(n_strong, 0) + coalesce(n_direct, 0) > 0 AND (wanted = 0 OR coalesce(fallen, '') <> '') AS fires FROM evr LEFT JOIN pth ON evr.theme = pth.theme LEFT JOIN drc ON evr.theme = drc.theme""")
def narrative_themes(spark, sf):
    """Which themes a narrative report tells, by enriched and strong pathways and by metabolites."""
    parts = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("pathway"), F.col("p_type").alias("theme"), F.col("p_brand").alias("metabolite")).distinct()
    members = parts.select("pathway", "metabolite")
    even = members.select("metabolite").distinct().filter(F.regexp_extract("metabolite", r"(\d+)", 1).try_cast("int") % 2 == 0)
    enriched = M.over_representation(members, even).select("pathway", "hits", F.bround(M.hypergeometric_tail("hits", "size", "significant", "background"), 10).alias("p"))
    changes = M.group_tests(X.normalised(spark, sf)).select(F.col("feature").alias("metabolite"), "log2fc")
    rules = parts.select("theme", F.lit("pathway").alias("kind"), F.col("pathway").alias("name")).distinct().unionByName(spark.createDataFrame(NAMED, "theme string, kind string, name string"))
    return P.themes(T.benjamini_hochberg(enriched), even.join(changes, "metabolite", "left"), rules)


# Similarities of runs of one producer, and 2,000 means of resampled ones.
WITHIN = C.VEC + f""", win AS (SELECT agent_a AS agent, run_a, run_b, round_even(s, 9) AS s FROM sims WHERE agent_a = agent_b), qs AS (SELECT agent, count(*) AS n, avg(s) AS mean, quantile_cont(s, 0.25) AS q1, median(s) AS median, quantile_cont(s, 0.75) AS q3 FROM win GROUP BY agent),
ends AS (SELECT win.agent, min(s) FILTER (s >= q1 - 1.5::DOUBLE * (q3 - q1)) AS lo, max(s) FILTER (s <= q3 + 1.5::DOUBLE * (q3 - q1)) AS hi, count_if(s < q1 - 1.5::DOUBLE * (q3 - q1) OR s > q3 + 1.5::DOUBLE * (q3 - q1)) AS n_outliers FROM win JOIN qs ON win.agent = qs.agent GROUP BY win.agent),
slot AS (SELECT agent, s, row_number() OVER (PARTITION BY agent ORDER BY run_a, run_b) - 1 AS k, count(*) OVER (PARTITION BY agent) AS n, dense_rank() OVER (ORDER BY agent) - 1 AS a FROM win),
g0 AS (SELECT agent, n, b, (b * 48271 + k * 69621 + a * 40692 + 42 * 16807 + 1) % 2147483647 AS x0 FROM slot, (SELECT unnest(generate_series(0, 1999)) AS b)), g1 AS (SELECT agent, n, b, {R._P5.format(x='x0')} AS x1 FROM g0), g2 AS (SELECT agent, n, b, (x1 * 48271 + 11) % 2147483647 AS x2 FROM g1),
g3 AS (SELECT agent, b, ({R._P5.format(x='x2')}) % n AS i FROM g2), boot AS (SELECT g3.agent, b, avg(s) AS m FROM g3 JOIN slot ON g3.agent = slot.agent AND i = k GROUP BY ALL), ci AS (SELECT agent, quantile_cont(m, 0.025) AS lo95, quantile_cont(m, 0.975) AS hi95 FROM boot GROUP BY agent)"""
_BOX = ("mean", "q1", "median", "q3", "whisker_lo", "whisker_hi", "ci95_lo", "ci95_hi")


def within_similarities(spark: SparkSession, sf: str) -> DataFrame:
    return C.run_similarities(spark, sf).filter("agent_a = agent_b").select(F.col("agent_a").alias("agent"), "run_a", "run_b", F.bround("s", 9).alias("s"))


@query(f"""WITH {WITHIN} SELECT qs.agent, n, round_even(mean, 7) AS mean, round_even(q1, 7) AS q1, round_even(median, 7) AS median, round_even(q3, 7) AS q3, round_even(least(lo, q1), 7) AS whisker_lo, round_even(greatest(hi, q3), 7) AS whisker_hi, n_outliers, round_even(lo95, 7) AS ci95_lo, round_even(hi95, 7) AS ci95_hi
FROM qs JOIN ends ON qs.agent = ends.agent JOIN ci ON qs.agent = ci.agent""")
def within_boxes(spark, sf):
    """The box plot of similarities within producers: boxes, whiskers, outliers, and the interval of 2,000 resampled means."""
    rows = within_similarities(spark, sf)
    means = T.bootstrap_means(rows.select("agent", F.struct("run_a", "run_b").alias("run"), "s"), "s", 2000)
    limits = means.groupBy("agent").agg(*(F.percentile("m", F.lit(p)).alias(n) for p, n in ((0.025, "ci95_lo"), (0.975, "ci95_hi"))))
    return P.boxes(rows, "agent", "s").join(limits, "agent").withColumns({c: F.bround(c, 7) for c in _BOX})


@query(f"WITH {WITHIN} SELECT win.agent, run_a, run_b, s FROM win JOIN qs ON win.agent = qs.agent WHERE s < q1 - 1.5::DOUBLE * (q3 - q1) OR s > q3 + 1.5::DOUBLE * (q3 - q1)")
def within_box_outliers(spark, sf):
    return P.box_outliers(within_similarities(spark, sf), "agent", "s")


# Manual scores of every other run take the place of the proxy; the summary's means are resampled from the final scores.
_FINAL = """, man AS (SELECT agent, run, purchases * 1.0::DOUBLE AS manual FROM sc WHERE run % 2 = 1), fin AS (SELECT sc.agent, sc.run, coalesce(manual, score) AS score, CASE WHEN manual IS NULL THEN 'proxy' ELSE 'manual' END AS score_type FROM sc LEFT JOIN man ON sc.agent = man.agent AND sc.run = man.run)"""
SUMMARY = R.EV + _FINAL + R.BOOT[len(R.EV) :].replace("FROM sc)", "FROM fin)")
_SUMMARY = ("mean_score", "sd_score", "sem_score", "ci95_lo", "ci95_hi", "err_lo", "err_hi")


@query(f"""WITH {SUMMARY}, s AS (SELECT agent, count(*) AS n_runs, avg(score) AS mean_score, coalesce(stddev_samp(score), 0) AS sd_score, count_if(score_type = 'manual') AS m FROM fin GROUP BY agent), l AS (SELECT agent, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM boot GROUP BY agent)
SELECT s.agent, n_runs, round_even(mean_score, 6) AS mean_score, round_even(sd_score, 6) AS sd_score, round_even(sd_score / sqrt(n_runs), 6) AS sem_score, round_even(lo, 6) AS ci95_lo, round_even(hi, 6) AS ci95_hi, round_even(greatest(mean_score - lo, 0), 6) AS err_lo, round_even(greatest(hi - mean_score, 0), 6) AS err_hi,
 CASE WHEN m >= n_runs - m THEN 'manual' ELSE 'proxy' END AS score_type, CAST(floor(rank() OVER (ORDER BY round_even(mean_score, 9) DESC) + (count(*) OVER (PARTITION BY round_even(mean_score, 9)) - 1) / 2.0) AS BIGINT) AS rank FROM s JOIN l ON s.agent = l.agent""")
def agent_summary(spark, sf):
    """Producers by final scores, with intervals, error bars and the commonest kind of score."""
    runs = R.event_scores(spark, sf)
    manual = runs.filter("run % 2 = 1").select("agent", "run", F.col("purchases").cast("double").alias("manual"))
    final = runs.join(manual, ["agent", "run"], "left").select("agent", "run", F.coalesce("manual", "score").alias("score"), F.when(F.col("manual").isNull(), "proxy").otherwise("manual").alias("score_type"))
    means = T.bootstrap_means(final, "score", R.DRAWS).withColumn("m", F.bround("m", 9))
    return P.agent_summary(final, "score", means).withColumns({c: F.bround(c, 6) for c in _SUMMARY})


@query("SELECT source AS agent, CAST(1 + (doc_id // 20) % 8 AS INTEGER) AS run, lang AS file_type, count(*) AS n FROM documents GROUP BY ALL")
def kept_inventory(spark, sf):
    """The inventory's summary, written to a result folder and read back by its manifest."""
    folder = fresh_folder(spark, "results")
    rows = C.inventory_summary(spark, sf)
    results.write_table(rows, folder, "inventory_summary")
    return results.read_table(spark, folder, "inventory_summary", rows.schema)


# Pathways of three members or more, ranked by p, then by ratio; genes by their hits, then by their best q.
RANKED = f"""{X.TESTS}, mem AS (SELECT DISTINCT p_type || ' ' || p_size AS pathway, p_brand AS metabolite FROM part), even AS (SELECT DISTINCT metabolite FROM mem WHERE TRY_CAST(regexp_extract(metabolite, '(\\d+)', 1) AS INTEGER) % 2 = 0),
tot AS (SELECT CAST(count(DISTINCT metabolite) AS INTEGER) AS n FROM mem), sg AS (SELECT CAST(count(*) AS INTEGER) AS g FROM even),
k AS (SELECT pathway, CAST(count(*) AS INTEGER) AS size, CAST(count(even.metabolite) AS INTEGER) AS hits, coalesce(string_agg(even.metabolite, '; ' ORDER BY even.metabolite), '') AS hit_list, avg(log2fc) AS mean_log2fc_sig
  FROM mem LEFT JOIN even ON mem.metabolite = even.metabolite LEFT JOIN st ON st.feature = even.metabolite GROUP BY pathway HAVING count(*) >= 3), i AS (SELECT pathway, hits, n, g, size, unnest(generate_series(hits, least(size, g))) AS i FROM k, tot, sg),
pv AS (SELECT pathway AS feature, round_even(least(1.0, sum(CASE WHEN g - i > n - size THEN 0 ELSE exp(lgamma(size + 1) - lgamma(i + 1) - lgamma(size - i + 1) + lgamma(n - size + 1) - lgamma(g - i + 1) - lgamma(n - size - g + i + 1) - lgamma(n + 1) + lgamma(g + 1) + lgamma(n - g + 1)) END)), 10) AS p_value FROM i GROUP BY pathway),
q AS ({X.bh_sql('pv', 'p_value', 'q_value')}),
enr AS (SELECT k.pathway, size, hits, size * g / CAST(n AS DOUBLE) AS expected, hits / (size * g / CAST(n AS DOUBLE)) AS ratio, hit_list, p_value, q_value, mean_log2fc_sig, q_value < 0.05 AS enriched FROM k JOIN q ON q.feature = k.pathway, tot, sg)"""


def enrichment_frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("pathway"), F.col("p_brand").alias("metabolite")).distinct()
    even = members.select("metabolite").distinct().filter(F.regexp_extract("metabolite", r"(\d+)", 1).try_cast("int") % 2 == 0)
    changes = M.group_tests(X.normalised(spark, sf)).select(F.col("feature").alias("metabolite"), "log2fc")
    return members, even, M.enrichment(members, even, changes)


@query(f"WITH {RANKED} SELECT pathway, size, hits, round_even(expected, 6) AS expected, round_even(ratio, 6) AS ratio, hit_list, round_even(p_value, 9) AS p_value, round_even(q_value, 8) AS q_value, round_even(mean_log2fc_sig, 8) AS mean_log2fc_sig, enriched FROM enr ORDER BY p_value, ratio DESC, pathway")
def enrichment_ranked(spark, sf):
    """The enrichment table with q and the hits' mean change, by p, then by ratio."""
    rows = enrichment_frames(spark, sf)[2]
    return rows.orderBy(F.asc_nulls_last("p_value"), F.desc("ratio"), "pathway").withColumns({"p_value": F.bround("p_value", 9), "q_value": F.bround("q_value", 8), "mean_log2fc_sig": F.bround("mean_log2fc_sig", 8)})


@query(f"""WITH {RANKED}, g2 AS (SELECT DISTINCT p_type || ' ' || p_size AS pathway, 'gene' || (p_size % 12) AS gene FROM part)
SELECT gene, count(DISTINCT m.pathway) AS n_pathways, count(DISTINCT m.metabolite) AS n_metabolites, round_even(min(q_value), 8) AS best_pathway_q FROM g2 JOIN mem m ON g2.pathway = m.pathway JOIN even ON even.metabolite = m.metabolite LEFT JOIN enr ON enr.pathway = m.pathway GROUP BY gene ORDER BY n_metabolites DESC, best_pathway_q, gene""")
def gene_nomination(spark, sf):
    """Genes by their pathways' hits, then by the best q among these pathways."""
    members, even, enriched = enrichment_frames(spark, sf)
    genes = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("pathway"), F.concat(F.lit("gene"), F.col("p_size") % 12).alias("gene")).distinct()
    rows = M.nominate_genes(members, even, genes, enriched)
    return rows.orderBy(F.desc("n_metabolites"), F.asc_nulls_last("best_pathway_q"), "gene").withColumn("best_pathway_q", F.bround("best_pathway_q", 8))


# Samples have names with a number at the end, those of cases in another order: pairs go by number, Cohen's d by position.
_NUMBER = "CASE WHEN sample < 4 THEN sample + 1 ELSE (sample * 3) % 4 + 1 END"
_PT = "(m / (nullif(s, 0) / sqrt(n_pairs)))"
PAIRED = f"""{X.TESTS}, num AS (SELECT *, {_NUMBER} AS number FROM lg), px AS (SELECT feature, number, max(l) FILTER (grp = 'case') - max(l) FILTER (grp = 'control') AS x FROM num GROUP BY ALL), ps AS (SELECT feature, count(*) AS n_pairs, avg(x) AS m, stddev_samp(x) AS s FROM px GROUP BY feature),
r AS (SELECT feature, x, rank() OVER (PARTITION BY feature ORDER BY abs(x)) + (count(*) OVER (PARTITION BY feature, abs(x)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, abs(x)) AS same FROM px WHERE x <> 0),
w AS (SELECT feature, CAST(coalesce(sum(r) FILTER (x > 0), 0) AS DOUBLE) AS w, count(*) AS n, CAST(sum(same * same - 1) AS DOUBLE) AS ties FROM r GROUP BY feature), sg AS (SELECT m, list_sum(list_transform(generate_series(0, 3), lambda i: ((m >> i) & 1) * (i + 1))) AS s FROM (SELECT unnest(generate_series(0, 15)) AS m)),
sr AS (SELECT feature, CASE WHEN ties = 0 THEN least(1.0, 2 * count_if(m < 2 ** n AND s >= greatest(w, n * (n + 1) / 2 - w)) / 2.0::DOUBLE ** n) ELSE {special.normal_two_sided_sql("((greatest(w, n * (n + 1) / 2.0::DOUBLE - w) - n * (n + 1) / 4.0::DOUBLE) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24.0::DOUBLE))")} END AS p_nonparam FROM w, sg GROUP BY feature, w, n, ties),
pd AS (SELECT a.feature, avg(b.l - a.l) / nullif(stddev_samp(b.l - a.l), 0) AS cohens_d FROM lg a JOIN lg b ON a.feature = b.feature AND a.sample + 4 = b.sample GROUP BY a.feature),
al AS (SELECT ps.feature, n_pairs, log2fc, {_PT} AS t, {special.t_two_sided_sql(_PT, "CAST(n_pairs - 1 AS DOUBLE)")} AS p_param, p_nonparam, cohens_d FROM ps JOIN st ON st.feature = ps.feature JOIN pd ON pd.feature = ps.feature LEFT JOIN sr ON sr.feature = ps.feature WHERE n1 >= 3 AND n0 >= 3),
pp AS (SELECT *, coalesce(p_param, p_nonparam) AS p_value FROM al), pq AS ({X.bh_sql('pp', 'p_value', 'q_value')})"""
_PAIRED = {"log2fc": 6, "t": 5, "p_param": 6, "p_nonparam": 6, "cohens_d": 5, "p_value": 6, "q_value": 6}


@query(f"WITH {PAIRED} SELECT feature, n_pairs, " + ", ".join(f"round_even({c}, {n}) AS {c}" for c, n in _PAIRED.items()) + " FROM pq")
def paired_differential(spark, sf):
    """Differential tests of pairs by the number at the samples' names' ends."""
    cells = X.normalised(spark, sf).withColumn("name", F.concat("grp", F.lit("_"), F.expr(_NUMBER).cast("string")))
    found = M.differential_paired(cells.select("feature", "name", F.col("sample").alias("position"), "grp", "v"))
    return found.withColumns({c: F.bround(c, n) for c, n in _PAIRED.items()})
