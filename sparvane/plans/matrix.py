"""Registered queries: feature-by-sample matrices in long form, their tests and pathways."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.functions import special
from sparvane.operators import matrix as M
from sparvane.operators import names as N
from sparvane.operators.settled import settled
from sparvane.operators import stats as T
from sparvane.plans.catalogue import query, table

# Brands are features, suppliers mod 10 samples: 0-3 control, 4-7 case, 8-9 quality control.
LONG = """x AS (SELECT p_brand AS feature, l_suppkey % 10 AS sample, round_even(avg(l_extendedprice), 4) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
raw AS (SELECT feature, sample, CASE WHEN sample < 4 THEN 'control' WHEN sample < 8 THEN 'case' ELSE 'qc' END AS grp, CASE WHEN (TRY_CAST(regexp_extract(feature, '(\\d+)', 1) AS INTEGER) * 7 + sample * 3) % 11 = 0 THEN NULL ELSE v END AS v FROM x)"""
QC = LONG + """, qc AS (SELECT feature, count(v) FILTER (grp = 'qc') AS n_qc, stddev_samp(v) FILTER (grp = 'qc') / avg(v) FILTER (grp = 'qc') AS cv, avg(CASE WHEN v IS NULL AND grp <> 'qc' THEN 1.0::DOUBLE WHEN grp <> 'qc' THEN 0 END) AS missing FROM raw GROUP BY feature),
kept AS (SELECT raw.* FROM raw JOIN qc ON raw.feature = qc.feature WHERE grp <> 'qc' AND missing <= 0.5 AND missing < 1 AND coalesce(cv, 0) <= 0.30)"""
IMP = QC + ", imp AS (SELECT feature, sample, grp, coalesce(v, 0.5 * min(v) OVER (PARTITION BY feature)) AS v FROM kept)"
PQN = IMP + """, ref AS (SELECT feature, median(v) AS ref FROM imp GROUP BY feature), fac AS (SELECT sample, median(v / nullif(ref, 0)) AS f FROM imp JOIN ref ON imp.feature = ref.feature GROUP BY sample),
pqn AS (SELECT imp.feature, imp.sample, grp, v / coalesce(nullif(f, 0), 1) AS v FROM imp JOIN fac ON imp.sample = fac.sample)"""
TESTS = PQN + """, lg AS (SELECT feature, sample, grp, v, log2(greatest(v, 0) + 1) AS l FROM pqn),
st AS (SELECT feature, log2(avg(v) FILTER (grp = 'case') / avg(v) FILTER (grp = 'control')) AS log2fc, avg(l) FILTER (grp = 'case') AS m1, avg(l) FILTER (grp = 'control') AS m0, var_samp(l) FILTER (grp = 'case') AS v1, var_samp(l) FILTER (grp = 'control') AS v0, count(l) FILTER (grp = 'case') AS n1, count(l) FILTER (grp = 'control') AS n0 FROM lg GROUP BY feature)"""


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """``feature, sample, grp, v``, with some values missing by rule."""
    items = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"))
    cells = items.join(parts, "l_partkey").groupBy("feature", (F.col("l_suppkey") % 10).alias("sample")).agg(F.bround(F.avg("l_extendedprice"), 4).alias("v"))
    brand = F.regexp_extract("feature", r"(\d+)", 1).try_cast("int")
    group = F.when(F.col("sample") < 4, "control").when(F.col("sample") < 8, "case").otherwise("qc")
    return cells.select("feature", "sample", group.alias("grp"), F.when(F.coalesce((brand * 7 + F.col("sample") * 3) % 11 != 0, F.lit(True)), F.col("v")).alias("v"))


def imputed(spark: SparkSession, sf: str) -> DataFrame:
    """The filtered matrix without gaps: several steps read it, so it is computed once."""
    return settled(M.impute(M.quality_filter(raw(spark, sf)), "half_min"))


def normalised(spark: SparkSession, sf: str, how: str = "pqn") -> DataFrame:
    return settled(M.normalise(imputed(spark, sf), how))


@query(f"WITH {QC} SELECT feature, n_qc, round_even(cv, 6) AS cv, round_even(missing, 6) AS missing, missing <= 0.5 AND missing < 1 AND coalesce(cv, 0) <= 0.30 AS kept FROM qc")
def qc_filter(spark, sf):
    stats = M.quality(raw(spark, sf))
    return stats.select("feature", "n_qc", F.bround("cv", 6).alias("cv"), F.bround("missing", 6).alias("missing"), "kept")


@query(f"WITH {IMP} SELECT feature, sample, round_even(v, 6) AS v FROM imp")
def half_min_impute(spark, sf):
    return imputed(spark, sf).select("feature", "sample", F.bround("v", 6).alias("v"))


@query(f"WITH {PQN} SELECT feature, sample, round_even(v, 4) AS v FROM pqn")
def pqn_normalise(spark, sf):
    return normalised(spark, sf).select("feature", "sample", F.bround("v", 4).alias("v"))


for _kind, _agg in (("sum", "sum"), ("median", "median")):

    def _normalise(spark, sf, kind=_kind):
        return normalised(spark, sf, kind).select("feature", "sample", F.bround("v", 4).alias("v"))

    _normalise.__name__ = f"{_kind}_normalise"
    query(f"""WITH {IMP}, f AS (SELECT sample, {_agg}(v) AS f FROM imp GROUP BY sample), g AS (SELECT sample, f / (SELECT median(f) FROM f) AS f FROM f)
SELECT feature, imp.sample, round_even(v / coalesce(nullif(f, 0), 1), 4) AS v FROM imp JOIN g ON imp.sample = g.sample""")(_normalise)

for _kind, _div in (("auto", "nullif(stddev_samp(l) OVER w, 0)"), ("pareto", "nullif(sqrt(stddev_samp(l) OVER w), 0)"), ("range", "nullif(max(l) OVER w - min(l) OVER w, 0)")):

    def _scale(spark, sf, kind=_kind):
        logged = normalised(spark, sf).withColumn("v", M.log("v", "log2"))
        return M.scale(logged, kind).select("feature", "sample", F.bround("v", 6).alias("v"))

    _scale.__name__ = f"{_kind}_scale"
    query(f"WITH {TESTS} SELECT feature, sample, round_even(coalesce((l - avg(l) OVER w) / {_div}, 0), 6) AS v FROM lg WINDOW w AS (PARTITION BY feature)")(_scale)


def tests(spark: SparkSession, sf: str) -> DataFrame:
    return M.group_tests(normalised(spark, sf))


@query(f"""WITH {TESTS} SELECT feature, n1, n0, round_even(log2fc, 6) AS log2fc, round_even((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 5) AS welch_t,
 round_even((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)), 5) AS df, round_even((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 5) AS cohens_d FROM st""")
def differential_statistics(spark, sf):
    rows = tests(spark, sf)
    return rows.select("feature", "n1", "n0", F.bround("log2fc", 6).alias("log2fc"), F.bround("welch_t", 5).alias("welch_t"), F.bround("df", 5).alias("df"), F.bround("cohens_d", 5).alias("cohens_d"))


@query(f"""WITH {TESTS}, r AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM lg),
a AS (SELECT feature, (sum(r) FILTER (grp = 'case') - count(*) FILTER (grp = 'case') * (count(*) FILTER (grp = 'case') + 1) / 2.0) / (count(*) FILTER (grp = 'case') * count(*) FILTER (grp = 'control')) AS a FROM r GROUP BY feature)
SELECT feature, round_even(CAST(greatest(a, 1 - a) AS DOUBLE), 6) AS auc FROM a""")
def feature_auc(spark, sf):
    rows = normalised(spark, sf).select("feature", "grp", T.average_rank("v", ["feature"]).alias("r"))
    n1, n0 = F.count_if(F.col("grp") == "case"), F.count_if(F.col("grp") == "control")
    a = (F.sum(F.when(F.col("grp") == "case", F.col("r"))) - n1 * (n1 + 1) / 2.0)
    a = F.try_divide(a, n1 * n0)
    return rows.groupBy("feature").agg(F.bround(F.greatest(a, 1 - a), 6).alias("auc"))


@query("""WITH p AS (SELECT p_brand AS feature, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE round_even((count(*) % 97) / 97.0::DOUBLE + 0.001::DOUBLE, 6) END AS p FROM part GROUP BY p_brand),
r AS (SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS i, count(*) OVER () AS m FROM p WHERE p IS NOT NULL),
q AS (SELECT feature, p, least(1.0, min(p * m / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
SELECT feature, p, round_even(q, 9) AS q FROM (SELECT * FROM q UNION ALL SELECT feature, p, NULL FROM p WHERE p IS NULL)""")
def benjamini_hochberg(spark, sf):
    n = F.count("*")
    p = table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.when(n % 7 != 0, F.bround((n % 97) / 97.0 + 0.001, 6)).alias("p"))
    return T.benjamini_hochberg(p).select("feature", "p", F.bround("q", 9).alias("q"))


def bh_sql(source: str, p: str, q: str) -> str:
    """Query that adds step-up values of p to a table; null p stay null."""
    return f"""SELECT * EXCLUDE (i, m, a), CASE WHEN {p} IS NOT NULL THEN least(1.0, min(a) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) END AS {q}
  FROM (SELECT *, {p} * m / i AS a FROM (SELECT *, row_number() OVER (ORDER BY {p} NULLS LAST, feature) AS i, count({p}) OVER () AS m FROM {source}))"""


WELCH, WELCH_DF = "((m1 - m0) / sqrt(v1 / n1 + v0 / n0))", "((v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)))"
# All groups have four samples: U's exact distribution by the 70 ways to choose four of eight ranks.
# With ties: the normal approximation, corrected for ties and continuity.
_TIED = special.normal_two_sided_sql("((greatest(mw.u, 16 - mw.u) - 8.5) / sqrt(16 / 12.0::DOUBLE * (9 - ties / 56.0::DOUBLE)))")
RANKED = TESTS + f""", rk AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, v) AS same FROM lg),
ways AS (SELECT list_sum(list_transform(generate_series(0, 7), lambda i: ((m >> i) & 1) * (i + 1))) - 10 AS u FROM (SELECT unnest(generate_series(0, 255)) AS m) WHERE bit_count(m) = 4),
mw AS (SELECT feature, CAST(sum(r) FILTER (grp = 'case') - 10 AS DOUBLE) AS u, CAST(sum(same * same - 1) AS DOUBLE) AS ties FROM rk GROUP BY feature),
np AS (SELECT feature, mw.u, CASE WHEN ties = 0 THEN least(1.0, 2 * count_if(ways.u >= greatest(mw.u, 16 - mw.u)) / 70.0::DOUBLE) ELSE {_TIED} END AS p_nonparam FROM mw, ways GROUP BY feature, mw.u, ties)"""
DIFF = RANKED + f""", d0 AS (SELECT st.feature, mc AS mean_control, mk AS mean_case, log2fc, mk / mc AS fold_change, {special.t_two_sided_sql(WELCH, WELCH_DF)} AS p_param, p_nonparam,
 (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS cohens_d, greatest(u / 16, 1 - u / 16) AS auc, n0 AS n_control, n1 AS n_case
 FROM st JOIN np ON st.feature = np.feature JOIN (SELECT feature, avg(v) FILTER (grp = 'control') AS mc, avg(v) FILTER (grp = 'case') AS mk FROM lg GROUP BY feature) x ON x.feature = st.feature WHERE n1 >= 3 AND n0 >= 3),
d1 AS (SELECT *, coalesce(p_param, p_nonparam) AS p_value FROM d0), d2 AS ({bh_sql("d1", "p_value", "q_value")}), d3 AS ({bh_sql("d2", "p_nonparam", "q_nonparam")}),
diff AS (SELECT *, -log10(greatest(p_value, 1e-300)) AS neg_log10_p, q_value < ALPHA AS significant,
 CASE WHEN q_value < ALPHA AND log2fc > 0 THEN 'up' WHEN q_value < ALPHA AND log2fc < 0 THEN 'down' ELSE 'ns' END AS regulation, q_value < ALPHA AND abs(log2fc) >= LEAST_CHANGE AS candidate_biomarker FROM d3)"""
_ROUND = {"mean_control": 3, "mean_case": 3, "log2fc": 6, "fold_change": 6, "p_param": 6, "p_nonparam": 6, "cohens_d": 5, "auc": 6, "p_value": 6, "q_value": 6, "q_nonparam": 6, "neg_log10_p": 5}
_DIFF_COLUMNS = ", ".join(["feature", *(f"round_even({c}, {n}) AS {c}" for c, n in _ROUND.items()), "n_control", "n_case", "significant", "regulation", "candidate_biomarker"])


def diff_sql(alpha: float = 0.05, change: float = 1.0) -> str:
    return DIFF.replace("ALPHA", str(alpha)).replace("LEAST_CHANGE", str(change))


def differential_frame(spark: SparkSession, sf: str, **limits: float) -> DataFrame:
    return M.differential(normalised(spark, sf), **limits)


@query(f"WITH {diff_sql()} SELECT {_DIFF_COLUMNS} FROM diff ORDER BY q_value, p_value")
def differential_abundance(spark, sf):
    """The whole differential table at the reference's limits, sorted by q, then p."""
    rows = differential_frame(spark, sf)
    return rows.orderBy(F.asc_nulls_last("q_value"), F.asc_nulls_last("p_value")).withColumns({c: F.bround(c, n) for c, n in _ROUND.items()})


@query(f"WITH {diff_sql(0.99, 0.001)} SELECT feature, significant, regulation, candidate_biomarker FROM diff")
def regulation_flags(spark, sf):
    """Regulation and candidates at limits wide enough to mark some of these features."""
    return differential_frame(spark, sf, alpha=0.99, threshold=0.001).select("feature", "significant", "regulation", "candidate_biomarker")


@query(f"""WITH {diff_sql(0.99, 0.001)}, top AS (SELECT regulation, feature, row_number() OVER (PARTITION BY regulation ORDER BY q_value, p_value, feature) AS r FROM diff)
SELECT count(*) AS n_tested, count_if(significant) AS n_significant, count_if(regulation = 'up') AS n_up, count_if(regulation = 'down') AS n_down, count_if(candidate_biomarker) AS n_candidate_biomarkers,
 coalesce((SELECT string_agg(feature, '; ' ORDER BY r) FROM top WHERE regulation = 'up' AND r <= 10), '') AS top_up, coalesce((SELECT string_agg(feature, '; ' ORDER BY r) FROM top WHERE regulation = 'down' AND r <= 10), '') AS top_down FROM diff""")
def differential_summary(spark, sf):
    return M.summarise(differential_frame(spark, sf, alpha=0.99, threshold=0.001))


# Nearest-sample imputation of the features that pass the filter.
KNN = QC + """, width AS (SELECT count(DISTINCT feature) AS w FROM kept), known AS (SELECT feature, sample, v FROM kept WHERE v IS NOT NULL),
far AS (SELECT a.sample, b.sample AS donor, sum((a.v - b.v) * (a.v - b.v)) * any_value(w) / count(*) AS far FROM known a JOIN known b ON a.feature = b.feature AND a.sample <> b.sample, width GROUP BY ALL),
cand AS (SELECT m.feature, m.sample, k.v, row_number() OVER (PARTITION BY m.feature, m.sample ORDER BY far, far.donor) AS r FROM kept m JOIN far ON far.sample = m.sample JOIN known k ON k.sample = far.donor AND k.feature = m.feature WHERE m.v IS NULL),
fill AS (SELECT feature, sample, avg(v) AS f FROM cand WHERE r <= 5 GROUP BY ALL)"""


@query(f"WITH {KNN} SELECT kept.feature, kept.sample, round_even(coalesce(v, f), 5) AS v FROM kept LEFT JOIN fill ON kept.feature = fill.feature AND kept.sample = fill.sample")
def knn_impute(spark, sf):
    return M.impute(M.quality_filter(raw(spark, sf)), "knn").select("feature", "sample", F.bround("v", 5).alias("v"))


@query(f"""WITH {QC}, n AS (SELECT count(*) AS a, count_if(missing < 1) AS b, count_if(missing < 1 AND missing <= 0.5) AS c, count_if(missing <= 0.5 AND missing < 1 AND coalesce(cv, 0) <= 0.30) AS d FROM qc)
SELECT CAST(unnest(generate_series(1, 7)) AS INTEGER) AS step, unnest([printf('Removed %d all-missing features (%d -> %d).', a - b, a, b), printf('Removed %d features with >50%% missingness (-> %d).', b - c, c),
 printf('Removed %d features with QC CV>30%% (-> %d).', c - d, d), 'Imputed missing values with ''half_min''.', 'Sample normalization: ''pqn''.', 'Transform: ''log2''.', 'Scaling (multivariate only): ''pareto''.']) AS text FROM n""")
def preprocess_steps(spark, sf):
    return M.preprocess(raw(spark, sf))[2]


@query(f"WITH {QC} SELECT kept.feature, round_even(any_value(cv), 6) AS qc_cv, round_even(avg(CASE WHEN v IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS missing_frac, round_even(avg(v), 4) AS mean_intensity FROM kept JOIN qc ON kept.feature = qc.feature GROUP BY kept.feature")
def feature_quality(spark, sf):
    return M.preprocess(raw(spark, sf))[1].select("feature", F.bround("qc_cv", 6).alias("qc_cv"), F.bround("missing_frac", 6).alias("missing_frac"), F.bround("mean_intensity", 4).alias("mean_intensity"))


# Quality controls among the biological samples' scale: neither normalised nor scaled by their own spread.
@query(f"""WITH {TESTS}, sd AS (SELECT feature, avg(l) AS m, nullif(stddev_samp(l), 0) AS s FROM lg GROUP BY feature), q AS (SELECT feature, sample, coalesce(v, min(v) OVER (PARTITION BY feature), 0) AS v FROM raw WHERE grp = 'qc')
SELECT q.feature, q.sample, round_even(coalesce((log2(greatest(v, 0) + 1) - m) / sqrt(s), 0), 5) AS v FROM q JOIN sd ON q.feature = sd.feature""")
def qc_projection(spark, sf):
    logged = normalised(spark, sf).withColumn("v", M.log("v", "log2"))
    return M.scale_like(raw(spark, sf).filter("grp = 'qc'"), logged, "pareto").select("feature", "sample", F.bround("v", 5).alias("v"))


@query(f"""WITH {TESTS}, sc AS (SELECT feature, sample, coalesce((l - avg(l) OVER w) / nullif(sqrt(stddev_samp(l) OVER w), 0), 0) AS v FROM lg WINDOW w AS (PARTITION BY feature)),
z AS (SELECT feature, sample, (v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0) AS z FROM sc WINDOW w AS (PARTITION BY feature)) SELECT sample, count(*) AS n, round_even(sum(z), 5) AS total, md5(string_agg(feature, ',' ORDER BY feature)) AS features_md5 FROM z GROUP BY sample""")
def sample_rows(spark, sf):
    """The matrix turned: per sample its features with their row z-scores."""
    scaled = M.scale(normalised(spark, sf).withColumn("v", M.log("v", "log2")), "pareto")
    w = Window.partitionBy("feature")
    z = scaled.withColumn("z", F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_samp("v").over(w)))
    return z.groupBy("sample").agg(F.count("*").alias("n"), F.bround(F.sum("z"), 5).alias("total"), F.md5(F.array_join(F.array_sort(F.collect_list("feature")), ",")).alias("features_md5"))


# Pathways are part types, metabolites are brands; hits are brands of even number.
PATH = "mem AS (SELECT DISTINCT p_type AS pathway, p_brand AS metabolite FROM part), hit AS (SELECT DISTINCT metabolite FROM mem WHERE TRY_CAST(regexp_extract(metabolite, '(\\d+)', 1) AS INTEGER) % 2 = 0)"


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_type").alias("pathway"), F.col("p_brand").alias("metabolite")).distinct()


@query(f"""WITH {PATH}, t AS (SELECT count(DISTINCT metabolite) AS n_background FROM mem), s AS (SELECT count(*) AS n_significant FROM hit)
SELECT pathway, count(*) AS size, count(hit.metabolite) AS hits, any_value(n_background) AS background, any_value(n_significant) AS significant, round_even(count(*) * any_value(n_significant) / CAST(any_value(n_background) AS DOUBLE), 6) AS expected,
 round_even(count(hit.metabolite) / (count(*) * any_value(n_significant) / CAST(any_value(n_background) AS DOUBLE)), 6) AS ratio, coalesce(string_agg(hit.metabolite, '; ' ORDER BY hit.metabolite), '') AS hit_list
FROM mem LEFT JOIN hit ON mem.metabolite = hit.metabolite, t, s GROUP BY pathway""")
def enrichment_table(spark, sf):
    rows = members(spark, sf)
    hits = rows.select("metabolite").distinct().filter(F.regexp_extract("metabolite", r"(\d+)", 1).try_cast("int") % 2 == 0)
    return M.over_representation(rows, hits)


@query(f"""WITH {PATH}, g AS (SELECT DISTINCT p_type AS pathway, 'gene' || (p_size % 12) AS gene FROM part)
SELECT gene, count(DISTINCT m.pathway) AS n_pathways, count(DISTINCT h.metabolite) AS n_metabolites, array_to_string(list_sort(list(DISTINCT m.pathway)), '; ') AS pathways
FROM g JOIN mem m ON g.pathway = m.pathway JOIN hit h ON m.metabolite = h.metabolite GROUP BY gene""")
def gene_table(spark, sf):
    rows = members(spark, sf)
    genes = table(spark, sf, "part").select(F.col("p_type").alias("pathway"), F.concat(F.lit("gene"), F.col("p_size") % 12).alias("gene")).distinct()
    hits = rows.filter(F.regexp_extract("metabolite", r"(\d+)", 1).try_cast("int") % 2 == 0)
    return hits.join(genes, "pathway").groupBy("gene").agg(F.count_distinct("pathway").alias("n_pathways"), F.count_distinct("metabolite").alias("n_metabolites"), F.array_join(F.array_sort(F.collect_set("pathway")), "; ").alias("pathways"))


@query("""WITH p AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE p_name || '#' || k END AS name FROM p""")
def unique_names(spark, sf):
    number = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    return table(spark, sf, "part").select("p_partkey", F.when(number == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("#"), number)).alias("name"))


# Names as instruments report them, from parts, in forms that meet every rule of the mapping; every third part is known, its type is the pathway.
_SPELT = ["p_name", "'L-' || p_name", "p_name || '_(principal)'", "p_name || ' (qualifier)'", "upper(p_name) || '#1'", "p_name || '-d3'", "'SM ' || p_size || ':0'", "'PC(' || p_size || ':1)'", "'DL-' || p_name || ' pool'", "split_part(p_name, ' ', 2)", "'x ' || p_name || '  y'", "'Ceramide d' || p_size", "p_type", "'  ' || p_name || ' '", "'lysoPC ' || p_name"]
_KNOWN = "CASE WHEN p_partkey % 2 = 0 THEN 'D-' || p_name ELSE p_name END"
_NAMES_SQL = "SELECT DISTINCT CASE p_partkey % 15 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SPELT)) + " END AS name FROM part"


def reported(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.expr("CASE p_partkey % 15 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SPELT)) + " END").alias("name")).distinct()


def _form_sql(column: str) -> str:
    out = f"regexp_replace(regexp_replace(lower(trim({column})), '_\\((principal|qualifier)\\)', '', 'g'), '\\s*\\((principal|qualifier)\\)', '', 'g')"
    return f"trim(regexp_replace(replace(regexp_replace(regexp_replace(replace({out}, '#', ' '), '-d\\d+\\b', '', 'g'), '\\s+pool\\b', '', 'g'), 'dl-', ''), '\\s+', ' ', 'g'))"


_LIPID_SQL = """SELECT name, 'Sphingolipid metabolism' AS pathway FROM f WHERE contains(form, 'sm(') OR contains(form, 'sm ') OR contains(form, 'ceramide') OR contains(form, 'sphingo')
 UNION ALL SELECT name, 'Glycerophospholipid metabolism' FROM f WHERE regexp_matches(form, 'pc\\(|pe\\(|ps\\(|pg\\(|pi\\(|pa\\(|lysopc|plasmalogen|bmp\\(|cl\\(')"""
MAPPED = f"""kb AS (SELECT DISTINCT p_type AS pathway, {_KNOWN} AS metabolite FROM part WHERE p_partkey % 3 = 0 AND p_size > 45), nm AS ({_NAMES_SQL}), f AS (SELECT name, {_form_sql('name')} AS form FROM nm),
k0 AS (SELECT pathway, {_form_sql('metabolite')} AS key FROM kb), k AS (SELECT DISTINCT pathway, key FROM (SELECT * FROM k0 UNION ALL SELECT pathway, regexp_replace(key, '^[ld]-', '') FROM k0)),
lip AS ({_LIPID_SQL}), eq AS (SELECT DISTINCT name, pathway FROM f JOIN k ON key = form OR key = regexp_replace(form, '^[ld]-', '')), sub AS (SELECT DISTINCT name, pathway FROM f JOIN k ON length(key) >= 5 AND (contains(form, key) OR contains(key, form))),
maps AS (SELECT * FROM lip UNION ALL SELECT * FROM eq WHERE name NOT IN (SELECT name FROM lip) UNION ALL SELECT * FROM sub WHERE name NOT IN (SELECT name FROM lip) AND name NOT IN (SELECT name FROM eq))"""


@query(f"WITH {MAPPED} SELECT nm.name, count(pathway) AS n_pathways, coalesce(string_agg(pathway, '; ' ORDER BY pathway), '') AS pathways, count(pathway) > 0 AS mapped FROM nm LEFT JOIN maps ON nm.name = maps.name GROUP BY nm.name")
def metabolite_annotation(spark, sf):
    known = table(spark, sf, "part").filter("p_partkey % 3 = 0 AND p_size > 45").select(F.col("p_type").alias("pathway"), F.expr(_KNOWN).alias("metabolite")).distinct()
    return N.annotate(reported(spark, sf), known)


@query(f"WITH {MAPPED} SELECT name, form FROM f")
def name_forms(spark, sf):
    return reported(spark, sf).select("name", N.normal_form(F.col("name")).alias("form"))
