"""Registered queries over the driver's tables, each with SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.functions import lexicon as L
from sparvane.operators import scoring as S
from sparvane.operators import stats as T
from sparvane.operators.settled import settled

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

# Sentences that give the documents something to find; document i gets number i mod 20.
PHRASES = [
    "PCA and PLS-DA show a batch; results should be interpreted with caution.", "Quality control by FastQC and MultiQC; QC passed.",
    "Normalization with TMM and scaling to unit variance.", "DESeq2 and edgeR give differential expression of 12 genes.", "FDR below 0.05 after Benjamini-Hochberg, p-value 0.01.",
    "The fold change and log2FC are in the table | - | - |.", "KEGG pathway analysis and GSEA find an immune mechanism.", "One limitation is uncertainty of annotation.",
    "Genes: gene, gene, gene, gene, gene, gene in a pathway.", "See ```code``` and ![plot](a.png).", "Wilcoxon and t-test, ANOVA.", "RNA-seq reads were aligned by STAR and counted by salmon.",
    "Imputation of missing counts; preprocessing by trimming.", "Cell cycle and signaling are plausible.", "Consistent across runs: LC-MS/MS with DIA, label-free, pooled QC samples.", "Batch correction with ComBat.",
    "Significant DEGs were annotated, level 2.", "Heatmap and volcano plot.", "Exploratory, preliminary and not conclusive: lipid and amino acid metabolites, kinase and phosphorylation.", "Untargeted metabolomics: metabolite, metabolite, metabolite, metabolites, metabolites, metabolite; protein, protein, proteins, protein, proteins, protein.",
]


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``agent, run, file_id, text``: sources are agents, with eight runs each."""
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % 20 + 1).cast("int"))
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("agent"), (1 + F.floor(F.col("doc_id") / 20) % 8).cast("int").alias("run"), F.col("doc_id").alias("file_id"), F.concat_ws(" ", "text", phrase).alias("text"))


_Q = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
CORPUS = f"""corpus AS (SELECT source AS agent, CAST(1 + (doc_id // 20) % 8 AS INTEGER) AS run, doc_id AS file_id,
  concat_ws(' ', text, {_Q}[1 + doc_id % 20]) AS text FROM documents),
ascii AS (SELECT *, regexp_replace(text, '[\\x{{80}}-\\x{{10FFFF}}]', 'x', 'g') AS t FROM corpus)"""


def features(spark: SparkSession, sf: str, lexicons: tuple = L.ALL, entity: str = "gene") -> DataFrame:
    """Per file the structural counts, the terms of all families, and how often entities and pathways are named."""
    rows = corpus(spark, sf).repartition("file_id")  # a file of one row group is one task's work otherwise
    rows = rows.withColumn("read", L.reading(F.col("text"), lexicons))  # a column of its own: found once, not for each pattern
    columns = L.structure(F.col("text"), F.col("read.held"), F.col("read"))
    for lexicon in lexicons:
        columns |= lexicon.counts(F.col("read.near"), F.col("read.held"))
    counted = rows.select("agent", "run", "file_id", *(c.alias(n) for n, c in columns.items()))
    return counted.withColumns({f"n_{entity}_mentions": F.col(f"bio_{entity}"), "n_pathway_mentions": F.col("bio_pathway")})


def _hits(name: str) -> str:
    return f"len(regexp_extract_all(t, '{L.STRUCTURE[name]}'))"


_STRUCT_SQL = {
    "n_chars": "length(text)", "n_words": "len(regexp_extract_all(t, '\\S+'))", "n_lines": "CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END",
    "n_sheets": _hits("n_sheets"), "n_tables": f"CASE WHEN {_hits('n_sheets')} > 0 THEN {_hits('n_sheets')} ELSE {_hits('n_marks')} END",
    **{n: _hits(n) for n in ("n_images", "n_numeric", "n_pvalues", "n_fdr", "n_code_blocks")},
}
_TERM_SQL = {f"{x.family}_{t}": x.sql(t, "t") for x in L.ALL for t in x.terms}
STRUCT = list(_STRUCT_SQL)


def runs_sql(terms: dict[str, str], entity: str = "gene") -> str:
    """CTEs up to ``runs``: all counts of files summed by run."""
    files = ", ".join(f'CAST({q} AS BIGINT) AS "{n}"' for n, q in (_STRUCT_SQL | terms).items())
    sums = ", ".join(f'CAST(sum("{n}") AS BIGINT) AS "{n}"' for n in _STRUCT_SQL | terms)
    names = f'CAST(sum("bio_{entity}") AS BIGINT) AS n_{entity}_mentions, CAST(sum(bio_pathway) AS BIGINT) AS n_pathway_mentions'
    return f"{CORPUS}, features AS (SELECT agent, run, file_id, {files} FROM ascii), runs AS (SELECT agent, run, count(*) AS n_files, {sums}, {names} FROM features GROUP BY ALL)"


def known_features(terms: dict[str, str], entity: str = "gene") -> set[str]:
    return {*_STRUCT_SQL, *terms, f"n_{entity}_mentions", "n_pathway_mentions"}


def parts_sql(terms: dict[str, str], scheme: S.Scheme) -> str:
    known = known_features(terms, scheme.entity)
    return ", parts AS (SELECT agent, run, " + ", ".join(f"{S.component_sql(x, known)} AS {c}" for c, x in scheme.components.items()) + " FROM runs)"


def graded_sql(terms: dict[str, str], scheme: S.Scheme) -> str:
    known = known_features(terms, scheme.entity)
    grades = ", ".join(f"{S.grade_sql(r, known)} AS {c}" for c, r in scheme.rubric.items())
    return f", graded0 AS (SELECT agent, run, {grades} FROM runs), graded AS (SELECT *, round_even(CAST({' + '.join(scheme.rubric)} AS DOUBLE) * 100 / 32, 2) AS DomainScore FROM graded0)"


RUNS = runs_sql(_TERM_SQL)
PARTS = RUNS + parts_sql(_TERM_SQL, S.TRANSCRIPTS)


def _mean_sql(group: dict, without: tuple = ()) -> str:
    names = [n for n in group if n not in without]
    return f"round_even(CAST({' + '.join(names)} AS DOUBLE) / {len(names)} * 100, 2)"


def scores_sql(name: str, without: tuple = (), scheme: S.Scheme = S.TRANSCRIPTS) -> str:
    return f""", {name} AS (SELECT *, P * (0.50::DOUBLE + 0.30::DOUBLE * D / 100 + 0.20::DOUBLE * R / 100) AS AgentScore FROM (
  SELECT agent, run, {_mean_sql(scheme.result, without)} AS R, {_mean_sql(scheme.process, without)} AS P, {_mean_sql(scheme.depth, without)} AS D FROM parts))"""


SCORES = PARTS + scores_sql("scores")
GRADED = RUNS + graded_sql(_TERM_SQL, S.TRANSCRIPTS)


def summary_sql(source: str, value: str) -> str:
    return f"""SELECT agent, mean, sd, n_runs, sd / sqrt(n_runs) AS sem,
  CAST(floor(rank() OVER (ORDER BY mean DESC) + (count(*) OVER (PARTITION BY mean) - 1) / 2.0) AS BIGINT) AS rank
FROM (SELECT agent, round_even(avg({value}), 6) AS mean, coalesce(stddev_samp({value}), 0) AS sd, count(*) AS n_runs FROM {source} GROUP BY agent)"""


def run_features_frame(spark: SparkSession, sf: str, lexicons: tuple = L.ALL, entity: str = "gene") -> DataFrame:
    files = features(spark, sf, lexicons, entity)
    return files.groupBy("agent", "run").agg(F.count("*").alias("n_files"), *(F.sum(c).alias(c) for c in files.columns[3:]))


def scores_frame(spark: SparkSession, sf: str) -> DataFrame:
    return S.run_scores(S.components(run_features_frame(spark, sf)))


@query(f"WITH {CORPUS} SELECT file_id, " + ", ".join(f"{q} AS {n}" for n, q in _STRUCT_SQL.items()) + " FROM ascii")
def structural_counts(spark, sf):
    return corpus(spark, sf).select("file_id", *(c.alias(n) for n, c in L.structure(F.col("text")).items()))


@query(f"WITH {RUNS} SELECT * FROM runs")
def run_features(spark, sf):
    return run_features_frame(spark, sf)


@query(f"WITH {RUNS} SELECT agent, " + ", ".join(f"round_even(avg({n}), 6) AS mean_{n}" for n in STRUCT) + " FROM runs GROUP BY agent")
def agent_features(spark, sf):
    return run_features_frame(spark, sf).groupBy("agent").agg(*(F.bround(F.avg(n), 6).alias(f"mean_{n}") for n in STRUCT))


@query(f"WITH {PARTS} SELECT *, P_subtotal + R_subtotal + D_subtotal AS total FROM (SELECT *, {' + '.join(S.PROCESS)} AS P_subtotal, {' + '.join(S.RESULT)} AS R_subtotal, {' + '.join(S.DEPTH)} AS D_subtotal FROM parts)")
def proxy_components(spark, sf):
    return S.decomposition(S.components(run_features_frame(spark, sf)))


@query(f"WITH {SCORES} SELECT agent, run, R, P, D, round_even(AgentScore, 6) AS AgentScore FROM scores")
def run_scores(spark, sf):
    return scores_frame(spark, sf).withColumn("AgentScore", F.bround("AgentScore", 6))


@query(f"WITH {PARTS}{scores_sql('less', S.VOLUME)} SELECT agent, run, R, P, D, round_even(AgentScore, 6) AS AgentScore FROM less")
def scores_without_volume(spark, sf):
    return S.run_scores(S.components(run_features_frame(spark, sf)), S.VOLUME).withColumn("AgentScore", F.bround("AgentScore", 6))


@query(f"WITH {GRADED} SELECT * FROM graded")
def domain_rubric(spark, sf):
    return S.rubric(run_features_frame(spark, sf))


@query(f"WITH {GRADED} {summary_sql('graded', 'DomainScore')}")
def domain_summary(spark, sf):
    return S.summary(S.rubric(run_features_frame(spark, sf)), "DomainScore")


@query(f"WITH {SCORES} {summary_sql('scores', 'AgentScore')}")
def agent_ranking(spark, sf):
    return S.summary(scores_frame(spark, sf), "AgentScore")


# Terms in long form: one row per agent, run and term.
LONG = RUNS + ", long AS (" + " UNION ALL ".join(f"SELECT agent, run, '{n.partition('_')[0]}' AS family, '{n.partition('_')[2]}' AS term, \"{n}\" AS cnt FROM runs" for n in _TERM_SQL) + ")"


def long_terms(spark: SparkSession, sf: str, runs: DataFrame | None = None) -> DataFrame:
    """One row per agent, run and term; the runs' features are computed once, however often the rows are read."""
    runs = settled(run_features_frame(spark, sf)) if runs is None else runs
    pairs = F.array(*(F.struct(F.lit(n.partition("_")[0]).alias("family"), F.lit(n.partition("_")[2]).alias("term"), F.col(f"`{n}`").alias("cnt")) for n in _TERM_SQL))
    return runs.select("agent", "run", F.inline(pairs))


@query(f"WITH {LONG} SELECT agent, run, family, term, cnt, CAST(cnt > 0 AS INTEGER) AS present FROM long")
def run_terms(spark, sf):
    return long_terms(spark, sf).withColumn("present", (F.col("cnt") > 0).cast("int"))


@query(f"""WITH {LONG}, per AS (SELECT family, term, agent, count_if(cnt > 0) AS runs_with, count(*) AS n_runs, round_even(avg(cnt), 3) AS freq FROM long GROUP BY ALL),
tot AS (SELECT count(DISTINCT agent) AS agents FROM long)
SELECT family, term, count_if(runs_with > 0) AS n_agents_present, CAST(sum(runs_with) AS BIGINT) AS n_runs_present, round_even(100.0::DOUBLE * sum(runs_with) / sum(n_runs), 2) AS prevalence_pct,
  count_if(runs_with > 0) = max(agents) AS shared_all, count_if(runs_with > 0) >= 2 AS shared_2plus, count_if(runs_with > 0) = 1 AS agent_specific,
  CASE WHEN count_if(runs_with > 0) = max(agents) THEN 'shared' ELSE arg_min(agent, (-freq, agent)) END AS dominant_agent
FROM per, tot GROUP BY family, term HAVING sum(runs_with) > 0""")
def shared_terms(spark, sf):
    rows = long_terms(spark, sf)
    per = rows.groupBy("family", "term", "agent").agg(F.count_if(F.col("cnt") > 0).alias("runs_with"), F.count("*").alias("n_runs"), F.bround(F.avg("cnt"), 3).alias("freq"))
    per = per.crossJoin(F.broadcast(rows.agg(F.count_distinct("agent").alias("agents"))))  # one row
    present = F.count_if(F.col("runs_with") > 0)
    out = per.groupBy("family", "term").agg(
        present.alias("n_agents_present"), F.sum("runs_with").alias("n_runs_present"), F.bround(100.0 * F.sum("runs_with") / F.sum("n_runs"), 2).alias("prevalence_pct"),
        (present == F.max("agents")).alias("shared_all"), (present >= 2).alias("shared_2plus"), (present == 1).alias("agent_specific"),
        F.when(present == F.max("agents"), "shared").otherwise(F.min_by("agent", F.struct(-F.col("freq"), "agent"))).alias("dominant_agent"),
    )
    return out.filter("n_runs_present > 0")


@query(f"""WITH {LONG}, per AS (SELECT family, term, agent, count_if(cnt > 0) AS w, count(*) AS n FROM long GROUP BY ALL)
SELECT family, term, bool_and(w > 0) AS strict_core, count_if(w * 2 >= n) >= 2 AS robust_core FROM per GROUP BY family, term HAVING bool_and(w > 0) OR count_if(w * 2 >= n) >= 2""")
def consensus_core(spark, sf):
    per = long_terms(spark, sf).groupBy("family", "term", "agent").agg(F.count_if(F.col("cnt") > 0).alias("w"), F.count("*").alias("n"))
    out = per.groupBy("family", "term").agg(F.bool_and(F.col("w") > 0).alias("strict_core"), (F.count_if(F.col("w") * 2 >= F.col("n")) >= 2).alias("robust_core"))
    return out.filter("strict_core or robust_core")


@query(f"WITH {LONG} SELECT agent, family, term, round_even(avg(CAST(cnt > 0 AS INTEGER)), 6) AS fraction FROM long GROUP BY ALL")
def presence_fractions(spark, sf):
    return long_terms(spark, sf).groupBy("agent", "family", "term").agg(F.bround(F.avg((F.col("cnt") > 0).cast("int")), 6).alias("fraction"))


@query(f"""WITH {LONG}, s AS (SELECT agent, run, list(term) FILTER (cnt > 0 AND family = 'kw') AS kw FROM long GROUP BY ALL)
SELECT a.agent AS agent_a, a.run AS run_a, b.agent AS agent_b, b.run AS run_b,
 round_even(CASE WHEN coalesce(len(a.kw), 0) + coalesce(len(b.kw), 0) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(a.kw, []), coalesce(b.kw, []))) / CAST(len(list_distinct(list_concat(a.kw, b.kw))) AS DOUBLE) END, 6) AS jaccard_kw
FROM s a JOIN s b ON (a.agent, a.run) < (b.agent, b.run)""")
def jaccard_terms(spark, sf):
    sets = long_terms(spark, sf).groupBy("agent", "run").agg(F.collect_list(F.when((F.col("cnt") > 0) & (F.col("family") == "kw"), F.col("term"))).alias("kw"))
    a, b = (sets.select(F.col("agent").alias(f"agent_{x}"), F.col("run").alias(f"run_{x}"), F.col("kw").alias(f"kw_{x}")) for x in "ab")
    pairs = a.join(b, F.struct("agent_a", "run_a") < F.struct("agent_b", "run_b"))
    either = F.size(F.array_union("kw_a", "kw_b"))
    return pairs.select("agent_a", "run_a", "agent_b", "run_b", F.bround(F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect("kw_a", "kw_b")) / either), 6).alias("jaccard_kw"))


# Chunks of 800 words that overlap by 150.
@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(generate_series(0, CAST(greatest(ceil((len(w) - 800) / 650.0), 0) AS BIGINT))) AS k FROM w WHERE len(w) > 0)
SELECT doc_id, printf('%d_chunk%04d', doc_id, k) AS chunk_id, CAST(k * 650 AS BIGINT) AS start_token, CAST(least(k * 650 + 800, len(w)) AS BIGINT) AS end_token,
  md5(array_to_string(w[k * 650 + 1 : k * 650 + 800], ' ')) AS text_md5 FROM c""")
def chunks(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    rows = words.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil((F.col("n") - 800) / 650), F.lit(0)).cast("int"))))
    return rows.select(
        "doc_id", F.format_string("%d_chunk%04d", "doc_id", "k").alias("chunk_id"), (F.col("k") * 650).cast("bigint").alias("start_token"),
        F.least(F.col("k") * 650 + 800, "n").cast("bigint").alias("end_token"), F.md5(F.array_join(F.slice("w", F.col("k") * 650 + 1, F.lit(800)), " ")).alias("text_md5"),
    )


@query("SELECT source AS agent, CAST(1 + (doc_id // 20) % 8 AS INTEGER) AS run, lang AS file_type, count(*) AS n FROM documents GROUP BY ALL")
def inventory_summary(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("agent"), (1 + F.floor(F.col("doc_id") / 20) % 8).cast("int").alias("run"), F.col("lang").alias("file_type")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id % 4 AS agent, 1 + (event_id // 4) % 8 AS run, event_type, value FROM events),
n AS (SELECT agent, run, event_type, count(*) AS n FROM e GROUP BY ALL),
t AS (SELECT agent, run, n / CAST(sum(n) OVER (PARTITION BY agent, run) AS DOUBLE) AS p FROM n),
d AS (SELECT agent, run, round_even(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 4) AS artifact_diversity FROM t GROUP BY ALL)
SELECT e.agent, e.run, count(*) AS n_files, """ + ", ".join(f"count_if(event_type = '{x}') AS n_{x}" for x in ("click", "error", "purchase", "signup", "view")) + """,
  round_even(sum(value), 4) AS total_size, round_even(avg(value), 6) AS mean_size, any_value(artifact_diversity) AS artifact_diversity
FROM e JOIN d ON e.agent = d.agent AND e.run = d.run GROUP BY e.agent, e.run""")
def volume_metrics(spark, sf):
    kinds = ("click", "error", "purchase", "signup", "view")
    rows = table(spark, sf, "events").select((F.col("event_id") % 4).alias("agent"), (1 + F.floor(F.col("event_id") / 4) % 8).alias("run"), "event_type", "value")
    per = rows.groupBy("agent", "run").agg(F.count("*").alias("n_files"), *(F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds), F.bround(F.sum("value"), 4).alias("total_size"), F.bround(F.avg("value"), 6).alias("mean_size"))
    shares = [F.col(f"n_{k}") / F.col("n_files") for k in kinds]
    entropy = sum(F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in shares)
    used = sum((F.col(f"n_{k}") > 0).cast("int") for k in kinds)
    return per.withColumn("artifact_diversity", F.bround(F.when(used > 1, entropy / F.log(used)).otherwise(0.0), 4))


@query("""WITH r AS (SELECT source AS agent, 1 + (doc_id // 20) % 8 AS run FROM documents GROUP BY ALL)
SELECT agent, count(*) AS runs_detected, array_to_string(list_sort(list_filter([1,2,3,4,5,6,7,8], lambda x: NOT list_contains(list(run), x))), ',') AS missing_runs,
  CASE WHEN count(*) = 8 THEN 'complete' ELSE 'incomplete' END AS status FROM r GROUP BY agent""")
def design_validation(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("agent"), (1 + F.floor(F.col("doc_id") / 20) % 8).cast("int").alias("run")).distinct()
    missing = F.array_except(F.sequence(F.lit(1), F.lit(8)), F.collect_set("run"))
    return rows.groupBy("agent").agg(F.count("*").alias("runs_detected"), F.array_join(missing.cast("array<string>"), ",").alias("missing_runs"), F.when(F.count("*") == 8, "complete").otherwise("incomplete").alias("status"))


@query(r"""SELECT conv_id, count(*) AS turns, md5(string_agg('[' || role || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS transcript_md5 FROM conversations GROUP BY conv_id""")
def transcripts(spark, sf):
    line = F.struct("turn", F.concat(F.lit("["), "role", F.lit("] "), "text").alias("line"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("conv_id", "turns", F.md5(F.array_join(F.transform("lines", lambda x: x.line), "\n\n")).alias("transcript_md5"))


# Vectors: labels are agents, vec_id mod 8 is the run.
VEC = """cent AS (SELECT label AS agent, d, avg(x) AS x FROM (SELECT label, unnest(generate_series(1, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
runv AS (SELECT label AS agent, vec_id % 8 AS run, d, avg(x) AS x FROM (SELECT label, vec_id, unnest(generate_series(1, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
sims AS (SELECT a.agent AS agent_a, a.run AS run_a, b.agent AS agent_b, b.run AS run_b, sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) AS s
  FROM runv a JOIN runv b ON a.d = b.d AND (a.agent, a.run) < (b.agent, b.run) GROUP BY ALL)"""


def run_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("agent"), (F.col("vec_id") % 8).alias("run"), "embedding")
    return T.mean_vector(rows, ["agent", "run"], "embedding")


def run_similarities(spark: SparkSession, sf: str) -> DataFrame:
    runs = run_vectors(spark, sf)
    a, b = (runs.select(*(F.col(c).alias(f"{c}_{x}") for c in runs.columns)) for x in "ab")
    return a.join(b, F.struct("agent_a", "run_a") < F.struct("agent_b", "run_b")).select("agent_a", "run_a", "agent_b", "run_b", T.cosine("embedding_a", "embedding_b").alias("s"))


@query(f"WITH {VEC} SELECT agent, CAST(d AS INTEGER) AS d, round_even(x, 9) AS x FROM cent")
def agent_centroids(spark, sf):
    rows = T.mean_vector(table(spark, sf, "embeddings").select(F.col("label").alias("agent"), "embedding"), ["agent"], "embedding")
    return rows.select("agent", F.posexplode("embedding").alias("d", "x")).select("agent", (F.col("d") + 1).alias("d"), F.bround("x", 9).alias("x"))


@query(f"WITH {VEC} SELECT agent_a, run_a, agent_b, run_b, round_even(s, 8) AS cosine_sim FROM sims")
def pairwise_cosine(spark, sf):
    return run_similarities(spark, sf).withColumn("cosine_sim", F.bround("s", 8)).drop("s")


@query(f"""WITH {VEC} SELECT agent_a AS agent, count(*) AS n_pairs, round_even(avg(s), 6) AS mean_sim, round_even(coalesce(stddev_samp(s), 0), 6) AS sd_sim, round_even(min(s), 6) AS min_sim, round_even(max(s), 6) AS max_sim,
 round_even(greatest(0, 1 - coalesce(stddev_samp(s), 0) / abs(avg(s))), 5) AS reproducibility FROM sims WHERE agent_a = agent_b GROUP BY agent_a""")
def within_reproducibility(spark, sf):
    sd = F.coalesce(F.stddev_samp("s"), F.lit(0.0))
    rows = run_similarities(spark, sf).filter("agent_a = agent_b").groupBy(F.col("agent_a").alias("agent"))
    return rows.agg(F.count("*").alias("n_pairs"), F.bround(F.avg("s"), 6).alias("mean_sim"), F.bround(sd, 6).alias("sd_sim"), F.bround(F.min("s"), 6).alias("min_sim"), F.bround(F.max("s"), 6).alias("max_sim"), F.bround(F.greatest(F.lit(0.0), 1 - F.try_divide(sd, F.abs(F.avg("s")))), 5).alias("reproducibility"))


@query(f"""WITH {VEC}, c AS (SELECT a.agent AS agent_a, b.agent AS agent_b, sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) AS centroid FROM cent a JOIN cent b ON a.d = b.d AND a.agent < b.agent GROUP BY ALL)
SELECT c.agent_a, c.agent_b, round_even(any_value(centroid), 8) AS centroid_cosine, round_even(avg(s), 8) AS mean_cross_cosine FROM c JOIN sims ON c.agent_a = sims.agent_a AND c.agent_b = sims.agent_b GROUP BY ALL""")
def between_similarity(spark, sf):
    cent = T.mean_vector(table(spark, sf, "embeddings").select(F.col("label").alias("agent"), "embedding"), ["agent"], "embedding")
    a, b = (cent.select(F.col("agent").alias(f"agent_{x}"), F.col("embedding").alias(f"e_{x}")) for x in "ab")
    between = a.join(b, F.col("agent_a") < F.col("agent_b")).select("agent_a", "agent_b", F.bround(T.cosine("e_a", "e_b"), 8).alias("centroid_cosine"))
    cross = run_similarities(spark, sf).filter("agent_a < agent_b").groupBy("agent_a", "agent_b").agg(F.bround(F.avg("s"), 8).alias("mean_cross_cosine"))
    return between.join(cross, ["agent_a", "agent_b"])


@query(f"""WITH {VEC} SELECT e.agent, round_even(avg(dist), 7) AS compactness, count(*) AS n FROM (SELECT v.agent, v.vec_id, sqrt(sum((v.x - c.x) * (v.x - c.x))) AS dist
  FROM (SELECT label AS agent, vec_id, unnest(generate_series(1, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) v JOIN cent c ON v.agent = c.agent AND v.d = c.d GROUP BY ALL) e GROUP BY e.agent""")
def centroid_compactness(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("agent"), "embedding")
    cent = T.mean_vector(rows, ["agent"], "embedding").withColumnRenamed("embedding", "c")
    far = F.sqrt(F.aggregate(F.zip_with("embedding", "c", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))
    return rows.join(cent, "agent").groupBy("agent").agg(F.bround(F.avg(far), 7).alias("compactness"), F.count("*").alias("n"))
