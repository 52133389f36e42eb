"""Registered queries: text vectors, their pooling, and reductions of run vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.operators import embedding as E
from sparvane.operators import matrix as M
from sparvane.operators import vectors as V
from sparvane.operators.settled import fresh_folder, settled
from sparvane.plans import catalogue as C
from sparvane.plans import matrix as X
from sparvane.plans.catalogue import query, table

TFIDF = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '{V.WORD}') AS w FROM documents),
t AS (SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), top AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT {V.TERMS}), n AS (SELECT count(*) AS n FROM documents),
x AS (SELECT doc_id, c.term, (1 + ln(tf)) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM c JOIN top ON c.term = top.term, n),
u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x)"""


def _sum(values: str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


@query(f"WITH {TFIDF} SELECT doc_id, count(*) AS n_terms, round_even(max(w), 6) AS largest, arg_max(term, (round(w, 9), term)) AS top_term, round_even(sum(w), 5) AS total FROM u GROUP BY doc_id")
def tfidf_weights(spark, sf):
    """Per document its terms among the most frequent, their largest and their summed weight."""
    rows, names = V.sparse_tfidf(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"))
    best = F.array_max(F.zip_with("w", "at", lambda w, at: F.struct(F.round(w, 9).alias("w"), at.alias("at"))))["at"]  # terms are numbered by name
    found = rows.select(F.col("id").alias("doc_id"), F.size("at").cast("bigint").alias("n_terms"), F.bround(F.array_max("w"), 6).alias("largest"), best.alias("at"), F.bround(_sum("w"), 5).alias("total"))
    return found.join(V.named(names, spark), "at").select("doc_id", "n_terms", "largest", F.col("term").alias("top_term"), "total")


# Chunks are vectors, 24 files a producer, file modulo 8 is the run.
_POOL = """c AS (SELECT label AS agent, vec_id % 24 AS file, unnest(generate_series(1, 64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), f AS (SELECT agent, file, d, avg(x) AS x FROM c GROUP BY ALL),
r AS (SELECT agent, file % 8 AS run, d, avg(x) AS x FROM f GROUP BY ALL), a AS (SELECT agent, d, avg(x) AS x FROM r GROUP BY ALL)"""


@query(f"WITH {_POOL} SELECT agent, CAST(d AS INTEGER) AS d, round_even(x, 9) AS x FROM a")
def pooled_centroids(spark, sf):
    """Chunks to files to runs to producers, unweighted at each level."""
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("agent"), (F.col("vec_id") % 24).alias("file"), (F.col("vec_id") % 8).alias("run"), "embedding")
    means = V.pooled(rows, [["agent", "run", "file"], ["agent", "run"], ["agent"]])
    return means.select("agent", F.posexplode("embedding").alias("d", "x")).select("agent", (F.col("d") + 1).alias("d"), F.bround("x", 9).alias("x"))


def embedded_runs(spark: SparkSession, sf: str, components: int = V.COMPONENTS) -> DataFrame:
    """``agent, run, embedding`` from texts: terms, components, means over files and runs."""
    files = C.corpus(spark, sf)
    rows, names = V.sparse_tfidf(files.select(F.struct("file_id", "agent", "run").alias("id"), "text"))
    rows = settled(rows)  # read in each round of the fit
    vectors = V.embed(rows, V.fit_components(rows, len(names), components)).select("id.*", "embedding")
    return V.pooled(vectors, [["agent", "run"]])


@query(None)
def text_run_similarity(spark, sf):
    """Cosines of runs by their texts' reduced TF-IDF vectors (no SQL twin: a singular value decomposition; the tests hold it against an exact one)."""
    from sparvane.operators.stats import cosine

    runs = embedded_runs(spark, sf)
    a, b = (runs.select(*(F.col(c).alias(f"{c}_{x}") for c in runs.columns)) for x in "ab")
    return a.join(b, F.struct("agent_a", "run_a") < F.struct("agent_b", "run_b")).select("agent_a", "run_a", "agent_b", "run_b", F.bround(cosine("embedding_a", "embedding_b"), 6).alias("cosine_sim"))


@query(None)
def run_principal_components(spark, sf):
    """Three principal components of standardised run vectors with their explained shares (no SQL twin; see the tests)."""
    return V.run_components(C.run_vectors(spark, sf), "embedding")


@query(None)
def discriminant_importance(spark, sf):
    """Importance of features in a partial least squares fit of case against control, with R2 and leave-one-out Q2 (no SQL twin; see the tests)."""
    scaled = M.scale(X.normalised(spark, sf).withColumn("v", M.log("v", "log2")), "pareto")
    return V.discriminate(scaled).orderBy(F.desc("vip"))


# Chunks of 800 words of all documents fit the model; benchmark items are texts that come later.
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
CHUNKS = f"""cw AS (SELECT doc_id, {_WORDS} AS w FROM documents), ck AS (SELECT doc_id, w, unnest(generate_series(0, greatest(CAST(ceil((len(w) - 800) / 650.0::DOUBLE) AS BIGINT), 0))) AS k FROM cw WHERE len(w) > 0),
ch AS (SELECT doc_id || '/' || k AS id, array_to_string(w[k * 650 + 1 : k * 650 + 800], ' ') AS text FROM ck)"""


def _terms_sql(name: str, source: str) -> str:
    words = f"SELECT id, regexp_extract_all(lower(text), '{V.WORD}') AS w FROM {source}"
    pairs = "SELECT id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term"
    return f"{name} AS (SELECT id, term, count(*) AS tf FROM ({pairs} FROM ({words})) GROUP BY ALL)"


_MODEL = f"""{CHUNKS}, {_terms_sql('c', 'ch')}, top AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT {V.TERMS}), n AS (SELECT count(*) AS n FROM ch),
model AS (SELECT term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM top, n)"""


def _scored_sql(counts: str) -> str:
    weights = f"SELECT id, {counts}.term, (1 + ln(tf)) * idf AS w FROM {counts} JOIN model ON {counts}.term = model.term"
    return f"SELECT id, count(term) AS n_terms, coalesce(round_even(max(w), 6), 0) AS largest, coalesce(round_even(sum(w), 5), 0) AS total FROM ids LEFT JOIN (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM ({weights})) USING (id) GROUP BY id"


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``id, text, agent, run, doc_id`` of all documents' chunks."""
    files = table(spark, sf, "documents").select("doc_id", F.col("source").alias("agent"), (1 + F.floor(F.col("doc_id") / 20) % 8).cast("int").alias("run"), "text")
    return E.chunked(files, F.col("text")).select(F.concat_ws("/", "doc_id", "chunk").alias("id"), F.col("chunk_text").alias("text"), "agent", "run", "doc_id")


def chunk_model(spark: SparkSession, sf: str, components: int = V.COMPONENTS) -> E.TermModel:
    return E.fitted(chunk_rows(spark, sf).select("id", "text"), fresh_folder(spark, "terms"), components=components)


def _scored(model: E.TermModel, texts: DataFrame) -> DataFrame:
    largest = F.coalesce(F.bround(F.array_max("w"), 6), F.lit(0.0))
    return model.sparse(texts).select("id", F.size("at").cast("bigint").alias("n_terms"), largest.alias("largest"), F.bround(_sum("w"), 5).alias("total"))


@query(f"WITH {_MODEL}, ids AS (SELECT id FROM ch) {_scored_sql('c')}")
def chunk_weights(spark, sf):
    """What a model that is fitted on all chunks finds in each of them; chunks without its terms stay, with zeros."""
    return _scored(chunk_model(spark, sf, 0), chunk_rows(spark, sf).select("id", "text"))


@query(f"WITH {_MODEL}, b AS (SELECT item_id AS id, text FROM benchmark), {_terms_sql('cb', 'b')}, ids AS (SELECT id FROM b) {_scored_sql('cb')}")
def reused_weights(spark, sf):
    """What the model of the documents' chunks, written and loaded again, finds in texts that it has not seen."""
    model = E.TermModel.load(spark, chunk_model(spark, sf, 0).folder)
    return _scored(model, table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"))


@query(None)
def chunk_agent_similarity(spark, sf):
    """Cosines of producers by their chunks' embeddings, pooled to files, runs and producers (no SQL twin: a decomposition; see the tests)."""
    from sparvane.operators.stats import cosine

    chunks = chunk_rows(spark, sf)
    vectors = chunk_model(spark, sf).encode(chunks.select(F.struct("id", "agent", "run", "doc_id").alias("id"), "text")).select("id.*", "embedding")
    agents = V.pooled(V.mean_of_few(vectors, ["agent", "run", "doc_id"]), [["agent", "run"], ["agent"]])
    a, b = (agents.select(*(F.col(c).alias(f"{c}_{x}") for c in agents.columns)) for x in "ab")
    return a.join(b, F.col("agent_a") < F.col("agent_b")).select("agent_a", "agent_b", F.bround(cosine("embedding_a", "embedding_b"), 6).alias("cosine_sim"))
