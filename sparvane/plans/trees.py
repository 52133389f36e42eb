"""Registered queries: which files of a tree count and where they belong, with documents as the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.plans.catalogue import query, table
from sparvane.sources import ingest, paths

TOPS = ["", "ChatGPT", "k-dense", "my_Biomni_x", "MyAgent", "tables", "run_3", "RUN-12", "Figures", "$RECYCLE.BIN", "__MACOSX_a", "FICH", "r2d2"]
MIDDLES = ["", "run_1", "Run-2", "r3", "x", "7", "tables", "System Volume Information"]
DEEP = ["", "finch notes", "deep 12"]
NAMES = ["notes.txt", "run_9.md", "chatgpt_run_4.csv", ".hidden", ".DS_Store", "Thumbs.db", "desktop.ini", "~$a.xlsx", "noext", "results.xlsx.md", "finch7.html", "a.b.unknown", "run99999999999.txt"] + sorted({f"f{x}" for kind in paths.KINDS.values() for x in kind.split()})


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# The paths of a tree are made of documents: their producer or one of TOPS, folders and names by their number.
GRID = f"""grid AS (SELECT CASE WHEN doc_id % 4 = 3 THEN source ELSE ({_list(TOPS)})[1 + doc_id % {len(TOPS)}] END AS a, ({_list(MIDDLES)})[1 + (doc_id // 2) % {len(MIDDLES)}] AS b, ({_list(DEEP)})[1 + (doc_id // 5) % {len(DEEP)}] AS c,
  CASE WHEN doc_id % 3 = 2 THEN lang || '_r' || doc_id || '.' || lang ELSE ({_list(NAMES)})[1 + (doc_id // 3) % {len(NAMES)}] END AS n, coalesce(length(text), 0) AS size FROM documents)"""
# What SQL states of the rules is its own, so that a wrong constant of the library shows.
_ALIAS = """CASE WHEN contains(lower(s), 'k-dense') OR contains(lower(s), 'k_dense') OR contains(lower(s), 'kdense') THEN 'KDense' WHEN contains(lower(s), 'chatgpt') THEN 'ChatGPT' WHEN contains(lower(s), 'biomni') THEN 'Biomni' WHEN contains(lower(s), 'finch') OR contains(lower(s), 'fich') THEN 'Finch' END"""
_RUN = r"TRY_CAST(coalesce(nullif(regexp_extract(lower(s), 'run[_\-\s]*(\d+)', 1), ''), nullif(regexp_extract(lower(s), 'r(\d+)', 1), ''), nullif(regexp_extract(lower(s), '(\d+)', 1), '')) AS INTEGER)"
_KIND = """CASE WHEN extension IN ('.png', '.jpg', '.jpeg', '.gif', '.svg', '.tiff', '.bmp') THEN 'image' WHEN extension IN ('.csv', '.tsv', '.scv', '.xlsx', '.xls', '.xlsm') THEN 'table' WHEN extension IN ('.pdf', '.docx', '.doc') THEN 'document'
 WHEN extension IN ('.py', '.r', '.rmd', '.ipynb', '.sh', '.bash') THEN 'code' WHEN extension IN ('.txt', '.md', '.json', '.jsonl', '.html', '.htm', '.xml', '.log', '.tex', '.bib', '.bbl', '.blg', '.aux', '.sty', '.toc', '.out', '.toml') THEN 'text' ELSE 'other' END"""
RULES = f"""paths AS (SELECT array_to_string(list_filter([a, b, c, n], lambda x: x <> ''), '/') AS path, n, list_filter([a, b, c], lambda x: x <> '') AS f, max(size) AS size FROM grid GROUP BY ALL),
names AS (SELECT s, {_ALIAS} AS alias, {_RUN} AS run,
  CASE WHEN lower(s) IN ('tables', 'figures', 'report', 'raw_archives', 'benchmark_results') THEN NULL ELSE coalesce({_ALIAS}, CASE WHEN NOT regexp_full_match(lower(s), 'run[_\\-\\s]*\\d+') THEN s END) END AS top,
  lower(s) IN ('__macosx', '$recycle.bin', 'system volume information') OR starts_with(lower(s), '__macosx') AS gone FROM (SELECT DISTINCT unnest([a, b, c, n]) AS s FROM grid) WHERE s <> ''),
found AS (SELECT path, n AS filename, size, coalesce(p0.top, nm.alias, p0.alias, p1.alias, p2.alias) AS agent, coalesce(p1.run, p0.run, nm.run, p2.run) AS run,
  coalesce(p0.gone, false) OR coalesce(p1.gone, false) OR coalesce(p2.gone, false) OR lower(n) IN ('.ds_store', 'thumbs.db', 'desktop.ini') OR starts_with(n, '~$') OR starts_with(n, '.') AS gone,
  lower(regexp_extract(n, '^.+(\\.[^.]+)$', 1)) AS extension
  FROM paths LEFT JOIN names nm ON nm.s = n LEFT JOIN names p0 ON p0.s = f[1] LEFT JOIN names p1 ON p1.s = f[2] LEFT JOIN names p2 ON p2.s = f[3]),
inv AS (SELECT agent, run, path, filename, extension, {_KIND} AS file_type, CAST(size AS BIGINT) AS size_bytes FROM found WHERE NOT gone AND agent IS NOT NULL AND run IS NOT NULL)"""
TREE = GRID + ", " + RULES


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """``path, length`` of the files below the root ``/in`` that documents stand for; of those with one path the longest."""
    pick = lambda values, number: F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))
    i = F.col("doc_id")
    name = F.when(i % 3 == 2, F.concat("lang", F.lit("_r"), i, F.lit("."), "lang")).otherwise(pick(NAMES, F.floor(i / 3)))
    below = F.array(F.when(i % 4 == 3, F.col("source")).otherwise(pick(TOPS, i)), pick(MIDDLES, F.floor(i / 2)), pick(DEEP, F.floor(i / 5)), name)
    rows = table(spark, sf, "documents").select(F.concat(F.lit("/in/"), F.array_join(F.filter(below, lambda x: x != ""), "/")).alias("path"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return rows.groupBy("path").agg(F.max("n").cast("bigint").alias("length"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.inventory(tree(spark, sf), "/in")
    return rows.withColumn("path", F.substr("path", F.lit(5)))


@query(f"WITH {TREE} SELECT * FROM inv")
def tree_inventory(spark, sf):
    """Every file that counts with its producer, run, extension and kind, in the inventory's order."""
    return records(spark, sf).orderBy("agent", "run", "filename", "path")


@query(f"""WITH {TREE} SELECT agent, run, count(*) AS n_files, md5(string_agg(filename || ':' || path, ',' ORDER BY filename, path)) AS records_md5 FROM inv GROUP BY agent, run""")
def tree_groups(spark, sf):
    listed = F.transform("records", lambda r: F.concat(r["filename"], F.lit(":"), r["path"]))
    return ingest.grouped(records(spark, sf)).select("agent", "run", "n_files", F.md5(F.array_join(listed, ",")).alias("records_md5"))


@query(f"""WITH {TREE}, n AS (SELECT agent, run, file_type, count(*) AS n FROM inv GROUP BY ALL) SELECT agent, run, file_type, n FROM n""")
def tree_file_counts(spark, sf):
    return records(spark, sf).groupBy("agent", "run", "file_type").agg(F.count("*").alias("n"))


# Files of one name in several folders share an id: the last text in path order stands for all, yet each counts (quirk Q2).
@query(f"""WITH {TREE}, m AS (SELECT *, agent || '__run' || run || '__' || filename AS file_id FROM inv), f AS (SELECT file_id, max_by(size_bytes, path) AS n_chars FROM m WHERE extension <> '.png' GROUP BY file_id)
SELECT agent, run, count(*) AS n_files, count(n_chars) AS n_parsed, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars FROM m LEFT JOIN f ON m.file_id = f.file_id GROUP BY agent, run""")
def metadata_with_features(spark, sf):
    """Inventory rows left-joined with their files' features by file id."""
    meta = records(spark, sf).withColumn("file_id", F.concat(F.col("agent"), F.lit("__run"), F.col("run"), F.lit("__"), F.col("filename")))
    parsed = meta.filter("extension <> '.png'").groupBy("file_id").agg(F.max_by("size_bytes", "path").alias("n_chars"))
    return meta.join(parsed, "file_id", "left").groupBy("agent", "run").agg(F.count("*").alias("n_files"), F.count("n_chars").alias("n_parsed"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))
