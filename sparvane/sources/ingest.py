"""Reads a tree ``<producer>/<run>/<file>`` into one row per file with its text, and the tables beside it.

Paths decide which files count and where they belong (:mod:`sparvane.sources.paths`);
contents become texts by column expressions (:mod:`sparvane.sources.texts`) and, where a
format needs one, by a parser (:mod:`sparvane.sources.formats`).  Spark's listing
leaves out names that begin with an underscore.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.sources import paths
from sparvane.sources.formats import READERS, parse
from sparvane.sources.texts import text_of


def inventory(files: DataFrame, root: str) -> DataFrame:
    """``agent, run, path, filename, extension, file_type, size_bytes`` from ``path`` and ``length``; files without producer or run are left out."""
    where = re.sub("^file:/*", "/", root).rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(where) + "/+", "")
    rows = files.withColumn("__below", relative).filter(~paths.ignored(F.col("__below")))
    below = F.col("__below")
    out = rows.select(
        paths.agent_of(below).alias("agent"), paths.run_number(below).alias("run"), "path", paths.filename(below).alias("filename"), paths.extension(below).alias("extension"),
        paths.file_type_of(below).alias("file_type"), F.col("length").alias("size_bytes"), *[c for c in files.columns if c == "content"],
    )
    return out.filter("agent is not null and run is not null")


def grouped(records: DataFrame) -> DataFrame:
    """Per producer and run its records by file name (a run's files are few)."""
    record = F.struct("filename", "path", "file_type", "size_bytes")
    return records.groupBy("agent", "run").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(record)).alias("records"))


def _with_empty(files: DataFrame) -> DataFrame:
    """A scan with the files of no content, which scans leave out, from the listing that the driver has made for it."""
    bare = F.regexp_replace("path", "^file:/*", "/")
    listed = files.sparkSession.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").withColumn("__bare", bare)
    empty = listed.join(files.select(bare.alias("__bare")), "__bare", "left_anti")
    found = files.select("path", "length", "content")
    return found.unionByName(empty.select("path", F.lit(0).cast("bigint").alias("length"), F.lit(b"").alias("content")))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """The inventory of a tree with ``file_id`` (which leaves out folders below the run) and ``text``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = inventory(_with_empty(files), root).withColumn("file_id", F.concat_ws("__", "agent", F.concat(F.lit("run"), "run"), "filename"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["parsed"] = [parse(e, n, bytes(c)) if e in READERS else None for e, n, c in zip(batch["extension"], batch["filename"], batch["content"])]
            yield batch

    parsed = rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", parsed string")
    text = text_of(F.col("filename"), F.col("extension"), F.col("content"), F.col("parsed"), list(READERS))
    return parsed.withColumn("text", text).drop("content", "parsed")


TRUE_WORDS = ("1", "true", "yes", "y", "t")
FLAGS = ("interactive_mode", "asked_additional_questions", "requested_metadata", "additional_metadata_provided")


def _csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file with its header and all cells as text; None where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def manual_scores(spark: SparkSession, path: str) -> DataFrame | None:
    """``agent, run, R, P, D`` of a CSV file of scores given by hand; None without the file or one of these columns."""
    table = _csv(spark, path)
    if table is None or not {"agent", "run", "R", "P", "D"} <= set(table.columns):
        return None
    return table.select(F.trim("agent").alias("agent"), F.col("run").try_cast("int").alias("run"), *(F.col(c).try_cast("double").alias(c) for c in "RPD"))


def truth(flag: Column) -> Column:
    return F.coalesce(F.lower(F.trim(flag.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def run_registry(spark: SparkSession, path: str) -> DataFrame | None:
    """``agent, run``, the flags (false where the column is absent or says nothing) and ``notes``; None without the file or its keys."""
    table = _csv(spark, path)
    if table is None or not {"agent", "run"} <= set(table.columns):
        return None
    flags = [(truth(F.col(c)) if c in table.columns else F.lit(False)).alias(c) for c in FLAGS]
    notes = F.coalesce(F.col("notes"), F.lit("")) if "notes" in table.columns else F.lit("")
    return table.select(F.trim("agent").alias("agent"), F.col("run").try_cast("int").alias("run"), *flags, notes.alias("notes"))


def intensities(spark: SparkSession, path: str, feature: str = "Molecule", control: str = "Contr", case: str = "Fibr", quality: str = "QC") -> DataFrame:
    """``feature, sample, grp, pair, v`` in long form from a wide table of features by samples.

    Samples are told by their names: ``quality`` anywhere is a quality control, else a name
    that begins with ``control`` or ``case``; others are left out.  ``pair`` is the number
    at a name's end.  Features named "nan" are dropped, a name that comes again gets ``#k``
    in the file's order; cells that are no numbers are null.
    """
    wide = _csv(spark, path)
    if wide is None or feature not in wide.columns:
        raise ValueError(f"{path} has no column {feature}")
    samples = [c for c in wide.columns if c != feature]
    cells = F.array(*(F.struct(F.lit(c).alias("sample"), F.col(f"`{c}`").try_cast("double").alias("v")) for c in samples))
    named = wide.withColumn("__row", F.monotonically_increasing_id()).withColumn("__name", F.trim(F.col(f"`{feature}`")))
    named = named.filter(F.col("__name").isNotNull() & (F.lower("__name") != "nan"))
    again = F.row_number().over(Window.partitionBy("__name").orderBy("__row")) - 1
    unique = named.withColumn("feature", F.when(again == 0, F.col("__name")).otherwise(F.concat("__name", F.lit("#"), again)))
    name = F.col("sample")
    group = F.when(name.contains(quality), "qc").when(name.startswith(control), "control").when(name.startswith(case), "case")
    pair = F.nullif(F.regexp_extract(name, r"(\d+)\s*$", 1), F.lit("")).try_cast("int")
    return unique.select("feature", F.inline(cells)).select("feature", "sample", group.alias("grp"), pair.alias("pair"), F.when(~F.isnan("v"), F.col("v")).alias("v")).filter("grp is not null")
