"""Path and name rules on literal fixtures that meet every one of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparvane.operators import names as N
from sparvane.plans import trees
from sparvane.sources import ingest

KNOWN = [("Glycine, serine and threonine metabolism", "L-Serine"), ("Glycine, serine and threonine metabolism", "Glycine"), ("Taurine metabolism", "Taurine"), ("Carnitine shuttle", "Carnitine"), ("Carnitine shuttle", "Acetylcarnitine"), ("Purine metabolism", "Hypoxanthine"), ("Purine metabolism", "Uric acid"), ("TCA cycle", "Citrate"), ("Short", "Urea")]
NAMES = ["L-Serine", "serine", "D-Serine", "DL-Serine_(principal)", "Glycine (qualifier)", "taurine#1", "Carnitine-d3", "octanoylcarnitine", "PC(34:1)", "SM 18:0", "Ceramide d18:1", "LysoPC 16:0", "Hypoxanthine pool", "uric  acid", "acid", "citr", "urea", "x-urea", "unknown", "  TAURINE ", "CL(72:8) with ceramide", "", "a", "é"]


def test_every_path_rule(spark):
    grid = spark.range(1)
    for name, values in (("a", trees.TOPS), ("b", trees.MIDDLES), ("c", trees.DEEP), ("n", trees.NAMES)):
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    below = F.array_join(F.filter(F.array("a", "b", "c", "n"), lambda x: x != ""), "/")
    files = grid.select(F.concat(F.lit("/in/"), below).alias("path"), F.length(below).cast("bigint").alias("length")).distinct()
    got = ingest.inventory(files, "/in").withColumn("path", F.substr("path", F.lit(5))).select("agent", "run", "path", "filename", "extension", "file_type", "size_bytes")
    unnested = ", ".join(f"(SELECT unnest({trees._list(v)}) AS {n})" for n, v in (("a", trees.TOPS), ("b", trees.MIDDLES), ("c", trees.DEEP), ("n", trees.NAMES)))
    wanted = duckdb.sql(f"WITH grid AS (SELECT *, length(array_to_string(list_filter([a, b, c, n], lambda x: x <> ''), '/')) AS size FROM {unnested}), {trees.RULES} SELECT agent, run, path, filename, extension, file_type, size_bytes FROM inv").fetchall()
    assert len(wanted) > 6_000 and sorted(map(tuple, got.collect())) == sorted(wanted)


def test_every_name_rule(spark):
    forms = dict(spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", N.normal_form(F.col("name"))).collect())
    keys = dict(spark.createDataFrame([(m,) for _, m in KNOWN], "name string").select("name", N.normal_form(F.col("name"))).collect())
    bare = lambda x: x[2:] if x[:2] in ("l-", "d-") else x
    wanted = {}
    for name, form in forms.items():
        lipid = {p for p, parts in N.LIPIDS.items() if any(x in form for x in parts)}
        known = {(p, k) for p, m in KNOWN for k in (keys[m], bare(keys[m]))}
        equal = {p for p, k in known if k in (form, bare(form))}
        wanted[name] = lipid or equal or {p for p, k in known if len(k) >= 5 and (k in form or form in k)}
    rows = N.annotate(spark.createDataFrame([(n,) for n in NAMES], "name string"), spark.createDataFrame(KNOWN, "pathway string, metabolite string")).collect()
    assert {r["name"]: (r["pathways"], r["n_pathways"], r["mapped"]) for r in rows} == {n: ("; ".join(sorted(p)), len(p), bool(p)) for n, p in wanted.items()}
    assert forms["DL-Serine_(principal)"] == "serine" and forms["  TAURINE "] == "taurine" and wanted["octanoylcarnitine"] == {"Carnitine shuttle"}


def test_names_are_joined_by_equality(spark):
    names, members = spark.createDataFrame([("a",)], "name string"), spark.createDataFrame(KNOWN, "pathway string, metabolite string")
    plan = N.pathways_of(names, members)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("rows", [[], [("n", None)]])
def test_no_known_names(spark, rows):
    out = N.annotate(spark.createDataFrame([("x",), ("PC(1)",)], "name string"), spark.createDataFrame(rows, "pathway string, metabolite string")).collect()
    assert {r["name"]: r["mapped"] for r in out} == {"x": False, "PC(1)": True}
