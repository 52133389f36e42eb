"""Result folders: what is written is there as a whole or not at all."""

import json

import pytest
from pyspark.sql import functions as F

from sparvane.sources import results


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_tables_come_back_as_they_were(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else f'a "quoted", text\nline {i}', i / 3) for i in range(500)]
    table = spark.createDataFrame(rows, "i int, t string, x double").repartition(5)
    folder = f"file://{tmp_path}/out"
    assert results.write_table(table, folder, "t")
    manifest = results.read_manifest(folder, "t")
    assert manifest["rows"] == 500 and len(manifest["files"]) == 5
    got = results.read_table(spark, folder, "t", table.schema)
    assert sorted(map(tuple, got.collect())) == sorted(rows, key=lambda r: r[0])
    assert results.write_table(table.filter("i < 10"), folder, "t") and results.read_table(spark, folder, "t", table.schema).count() == 10
    assert not any(f.startswith("_staging") for f in files(tmp_path / "out")) and len(results.read_manifest(folder, "t")["files"]) == len([f for f in files(tmp_path / "out") if f.endswith(".csv")])
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name != "_staging") == ["figures", "report", "tables"]


def test_empty_tables_leave_none(spark, tmp_path):
    table, folder = spark.range(3), f"file://{tmp_path}/out"
    assert results.write_table(table, folder, "t") and not results.write_table(table.limit(0), folder, "t")
    assert results.read_manifest(folder, "t") is None and results.read_table(spark, folder, "t", "id long").count() == 0 and not files(tmp_path / "out")


def test_a_failed_task_leaves_the_table_before(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    results.write_table(spark.range(4), folder, "t")
    before = files(tmp_path / "out")
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        results.write_table(broken, folder, "t")
    assert files(tmp_path / "out") == before and results.read_table(spark, folder, "t", "id long").count() == 4


def test_nested_columns_and_the_summary(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    table = spark.createDataFrame([(1, [1, 2], {"a": 1}, b"xy")], "i int, l array<int>, m map<string,int>, b binary")
    results.write_table(table, folder, "nested")
    row = results.read_table(spark, folder, "nested", "i int, l string, m string, b string").first()
    assert (row["l"], row["m"], row["b"]) == ("[1,2]", '{"a":1}', "eHk=")
    results.write_summary(folder, {"study": "é", "n": 3})
    assert json.loads((tmp_path / "out/report/run_summary.json").read_text()) == {"study": "é", "n": 3, "tables": {"nested": 1}}
