"""Every registered query of the library against its SQL twin on DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from sparvane.plans import answers, audit, catalogue, consensus, embeddings, errors, matrix, montecarlo, reductions, report, resampling, shapes, trees  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "None"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return repr(round(float(x), 3) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_its_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    wanted = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = lambda d: sorted(tuple(map(plain, r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(wanted)
