"""Numbers in report texts, as the SQL prints them."""

import duckdb

from sparvane.operators import answers as A


def test_small_negative_numbers_keep_their_sign(spark):
    values = [-0.004, -0.0049, 0.004, 0.0, -0.02, -1.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(A.fixed("v")).collect()]
    assert got == [duckdb.connect().execute(f"select printf('%.2f', round_even({v}::double, 2))").fetchone()[0] for v in values]
