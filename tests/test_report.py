"""Themes, boxes and summaries on small tables."""

import numpy as np

from sparvane.operators import report


def test_themes(spark):
    enrichment = spark.createDataFrame([("P1", 5, 0.001, 0.01), ("P2", 3, 0.09, 0.4), ("P3", 2, 0.09, 0.4), ("P4", 9, 0.1, 0.4), ("P5", 1, None, None)], "pathway string, hits long, p double, q double")
    hits = spark.createDataFrame([("ATP", -1.0), ("ADP", 2.0), ("Taurine pool", None), (None, 1.0)], "metabolite string, log2fc double")
    rules = [("a", "pathway", "P1"), ("a", "pathway", "P2"), ("b", "pathway", "P3"), ("c", "pathway", "P4"), ("c", "metabolite", "taurine"), ("d", "falls", "atp"), ("d", "falls", "adp"), ("e", "falls", "adp"), ("f", "pathway", "P5"), ("g", "pathway", "P1"), ("g", "falls", "adp")]
    got = {r["theme"]: (r["n_enriched"], r["n_strong"], r["n_direct"], r["fallen"], r["fires"]) for r in report.themes(enrichment, hits, spark.createDataFrame(rules, "theme string, kind string, name string")).collect()}
    assert got == {"a": (1, 2, 0, "", True), "b": (0, 0, 0, "", False), "c": (0, 0, 1, "", True), "d": (0, 0, 2, "ATP", True), "e": (0, 0, 1, "", False), "f": (0, 0, 0, "", False), "g": (1, 1, 1, "", False)}


def test_boxes(spark):
    rng = np.random.default_rng(4)
    groups = {"a": [*rng.normal(size=30), 9.0, -8.0], "b": [1.0], "c": [2.0] * 5, "d": [0.0, 0.0, 0.0, 0.0, 5.0]}
    frame = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("a", None)], "agent string, s double")
    rows = {r["agent"]: r for r in report.boxes(frame, "agent", "s").collect()}
    out = sorted((r["agent"], r["s"]) for r in report.box_outliers(frame, "agent", "s").collect())
    wanted = []
    for k, v in groups.items():
        x = np.array(v, float)
        q1, q3 = np.percentile(x, [25, 75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        wanted += [(k, float(y)) for y in x if y < low or y > high]
        assert np.allclose([rows[k][c] for c in ("q1", "median", "q3", "whisker_lo", "whisker_hi", "n", "n_outliers")], [q1, np.median(x), q3, min(x[x >= low].min(), q1), max(x[x <= high].max(), q3), len(x), ((x < low) | (x > high)).sum()])
    assert out == sorted(wanted) and len(out) >= 3


def test_agent_summary(spark):
    runs = spark.createDataFrame([("a", 1, "proxy", 3.0), ("a", 2, "manual", 5.0), ("b", 1, "proxy", 4.0), ("c", 1, "manual", 9.0)], "agent string, run int, score_type string, score double")
    means = spark.createDataFrame([("a", 4.5), ("a", 4.6), ("b", 4.0), ("c", 9.0)], "agent string, m double")
    rows = {r["agent"]: r for r in report.agent_summary(runs, "score", means).collect()}
    assert [rows[a]["rank"] for a in "abc"] == [2, 2, 1] and [rows[a]["score_type"] for a in "abc"] == ["manual", "proxy", "manual"]
    assert rows["a"]["err_lo"] == 0 and round(rows["a"]["err_hi"], 3) == 0.597 or rows["a"]["err_hi"] > 0
    assert rows["b"]["sd_score"] == 0 and rows["a"]["sem_score"] == rows["a"]["sd_score"] / 2**0.5
