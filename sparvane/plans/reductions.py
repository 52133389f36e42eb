"""Registered queries: runs in a plane by their distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparvane.operators import layouts as L
from sparvane.plans import catalogue as C
from sparvane.plans.catalogue import query


def _distances(spark, sf):
    return L.distances(C.run_vectors(spark, sf), ["agent", "run"], "embedding")


@query(None)
def metric_scaling(spark, sf):
    """Runs in a plane by stress majorisation of their standardised vectors' distances (no SQL twin: an iteration; see the tests)."""
    far, keys = _distances(spark, sf)
    at, _ = L.majorise(far)
    return L.placed(spark, keys, at, "agent int, run bigint, mds1 double, mds2 double").withColumns({c: F.bround(c, 6) for c in ("mds1", "mds2")})


@query(None)
def neighbour_layout(spark, sf, rounds: int = 300, early: int = 100):
    """Runs in a plane by stochastic neighbours, 300 rounds of them (no SQL twin: an iteration; see the tests); no rows for fewer than four runs."""
    far, keys = _distances(spark, sf)
    found = L.stochastic_neighbours(far, rounds, early)
    rows = L.placed(spark, keys, found[0], "agent int, run bigint, tsne1 double, tsne2 double") if found else spark.createDataFrame([], "agent int, run bigint, tsne1 double, tsne2 double")
    return rows.withColumns({c: F.bround(c, 6) for c in ("tsne1", "tsne2")})


@query(None)
def graph_layout(spark, sf, rounds: int = 100):
    """Runs in a plane by the graph of their nearest neighbours (no SQL twin: an iteration; see the tests)."""
    far, keys = _distances(spark, sf)
    at = L.graph_layout(L.neighbour_graph(far), far.n, rounds)
    return L.placed(spark, keys, at, "agent int, run bigint, umap1 double, umap2 double").withColumns({c: F.bround(c, 6) for c in ("umap1", "umap2")})


@query(None)
def neighbour_edges(spark, sf):
    """The weighted edges of that graph, by the runs' numbers in order of producer and run (no SQL twin: a bisection a run; see the tests)."""
    far, _ = _distances(spark, sf)
    return L.neighbour_graph(far).filter("i < to").select("i", "to", F.bround("w", 8).alias("w"))
