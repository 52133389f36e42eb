"""Metabolite names: a normal form, and the pathways a name belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a normal form leaves out, in order; and name parts that tell a lipid's pathway.
STEPS = [(r"_\((principal|qualifier)\)", ""), (r"\s*\((principal|qualifier)\)", ""), ("#", " "), (r"-d\d+\b", ""), (r"\s+pool\b", ""), ("dl-", ""), (r"\s+", " ")]
LIPIDS = {
    "Sphingolipid metabolism": ["sm(", "sm ", "ceramide", "sphingo"],
    "Glycerophospholipid metabolism": ["pc(", "pe(", "ps(", "pg(", "pi(", "pa(", "lysopc", "plasmalogen", "bmp(", "cl("],
}
SHORTEST = 5


def normal_form(name: Column) -> Column:
    return F.trim(reduce(lambda s, step: F.regexp_replace(s, *step), STEPS, F.lower(F.trim(name))))


def without_stereo(name: Column) -> Column:
    return F.regexp_replace(name, "^[ld]-", "")


def _pieces(text: Column, n: int) -> Column:
    """All different substrings of n characters."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(n))))


def pathways_of(names: DataFrame, members: DataFrame) -> DataFrame:
    """``name, pathway`` of the ``names``, from ``members`` (``pathway, metabolite``).

    The first rule that finds something holds: a lipid's name parts; the same normal form,
    with or without its stereo mark; one form within the other, for known forms of SHORTEST
    characters or more.  What lies within another name shares its first letters with a piece
    of that, so that all rules are joins by equality.
    """
    forms = names.select("name").distinct().withColumn("form", normal_form(F.col("name")))
    known = members.select("pathway", normal_form(F.col("metabolite")).alias("key"))
    known = known.unionByName(known.withColumn("key", without_stereo(F.col("key")))).distinct()
    lipid = F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (F.col("form").contains(p) for p in parts)), pathway) for pathway, parts in LIPIDS.items())))
    by_lipid = forms.select("name", F.explode(lipid).alias("pathway"))
    rest = forms.join(by_lipid, "name", "left_anti")
    both = rest.select("name", F.explode(F.array_distinct(F.array("form", without_stereo(F.col("form"))))).alias("key"))
    by_form = both.join(known, "key").select("name", "pathway")
    left = rest.join(by_form, "name", "left_anti")
    long = known.filter(F.length("key") >= SHORTEST)
    in_form = left.withColumn("piece", F.explode(_pieces(F.col("form"), SHORTEST))).join(long.withColumn("piece", F.substring("key", 1, SHORTEST)), "piece").filter(F.col("form").contains(F.col("key")))
    all_pieces = F.concat(F.array(F.lit("")), *(_pieces(F.col("key"), n) for n in range(1, SHORTEST + 1)))
    in_key = left.withColumn("piece", F.substring("form", 1, SHORTEST)).join(long.withColumn("piece", F.explode(all_pieces)), "piece").filter(F.col("key").contains(F.col("form")))
    by_part = in_form.select("name", "pathway").unionByName(in_key.select("name", "pathway"))
    return by_lipid.unionByName(by_form).unionByName(by_part).distinct()


def annotate(names: DataFrame, members: DataFrame) -> DataFrame:
    """``name, n_pathways, pathways, mapped`` for every name."""
    found = pathways_of(names, members).groupBy("name").agg(F.count("*").alias("n_pathways"), F.array_join(F.array_sort(F.collect_list("pathway")), "; ").alias("pathways"))
    every = names.select("name").distinct().join(found, "name", "left")
    return every.select("name", F.coalesce("n_pathways", F.lit(0)).alias("n_pathways"), F.coalesce("pathways", F.lit("")).alias("pathways"), F.col("n_pathways").isNotNull().alias("mapped"))
