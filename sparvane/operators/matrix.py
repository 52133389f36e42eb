"""Feature-by-sample matrices in long form: ``feature, sample, grp, v`` with null for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvane.functions import special
from sparvane.operators.stats import average_rank, benjamini_hochberg

EXACT_RANKS, EXACT_SIGNS = 8, 25


def quality(cells: DataFrame, most_missing: float = 0.5, most_cv: float = 0.30) -> DataFrame:
    """Per feature: QC values, their variation, the missing share elsewhere, and whether it is kept."""
    qc = F.when(F.col("grp") == "qc", F.col("v"))
    lost = F.when(F.col("grp") != "qc", F.col("v").isNull().cast("double"))
    stats = cells.groupBy("feature").agg(F.count(qc).alias("n_qc"), F.try_divide(F.stddev_samp(qc), F.avg(qc)).alias("cv"), F.avg(lost).alias("missing"))
    return stats.withColumn("kept", (F.col("missing") <= most_missing) & (F.col("missing") < 1) & (F.coalesce("cv", F.lit(0.0)) <= most_cv))


def quality_filter(cells: DataFrame, most_missing: float = 0.5, most_cv: float = 0.30) -> DataFrame:
    """Biological samples of the features that pass :func:`quality`, by windows over one scan."""
    w = Window.partitionBy("feature")
    qc = F.when(F.col("grp") == "qc", F.col("v"))
    lost = F.avg(F.when(F.col("grp") != "qc", F.col("v").isNull().cast("double"))).over(w)
    cv = F.try_divide(F.stddev_samp(qc).over(w), F.avg(qc).over(w))
    return cells.withColumns({"__lost": lost, "__cv": cv}).filter((F.col("grp") != "qc") & (F.col("__lost") <= most_missing) & (F.col("__lost") < 1) & (F.coalesce("__cv", F.lit(0.0)) <= most_cv)).drop("__lost", "__cv")


def impute(cells: DataFrame, how: str) -> DataFrame:
    """Missing values become the feature's minimum (``min``), half of it (``half_min``), 0 if it has none, or the mean of its nearest samples (``knn``)."""
    if how == "knn":
        return nearest_impute(cells)
    share = {"min": 1.0, "half_min": 0.5}[how]
    return cells.withColumn("v", F.coalesce("v", share * F.min("v").over(Window.partitionBy("feature")), F.lit(0.0)))


def nearest_impute(cells: DataFrame, k: int = 5) -> DataFrame:
    """Missing values become the mean over the k nearest samples that have the feature (ties by sample).

    Samples are as far apart as the root of their squared differences over the features that
    both have, scaled up to all features; pairs of samples are few, features are summed
    where they lie.
    """
    known = cells.filter("v is not null").select("feature", "sample", "v")
    width = cells.agg(F.count_distinct("feature").alias("width"))  # one row
    other = known.select("feature", F.col("sample").alias("donor"), F.col("v").alias("w"))
    apart = known.join(other, "feature").filter("sample <> donor").groupBy("sample", "donor").agg(F.sum((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("d"), F.count("*").alias("n"))
    apart = apart.crossJoin(F.broadcast(width)).select("sample", "donor", (F.col("d") * F.col("width") / F.col("n")).alias("far"))
    missing = cells.filter("v is null").select("feature", "sample").join(apart, "sample").join(other, ["feature", "donor"])
    ranked = missing.withColumn("__r", F.row_number().over(Window.partitionBy("feature", "sample").orderBy("far", "donor"))).filter(F.col("__r") <= k)
    filled = ranked.groupBy("feature", "sample").agg(F.avg("w").alias("__fill"))
    means = known.groupBy("feature").agg(F.avg("v").alias("__mean"))  # for samples without any neighbour
    return cells.join(filled, ["feature", "sample"], "left").join(means, "feature", "left").withColumn("v", F.coalesce("v", "__fill", "__mean")).drop("__fill", "__mean")


def preprocess(cells: DataFrame, impute_how: str = "half_min", normalise_how: str | None = "pqn", log_how: str = "log2", scale_how: str | None = "pareto", most_missing: float = 0.5, most_cv: float = 0.30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scaled matrix, its features' quality (``feature, qc_cv, missing_frac, mean_intensity``) and the log (``step, text``)."""
    stats = quality(cells, most_missing, most_cv)
    kept = cells.join(stats.filter("kept").select("feature"), "feature", "left_semi").filter("grp <> 'qc'")
    normal = normalise(impute(kept, impute_how), normalise_how)
    scaled = scale(normal.withColumn("v", log("v", log_how)), scale_how)
    rows = kept.groupBy("feature").agg(F.avg(F.col("v").isNull().cast("double")).alias("missing_frac"), F.avg("v").alias("mean_intensity"))
    feature_qc = rows.join(stats.select("feature", F.col("cv").alias("qc_cv")), "feature").select("feature", "qc_cv", "missing_frac", "mean_intensity")
    some, lost = F.col("missing") < 1, F.col("missing") <= most_missing
    n = stats.agg(F.count("*").alias("a"), F.count_if(some).alias("b"), F.count_if(some & lost).alias("c"), F.count_if("kept").alias("d"))
    texts = [
        F.format_string("Removed %d all-missing features (%d -> %d).", F.col("a") - F.col("b"), "a", "b"),
        F.format_string(f"Removed %d features with >{most_missing:.0%}% missingness (-> %d).", F.col("b") - F.col("c"), "c"),
        F.format_string(f"Removed %d features with QC CV>{most_cv:.0%}% (-> %d).", F.col("c") - F.col("d"), "d"),
        *(F.lit(x) for x in (f"Imputed missing values with '{impute_how}'.", f"Sample normalization: '{normalise_how}'.", f"Transform: '{log_how}'.", f"Scaling (multivariate only): '{scale_how}'.")),
    ]
    steps = n.select(F.posexplode(F.array(*texts)).alias("step", "text")).select((F.col("step") + 1).alias("step"), "text")
    return scaled, feature_qc, steps


def scale_like(qc: DataFrame, logged: DataFrame, how: str | None, log_how: str = "log2") -> DataFrame:
    """Quality controls (not normalised, gaps filled by their feature's minimum) on the scale of the biological samples' log values."""
    stats = logged.groupBy("feature").agg(F.avg("v").alias("__m"), F.nullif(F.stddev_samp("v"), F.lit(0.0)).alias("__s"))
    filled = qc.withColumn("v", F.coalesce("v", F.min("v").over(Window.partitionBy("feature")), F.lit(0.0))).withColumn("v", log("v", log_how))
    by = {"auto": F.col("__s"), "pareto": F.sqrt("__s")}.get(how or "", F.lit(1.0))
    return filled.join(stats, "feature").withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.col("__m"), by), F.lit(0.0))).drop("__m", "__s")


def normalise(cells: DataFrame, how: str | None) -> DataFrame:
    """Divides samples by a factor: ``pqn``, ``sum``, ``median`` or None; a factor of 0 or null is 1."""
    if how is None:
        return cells
    if how == "pqn":
        medians = cells.groupBy("feature").agg(F.median("v").alias("ref"))
        factors = cells.join(medians, "feature").groupBy("sample").agg(F.median(F.try_divide("v", F.nullif("ref", F.lit(0.0)))).alias("f"))
    else:
        sums = cells.groupBy("sample").agg({"sum": F.sum, "median": F.median}[how]("v").alias("f"))
        factors = sums.crossJoin(sums.agg(F.median("f").alias("mid"))).select("sample", F.try_divide("f", "mid").alias("f"))  # one row
    return cells.join(factors, "sample").withColumn("v", F.col("v") / F.coalesce(F.nullif("f", F.lit(0.0)), F.lit(1.0))).drop("f")


def log(value: str, how: str) -> Column:
    """log2 or log10 of 1 + max(v, 0), or its natural logarithm (``ln``); null stays null."""
    raised = F.when(F.col(value).isNotNull(), F.greatest(F.col(value), F.lit(0.0))) + 1
    return {"log2": F.log2, "log10": F.log10, "ln": F.log}[how](raised)


def scale(cells: DataFrame, how: str | None) -> DataFrame:
    """Centres each feature and divides by its deviation (``auto``), its root (``pareto``) or range; 0 where that is 0."""
    if how is None:
        return cells
    w = Window.partitionBy("feature")
    by = {"auto": F.stddev_samp("v").over(w), "pareto": F.sqrt(F.stddev_samp("v").over(w)), "range": F.max("v").over(w) - F.min("v").over(w)}[how]
    return cells.withColumn("v", F.coalesce(F.try_divide(F.col("v") - F.avg("v").over(w), by), F.lit(0.0)))


def _of(group: str, column: str) -> Column:
    return F.when(F.col("grp") == group, F.col(column))


def _group_sums() -> list[Column]:
    """Aggregates of rows with ``v`` and its logarithm ``l``."""
    means = [F.avg(_of(g, "v")).alias(f"mean_{g}") for g in ("control", "case")]
    return means + [f(_of(g, "l")).alias(f"{n}{i}") for i, g in ((1, "case"), (0, "control")) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))]


def _group_stats() -> dict[str, Column]:
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return {
        "log2fc": F.log2(F.try_divide("mean_case", "mean_control")), "welch_t": F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)),
        "df": F.try_divide((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1)), "cohens_d": F.try_divide(F.col("m1") - F.col("m0"), pooled),
    }


def group_tests(cells: DataFrame) -> DataFrame:
    """Per feature: log2 fold change of means, Welch's t and degrees of freedom, and Cohen's d on the log scale."""
    stats = cells.withColumn("l", log("v", "log2")).groupBy("feature").agg(*_group_sums())
    return stats.select("feature", "n1", "n0", *(c.alias(n) for n, c in _group_stats().items()))


def _ranked(cells: DataFrame) -> DataFrame:
    """Adds each value's rank ``r`` within its feature and how many are the ``same``; missing ones come last and don't count."""
    below = F.rank().over(Window.partitionBy("feature").orderBy(F.asc_nulls_last("v")))
    same = F.count("v").over(Window.partitionBy("feature", "v"))
    return cells.withColumn("same", same).withColumn("r", F.when(F.col("v").isNotNull(), below + (F.col("same") - 1) / 2.0))


def _rank_sums() -> list[Column]:
    sizes = [F.count(_of(g, "v")).alias(n) for g, n in (("case", "ranked1"), ("control", "ranked0"))]
    return [F.sum(_of("case", "r")).alias("r1"), *sizes, F.sum(F.when(F.col("v").isNotNull(), F.col("same") * F.col("same") - 1)).cast("double").alias("ties")]


def _rank_stats(sums: DataFrame) -> DataFrame:
    n1, n0 = F.col("ranked1"), F.col("ranked0")
    rows = sums.withColumn("u", (F.col("r1") - n1 * (n1 + 1) / 2).cast("double"))
    most, n = F.greatest(F.col("u"), n1 * n0 - F.col("u")), n1 + n0
    ways = {100 * a + b: special.rank_sums(a, b) for a in range(1, EXACT_RANKS + 1) for b in range(1, EXACT_RANKS + 1)}
    exact = special.exact_tail(most, 100 * n1 + n0, ways)
    spread = F.sqrt(n1 * n0 / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    normal = special.normal_two_sided(F.try_divide(most - n1 * n0 / 2.0 - 0.5, spread))
    p = F.when(F.col("ties") == 0, F.coalesce(exact, normal)).otherwise(normal)
    return rows.withColumn("p_nonparam", F.when((n1 > 0) & (n0 > 0), p))


def rank_test(cells: DataFrame) -> DataFrame:
    """``feature, u, p_nonparam``: Mann-Whitney's U of the cases and its two-sided p.

    Exact without ties for groups of up to EXACT_RANKS, else by the normal approximation
    with corrections for ties and continuity.
    """
    sums = _ranked(cells.filter("v is not null")).groupBy("feature").agg(*_rank_sums())
    return _rank_stats(sums).select("feature", "u", "p_nonparam")


def signed_rank_test(pairs: DataFrame) -> DataFrame:
    """``feature, w, p``: Wilcoxon's signed ranks of ``feature, x`` (differences; zeros are dropped), two-sided; exact without ties up to EXACT_SIGNS, else the normal approximation; features whose differences are all 0 are left out."""
    ranks = pairs.filter("x <> 0").withColumn("size", F.abs("x")).select("feature", "x", average_rank("size", ["feature"]).alias("r"), F.count("*").over(Window.partitionBy("feature", "size")).alias("same"))
    rows = ranks.groupBy("feature").agg(F.sum(F.when(F.col("x") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.count("*").alias("n"), F.sum(F.col("same") * F.col("same") - 1).cast("double").alias("ties"))
    most = F.greatest("w", F.col("n") * (F.col("n") + 1) / 2 - F.col("w"))
    exact = special.exact_tail(most, F.col("n"), {n: special.signed_rank_sums(n) for n in range(1, EXACT_SIGNS + 1)})
    spread = F.sqrt((F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) - F.col("ties") / 2) / 24.0)
    p = F.when(F.col("ties") == 0, F.coalesce(exact, special.normal_two_sided(F.try_divide(most - F.col("n") * (F.col("n") + 1) / 4, spread)))).otherwise(special.normal_two_sided(F.try_divide(most - F.col("n") * (F.col("n") + 1) / 4, spread)))
    return rows.select("feature", "w", p.alias("p"))


def differential(cells: DataFrame, alpha: float = 0.05, threshold: float = 1.0, least: int = 3) -> DataFrame:
    """The differential table of ``feature, sample, grp, v``: means, fold change, Welch's and the rank test, effect size, AUC, adjusted values and what follows.

    Features with fewer than ``least`` values in a group are left out.
    """
    sums = _ranked(cells.withColumn("l", log("v", "log2"))).groupBy("feature").agg(*_group_sums(), *_rank_sums())  # all tests from one pass
    rows = _rank_stats(sums).withColumns(_group_stats()).filter((F.col("n1") >= least) & (F.col("n0") >= least))
    share = F.try_divide(F.col("u"), F.col("ranked1") * F.col("ranked0"))
    p = special.t_two_sided(F.col("welch_t"), F.col("df"))
    rows = rows.select(
        "feature", "mean_control", "mean_case", "log2fc", F.try_divide("mean_case", "mean_control").alias("fold_change"), p.alias("p_param"), "p_nonparam", "cohens_d",
        F.greatest(share, 1 - share).alias("auc"), F.col("n0").alias("n_control"), F.col("n1").alias("n_case"),
    ).withColumn("p_value", F.coalesce("p_param", "p_nonparam"))
    rows = benjamini_hochberg(benjamini_hochberg(rows, "p_value", "q_value"), "p_nonparam", "q_nonparam")
    significant = F.coalesce(F.col("q_value") < alpha, F.lit(False))
    up = F.when(significant & (F.col("log2fc") > 0), "up").when(significant & (F.col("log2fc") < 0), "down").otherwise("ns")
    return rows.withColumns({"neg_log10_p": -F.log10(F.greatest("p_value", F.lit(1e-300))), "significant": significant, "regulation": up, "candidate_biomarker": significant & F.coalesce(F.abs("log2fc") >= threshold, F.lit(False))})


def summarise(table: DataFrame, top: int = 10) -> DataFrame:
    """One row: numbers tested, significant, up, down and of candidates, and the first names up and down by (q, p)."""
    names = lambda side: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("regulation") == side, F.struct("q_value", "p_value", "feature")))), 1, top), lambda x: x.feature), "; ")
    side = lambda x: F.count_if(F.col("regulation") == x)
    return table.agg(F.count("*").alias("n_tested"), F.count_if("significant").alias("n_significant"), side("up").alias("n_up"), side("down").alias("n_down"), F.count_if("candidate_biomarker").alias("n_candidate_biomarkers"), names("up").alias("top_up"), names("down").alias("top_down"))


def hypergeometric_tail(hits: str, size: str, drawn: str, total: str) -> Column:
    """Chance of at least ``hits`` of ``size`` marked ones among ``drawn`` of ``total`` (Fisher's exact test, greater)."""
    k, m, n, t = (F.col(c).cast("int") for c in (hits, size, drawn, total))

    def log_factorial(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.greatest(x, F.lit(0))), F.lit(0.0), lambda a, i: a + F.log(F.greatest(i, F.lit(1)).cast("double")))

    def choose(a: Column, b: Column) -> Column:
        return log_factorial(a) - log_factorial(b) - log_factorial(a - b)

    def term(a: Column, i: Column) -> Column:
        return a + F.when(n - i > t - m, 0.0).otherwise(F.exp(choose(m, i) + choose(t - m, n - i) - choose(t, n)))

    possible = F.filter(F.sequence(F.lit(0), F.least(m, n)), lambda i: i >= k)
    return F.least(F.lit(1.0), F.aggregate(possible, F.lit(0.0), term))


def over_representation(members: DataFrame, hits: DataFrame) -> DataFrame:
    """Per pathway: size, hits, background, significant, expected hits, ratio and the hits' list."""
    totals = members.agg(F.count_distinct("metabolite").alias("background")).crossJoin(hits.agg(F.count("*").alias("significant")))  # one row
    marked = members.join(hits.withColumn("hit", F.col("metabolite")), "metabolite", "left")
    per = marked.groupBy("pathway").agg(F.count("*").alias("size"), F.count("hit").alias("hits"), F.array_join(F.array_sort(F.collect_set("hit")), "; ").alias("hit_list"))
    expected = F.col("size") * F.col("significant") / F.col("background")
    return per.crossJoin(F.broadcast(totals)).withColumn("ratio", F.bround(F.try_divide("hits", expected), 6)).withColumn("expected", F.bround(expected, 6))


def trailing_number(name: Column) -> Column:
    """The number at a name's end, by which control and case samples are pairs; null without one."""
    return F.nullif(F.regexp_extract(name, r"(\d+)$", 1), F.lit("")).try_cast("int")


def differential_paired(cells: DataFrame, least: int = 3) -> DataFrame:
    """The paired form of the tests of ``feature, name, position, grp, v``: control and case samples whose names end in the same number are pairs.

    Paired t and signed ranks take the pairs' differences of logarithms, if a feature has
    ``least`` of them; Cohen's d takes differences of the groups' values in the order of their positions,
    whatever their numbers, as long as both have as many.
    """
    logged = cells.filter("v is not null").withColumns({"l": log("v", "log2"), "pair": trailing_number(F.col("name"))})
    difference = F.max(_of("case", "l")) - F.max(_of("control", "l"))
    pairs = logged.filter("pair is not null").groupBy("feature", "pair").agg(difference.alias("x")).filter("x is not null")
    sums = pairs.groupBy("feature").agg(F.count("*").alias("n_pairs"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    some = F.col("n_pairs") >= least
    t = F.try_divide(F.col("m"), F.nullif(F.col("s"), F.lit(0.0)) / F.sqrt("n_pairs"))
    tested = sums.select("feature", "n_pairs", F.when(some, t).alias("t")).withColumn("p_param", special.t_two_sided(F.col("t"), (F.col("n_pairs") - 1).cast("double")))
    signed = signed_rank_test(pairs).select("feature", F.col("p").alias("p_signed"))
    placed = logged.withColumn("place", F.row_number().over(Window.partitionBy("feature", "grp").orderBy("position")))
    by_place = placed.groupBy("feature", "place").agg(difference.alias("x"), F.count("*").alias("both"))
    paired_d = by_place.groupBy("feature").agg(F.when(F.min("both") == 2, F.try_divide(F.avg("x"), F.nullif(F.stddev_samp("x"), F.lit(0.0)))).alias("paired_d"), (F.min("both") == 2).alias("even"))
    stats = group_tests(cells).filter((F.col("n1") >= least) & (F.col("n0") >= least))
    rows = stats.join(tested, "feature", "left").join(signed, "feature", "left").join(paired_d, "feature", "left")
    p_nonparam = F.when(F.col("n_pairs") >= least, F.col("p_signed"))
    d = F.when(F.col("even") & (F.col("n1") > 1), F.col("paired_d")).otherwise(F.col("cohens_d"))
    out = rows.select("feature", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "log2fc", "t", "p_param", p_nonparam.alias("p_nonparam"), d.alias("cohens_d"))
    return benjamini_hochberg(out.withColumn("p_value", F.coalesce("p_param", "p_nonparam")), "p_value", "q_value")


def enrichment(members: DataFrame, hits: DataFrame, changes: DataFrame, smallest: int = 3, alpha: float = 0.05) -> DataFrame:
    """Pathways of ``smallest`` members or more: size, hits, expected hits, ratio, Fisher's p and its q, the hits' mean log2 change, and whether they are enriched.  ``changes``: ``metabolite, log2fc``."""
    sized = over_representation(members, hits).filter(F.col("size") >= smallest).withColumn("p_value", hypergeometric_tail("hits", "size", "significant", "background"))
    means = members.join(hits, "metabolite").join(changes, "metabolite").groupBy("pathway").agg(F.avg("log2fc").alias("mean_log2fc_sig"))
    rows = benjamini_hochberg(sized.select("pathway", "size", "hits", "expected", "ratio", "hit_list", F.bround("p_value", 10).alias("p_value")), "p_value", "q_value")
    return rows.join(means, "pathway", "left").withColumn("enriched", F.coalesce(F.col("q_value") < alpha, F.lit(False)))


def nominate_genes(members: DataFrame, hits: DataFrame, genes: DataFrame, enriched: DataFrame) -> DataFrame:
    """Genes (``pathway, gene``) of pathways with a hit: their pathways and hits, and the least q of these pathways."""
    rows = members.join(hits, "metabolite").join(genes, "pathway").join(enriched.select("pathway", "q_value"), "pathway", "left")
    return rows.groupBy("gene").agg(F.count_distinct("pathway").alias("n_pathways"), F.count_distinct("metabolite").alias("n_metabolites"), F.min("q_value").alias("best_pathway_q"))
