import itertools
import math

import numpy as np

from pyspark.sql import functions as F

from sparvane.functions import lexicon, special
from sparvane.operators import matrix, names, robust, scoring, stats


def t_tail(t, df):
    """Two-sided p of Student's t by its density, far out in small steps."""
    x = np.concatenate([np.linspace(t, 50, 400_001), np.geomspace(50, 1e6, 400_001)[1:]])
    density = math.gamma((df + 1) / 2) / math.sqrt(df * math.pi) / math.gamma(df / 2) * (1 + x * x / df) ** (-(df + 1) / 2)
    return float(2 * ((density[1:] + density[:-1]) / 2 * np.diff(x)).sum())


def test_special_functions_give_known_values(spark):
    rows = spark.createDataFrame([(2.228139, 10.0, 0.05), (12.7062, 1.0, 0.05), (0.0, 5.0, 1.0), (2.0, 4.5, t_tail(2.0, 4.5)), (40.0, 30.0, 0.0), (None, 3.0, None)], "t double, df double, p double")
    for r in rows.select("p", special.t_two_sided(F.col("t"), F.col("df")).alias("got")).collect():
        assert (r.got is None) == (r.p is None) and (r.p is None or abs(r.got - r.p) < 2e-5)
    z = spark.range(1).select(special.normal_two_sided(F.lit(1.959964)).alias("z"), special.log_gamma(F.lit(7.0)).alias("g")).first()
    assert abs(z.z - 0.05) < 1e-6 and abs(z.g - math.log(720)) < 1e-10


def test_exact_rank_distributions_equal_enumeration():
    for n, m in ((1, 1), (3, 4), (4, 4), (5, 2)):
        found = [0] * (n * m + 1)
        for chosen in itertools.combinations(range(1, n + m + 1), n):
            found[sum(chosen) - n * (n + 1) // 2] += 1
        assert special.rank_sums(n, m) == found
    found = [0] * 16
    for signs in itertools.product((0, 1), repeat=5):
        found[sum(r * s for r, s in zip(range(1, 6), signs))] += 1
    assert special.signed_rank_sums(5) == found


def test_rank_tests_with_ties_and_large_groups(spark):
    cells = spark.createDataFrame([("a", g, float(v)) for g, values in (("case", [5, 6, 7, 7]), ("control", [1, 2, 7, 3])) for v in values] + [("b", "case", float(i)) for i in range(20)] + [("b", "control", i + 10.5) for i in range(15)], "feature string, grp string, v double")
    got = {r.feature: r for r in matrix.rank_test(cells).collect()}
    assert got["a"].u == 13.0 and abs(got["a"].p_nonparam - 0.18315) < 1e-5  # normal approximation with ties and continuity
    assert got["b"].u == 45.0 and abs(got["b"].p_nonparam - 0.000496) < 1e-5
    pairs = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("a", 1.0), ("a", -2.0), ("a", 3.0), ("a", 0.0)], "feature string, x double")
    assert {r.feature: (r.w, r.p) for r in matrix.signed_rank_test(pairs).collect()} == {"a": (4.0, 0.75)}


def test_step_up_values_with_nulls(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9), ("e", None)], "feature string, p double")
    got = {r.feature: r.q for r in stats.benjamini_hochberg(rows).collect()}
    assert got["e"] is None
    assert [round(got[k], 6) for k in "abcd"] == [0.04, 0.053333, 0.053333, 0.9]


def test_resampling_spread_matches_theory(spark):
    scores = spark.createDataFrame([("x", r, float(r * r)) for r in range(8)], "agent string, run int, score double")
    means = stats.bootstrap_means(scores, "score", 4000)
    sd = means.agg(F.stddev_samp("m")).first()[0]
    values = [float(r * r) for r in range(8)]
    mean = sum(values) / 8
    theory = math.sqrt(sum((v - mean) ** 2 for v in values) / 8 / 8)
    assert abs(sd / theory - 1) < 0.05


def test_average_rank_truncates_ties(spark):
    rows = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0)], "agent string, v double")
    got = {r.agent: r["rank"] for r in rows.withColumn("rank", scoring.rank_average("v")).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 4}


def test_lexicon_counts_respect_accents_and_case(spark):
    text = "éPCA PCA pca, principal component analysis; Genes gene; p-value FDR fdr"
    rows = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = rows.select(lexicon.KEYWORDS.count("PCA", F.col("text")).alias("pca"), lexicon.TERMS.count("gene", F.col("text")).alias("gene"), *(c.alias(n) for n, c in lexicon.structure(F.col("text")).items())).collect()
    assert (got[0].pca, got[0].gene, got[0].n_fdr, got[0].n_pvalues) == (3, 2, 2, 1)
    assert all(v == 0 for v in got[1]) and all(v == 0 for v in got[2])


def test_prefilter_keeps_letters_that_fold_to_ascii(spark):
    rows = spark.createDataFrame([("ſcaling and SCALİNG",)], "text string")
    assert rows.select(lexicon.KEYWORDS.count("scaling", F.col("text")).alias("n")).first().n == 2


def test_literal_part_of_a_pattern():
    assert lexicon.literal(r"\bt[-\s]?test\b") == "test"
    assert lexicon.literal(r"\b(raw\s+)?counts\b") == "counts"
    assert lexicon.literal(r"\blog2?FC\b") in ("log", "FC")
    assert lexicon.literal(r"\bpathway\s+(analysis|enrichment)\b") == "pathway"


def test_huber_regression_is_optimal_and_withstands_outliers():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    y = x @ [2.0, -1.0, 0.5] + 4 + rng.normal(scale=0.1, size=60)
    y[:5] += 50
    w, c, scale = robust.huber(x, y)
    assert np.allclose(w, [2, -1, 0.5], atol=0.1) and abs(c - 4) < 0.1

    def loss(w, c, s):
        r = np.abs(y - x @ w - c) / s
        return 60 * s + s * np.where(r <= robust.EPSILON, r**2, 2 * robust.EPSILON * r - robust.EPSILON**2).sum() + robust.RIDGE * (w**2).sum()

    best = loss(w, c, scale)
    for _ in range(200):
        assert loss(w + rng.normal(scale=1e-3, size=3), c + rng.normal(scale=1e-3), scale * (1 + rng.normal(scale=1e-3))) >= best - 1e-9


def test_volume_penalised_scores_keep_the_mean(spark):
    rows = [(f"a{i % 4}", i, 50.0 + 3 * (i % 7) + (i % 3), float(i % 7)) for i in range(32)]
    got = robust.volume_penalised(spark.createDataFrame(rows, "agent string, run int, s double, n double"), "s", ["n"]).toPandas()
    assert abs(got.AgentScore_raw.mean() - got.AgentScore_volume_penalized.mean()) < 1 and got.AgentScore_volume_penalized.std() < 1.5
    flat = robust.volume_penalised(spark.createDataFrame([(a, r, 5.0, n) for a, r, _, n in rows], "agent string, run int, s double, n double"), "s", ["n"]).toPandas()
    assert (flat.AgentScore_volume_penalized == 5.0).all()


def test_statistics_of_constant_and_single_groups_are_null(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0)], "g string, x double, y double")
    got = {r.g: r.c for r in rows.groupBy("g").agg(stats.correlation("x", "y").alias("c")).collect()}
    assert got["a"] is None and abs(got["b"] - 1) < 1e-12
    one = spark.createDataFrame([("f", "case", 1.0), ("f", "case", 2.0)], "feature string, grp string, v double")
    assert matrix.rank_test(one).first().p_nonparam is None and matrix.differential(one.withColumn("sample", F.lit(1))).count() == 0


def test_nearest_imputation_by_hand(spark):
    cells = [(f, s, v) for s, values in {"s1": (1.0, 1.0, None), "s2": (1.0, 2.0, 10.0), "s3": (5.0, 5.0, 20.0), "s4": (None, None, None)}.items() for f, v in zip("abc", values)]
    got = {(r.feature, r["sample"]): r.v for r in matrix.nearest_impute(spark.createDataFrame(cells, "feature string, sample string, v double"), k=1).collect()}
    assert got["c", "s1"] == 10.0 and abs(got["a", "s4"] - 7 / 3) < 1e-12 and got["c", "s3"] == 20.0


def test_names_without_any_rule_stay_unmapped(spark):
    rows = names.annotate(spark.createDataFrame([("zz",), ("L-Serine",)], "name string"), spark.createDataFrame([("P", "serine")], "pathway string, metabolite string")).collect()
    assert sorted((r.name, r.n_pathways, r.mapped) for r in rows) == [("L-Serine", 1, True), ("zz", 0, False)]


def test_the_matrix_is_computed_once(spark):
    from sparvane.plans import catalogue, matrix

    assert matrix  # it registers its queries
    for name in ("differential_abundance", "regulation_flags", "differential_summary"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan ") <= 2 and "Join" not in plan


def test_paired_tests_go_by_number_and_cohens_d_by_position(spark):
    import numpy as np

    from sparvane.operators import matrix as M

    rng = np.random.default_rng(5)
    names = {"control": ["c_3", "c_1", "c_2", "c_10", "c_x"], "case": ["k_1", "k_10", "k_3", "k_2", "k_7"]}
    cells, values = [], {}
    for feature in ("f", "gaps", "few"):
        for grp, listed in names.items():
            for i, name in enumerate(listed):
                v = float(rng.uniform(1, 9))
                v = None if feature == "gaps" and name == "k_3" or feature == "few" and grp == "case" and i > 1 else v
                values[feature, name] = v
                cells.append((feature, name, i, grp, v))
    rows = {r["feature"]: r for r in M.differential_paired(spark.createDataFrame(cells, "feature string, name string, position int, grp string, v double")).collect()}
    assert set(rows) == {"f", "gaps"}
    for feature, row in rows.items():
        log = lambda n: None if values[feature, n] is None else np.log2(values[feature, n] + 1)  # noqa: E731, B023
        x = np.array([log(f"k_{i}") - log(f"c_{i}") for i in (1, 2, 3, 10) if log(f"k_{i}") is not None])
        assert row["n_pairs"] == len(x) and np.isclose(row["t"], x.mean() / (x.std(ddof=1) / np.sqrt(len(x))))
        case, control = (np.array([log(n) for n in names[g] if log(n) is not None]) for g in ("case", "control"))
        if len(case) == len(control):
            d = case - control
            wanted = d.mean() / d.std(ddof=1)
        else:
            wanted = (case.mean() - control.mean()) / np.sqrt(((len(case) - 1) * case.var(ddof=1) + (len(control) - 1) * control.var(ddof=1)) / (len(case) + len(control) - 2))
        assert np.isclose(row["cohens_d"], wanted) and 0 <= row["p_param"] <= 1 and 0 < row["p_nonparam"] <= 1
