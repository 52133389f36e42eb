"""Run features: patterns are tried only where their literal parts stand, and each text is read for them once."""

import random
import re

from pyspark.sql import functions as F

from sparvane.functions import lexicon as L
from sparvane.functions.omics import MODALITIES
from sparvane.plans import catalogue as C
from sparvane.plans import consensus

SF = "/root/testdata/sf0.001"
TEXTS = ["PCA and pls-da, ﬁgs", "ſignificant DEGs; K-means KEGG, lİmma lımma", "=== Sheet: a\nx | - | y <TABLE", "!​[ ![x](y.PNG) <IMG src> .jpeg .ſvg", "p-value pval P val FDR fdr", "```a``` ~~~ <CODE>", "", "a\n\nb\n", "<html>\t.\t"] + C.PHRASES


def test_clues_lose_no_match(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "id int, text string")
    for lexicons in [L.ALL, *MODALITIES.values()]:
        wide = rows.withColumn("clues", L.clues(F.col("text"), lexicons))
        with_clues = {n: c for x in lexicons for n, c in x.counts(F.col("text"), F.col("clues")).items()} | L.structure(F.col("text"), F.col("clues"))
        plain = {f"{x.family}_{t}": sum((F.coalesce(F.regexp_count("text", F.lit(f"(?iuUd){p}")), F.lit(0)) for p in ps), F.lit(0)) for x in lexicons for t, ps in x.terms.items()}
        plain |= {n: F.coalesce(F.regexp_count("text", F.lit("(?Ud)" + L.STRUCTURE[n])), F.lit(0)) for n in L.STRUCTURE if n in with_clues}
        got = wide.select("id", *(with_clues[n].alias(n) for n in plain)).orderBy("id").collect()
        assert got == rows.select("id", *(c.cast("bigint").alias(n) for n, c in plain.items())).orderBy("id").collect()
    lines = rows.select(L.structure(F.col("text"))["n_lines"].alias("n"), "text").collect()
    assert all(r.n == (len(re.findall("\n", r.text)) + 1 if r.text else 0) for r in lines)


def test_documents_are_folded_and_scanned_once(spark):
    plan = C.run_features_frame(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 2  # before: once for each pattern
    rows = consensus.distinctiveness_scores(spark, SF)
    assert "documents.parquet" not in rows._jdf.queryExecution().optimizedPlan().toString() and not [f for f in rows.inputFiles() if "documents" in f]


def test_sentences_and_words_that_are_read_hold_all_matches(spark):
    rng = random.Random(4)
    bits = ["PCA", "pca", "signif.", "SIGNIF", "ſignif", "fold", "change", "log2FC", "FC", "t", "test", "p", "val", "İmmune", "gene", "GENES", "gené", "́", "limma", "lımma", "LC-MS/MS", "K", "12", "1.5", "1,000.25", "٣", "a1", "_1", "x", "ﬁ", "🙂", "�", "STAR", "quality", "control", "raw", "counts"]
    gaps = [" ", "  ", "\n", ".", ". ", "-", "\t", "\x1c", "\x1f", " ", " ", "\u0085", "", "́", ",", "/", "|", "\x00"]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [*TEXTS, None, "word. " * 30_000 + "PCA. gene", "x" * 1_100_000 + ". fdr"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(2)
    for lexicons in (L.ALL, MODALITIES["proteomics"]):
        wide = rows.withColumn("read", L.reading(F.col("text"), lexicons))
        read = {n: c for x in lexicons for n, c in x.counts(F.col("read.near"), F.col("read.held")).items()} | L.structure(F.col("text"), F.col("read.held"), F.col("read"))
        plain = {f"{x.family}_{t}": sum((F.coalesce(F.regexp_count("text", F.lit(f"(?iuUd){p}")), F.lit(0)) for p in ps), F.lit(0)).cast("bigint") for x in lexicons for t, ps in x.terms.items()} | L.structure(F.col("text"))
        got = wide.select("id", *(read[n].alias(n) for n in plain)).orderBy("id").collect()
        want = rows.select("id", *(c.alias(n) for n, c in plain.items())).orderBy("id").collect()
        assert got == want and sum(r["n_numeric"] for r in got) > 300
    short = wide.agg(F.sum(F.length("read.near")).alias("near"), F.sum(F.length("text")).alias("all")).first()
    assert short.near < short.all / 10  # the patterns run over these alone


def test_a_file_of_one_row_group_is_shared_out(spark):
    assert spark.read.parquet(f"{SF}/documents.parquet").rdd.getNumPartitions() == 1
    plan = C.run_features_frame(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("RepartitionByExpression") < plan.index("Relation")  # before: the file's one task did all


def test_the_pass_over_a_text_counts_characters_and_lines_too(spark):
    plan = C.run_features_frame(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\b(replace|length|char_length)\(text", plan)  # before: three more passes over each text


def test_words_by_bytes_are_those_by_patterns():
    rng = random.Random(6)
    bits = ["12", "a1", "1,000.25", "x", "é", "é3", "Σ", "🙂", "🙂7", "�", "", "\x1c", "\x1f9", "٣"]
    texts = ["", " ", "7", "\n7\n", *("".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\t\r", "\x0b", "\x0c ", "\u0085", " ", " ", "　"]) for _ in range(rng.randint(0, 12))) for _ in range(500))]
    plain = [L.spaced(t, t.encode()) for t in texts]
    assert all((x is None) == ("٣" in t) for t, x in zip(texts, plain)) and L.worded([]) == ([], [])
    for t, x, numbers, n_words in zip(texts, plain, *L.worded([x or b"" for x in plain])):
        words = re.findall(r"[\S\x1c-\x1f]+", t)
        assert x is None or (numbers, n_words) == (" ".join(w for w in words if re.search(r"\d", w)), len(words))
