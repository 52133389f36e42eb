"""Component scores, rubric grades and rankings of producers from run features."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A component is 1 if any of its inputs exceeds its threshold (0 unless given).
PROCESS = {
    "P_preprocessing_described": "aud_preprocessing kw_imputation",
    "P_normalization_described": "kw_normalization kw_scaling",
    "P_qc_described": "kw_QC kw_pooled_QC",
    "P_missing_value_handling": "kw_imputation",
    "P_statistical_testing": "kw_t-test kw_Mann-Whitney kw_Wilcoxon kw_ANOVA",
    "P_multiple_testing_correction": "kw_FDR kw_Benjamini-Hochberg n_fdr",
    "P_code_workflow_transparency": "n_code_blocks",
    "P_reproducible_tables": "n_tables",
}
RESULT = {
    "R_numerical_results_present": "n_numeric>10",
    "R_pvalues_present": "n_pvalues",
    "R_fdr_qvalues_present": "n_fdr kw_FDR",
    "R_fold_changes_present": "kw_fold_change kw_log2FC",
    "R_significant_features_reported": "aud_significant",
    "R_result_tables_provided": "n_tables",
    "R_consistency_run_level": "aud_consistency",
}
_CAUTION = {
    "D_biological_mechanism": "aud_mechanism",
    "D_uncertainty_limitations": "aud_limitations aud_uncertainty",
    "D_annotation_confidence_caution": "aud_annotation",
    "D_biological_plausibility": "aud_plausibility",
}
DEPTH = {
    "D_gene_interpretation": "n_gene_mentions>5",
    "D_pathway_interpretation": "n_pathway_mentions kw_pathway_analysis kw_KEGG kw_GO_enrichment kw_GSEA kw_GSVA kw_Reactome",
    "D_gene_function_interpretation": "bio_transcription_factor bio_immune bio_cell_cycle bio_signaling bio_metabolism bio_splicing",
} | _CAUTION
PROTEIN_DEPTH = {
    "D_protein_interpretation": "n_protein_mentions>5",
    "D_pathway_interpretation": "n_pathway_mentions kw_pathway_analysis kw_KEGG kw_GO_enrichment kw_GSEA kw_Reactome",
    "D_protein_function_interpretation": "bio_kinase bio_transcription_factor bio_mitochondrial bio_immune bio_PTM bio_phosphorylation",
} | _CAUTION
METABOLITE_DEPTH = {
    "D_metabolite_interpretation": "n_metabolite_mentions>5",
    "D_pathway_interpretation": "n_pathway_mentions kw_pathway_analysis kw_KEGG kw_MetaboAnalyst",
    "D_metabolite_class_interpretation": "bio_lipid bio_amino_acid bio_fatty_acid bio_sphingolipid bio_phospholipid",
} | _CAUTION
VOLUME = ("P_reproducible_tables", "R_result_tables_provided")
# Rubrics.  COUNT: sum 1, sum 2 or more; PAIR: one of two groups, both; FIRST:
# the first group without the second, the second; the others name a condition for grade 1
# and grade 2.
RUBRIC = {
    "dm_rnaseq_platform": "COUNT kw_RNA-seq kw_bulk_RNA-seq kw_transcriptomics kw_STAR kw_salmon kw_kallisto",
    "dm_qc_strategy": "COUNT kw_QC kw_FastQC kw_MultiQC",
    "dm_normalization": "PAIR kw_normalization / kw_scaling",
    "dm_batch_correction": "COUNT kw_batch_correction",
    "dm_de_analysis": "COUNT kw_DESeq2 kw_edgeR kw_limma kw_differential_expression",
    "dm_multiple_testing": "FIRST kw_FDR n_fdr / kw_Benjamini-Hochberg",
    "dm_effect_sizes": "PAIR kw_fold_change / kw_log2FC",
    "dm_pca_exploratory": "BOTH kw_PCA / kw_PLS-DA kw_OPLS-DA",
    "dm_pca_caution": "GATE kw_PCA / aud_caution aud_uncertainty",
    "dm_significant_genes": "OVER aud_significant / n_gene_mentions",
    "dm_annotation_uncertainty": "COUNT aud_annotation",
    "dm_avoid_overclaiming": "PAIR aud_caution / aud_annotation",
    "dm_pathway_go": "PAIR kw_pathway_analysis kw_KEGG kw_GO_enrichment kw_GSEA kw_GSVA kw_Reactome n_pathway_mentions / bio_transcription_factor bio_immune bio_cell_cycle bio_signaling",
    "dm_biological_mechanism": "PAIR aud_mechanism / aud_plausibility",
    "dm_limitations": "COUNT aud_limitations",
    "dm_reproducible_code_tables": "PAIR n_code_blocks / n_tables",
}
PROTEIN_RUBRIC = {
    "dm_proteomics_platform": "COUNT kw_LC-MS kw_LC-MS/MS kw_DDA kw_DIA kw_label_free kw_untargeted_proteomics",
    "dm_qc_strategy": "FIRST kw_QC / kw_pooled_QC",
    "dm_pooled_qc": "FIRST kw_QC / kw_pooled_QC",
    "dm_normalization_scaling": "PAIR kw_normalization / kw_scaling",
    "dm_missing_values": "COUNT kw_imputation",
    "dm_multiple_testing": "FIRST kw_FDR n_fdr / kw_Benjamini-Hochberg",
    "dm_effect_sizes": "PAIR kw_fold_change / kw_log2FC",
    "dm_pca_exploratory": "BOTH kw_PCA / kw_PLS-DA kw_OPLS-DA",
    "dm_pca_caution": "GATE kw_PCA / aud_caution aud_uncertainty",
    "dm_significant_proteins": "OVER aud_significant / n_protein_mentions",
    "dm_annotation_uncertainty": "COUNT aud_annotation",
    "dm_avoid_overclaiming": "PAIR aud_caution / aud_annotation",
    "dm_pathway_go": "PAIR kw_pathway_analysis kw_KEGG kw_GO_enrichment kw_GSEA kw_Reactome n_pathway_mentions / bio_kinase bio_transcription_factor bio_mitochondrial bio_immune bio_PTM",
    "dm_biological_mechanism": "PAIR aud_mechanism / aud_plausibility",
    "dm_limitations": "COUNT aud_limitations",
    "dm_reproducible_code_tables": "PAIR n_code_blocks / n_tables",
}
METABOLITE_RUBRIC = {
    "dm_lcms_context": "COUNT kw_LC-MS kw_LC-MS/MS kw_HILIC kw_untargeted_metabolomics",
    "dm_qc_strategy": "FIRST kw_QC / kw_pooled_QC",
    "dm_pooled_qc": "FIRST kw_QC / kw_pooled_QC",
    "dm_normalization_scaling": "PAIR kw_normalization / kw_scaling",
    "dm_missing_values": "COUNT kw_imputation",
    "dm_multiple_testing": "FIRST kw_FDR n_fdr / kw_Benjamini-Hochberg",
    "dm_effect_sizes": "PAIR kw_fold_change / kw_log2FC",
    "dm_pca_exploratory": "BOTH kw_PCA / kw_PLS-DA kw_OPLS-DA",
    "dm_pca_caution": "GATE kw_PCA / aud_caution aud_uncertainty",
    "dm_significant_features": "OVER aud_significant / n_metabolite_mentions",
    "dm_annotation_uncertainty": "COUNT aud_annotation",
    "dm_avoid_overclaiming": "PAIR aud_caution / aud_annotation",
    "dm_pathway_class": "PAIR kw_pathway_analysis kw_KEGG n_pathway_mentions / bio_lipid bio_amino_acid bio_fatty_acid bio_sphingolipid",
    "dm_biological_mechanism": "PAIR aud_mechanism / aud_plausibility",
    "dm_limitations": "COUNT aud_limitations",
    "dm_reproducible_code_tables": "PAIR n_code_blocks / n_tables",
}


@dataclass(frozen=True)
class Scheme:
    """How a modality's runs are scored, and which term its entities are counted by."""

    entity: str
    depth: dict[str, str]
    rubric: dict[str, str]
    process: dict[str, str] = field(default_factory=lambda: PROCESS)
    result: dict[str, str] = field(default_factory=lambda: RESULT)

    @property
    def components(self) -> dict[str, str]:
        return self.process | self.result | self.depth


SCHEMES = {
    "transcriptomics": Scheme("gene", DEPTH, RUBRIC),
    "proteomics": Scheme("protein", PROTEIN_DEPTH, PROTEIN_RUBRIC),
    "metabolomics": Scheme("metabolite", METABOLITE_DEPTH, METABOLITE_RUBRIC),
}
TRANSCRIPTS = SCHEMES["transcriptomics"]


def component_sql(inputs: str, known: set[str]) -> str:
    """Any input beyond its threshold, as SQL that Spark and DuckDB read alike once names are quoted; features that aren't ``known`` count as 0."""
    parts = [(n, t or 0) for n, _, t in (x.partition(">") for x in inputs.split()) if n in known]
    return "CASE WHEN " + (" OR ".join(f'"{n}" > {t}' for n, t in parts) or "false") + " THEN 1 ELSE 0 END"


def grade_sql(rule: str, known: set[str]) -> str:
    kind, _, rest = rule.partition(" ")
    sums = ["(" + (" + ".join(f'"{n}"' for n in group.split() if n in known) or "0") + ")" for group in rest.split(" / ")]
    a, b = sums[0], sums[-1]
    one, two = {
        "COUNT": (f"{a} = 1", f"{a} >= 2"),
        "PAIR": (f"({a} > 0) <> ({b} > 0)", f"{a} > 0 AND {b} > 0"),
        "FIRST": (f"{a} > 0 AND {b} = 0", f"{b} > 0"),
        "BOTH": (f"{a} > 0 AND {b} = 0", f"{a} > 0 AND {b} > 0"),
        "GATE": (f"{a} > 0 AND {b} = 1", f"{a} > 0 AND {b} >= 2"),
        "OVER": (f"{a} > 0 AND {b} <= 5", f"{a} > 0 AND {b} > 5"),
    }[kind]
    return f"CASE WHEN {two} THEN 2 WHEN {one} THEN 1 ELSE 0 END"


def _expr(sql: str) -> Column:
    return F.expr(sql.replace('"', "`"))


def components(features: DataFrame, scheme: Scheme = TRANSCRIPTS) -> DataFrame:
    """``agent, run`` and all binary components."""
    known = set(features.columns)
    return features.select("agent", "run", *(_expr(component_sql(x, known)).alias(c) for c, x in scheme.components.items()))


def mean_score(names: list[str]) -> Column:
    """Mean of components times 100, rounded half-even to two places."""
    return F.bround(sum(F.col(n) for n in names) / len(names) * 100, 2)


def run_scores(parts: DataFrame, without: tuple[str, ...] = (), scheme: Scheme = TRANSCRIPTS) -> DataFrame:
    """``agent, run, R, P, D, AgentScore`` from components, without some of them if asked."""
    pick = lambda group: [n for n in group if n not in without]
    scored = parts.select("agent", "run", mean_score(pick(scheme.result)).alias("R"), mean_score(pick(scheme.process)).alias("P"), mean_score(pick(scheme.depth)).alias("D"))
    return scored.withColumn("AgentScore", F.col("P") * (0.50 + 0.30 * F.col("D") / 100 + 0.20 * F.col("R") / 100))


def decomposition(parts: DataFrame, scheme: Scheme = TRANSCRIPTS) -> DataFrame:
    """All components with the numbers of those that hold, by group and in all."""
    sums = {f"{name}_subtotal": sum(F.col(c) for c in group) for name, group in (("P", scheme.process), ("R", scheme.result), ("D", scheme.depth))}
    return parts.withColumns(sums).withColumn("total", sum(F.col(c) for c in sums))


def rubric(features: DataFrame, scheme: Scheme = TRANSCRIPTS) -> DataFrame:
    """``agent, run``, a grade of 0 to 2 for each criterion and ``DomainScore`` in percent."""
    known = set(features.columns)
    graded = features.select("agent", "run", *(_expr(grade_sql(rule, known)).alias(c) for c, rule in scheme.rubric.items()))
    return graded.withColumn("DomainScore", F.bround(sum(F.col(c) for c in scheme.rubric) * 100.0 / (2 * len(scheme.rubric)), 2))


def rank_average(value: str) -> Column:
    """Descending rank, ties at their average, truncated to a whole number; over all rows (producers are few)."""
    return F.floor(F.rank().over(Window.orderBy(F.desc(value))) + (F.count("*").over(Window.partitionBy(value)) - 1) / 2.0).cast("bigint")


def summary(scores: DataFrame, value: str) -> DataFrame:
    """Per agent mean, standard deviation (0 for one run), standard error, runs and rank."""
    per = scores.groupBy("agent").agg(F.bround(F.avg(value), 6).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count("*").alias("n_runs"))
    return per.withColumn("sem", F.col("sd") / F.sqrt("n_runs")).withColumn("rank", rank_average("mean"))
