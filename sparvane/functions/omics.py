"""Lexicons of proteomics and metabolomics; :mod:`sparvane.functions.lexicon` has the transcriptomics ones."""

from __future__ import annotations

from sparvane.functions.lexicon import AUDITS, Lexicon

# Terms and patterns, a line a term, two blanks apart.
PROTEIN_METHODS = r"""
PCA  \bPCA\b  principal component analysis
PLS-DA  \bPLS[-\s]?DA\b
OPLS-DA  \bOPLS[-\s]?DA\b
t-test  \bt[-\s]?test\b
Mann-Whitney  \bMann[-\s]Whitney\b
Wilcoxon  \bWilcoxon\b
ANOVA  \bANOVA\b
FDR  \bFDR\b
Benjamini-Hochberg  \bBenjamini[-\s]Hochberg\b  \bBH\s+correction\b
fold_change  \bfold\s+change\b  \bFC\b
log2FC  \blog2?FC\b  \blog[_\s]?fold\s+change\b
volcano_plot  \bvolcano\s+plot\b
heatmap  \bheatmap\b
QC  \bQC\b  \bquality\s+control\b
pooled_QC  \bpooled\s+QC\b
batch_correction  \bbatch\s+correction\b
normalization  \bnormali[sz]ation\b  \bnormali[sz]e[d]?\b
scaling  \bscaling\b  \bunit\s+variance\b  \bauv\b
imputation  \bimput(ation|ed|e)\b
pathway_analysis  \bpathway\s+analysis\b  \bpathway\s+enrichment\b
GO_enrichment  \bGO\s+enrichment\b  \bgene\s+ontology\s+enrichment\b
GSEA  \bGSEA\b  \bgene\s+set\s+enrichment\b
KEGG  \bKEGG\b
Reactome  \bReactome\b
STRING  \bSTRING\b
UniProt  \bUniProt\b
MaxQuant  \bMaxQuant\b
Proteome_Discoverer  \bProteome\s+Discoverer\b
Perseus  \bPerseus\b
MSstats  \bMSstats\b
limma  \blimma\b
Percolator  \bPercolator\b
LC-MS  \bLC[-\s]?MS\b
LC-MS/MS  \bLC[-\s]?MS/MS\b
DDA  \bDDA\b  \bdata[-\s]dependent\s+acquisition\b
DIA  \bDIA\b  \bdata[-\s]independent\s+acquisition\b
label_free  \blabel[-\s]free\b  \bLFQ\b  \bMaxLFQ\b
iTRAQ  \biTRAQ\b
TMT  \bTMT\b  \btandem\s+mass\s+tag\b
SILAC  \bSILAC\b
peptide  \bpeptide[s]?\b
PSM  \bPSM[s]?\b  \bpeptide[-\s]spectrum\s+match
protein_inference  \bprotein\s+inference\b  \bprotein\s+group[s]?\b
untargeted_proteomics  \buntargeted\s+proteomics\b  \blabel[-\s]free\s+proteomics\b
"""
PROTEIN_BIOLOGY = r"""
protein  \bprotein[s]?\b
peptide  \bpeptide[s]?\b
pathway  \bpathway[s]?\b
GO  \bgene\s+ontology\b  \bGO\s+term[s]?\b
kinase  \bkinase[s]?\b
transcription_factor  \btranscription\s+factor[s]?\b
extracellular_matrix  \bextracellular\s+matrix\b  \bECM\b
mitochondrial  \bmitochondri(al|a)\b
ribosomal  \bribosomal\b  \bribosome[s]?\b
immune  \bimmune\b  \bimmunolog
inflammation  \binflammation\b  \binflammatory\b
oxidative_stress  \boxidative\s+stress\b
biomarker  \bbiomarker[s]?\b
PTM  \bPTM[s]?\b  \bpost[-\s]translational\s+modification
phosphorylation  \bphosphorylat
signaling  \bsignal(ing| transduction)\b
proteostasis  \bproteostasis\b  \bprotein\s+homeostasis\b
apoptosis  \bapoptosis\b  \bapoptotic\b
feature_selection  \bfeature\s+selection\b
"""
METABOLITE_METHODS = r"""
PCA  \bPCA\b  principal component analysis
PLS-DA  \bPLS[-\s]?DA\b
OPLS-DA  \bOPLS[-\s]?DA\b
t-test  \bt[-\s]?test\b
Mann-Whitney  \bMann[-\s]Whitney\b
Wilcoxon  \bWilcoxon\b
ANOVA  \bANOVA\b
FDR  \bFDR\b
Benjamini-Hochberg  \bBenjamini[-\s]Hochberg\b  \bBH\s+correction\b
fold_change  \bfold\s+change\b  \bFC\b
log2FC  \blog2?FC\b  \blog[_\s]?fold\s+change\b
volcano_plot  \bvolcano\s+plot\b
heatmap  \bheatmap\b
QC  \bQC\b  \bquality\s+control\b
pooled_QC  \bpooled\s+QC\b
batch_correction  \bbatch\s+correction\b
normalization  \bnormali[sz]ation\b  \bnormali[sz]e[d]?\b
scaling  \bscaling\b  \bunit\s+variance\b  \bauv\b
imputation  \bimput(ation|ed|e)\b
pathway_analysis  \bpathway\s+analysis\b  \bpathway\s+enrichment\b
KEGG  \bKEGG\b
HMDB  \bHMDB\b
MetaboAnalyst  \bMetaboAnalyst\b
LC-MS  \bLC[-\s]?MS\b
LC-MS/MS  \bLC[-\s]?MS/MS\b
HILIC  \bHILIC\b
untargeted_metabolomics  \buntargeted\s+metabolomics\b
"""
METABOLITE_BIOLOGY = r"""
metabolite  \bmetabolite[s]?\b
pathway  \bpathway[s]?\b
lipid  \blipid[s]?\b
amino_acid  \bamino\s+acid[s]?\b
fatty_acid  \bfatty\s+acid[s]?\b
sphingolipid  \bsphingolipid[s]?\b
phospholipid  \bphospholipid[s]?\b
glycolysis  \bglycolysis\b
TCA_cycle  \bTCA\s+cycle\b  \bKrebs\s+cycle\b
oxidative_stress  \boxidative\s+stress\b
biomarker  \bbiomarker[s]?\b
feature_selection  \bfeature\s+selection\b
"""

_SIGNIFICANT = (r"\bsignificant", r"\bsignif\.", r"\bdifferentially\s+abundant\b")
_PEAKS = (r"\bpre[-\s]?process", r"\bdata\s+cleaning\b", r"\bpeak\s+picking\b", r"\bdeconvolution\b", r"\bfeature\s+detection\b")
_SEARCH = (r"\bprotein\s+inference\b", r"\bpeptide\s+identification\b", r"\bspectral\s+library\b", r"\bsearch\s+engine\b")

#: Method, biology and audit lexicons by modality; audits differ in two terms.
MODALITIES = {
    "proteomics": (Lexicon.parse("kw", PROTEIN_METHODS), Lexicon.parse("bio", PROTEIN_BIOLOGY), Lexicon("aud", AUDITS.terms | {"preprocessing": _PEAKS + _SEARCH, "significant": _SIGNIFICANT})),
    "metabolomics": (Lexicon.parse("kw", METABOLITE_METHODS), Lexicon.parse("bio", METABOLITE_BIOLOGY), Lexicon("aud", AUDITS.terms | {"preprocessing": _PEAKS, "significant": _SIGNIFICANT})),
}
