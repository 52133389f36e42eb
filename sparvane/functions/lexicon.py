"""Term lexicons compiled to column expressions: counts of case-insensitive pattern matches."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms and patterns of the transcriptomics lexicons.  A line is a term and
# its patterns, two blanks apart.
METHODS = r"""
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
FastQC  \bFastQC\b
MultiQC  \bMultiQC\b
batch_correction  \bbatch\s+correction\b  \bComBat\b  \bRUV\b
normalization  \bnormali[sz]ation\b  \bnormali[sz]e[d]?\b  \bTMM\b
scaling  \bscaling\b  \bunit\s+variance\b  \bvst\b  \brlog\b
imputation  \bimput(ation|ed|e)\b
pathway_analysis  \bpathway\s+analysis\b  \bpathway\s+enrichment\b
GO_enrichment  \bGO\s+enrichment\b  \bgene\s+ontology\s+enrichment\b
GSEA  \bGSEA\b  \bgene\s+set\s+enrichment\b
GSVA  \bGSVA\b
KEGG  \bKEGG\b
Reactome  \bReactome\b
MSigDB  \bMSigDB\b  \bmolecular\s+signatures\s+database\b
clusterProfiler  \bclusterProfiler\b
Ensembl  \bEnsembl\b
GENCODE  \bGENCODE\b
DESeq2  \bDESeq2\b
edgeR  \bedgeR\b
limma  \blimma\b  \bvoom\b
RNA-seq  \bRNA[-\s]?seq\b  \bRNA\s+sequencing\b
bulk_RNA-seq  \bbulk\s+RNA[-\s]?seq\b
transcriptomics  \btranscriptomics\b  \btranscriptome\b
STAR  \bSTAR\b
HISAT2  \bHISAT2\b
salmon  \bsalmon\b
kallisto  \bkallisto\b
featureCounts  \bfeatureCounts\b  \bfeature\s+counts\b
HTSeq  \bHTSeq\b
TPM  \bTPM\b
FPKM  \bFPKM\b
RPKM  \bRPKM\b
counts  \b(raw\s+)?counts\b  \bcount\s+matrix\b
differential_expression  \bdifferential\s+expression\b  \bDEG[s]?\b  \bdifferentially\s+expressed\s+gene[s]?\b
"""
BIOLOGY = r"""
gene  \bgene[s]?\b
transcript  \btranscript[s]?\b  \bisoform[s]?\b
pathway  \bpathway[s]?\b
GO  \bgene\s+ontology\b  \bGO\s+term[s]?\b
transcription_factor  \btranscription\s+factor[s]?\b
immune  \bimmune\b  \bimmunolog
inflammation  \binflammation\b  \binflammatory\b
cell_cycle  \bcell\s+cycle\b
apoptosis  \bapoptosis\b  \bapoptotic\b
metabolism  \bmetaboli(sm|c)\b
signaling  \bsignal(ing| transduction)\b
oxidative_stress  \boxidative\s+stress\b
biomarker  \bbiomarker[s]?\b
lncRNA  \blncRNA[s]?\b  \blong\s+non[-\s]coding\s+RNA\b
miRNA  \bmiRNA[s]?\b  \bmicroRNA[s]?\b
splicing  \bsplic(ing|ed|e)\b  \balternative\s+splicing\b
epigenetic  \bepigenetic\b  \bDNA\s+methylation\b  \bhistone\b
feature_selection  \bfeature\s+selection\b
"""
AUDIT = r"""
preprocessing  \bpre[-\s]?process  \bdata\s+cleaning\b  \btrim(ming)?\b  \badapt(er)?\s+remov  \balignment\b  \bmapping\b  \bquantification\b  \bcount\s+matrix\b
significant  \bsignificant  \bsignif\.  \bdifferentially\s+expressed\b  \bDEG[s]?\b
limitations  \blimitation  \bcaveat  \bshortcoming
mechanism  \bmechanis  \bmode\s+of\s+action\b
plausibility  \bplausib  \bbiologically\s+(meaningful|relevant)\b
annotation  \bannotation  \bputativ  \btentative  \blevel\s+[1-3]\b  \bconfidence\s+level\b  \bidentification\s+confidence\b
consistency  \bconsisten  \breproducib  \bacross\s+runs\b  \bacross\s+replicates\b
uncertainty  \buncertain  \bconfidence\s+interval  \bvariabilit
exploratory  \bexploratory\b  \bunsupervised\b
caution  \bcaution  \bshould\s+be\s+interpreted  \bnot\s+conclusive\b  \bpreliminary\b  \bovercla
"""
STRUCTURE = {
    "n_sheets": r"(?m)^=== Sheet:",
    "n_marks": r"(?i)\|[-\s|]+\||\t.*\t|<table",
    "n_images": r"(?i)!\[.*?\]\(|<img\s|\.png\b|\.jpg\b|\.jpeg\b|\.svg\b",
    "n_numeric": r"\b\d+(?:[.,]\d+)*\b",
    "n_pvalues": r"(?i)\bp[-\s]?val",
    "n_fdr": r"(?i)\bFDR\b",
    "n_code_blocks": r"(?i)```|~~~|<code>",
}


def literal(pattern: str) -> str:
    """The longest run of letters and digits that every match holds; '' if none has two."""
    plain = re.sub(r"\((?:[^()])*\)\??|\[[^\]]*\][?+*]?|\\[bsdw][+*?]?|\\.", " ", pattern)
    runs = re.findall(r"[A-Za-z0-9]{2,}", re.sub(r"[A-Za-z0-9]\?", " ", plain))
    return max(runs, key=len, default="") if "|" not in plain else ""


# What a text must hold in lower case for any match; the other patterns match in most texts.
NEEDS = {"n_sheets": ("=== sheet:",), "n_marks": ("|", "\t", "<table"), "n_images": ("![", "<img", ".png", ".jpg", ".jpeg", ".svg"), "n_pvalues": ("val",), "n_fdr": ("fdr",), "n_code_blocks": ("```", "~~~", "<code>")}


def folded(text: Column) -> Column:
    """Lower case, with the letters that case-insensitive ASCII patterns match beyond ASCII: long s, Kelvin sign, i without and with its dot."""
    odd = reduce(or_, (text.contains(x) for x in "\u017f\u212a\u0131\u0130"))
    return F.when(odd, F.lower(F.translate(text, "\u017f\u212a\u0131\u0130", "skii"))).otherwise(F.lower(text))


GRAM, BITS, TOGETHER = 4, 5, 1 << 18  # letters of a part that are looked up, bits of each, characters looked up at once
CODES = bytearray(256)  # letters in either case; digits share five codes; all else is 0
for _c in range(36):
    for _x in ("0123456789abcdefghijklmnopqrstuvwxyz"[_c], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[_c]):
        CODES[ord(_x)] = _c - 9 if _c > 9 else 27 + _c % 5
WHITE, ASCII = b"\t\n\x0b\x0c\r ", bytes(range(128))
KINDS = bytes(0 if c in WHITE else 2 if chr(c) in "0123456789" else 1 for c in range(256))  # white space, digits, all else


class Finder:
    """Which parts (letters and digits) texts hold: where a part's first letters stand, by one table for all parts, it is searched for."""

    def __init__(self, parts: list[str]) -> None:
        self.by_code: dict[int, list[str]] = {}
        for part in parts:
            head, free = part[:GRAM], BITS * max(GRAM - len(part), 0)
            code = sum(int(CODES[ord(x)]) << BITS * (len(head) - 1 - i) for i, x in enumerate(head)) << free
            for more in range(1 << free):
                self.by_code.setdefault(code | more, []).append(part)
        self.table = np.zeros(1 << GRAM * BITS, bool)
        self.table[list(self.by_code)] = True

    def held(self, lows: list[str], data: list[bytes]) -> list[set[str]]:
        """The parts of each of ``lows``; ``data``: the same in UTF-8."""
        found: list[set[str]] = [set() for _ in lows]
        codes = np.frombuffer((b"".join(x + b"\n" * GRAM for x in data) + b"\n" * GRAM).translate(CODES), np.uint8)
        pairs = np.left_shift(codes[:-1], BITS, dtype=np.uint16) | codes[1:]
        grams = np.left_shift(pairs[:-2], 2 * BITS, dtype=np.intp) | pairs[2:]
        at = np.flatnonzero(self.table.take(grams))
        texts = np.searchsorted(np.cumsum([len(x) + GRAM for x in data]), at, "right")
        for key in np.unique(texts.astype(np.int64) << GRAM * BITS | grams[at]).tolist():
            k = key >> GRAM * BITS
            if k < len(lows):
                found[k].update(p for p in self.by_code[key & (1 << GRAM * BITS) - 1] if p not in found[k] and p in lows[k])
        return found


def spaced(low: str, data: bytes) -> bytes | None:
    """``data``, a text in UTF-8, with ASCII white space alone; None if it has digits beyond ASCII."""
    if low.isascii():
        return data
    odd = set(data.translate(None, ASCII).decode("utf-8", "replace"))
    if any(c.isdecimal() for c in odd):
        return None
    for c in odd:
        if c.isspace():
            low, data = low.replace(c, " "), b""
    return data or low.encode("utf-8", "replace")


def worded(data: list[bytes]) -> tuple[list[str], list[int]]:
    """Of each text in UTF-8 without white space beyond ASCII, the words with digits, and how many words there are."""
    kinds = np.frombuffer(b"".join(x + b"\n" for x in data).translate(KINDS), np.uint8)
    ends = np.flatnonzero(kinds == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.cumsum([len(x) + 1 for x in data])
    real = np.concatenate([[0], np.cumsum(ends > begins)])[np.searchsorted(ends, bounds - 1, "right")]
    digits = np.unique(np.searchsorted(ends, np.flatnonzero(kinds == 2)))
    starts = np.concatenate([[0], bounds[:-1]])
    owners = np.searchsorted(bounds, begins[digits], "right")
    found: list[list[bytes]] = [[] for _ in data]
    for k, i, j in zip(owners.tolist(), (begins[digits] - starts[owners]).tolist(), (ends[digits] - starts[owners]).tolist()):
        found[k].append(data[k][i:j])
    return [b" ".join(x).decode("utf-8", "replace") for x in found], np.diff(real, prepend=0).tolist()


def fold(t: str) -> str:
    """:func:`folded` of a string, in so far as ASCII letters go."""
    return t.lower() if t.isascii() else t.replace("\u0130", "i").lower().replace("\u017f", "s").replace("\u0131", "i")


def sentences(t: str, low: str, parts: list[str]) -> str:
    """Those of a text's sentences, up to and with the full stop, that hold one of the parts, in their order."""
    spans = set()
    for p in parts:
        i = low.find(p)
        while i >= 0:
            end = low.find(".", i) + 1 or len(low)
            spans.add((low.rfind(".", 0, i) + 1, end))
            i = low.find(p, end)
    return "".join(t[a:b] for a, b in sorted(spans)) if len(low) == len(t) else t


def reading(text: Column, lexicons: tuple[Lexicon, ...]) -> Column:
    """What one pass over a text finds: ``held, near, numbers, n_words, n_chars, n_lines``.

    ``held``: the literal parts of the families' patterns, and of structures, that the text holds, in lower case.  ``near``:
    its sentences that hold a part of a family's pattern, of n_pvalues or n_fdr; as no match goes beyond a full stop, these
    have as many matches as all of the text.  ``numbers``: the words with digits, in lower case.  Python and NumPy, as Spark's ``contains``
    compares byte by byte, and a pattern that takes all cases of Unicode some 30 ns a character.
    """
    patterns = [p for x in lexicons for patterns in x.terms.values() for p in patterns]
    apart = not any(re.search(r"\\\.(?!$)|(?<!\\)\.|\[\^|\\[SWD]", p) for p in patterns)  # else a match may go beyond a full stop
    parts = {literal(p).lower() for p in patterns} - {""} | {*NEEDS["n_pvalues"], *NEEDS["n_fdr"]}
    words_of = {x: re.findall("[a-z]+", x) for needs in NEEDS.values() for x in needs}
    hints = {x: w[0] for x, w in words_of.items() if w and x not in parts}
    signs = [x for x, w in words_of.items() if not w]
    digit, white = re.compile(r"\d"), re.compile(r"[^\S\x1c-\x1f]+")  # the four are white space in Python, but not in Unicode and in patterns

    @F.pandas_udf("held string, near string, numbers string, n_words bigint, n_chars bigint, n_lines bigint")
    def read(texts: pd.Series) -> pd.DataFrame:
        finder, values, rows = Finder(sorted(parts | set(hints.values()))), ["" if t is None else t for t in texts], []
        bounds = np.cumsum([0] + [len(t) for t in values]) // TOGETHER
        for chunk in np.split(np.arange(len(values)), np.flatnonzero(np.diff(bounds[:-1])) + 1):
            lows = [fold(values[i]) for i in chunk]
            data = [low.encode("utf-8", "replace") for low in lows]
            plain = [spaced(*x) for x in zip(lows, data)]
            for i, low, found, text, numbers, n_words in zip(chunk, lows, finder.held(lows, data), plain, *worded([x or b"" for x in plain])):
                t = values[i]
                held = sorted(found & parts)
                marks = [x for x, hint in hints.items() if hint in found and x in low] + [x for x in signs if x in t]
                if text is None:
                    words = white.split(low)
                    numbers, n_words = " ".join([w for w in words if digit.search(w)]), sum(map(bool, words))
                rows.append(("\n".join(held + marks), sentences(t, low, held) if apart else t, numbers, n_words, len(t), t.count("\n") + 1 if t else 0))
        return pd.DataFrame(rows, columns=["held", "near", "numbers", "n_words", "n_chars", "n_lines"])

    return read(F.coalesce(text, F.lit("")))


def clues(text: Column, lexicons: tuple[Lexicon, ...]) -> Column:
    """The literal parts of the families' patterns, and of structures, that a text holds, in lower case (see :func:`reading`)."""
    return reading(text, lexicons)["held"]


@dataclass(frozen=True)
class Lexicon:
    """A family of terms, each with its patterns."""

    family: str
    terms: dict[str, tuple[str, ...]]

    @classmethod
    def parse(cls, family: str, lines: str) -> Lexicon:
        rows = [line.split("  ") for line in lines.strip("\n").split("\n")]
        return cls(family, {term: tuple(patterns) for term, *patterns in rows})

    def count(self, term: str, text: Column, low: Column | None = None) -> Column:
        """Non-overlapping matches of all patterns; a pattern runs only where its literal part stands, in any case that Unicode knows.

        ``low``: a column with the text's :func:`clues`, or all of it :func:`folded`; without it every pattern folds the text again.
        """
        low = folded(text) if low is None else low
        total = F.lit(0)
        for pattern in self.terms[term]:
            matches = F.regexp_count(text, F.lit(f"(?iuUd){pattern}"))
            stem = literal(pattern)
            total = total + (F.when(low.contains(stem.lower()), matches).otherwise(0) if stem else matches)
        return F.coalesce(total, F.lit(0)).cast("bigint")

    def counts(self, text: Column, low: Column | None = None) -> dict[str, Column]:
        return {f"{self.family}_{term}": self.count(term, text, low) for term in self.terms}

    def sql(self, term: str, text: str) -> str:
        """The same count for DuckDB; ``text`` must have its non-ASCII letters replaced by ASCII ones."""
        return "(" + " + ".join(f"len(regexp_extract_all({text}, '(?i){p}'))" for p in self.terms[term]) + ")"


KEYWORDS, TERMS, AUDITS = Lexicon.parse("kw", METHODS), Lexicon.parse("bio", BIOLOGY), Lexicon.parse("aud", AUDIT)
ALL = (KEYWORDS, TERMS, AUDITS)


def structure(text: Column, low: Column | None = None, read: Column | None = None) -> dict[str, Column]:
    """Characters, words, lines, sheets, tables, images, numbers, p-values, FDR and code marks of a text.

    ``low`` as in :meth:`Lexicon.count`; ``read``: a column with the text's :func:`reading`, whose parts stand for the whole text where they can.
    """
    low = folded(text) if low is None else low
    parts = {} if read is None else {"n_numeric": read["numbers"], "n_pvalues": read["near"], "n_fdr": read["near"]}
    count = lambda p, t=text: F.regexp_count(t, F.lit("(?Ud)" + p)).cast("bigint")
    holds = lambda name: reduce(or_, (low.contains(x) for x in NEEDS[name]))
    counts = {name: count(p, parts.get(name, text)) for name, p in STRUCTURE.items()}
    found = {name: F.coalesce(F.when(holds(name), c) if name in NEEDS else c, F.lit(0).cast("bigint")) for name, c in counts.items()}
    sheets, marks = found.pop("n_sheets"), found.pop("n_marks")
    plain = {
        "n_chars": F.coalesce(F.char_length(text).cast("bigint"), F.lit(0).cast("bigint")),
        "n_words": F.coalesce(count(r"\S+"), F.lit(0).cast("bigint")),
        "n_lines": F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("bigint"),
    }
    return {
        **(plain if read is None else {n: read[n] for n in plain}),
        "n_sheets": sheets,
        "n_tables": F.when(sheets > 0, sheets).otherwise(marks),
        **found,
    }
