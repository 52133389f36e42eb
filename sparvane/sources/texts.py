"""Texts of files as column expressions over their name and content, for formats that need no parser of their own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of a bibliography's entries and fields, and the fields that come first.
ENTRY = r"(?si)@(\w+)\s*\{\s*([^,\s]+)\s*,\s*(.*?)\n\}"
FIELD = r"(?s)(\w+)\s*=\s*(?:\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}|\"([^\"]*)\"|(\d+))"
FIRST_FIELDS = ("title", "author", "year", "journal", "booktitle", "abstract", "keywords", "doi")
# Shapes of LaTeX helper files' lines, depths of an outline's levels.
CITATION, LABEL = r"\\citation\{([^}]+)\}", r"\\newlabel\{([^}]+)\}\{\{([^}]*)\}\{([^}]*)\}"
CONTENTS = r"(?s)\\contentsline\s*\{(\w+)\}\s*\{(?:\\numberline\s*\{[^}]*\}\s*)?([^}]+)\}\s*\{(\d+)\}"
BOOKMARK = r"(?s)\\BOOKMARK\s*\[(-?\d+)\]\[-\]\{[^}]*\}\{(.*?)\}\{[^}]*\}"
DEPTHS = {"part": 0, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
MOST_LABELS = 100
LEAST_LINE, LEAST_PRINTABLE = 4, 0.70


def plain(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1, which never fails; line ends as a text file's reader gives them."""
    text = content.cast("string")
    return F.regexp_replace(F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1")), "\r\n?", "\n")


def readable_lines(content: Column) -> Column:
    """Lines of LEAST_LINE characters or more of which LEAST_PRINTABLE are visible, blanks aside; empty without any."""
    def readable(line: Column) -> Column:
        solid = F.translate(line, " \t", "")
        return (F.length(line) >= LEAST_LINE) & (solid != "") & (F.length(F.regexp_replace(solid, r"[\p{C}\p{Z}]", "")) >= LEAST_PRINTABLE * F.length(solid))

    lines = F.transform(F.split(F.make_valid_utf8(content.cast("string")), "\n"), lambda x: F.regexp_replace(x, r"[\s\p{Z}\x1c-\x1f\x85]+$", ""))
    return F.array_join(F.filter(lines, readable), "\n")


def generic(name: Column, content: Column) -> Column:
    """Readable lines, or a stub."""
    return F.coalesce(F.nullif(readable_lines(content), F.lit("")), F.concat(F.lit("[BINARY FILE: "), name, F.lit(" — no readable text found]")))


def anything(name: Column, content: Column) -> Column:
    """Unknown formats: their text, readable lines if there is none."""
    text = plain(content)
    return F.when(text.rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"), text).otherwise(generic(name, content))


def _found(text: Column, pattern: str, *groups: int) -> Column:
    """Structs ``g1, g2..`` of the groups of each match."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in groups))


def _header(kind: str, name: Column, entries: Column | None = None) -> Column:
    count = [] if entries is None else [F.lit(" | entries="), F.size(entries).cast("string")]
    return F.concat(F.lit(f"[{kind}: "), name, *count, F.lit("]"))


def latex_aux(name: Column, content: Column) -> Column:
    """Sorted citations and the first MOST_LABELS labels; raw text with neither."""
    text = plain(content)
    cited = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: F.split(x, ","))), lambda x: F.trim(x))))
    labels = _found(text, LABEL, 1, 2)
    shown = F.transform(F.slice(labels, 1, MOST_LABELS), lambda x: F.concat(F.lit("  "), x["g1"], F.lit(" → page "), x["g2"]))
    some, more = F.size(cited) > 0, F.size(labels) > 0
    lines = F.concat(
        F.array(_header("LATEX AUX", name)), F.when(some, F.array(F.concat(F.lit("Citations ("), F.size(cited).cast("string"), F.lit("): "), F.array_join(cited, ", ")))).otherwise(F.array().cast("array<string>")),
        F.when(more, F.concat(F.array(F.concat(F.lit("\nCross-reference labels ("), F.size(labels).cast("string"), F.lit("):"))), shown)).otherwise(F.array().cast("array<string>")),
    )
    return F.when(some | more, F.array_join(lines, "\n")).otherwise(text)


def latex_toc(name: Column, content: Column) -> Column:
    """The outline, indented by depth, without LaTeX commands; raw text without entries."""
    text = plain(content)
    entries = _found(text, CONTENTS, 1, 2, 3)
    depths = F.create_map(*(F.lit(x) for pair in DEPTHS.items() for x in pair))
    depth = lambda level: F.coalesce(F.try_element_at(depths, F.lower(level)), F.lit(2))
    line = lambda x: F.concat(F.repeat(F.lit("  "), depth(x["g1"])), x["g1"], F.lit(": "), F.trim(F.regexp_replace(x["g2"], r"\\[a-zA-Z]+\s*", "")), F.lit(" (p."), x["g3"], F.lit(")"))
    return F.when(F.size(entries) > 0, F.array_join(F.concat(F.array(_header("LATEX TOC", name, entries)), F.transform(entries, line)), "\n")).otherwise(text)


# What escapes in bookmarks stand for: the mark of UTF-16, its zero bytes before ASCII, and blanks.
ESCAPES = {r"\376\377": "", r"\000": "", r"\040": " "}


def bookmark_title(raw: Column) -> Column:
    """A bookmark's title token by token: known escapes are what they stand for, commands go, all else stays."""
    tokens = F.regexp_extract_all(raw, F.lit(r"(?s)\\376\\377|\\[0-7]{3}|\\[a-zA-Z]+\s*|."), F.lit(0))
    known = F.create_map(*(F.lit(x) for pair in ESCAPES.items() for x in pair))
    meant = lambda t: F.coalesce(F.try_element_at(known, t), F.when(t.rlike(r"^\\[a-zA-Z]"), "").otherwise(t))
    return F.trim(F.array_join(F.transform(tokens, meant), ""))


def latex_out(name: Column, content: Column) -> Column:
    """Bookmarks, indented by depth; raw text without any."""
    text = plain(content)
    entries = _found(text, BOOKMARK, 1, 2)
    titled = F.filter(F.transform(entries, lambda x: F.struct(F.greatest(x["g1"].cast("int"), F.lit(0)).alias("depth"), bookmark_title(x["g2"]).alias("title"))), lambda x: x["title"] != "")
    lines = F.transform(titled, lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), x["title"]))
    return F.when(F.size(entries) > 0, F.array_join(F.concat(F.array(_header("LATEX BOOKMARKS", name, entries), F.lit("Document outline:")), lines), "\n")).otherwise(text)


def bibliography(name: Column, content: Column) -> Column:
    """A block for each entry: kind, key and its fields, telling ones first; of a field that stands twice the last value.  Raw text without entries."""
    text = plain(content)
    entries = _found(text, ENTRY, 1, 2, 3)

    def fields(body: Column) -> Column:
        found = F.transform(_found(body, FIELD, 1, 2, 3, 4), lambda x: F.struct(F.lower(x["g1"]).alias("k"), F.translate(F.trim(F.regexp_replace(F.concat(x["g2"], x["g3"], x["g4"]), r"^\s+|\s+$", "")), "\n", " ").alias("v")))
        names = F.array_distinct(F.transform(found, lambda x: x["k"]))
        first = F.filter(F.array(*map(F.lit, FIRST_FIELDS)), lambda k: F.array_contains(names, k))
        ordered = F.concat(first, F.filter(names, lambda k: ~k.isin(*FIRST_FIELDS)))
        return F.transform(ordered, lambda k: F.concat(F.lit("  "), k, F.lit(": "), F.element_at(F.filter(found, lambda x: x["k"] == k), -1)["v"]))

    block = lambda x: F.array_join(F.concat(F.array(F.concat(F.lit("\n@"), F.upper(x["g1"]), F.lit(" {"), x["g2"], F.lit("}"))), fields(x["g3"])), "\n")
    return F.when(F.size(entries) > 0, F.array_join(F.concat(F.array(_header("BIBTEX FILE", name, entries)), F.transform(entries, block)), "\n")).otherwise(text)


def _stub(kind: str, note: str = "") -> object:
    return lambda name, content: F.concat(F.lit(f"[{kind}: "), name, F.lit(f"{note}]"))


_BY_READER = [
    (".txt .md .log .tex .xml .html .htm .py .r .rmd .sh .bash .sty .bbl .blg", lambda name, content: plain(content)),
    (".aux", latex_aux), (".toc", latex_toc), (".out", latex_out), (".bib", bibliography),
    (".pdf", _stub("PDF FILE", " — install PyMuPDF to parse")), (".png .jpg .jpeg .gif .tiff .bmp", _stub("IMAGE FILE")),
    (".parquet .npy .feather .rds", lambda name, content: F.concat(F.lit("[BINARY DATA FILE: "), name, F.lit(", "), F.format_string("%.1f", F.octet_length(content) / 1_048_576), F.lit(" MB]"))),
]


def text_of(name: Column, extension: Column, content: Column, parsed: Column, parsed_extensions: list[str]) -> Column:
    """A file's text by its extension; ``parsed`` where a parser reads it, generic lines where that finds the format broken (null)."""
    out = F.when(extension.isin(*parsed_extensions), F.coalesce(parsed, generic(name, content)))
    for extensions, reader in _BY_READER:
        out = out.when(extension.isin(*extensions.split()), reader(name, content))
    return out.otherwise(anything(name, content))
