"""Columns that a file's path below a tree's root tells: producer, run, kind of file, and whether to skip it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name parts of known producers, in order of precedence.
ALIASES = {"k-dense": "KDense", "k_dense": "KDense", "kdense": "KDense", "chatgpt": "ChatGPT", "biomni": "Biomni", "finch": "Finch", "fich": "Finch"}
# Folders that are no producers, folders and files that don't count.
RESERVED = ("tables", "figures", "report", "raw_archives", "benchmark_results")
IGNORED_FOLDERS = ("__macosx", "$recycle.bin", "system volume information")
IGNORED_FILES = (".ds_store", "thumbs.db", "desktop.ini")
# Extensions by kind, in order of precedence.
KINDS = {
    "image": ".png .jpg .jpeg .gif .svg .tiff .bmp",
    "table": ".csv .tsv .scv .xlsx .xls .xlsm",
    "document": ".pdf .docx .doc",
    "code": ".py .r .rmd .ipynb .sh .bash",
    "text": ".txt .md .csv .tsv .scv .json .jsonl .html .htm .py .r .rmd .ipynb .xml .log .tex .bib .bbl .blg .aux .sty .toc .out .toml",
}
# Where a name tells its run, in order of precedence.
RUNS = (r"run[_\-\s]*(\d+)", r"r(\d+)", r"(\d+)")


def folders(path: Column) -> Column:
    """The folders above a file."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def filename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def known_agent(name: Column) -> Column:
    """The producer whose alias the name holds."""
    low = F.lower(name)
    return F.coalesce(*(F.when(low.contains(alias), agent) for alias, agent in ALIASES.items()))


def agent_of_folder(name: Column) -> Column:
    """A producer by its folder: a known one, or the folder's own name; null for reserved and run folders."""
    low = F.lower(name)
    own = F.when(~name.rlike(r"(?i)^run[_\-\s]*\d+$"), name)
    return F.when((name != "") & ~low.isin(*RESERVED), F.coalesce(known_agent(name), own))


def run_of(name: Column) -> Column:
    """Number after "run", else after "r", else the first number; null without one or beyond an int."""
    found = [F.nullif(F.regexp_extract(name, f"(?i){p}", 1), F.lit("")) for p in RUNS]
    return F.coalesce(*found).try_cast("int")


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def agent_of(path: Column) -> Column:
    """Producer: the top folder, else an alias in the file's name, else one in any folder's."""
    return F.coalesce(agent_of_folder(F.get(folders(path), F.lit(0))), known_agent(filename(path)), _first(F.transform(folders(path), known_agent)))


def run_number(path: Column) -> Column:
    """Run: the second folder, else the top one, else the file's name, else any folder."""
    above = folders(path)
    return F.coalesce(run_of(F.get(above, F.lit(1))), run_of(F.get(above, F.lit(0))), run_of(filename(path)), _first(F.transform(above, run_of)))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none."""
    return F.lower(F.regexp_extract(filename(path), r"^.+(\.[^.]+)$", 1))


def file_type_of(path: Column) -> Column:
    ext = extension(path)
    return F.coalesce(*(F.when(ext.isin(*x.split()), kind) for kind, x in KINDS.items()), F.lit("other"))


def ignored(path: Column) -> Column:
    """System and hidden files, office lock files, and all below system folders and archive leftovers."""
    name = F.lower(filename(path))
    folder = F.exists(folders(path), lambda p: F.lower(p).isin(*IGNORED_FOLDERS) | F.lower(p).startswith("__macosx"))
    return folder | name.isin(*IGNORED_FILES) | reduce(lambda a, b: a | b, (name.startswith(x) for x in ("~$", ".")))
