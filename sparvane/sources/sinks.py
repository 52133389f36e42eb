"""Writes result tables: CSV files and a Markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(table: DataFrame, path: str) -> bool:
    """One CSV file with a header, nested columns as JSON; nothing (False) for an empty table."""
    if table.isEmpty():
        return False
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in table.dtypes]
    table.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def markdown(table: DataFrame, order: list[str], edge: int = 15) -> str:
    """A Markdown table; of more than twice ``edge`` rows the first and last ``edge`` in the given order."""
    total = table.count()
    rows = table.orderBy(*order).limit(2 * edge).collect() if total <= 2 * edge else [*table.orderBy(*order).limit(edge).collect(), *reversed(table.orderBy(*(F.desc(c) for c in order)).limit(edge).collect())]
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(table.columns), line(["---"] * len(table.columns)), *map(line, rows)])
