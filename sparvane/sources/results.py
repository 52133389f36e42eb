"""A result folder with ``tables``, ``figures`` and ``report``, and a writer for its tables.

Tables are written by ``write.format("sparvane_results")`` as one CSV file a task.  A task
writes to a staging folder of its own attempt; the driver's commit moves what successful
attempts have written to the table's folder and then writes its manifest, which is all that
readers go by.  So a failed task or job leaves no table, or the one before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, PARTS, MANIFEST = "sparvane_results", ("tables", "figures", "report"), "manifest.json"


def _at(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def create(folder: str) -> None:
    """Makes the folder and its parts, where they aren't yet."""
    system, path = _at(folder)
    for part in PARTS:
        system.create_dir(f"{path}/{part}", recursive=True)


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class TableWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, table: str) -> None:
        self.folder, self.table, self.job = folder.rstrip("/"), table, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import csv

        context, out, rows = TaskContext.get(), None, 0
        system, path = _at(self.folder)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.csv"
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    system.create_dir(f"{path}/_staging/{self.job}", recursive=True)
                    out = csv.CSVWriter(system.open_output_stream(f"{path}/_staging/{self.job}/{name}", compression=None), batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is not None:
            out.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        """What attempts whose message arrives here have written is the table; without any row there is none."""
        system, path = _at(self.folder)
        found = sorted((m for m in messages if m is not None and m.file), key=lambda m: m.file)
        where = f"{path}/tables/{self.table}"
        before = read_manifest(self.folder, self.table)
        if found:
            system.create_dir(f"{where}/{self.job}", recursive=True)
            for m in found:
                system.move(f"{path}/_staging/{self.job}/{m.file}", f"{where}/{self.job}/{m.file}")
            manifest = {"table": self.table, "rows": sum(m.rows for m in found), "files": [f"{self.job}/{m.file}" for m in found]}
            with system.open_output_stream(f"{where}/{self.job}.tmp", compression=None) as out:
                out.write(json.dumps(manifest, indent=1).encode())
            system.move(f"{where}/{self.job}.tmp", f"{where}/{MANIFEST}")
        elif before:
            system.delete_file(f"{where}/{MANIFEST}")
        for old in {f.partition("/")[0] for f in (before or {"files": []})["files"]}:
            system.delete_dir(f"{where}/{old}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, path = _at(self.folder)
        if system.get_file_info(f"{path}/_staging/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_staging/{self.job}")


class ResultSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise NotImplementedError("tables are read by read_table")

    def writer(self, schema: StructType, overwrite: bool) -> TableWriter:
        return TableWriter(self.options["path"], self.options["table"])


def flat(table: DataFrame) -> DataFrame:
    """Nested columns as JSON, binary ones in Base64, all that a CSV cell can hold as it is."""
    def cell(name: str, kind: str):
        if kind.startswith(("array", "map", "struct")):
            return F.to_json(name).alias(name)
        return F.base64(name).alias(name) if kind == "binary" else F.col(name)

    return table.select(*(cell(c, kind) for c, kind in table.dtypes))


def write_table(table: DataFrame, folder: str, name: str) -> bool:
    """Writes ``table`` in place of the one of that name; an empty one leaves none, and False is returned."""
    create(folder)
    table.sparkSession.dataSource.register(ResultSource)
    flat(table).write.format(FORMAT).mode("append").option("path", folder).option("table", name).save()
    return read_manifest(folder, name) is not None


def read_manifest(folder: str, name: str) -> dict | None:
    from pyarrow import fs

    system, path = _at(folder)
    file = f"{path}/tables/{name}/{MANIFEST}"
    if system.get_file_info(file).type != fs.FileType.File:
        return None
    with system.open_input_stream(file, compression=None) as data:
        return json.loads(data.readall())


def read_table(spark: SparkSession, folder: str, name: str, schema: str | StructType) -> DataFrame:
    """The rows of a table's manifest; none where there is no such table."""
    manifest = read_manifest(folder, name)
    if not manifest:
        return spark.createDataFrame([], schema)
    files = [f"{folder.rstrip('/')}/tables/{name}/{f}" for f in manifest["files"]]
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(files)


def write_summary(folder: str, summary: dict, name: str = "run_summary") -> None:
    """A JSON file of the report, with the row counts of the folder's tables under ``tables``."""
    from pyarrow import fs

    create(folder)
    system, path = _at(folder)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(f"{path}/tables")) if f.type == fs.FileType.Directory]
    rows = {n: m["rows"] for n in sorted(names) if (m := read_manifest(folder, n))}
    with system.open_output_stream(f"{path}/report/{name}.json", compression=None) as out:
        out.write(json.dumps({**summary, "tables": rows}, indent=2, default=str, ensure_ascii=False).encode())
