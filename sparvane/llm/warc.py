"""WARC archives with a two-level capture index.

Each task writes one archive: a gzip member for every record, so a record can be read
alone from (file, offset, length).  The captures, sorted by reversed-host URL key, are
cut into index shards; a shard is a file of compressed blocks and ends in its sparse
directory (first key and place of each block).  A lookup finds the shard by its first key,
binary-searches the shard's directory, inflates one block, binary-searches it, and then
reads the record's range.

Archives and shards go to a new folder below ``spark.checkpoint.dir`` through pyarrow's
file systems.  File names hold the attempt; only those that finished attempts return are
ever read, so lost executors leave nothing but unused files.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparvane.llm.common import cut_lineage, fresh_folder

LEAST_SHARED = 100  #: smaller payloads are always stored
BLOCK_LINES = 256
CAPTURES_A_SHARD = 200_000
_CRLF = b"\r\n"


def url_key(url: str | None) -> str:
    """Reversed host labels, then the rest: ``http://a.b.com/x`` gives ``com,b,a)/x``; all lower case."""
    rest = (url or "").partition("://")[2] or (url or "")
    end = min(i for i in (rest.find("/"), rest.find("?"), rest.find("#"), len(rest)) if i >= 0)
    return (",".join(reversed(rest[:end].split("."))) + ")" + rest[end:]).lower().replace("\n", "%0a").replace("\0", "%00")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'' if page_id is None else page_id}"


def _open(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record of WARC 1.1: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else str(page_id).encode()),
        b"WARC-Target-URI: " + json.dumps(url).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha256:" + digest.encode(),
        b"WARC-Payload-Length: %d" % len(payload),
        *([b"WARC-Refers-To: <urn:page:%d>" % refers_to, b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        b"Content-Type: text/html",
        b"Content-Length: %d" % len(body),
    ]
    return _CRLF.join(head) + 2 * _CRLF + body + 2 * _CRLF


def parse(raw: bytes) -> dict:
    """Header fields of a record, and its body under ``body``."""
    head, _, rest = raw.partition(2 * _CRLF)
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields | {"body": rest[: int(fields["Content-Length"])]}


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row of ``pages`` (``page_id, url, html``) as a record and returns its capture.

    Captures: ``key, file, offset, length``.  Of equal payloads of at least LEAST_SHARED
    bytes the row with the smallest page_id (nulls last) is the response; rows that share
    this id are responses too; the others, if that id is not null, refer to it.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    seen = pages.filter(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest").distinct()
    copies = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = seen.join(copies, "digest").filter("page_id > first or page_id is null and first is not null").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "first")
    marked = pages.join(revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("bytes"), "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}.warc.gz"
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        offset = 0
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                captures = []
                for page_id, url, html, size, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = bytes(size) if html is None else html.encode()
                    member = gzip.compress(record(page_id, url, payload, digest, first), 1, mtime=0)
                    out.write(member)
                    captures.append((capture_key(url, page_id), name, offset, len(member)))
                    offset += len(member)
                yield pa.RecordBatch.from_pylist([dict(zip(("key", "file", "offset", "length"), c)) for c in captures], schema=_CAPTURES)

    return marked.mapInArrow(run, "key string, file string, offset long, length long")


_CAPTURES = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def index(captures: DataFrame, folder: str, shards: int) -> DataFrame:
    """Writes the sorted captures as index shards; returns ``first, shard`` (key and file name), a row a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{context.stageId()}-{context.partitionId()}-{context.taskAttemptId()}.idx"
        system, path = _open(folder)
        lines: list[tuple] = []
        directory: list[tuple[str, int, int]] = []
        offset = 0

        def flush() -> None:
            nonlocal offset
            block = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append((lines[0][0], offset, len(block)))
            out.write(block)
            offset += len(block)
            lines.clear()

        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for capture in zip(*(c.to_pylist() for c in batch.columns)):
                    lines.append(capture)
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed + len(packed).to_bytes(8, "little"))
        if directory:
            yield pa.RecordBatch.from_pylist([{"first": directory[0][0], "shard": name}])

    ordered = captures.repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "offset")
    return ordered.mapInArrow(run, "first string, shard string")


class Shard:
    """Reads one index shard: its directory at once, its blocks on demand (the last one is kept)."""

    def __init__(self, system, path: str) -> None:
        self.file = system.open_input_file(path)
        end = self.file.size()
        size = int.from_bytes(self.file.read_at(8, end - 8), "little")
        self.blocks = json.loads(zlib.decompress(self.file.read_at(size, end - 8 - size)))
        self.firsts, self.at, self.lines = [b[0] for b in self.blocks], -1, []

    def block(self, at: int) -> list[list]:
        if at != self.at:
            _, offset, size = self.blocks[at]
            self.at, self.lines = at, [json.loads(x) for x in zlib.decompress(self.file.read_at(size, offset)).split(b"\n")]
        return self.lines

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key, over as many blocks as they fill."""
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.blocks) and self.firsts[at] <= key:
            lines = self.block(at)
            for line in lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) :]:
                if line[0] != key:
                    return
                yield line
            at += 1


def lookup(spark, keys: DataFrame, folder: str, shards: list[tuple[str, str]], tasks: int) -> DataFrame:
    """Records found for ``keys`` (column ``key``, each asked once) through the index.

    ``shards`` are sorted (first key, file).  Returns the fields of :func:`read_back`.
    Keys that fill several shards are looked up in all of them.
    """
    firsts = [s[0] for s in shards]
    shared = spark.sparkContext.broadcast(shards)

    def route(key: str) -> list[int]:
        last = bisect.bisect_right(firsts, key) - 1
        start = max(0, bisect.bisect_left(firsts, key) - 1)
        return list(range(start, last + 1)) or []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"key": k, "shard": s} for k in batch.column("key").to_pylist() for s in route(k)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("shard", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        shard, at, files = None, -1, {}
        for batch in batches:
            out = []
            for key, number in zip(batch.column("key").to_pylist(), batch.column("shard").to_pylist()):
                if number != at:
                    shard, at = Shard(system, f"{path}/{shared.value[number][1]}"), number
                for _, name, offset, length in shard.find(key):
                    if name not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files)))
                        files[name] = system.open_input_file(f"{path}/{name}")
                    fields = parse(gzip.decompress(files[name].read_at(length, offset)))
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        if (len(fields["body"]), hashlib.sha256(fields["body"]).hexdigest()) != (size, digest):
                            raise ValueError(f"damaged record of {key!r} in {name} at {offset}")
                    out.append((_urn(fields["WARC-Record-ID"]), json.loads(fields["WARC-Target-URI"]), size, digest, fields["WARC-Type"], _urn(fields.get("WARC-Refers-To"))))
            yield pa.RecordBatch.from_pylist([dict(zip(_FOUND.names, x)) for x in out], schema=_FOUND)

    routed = keys.mapInArrow(deal, "key string, shard int").repartitionByRange(tasks, "shard", "key").sortWithinPartitions("shard", "key")
    return routed.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


_FOUND = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame, list[tuple[str, str]]]:
    """Writes archives and index: (folder, captures, shards by first key)."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    captures = cut_lineage(write(pages, folder))
    shards = max(1, -(-captures.count() // CAPTURES_A_SHARD))
    found = index(captures, folder, max(shards, min(8, spark.sparkContext.defaultParallelism))).collect()  # a row a shard
    return folder, captures, sorted(map(tuple, found))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives all pages and reads every record back through the index.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per row of
    ``pages``.  Null html: empty payload.  Null urls and ids and repeated rows keep a
    record each; other columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    folder, captures, shards = archive(pages, folder)
    keys = captures.select("key").distinct()
    tasks = max(len(shards), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lookup(spark, keys, folder, shards, tasks).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
