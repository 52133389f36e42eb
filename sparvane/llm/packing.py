"""Best-fit-decreasing packing of token sequences.

Which open bin a piece goes to depends on lengths alone, so the plan is made from the
histogram of lengths: at most ``capacity`` rows, whatever the corpus holds.  Lengths go
from long to short; a segment tree over the remaining capacities finds the tightest open
bin for each in logarithmic time.  Bins with the same remaining capacity are kept as
ranges of bin numbers, and equal pieces move into such a range in one step, so the plan
is a list of ranges too.  Every piece then gets its place from its number among the
pieces of its length: counted within tasks, offset by a running sum over tasks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparvane.llm.bpe import VOCABULARY, ChunkStore, encode_text, encoder
from sparvane.llm.common import cut_lineage, map_batches

END_ID = 1


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf says whether bins are open there."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        node = room + self.size
        self.open[node] = is_open
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] or self.open[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """Smallest open capacity that is at least ``length``."""
        node = length + self.size
        while not self.open[node]:
            while node & 1:  # right children: go up
                node //= 2
            if not node:
                return None
            node += 1
            if node & (node - 1) == 0:  # wrapped to the next level
                return None
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for ``histogram[length]`` pieces of each length.

    Returns the number of bins and rows (length, first piece, pieces, first bin, pieces
    a bin, offset): pieces numbered from ``first piece`` fill bins one after another from
    ``first bin``, each with ``pieces a bin`` of them from ``offset`` on.
    """
    tree, ranges, bins, rows = CapacityTree(capacity), {}, 0, []

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            ranges.setdefault(room, []).append((first, count))
            if len(ranges[room]) == 1:
                tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, number = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # no open bin is large enough: open as many as it takes
                room, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = ranges[room].pop()
                if not ranges[room]:
                    tree.set(room, False)
            each = room // length
            full = min(count, left // each)
            if full:
                rows.append((length, number, full * each, first, each, capacity - room))
                number, left = number + full * each, left - full * each
                add(room - each * length, first, full)
            if full < count and left:  # fewer than ``each`` are left: one bin more
                rows.append((length, number, left, first + full, each, capacity - room))
                add(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < count:
                add(room, first + full, count - full)
    return np.array(rows, np.int64).reshape(-1, 6), bins


def _numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``number``: 0.. among the pieces of equal length; needs ``task, rank, length``."""
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return pieces.join(starts, ["task", "length"]).withColumn("number", F.col("before") + F.col("rank"))


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``task, rank, length`` (1..capacity).

    ``rank`` numbers a task's pieces of one length from 0.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(histogram, capacity)
    # Piece numbers stay far below 2**48 and lengths below 2**15.
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    starts = (rows[:, 0] << 48) + rows[:, 1]
    shared = pieces.sparkSession.sparkContext.broadcast((starts, rows))
    kept = [f for f in pieces.schema if f.name not in ("task", "rank")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def work():
        starts, rows = shared.value

        def step(batch: dict) -> dict:
            length, number = batch["length"].to_numpy(zero_copy_only=False).astype(np.int64), batch.pop("number").to_numpy(zero_copy_only=False)
            at = rows[np.searchsorted(starts, (length << 48) + number, side="right") - 1] if len(length) else np.zeros((0, 6), np.int64)
            within = number - at[:, 1]
            return batch | {"sequence_id": at[:, 3] + within // np.maximum(at[:, 4], 1), "offset": at[:, 5] + within % np.maximum(at[:, 4], 1) * length}

        return step

    numbered = _numbered(pieces).select(*(f.name for f in kept), "number")
    return map_batches(numbered, work, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = 4096, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, on demand, ``ids``.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone.
    Documents longer than ``capacity`` are cut into pieces of that many ids and a rest.
    Null or repeated doc_ids and repeated rows keep a document each; other columns are
    ignored; an empty table gives no rows.
    """

    def work():
        store, ranks = ChunkStore(encoder(vocabulary)), {}
        task, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()

        def step(batch: dict) -> dict:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode_text(text.as_py() or "", store) + end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    rank = ranks.get(length, 0)
                    ranks[length] = rank + 1
                    for name, value in zip(out, (doc_id, k, start, length, zlib.crc32(part), task, rank, np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)):
                        out[name].append(value)
            return out

        return step

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * with_ids
    pieces = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)
    return pack_pieces(cut_lineage(pieces), capacity)
