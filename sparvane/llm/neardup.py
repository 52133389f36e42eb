"""Near-duplicate documents: DartMinHash signatures, banding, verified links, components.

Similarity is the weighted Jaccard of five-word shingles (a shingle weighs as often as it
occurs; texts of fewer words are one shingle; ASCII letters lower-cased; words split at
ASCII white space).  Equal texts are one node from the start, whatever their number.

Signatures: the occurrences of a shingle are regions of unit weight.  Darts thrown by hashes
land on (region, rank) with density one; a document of weight W takes the darts of rank
below R = t / W (t about k log k + 2k, so that every coordinate is hit with good odds;
documents with open coordinates take further darts), and keeps the earliest dart of each
of k coordinates.  Two documents agree in a coordinate with the probability of their
similarity.

Links: documents that share a band meet in a bucket.  Buckets of two or three nodes are
compared throughout.  In a larger one every node meets the node with the fewest shingles
of its own (the copy closest to the common original); links of at least 0.8 form
components.  What is left are pairs of a bucket whose components differ: of these, pairs
that could still reach 0.8 are compared one by one.  What two nodes can share is bounded by
what each shares with that leader and by the shingles beyond it that other nodes of such
buckets have too; a node that can't share 0.8 of itself is out at once, the others of a
bucket meet in tiles of TILE nodes, so no task gets a whole bucket.  So no candidate pair is
given up unless it is connected already or can't be similar, and no group is expanded into
all its pairs.  Python sees batches bounded in bytes.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparvane.llm.common import CHECK, ROW, all_there, cut_lineage, forget, fresh_folder, map_batches, numbered, pick_rows, remove_folder, steady_scans, write_row_sets

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
TILE = 512
K = BANDS * ROWS
DARTS = K * math.log(K) + 2 * K
_EMPTY = np.uint64(2**64 - 1)
#: Chance of at most n darts in a unit region, n = 0, 1, ..., as 32-bit integers.
_POISSON = np.array([min(2**32 - 1, round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1)))) for n in range(12)], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def units(text: str | None) -> np.ndarray:
    """Sorted hashes of (shingle, number of the occurrence); none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.array(list(map(crc32, words)), np.uint64)
    h = np.zeros(max(1, len(w) - WORDS + 1), np.uint64)
    for i in range(min(WORDS, len(w))):
        h = _mix(h + w[i : i + len(h)] + np.uint64(i + 1))
    h.sort()
    if len(h) > 1 and (h[1:] == h[:-1]).any():
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        number = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        h = np.where(number > 0, _mix(h + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
        h.sort()
    return h


def _throw(regions: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, earliest: np.ndarray) -> None:
    """Takes the darts with low <= rank < high (by owner) of all regions into ``earliest`` (owners x K)."""
    first = np.floor(low).astype(np.int64)[owner]
    slices = np.ceil(high).astype(np.int64)[owner] - first
    at = np.repeat(np.arange(len(regions)), slices)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(slices) - slices, slices) + first[at]
    h = _mix(regions[at] + cell.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    darts = np.searchsorted(_POISSON, h >> np.uint64(32), side="right")
    which = np.repeat(np.arange(len(h)), darts)
    number = np.arange(len(which)) - np.repeat(np.cumsum(darts) - darts, darts)
    dart = _mix(h[which] + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x165667B19E3779F9))
    fraction = dart >> np.uint64(44)  # 20 bits of rank within the cell
    rank = (cell[which].astype(np.uint64) << np.uint64(20)) + fraction
    own = owner[at[which]]
    exact = rank.astype(np.float64) / 2**20
    inside = np.flatnonzero((exact >= low[own]) & (exact < high[own]))
    dart, own, rank = dart[inside], own[inside], rank[inside]
    coordinate = ((dart & np.uint64(0xFFFFFFFF)) * np.uint64(K) >> np.uint64(32)).astype(np.int64)
    packed = np.minimum(rank, np.uint64(2**36 - 1)) << np.uint64(28) | (_mix(dart) & np.uint64(2**28 - 1))
    np.minimum.at(earliest.reshape(-1), own * K + coordinate, packed)


def signatures(regions: list[np.ndarray]) -> np.ndarray:
    """Earliest dart (rank, then identity) in each of the K coordinates, a row a document; none may be empty."""
    weights = np.array([len(r) for r in regions], np.float64)
    earliest = np.full((len(regions), K), _EMPTY)
    low, high = np.zeros(len(regions)), DARTS / weights
    todo = np.arange(len(regions))
    while len(todo):
        flat = np.concatenate([regions[i] for i in todo])
        owner = np.repeat(np.arange(len(todo)), weights[todo].astype(np.int64))
        part = earliest[todo]
        _throw(flat, owner, low[todo], high[todo], part)
        earliest[todo] = part
        todo = todo[(part == _EMPTY).any(1)]
        low[todo], high[todo] = high[todo], 2 * high[todo]
    return earliest


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band (rows x BANDS)."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def text_key(text: Column) -> Column:
    """128-bit content key; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _signed(docs: DataFrame) -> DataFrame:
    """``row, check, doc_id, key, weight, bands`` of numbered documents: no bands for a text without words."""

    def work():
        forget()

        def step(batch: dict) -> dict:
            found = [units(t.as_py()) for t in batch["text"]]
            full = [i for i, u in enumerate(found) if len(u)]
            keys: list = [[] for _ in found]
            for start in range(0, len(full), 256):
                part = full[start : start + 256]
                for i, row in zip(part, bands(signatures([found[i] for i in part])).view(np.int64)):
                    keys[i] = row
            return {ROW: batch[ROW], CHECK: batch[CHECK], "doc_id": batch["doc_id"], "key": batch["key"], "weight": [len(u) for u in found], "bands": keys}

        return step

    source = docs.select(ROW, CHECK, F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return map_batches(source, work, f"{ROW} long, {CHECK} long, doc_id long, key binary, weight long, bands array<long>")


def _units_of(docs: DataFrame, signed: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, units`` (sorted, packed) of the texts with these keys: a second scan picks a row for each."""

    def taken(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([units(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("key"), found], names=["key", "units"])

    rows = signed.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct(ROW, CHECK)).alias("first")).select("first.*")
    texts = docs.select(ROW, CHECK, text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    folder, n = write_row_sets(rows)
    found = all_there(cut_lineage(pick_rows(texts, folder, taken, "key binary, units binary")), n)
    remove_folder(docs.sparkSession, folder)
    return found


def _compared(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with ``common`` weight and whether they are ``similar``."""

    def work():
        def step(batch: dict) -> dict:
            common, similar = [], []
            for ua, ub in zip(batch["ua"], batch["ub"]):
                left, right = np.frombuffer(ua.as_buffer(), np.uint64), np.frombuffer(ub.as_buffer(), np.uint64)
                common.append(len(np.intersect1d(left, right, assume_unique=True)))
                similar.append(common[-1] >= SIMILAR * (len(left) + len(right) - common[-1]) - 1e-9)
            return {"a": batch["a"], "b": batch["b"], "common": common, "similar": similar}

        return step

    a, b = (shingles.select(F.col("key").alias(x), F.col("units").alias(f"u{x}")) for x in "ab")
    return map_batches(pairs.join(a, "a").join(b, "b"), work, "a binary, b binary, common long, similar boolean")


def components(links: DataFrame) -> DataFrame:
    """``key, comp``: smallest key of each linked node's connected component, by spreading minima and jumping."""
    both = cut_lineage(links.select(F.col("a").alias("key"), F.col("b").alias("other")).union(links.select(F.col("b").alias("key"), F.col("a").alias("other"))).distinct())
    labels = cut_lineage(both.groupBy("key").agg(F.min("other").alias("other")).select("key", F.least("key", "other").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("key").alias("other"), "comp"), "other").groupBy("key").agg(F.min("comp").alias("near"))
        spread = labels.join(near, "key").select("key", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("comp").alias("far"))
        stepped = cut_lineage(spread.join(jump, "next").select("key", F.least("next", "far").alias("comp"), (F.least("next", "far") != F.col("comp")).alias("moved")))
        labels = stepped.select("key", "comp")
        if stepped.filter("moved").isEmpty():
            return labels


def _links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Components of the distinct texts that are similar to another one."""
    nodes = signed.filter(F.size("bands") > 0).select("key", "weight", "bands").dropDuplicates(["key"])
    spread = nodes.select("key", "weight", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).filter("n > 1")
    members = cut_lineage(spread.join(shared, "band"))
    shingles = _units_of(docs, signed, members.select("key").distinct())

    def pair(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    small, large = members.filter("n <= 3"), members.filter("n > 3")
    first = small.filter("key != low").select(*pair("key", "low")).union(small.filter("key != high").select(*pair("key", "high")))
    # Shingles that one node alone has, among all nodes of larger buckets.
    alone = (
        map_batches(shingles.join(large.select("key").distinct(), "key", "left_semi"), lambda: _exploded, "key binary, unit long")
        .groupBy("unit").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1").groupBy("key").agg(F.count("*").alias("own"))
    )
    large = cut_lineage(large.select("band", "key", "weight").join(alone, "key", "left").fillna(0, ["own"]))
    leaders = large.groupBy("band").agg(F.min(F.struct("own", "key")).alias("least")).select("band", F.col("least.key").alias("leader"))
    led = large.join(leaders, "band")
    first = first.union(led.filter("key != leader").select(*pair("key", "leader"))).distinct()
    stars = cut_lineage(_compared(first, shingles))
    links = stars.filter("similar").select("a", "b")

    labelled = led.join(components(links), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    mixed = labelled.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("band")
    left = labelled.join(mixed, "band", "left_semi").withColumns({"a": F.least("key", "leader"), "b": F.greatest("key", "leader")})
    left = left.join(stars.select("a", "b", "common"), ["a", "b"], "left").withColumn("inside", F.coalesce("common", "weight"))
    left = left.withColumn("outside", F.when(F.col("key") == F.col("leader"), 0).otherwise(F.col("weight") - F.col("inside") - F.col("own")))
    left = cut_lineage(left.select("band", "key", "weight", "comp", "inside", "outside").join(nodes.select("key", "bands"), "key"))

    # A node that has too much alone is similar to none; the others of a bucket are dealt over tiles.
    left = left.filter(F.col("inside") + F.col("outside") >= SIMILAR * F.col("weight") - 1e-9)
    sizes = left.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 != c1").select("band", "tiles")
    left = left.join(sizes, "band").withColumn("tile", F.pmod(F.xxhash64("key", "band"), F.col("tiles")).cast("int"))
    x, y = (left.select("band", "tile", "tiles", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "weight", "comp", "inside", "outside", "bands"))) for s in "xy")
    x = x.select("*", F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("other")).drop("tiles")
    y = y.select("*", F.explode(F.sequence(F.lit(0), "tile")).alias("first")).withColumnsRenamed({"tile": "other", "first": "tile"}).drop("tiles")
    # What two nodes share lies in their bucket's leader or among what neither has alone.
    common = F.least("inside_x", "inside_y") + F.least("outside_x", "outside_y")
    could = common >= SIMILAR * (F.col("weight_x") + F.col("weight_y") - common) - 1e-9
    meeting = F.filter(F.zip_with("bands_x", "bands_y", lambda p, q: F.when(p == q, p)), lambda p: p.isNotNull())
    # A pair counts in the first band that it shares.
    met = x.join(y, ["band", "tile", "other"]).filter(((F.col("tile") < F.col("other")) | (F.col("key_x") < F.col("key_y"))) & (F.col("comp_x") != F.col("comp_y")) & could & (F.element_at(meeting, 1) == F.col("band")))
    rest = met.select(*pair("key_x", "key_y")).join(stars.select("a", "b"), ["a", "b"], "left_anti")
    more = cut_lineage(_compared(rest, shingles).filter("similar").select("a", "b"))
    return components(links.union(more))


def _exploded(batch: dict) -> dict:
    parts = [np.frombuffer(u.as_buffer(), np.int64) for u in batch["units"]]
    at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return {"key": batch["key"].take(pa.array(at, pa.int64())), "unit": np.concatenate(parts) if parts else np.zeros(0, np.int64)}


def _rows(docs: DataFrame) -> DataFrame:
    """Numbered documents, with text and doc_id as the content that two scans must agree on."""
    return numbered(docs, F.struct(text_key(F.col("text")), F.col("doc_id").cast("long")))


def _classed(docs: DataFrame) -> DataFrame:
    """``row, check, doc_id, class`` of every row of numbered documents; the class is a key."""
    signed = cut_lineage(_signed(docs))
    linked = _links(docs, signed)
    return signed.select(ROW, CHECK, "doc_id", "key").join(linked, "key", "left").select(ROW, CHECK, "doc_id", F.coalesce("comp", "key").alias("class"))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_docs`` for every row of ``docs`` (``doc_id, text``).

    Documents with equal texts (nulls count as empty) or linked by similarity, directly or
    over others, share a class; its id is the smallest doc_id in it (null if all are null)
    and ``n_docs`` its number of rows.  Texts without words equal only texts of the same
    characters.  Very long texts are compared whole.  Other columns are ignored; an empty
    table gives no rows.
    """
    with steady_scans(docs.sparkSession):
        found = cut_lineage(_classed(_rows(docs)).select("doc_id", "class"))
    ids = found.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_docs"))
    return found.join(ids, "class").select("doc_id", "class_id", "n_docs")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the row with the smallest doc_id (nulls last).

    All columns of ``docs`` are returned, written to the shared folder.  Of rows that share the smallest id and their
    text, one stays.  Texts without words are all kept unless they are equal.
    """
    rows, where = _rows(docs), fresh_folder(docs.sparkSession, "kept")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", ROW, CHECK)
    with steady_scans(docs.sparkSession):
        winners = _classed(rows).groupBy("class").agg(F.min(first).alias("best")).select(f"best.{ROW}", f"best.{CHECK}")
        folder, n = write_row_sets(winners)
        pick_rows(rows, folder).write.parquet(where)
    remove_folder(docs.sparkSession, folder)
    return all_there(docs.sparkSession.read.schema(docs.schema).parquet(where), n)
