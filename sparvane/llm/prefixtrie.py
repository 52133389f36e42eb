"""A trie of conversations: which ones begin with the same turns.

A turn is a number from the SHA-256 of its role and text; a prefix's fingerprint is the
polynomial of its turns' numbers in two primes.  One numpy scan over turns that are sorted by
conversation and range-partitioned, so that a conversation may span partitions, gives running
sums of each partition; what a conversation brings along from earlier partitions is added to
them afterwards.  As a fingerprint is a sum, the first turns that another conversation lends
are its own sum, and those that are replaced a difference.

Equal fingerprints at a depth are a group of candidates, its smallest conversation the
representative.  A group holds if in each of its rows the turn and the group one turn earlier
are the representative's, by induction over all turns; rows that differ get a number of their
own that all their later prefixes inherit, until every group holds.  Sums over subtrees climb
by doubling: after k rounds a node has those of all descendants less than 2^k below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparvane.llm.common import Tables, map_batches, remove_folder

PRIMES, FAMILY, LENT, PIECE = (2147483647, 2147483629), 20, 3, 4096
TURN = ["d1", "d2", "d3", "d4"]
KEY = ["depth", "fp", "split"]


def content(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, d1..d4, words``: the SHA-256 of each turn's role and text as four numbers, and how many words its text has."""
    def work():
        def step(c: dict) -> dict:
            texts = [[x or b"" for x in c[k].cast(pa.binary()).to_pylist()] for k in ("role", "text")]
            digests = b"".join(hashlib.sha256(len(role).to_bytes(8, "little") + role + text).digest() for role, text in zip(*texts))
            numbers = np.frombuffer(digests, np.int64).reshape(-1, 4)
            return {"conv_id": c["conv_id"], "turn": c["turn"], "words": pa.array([len(x.split()) for x in texts[1]], pa.int64())} | {d: pa.array(numbers[:, i].copy()) for i, d in enumerate(TURN)}

        return step

    chosen = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).filter("conv_id is not null")
    return map_batches(chosen, work, f"conv_id long, turn {chosen.schema['turn'].dataType.simpleString()}, d1 long, d2 long, d3 long, d4 long, words long")


def base_of(prime: int) -> int:
    return 31**5 % prime


def powers(prime: int, count: int) -> np.ndarray:
    """The base's powers 0..count-1."""
    table = np.ones(1, np.int64)
    while len(table) < count:
        table = np.concatenate([table, table * pow(base_of(prime), len(table), prime) % prime])
    return table[:count]


def scan(turns: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """Numbers each conversation's turns within a partition from 1, with the polynomial up to each turn (``s1, s2``) and before it (``q1, q2``)."""
    def work():
        part, last, place, sums = TaskContext.get().partitionId(), None, 0, [0, 0]

        def step(c: dict) -> dict:
            nonlocal last, place, sums
            conv = c["conv_id"].to_numpy()
            n = len(conv)
            out = {k: c[k] for k in ("conv_id", "words", *TURN)} | {"part": pa.array(np.full(n, part, np.int32))}
            if not n:
                return out | {k: pa.array([], pa.int64()) for k in ("place", "s1", "s2", "q1", "q2")}
            new = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            goes_on = begin < 0
            local = np.arange(n) - np.maximum(begin, 0) + 1
            number = c["d1"].to_numpy()
            for i, prime in enumerate(primes):
                power = powers(prime, n + 1)[local]
                power = np.where(goes_on, power * pow(base_of(prime), place, prime) % prime, power)
                term = number % prime * power % prime
                run = np.cumsum(term)
                earlier = np.where(goes_on, -sums[i], np.where(begin > 0, run[begin - 1], 0))
                upto = (run - earlier) % prime
                out |= {f"s{i + 1}": pa.array(upto), f"q{i + 1}": pa.array((upto - term) % prime)}
                sums[i] = int(upto[-1])
            at = np.where(goes_on, place, 0) + local
            last, place = conv[-1], int(at[-1])
            return out | {"place": pa.array(at)}

        return step

    return map_batches(turns, work, "part int, conv_id long, place long, d1 long, d2 long, d3 long, d4 long, words long, s1 long, s2 long, q1 long, q2 long")


def joined_up(scanned: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """Adds what conversations that span partitions have before a partition: their place and their polynomials.

    The driver sees two rows a partition.
    """
    spark = scanned.sparkSession
    edges = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last")).orderBy("part").collect()
    spanning = {b["first"] for a, b in zip(edges, edges[1:]) if a["last"] == b["first"]}
    carried, rows = {}, []
    if spanning:
        chosen = F.broadcast(spark.createDataFrame([(x,) for x in spanning], "conv_id long"))
        for r in scanned.join(chosen, "conv_id").groupBy("conv_id", "part").agg(F.max("place").alias("n"), *(F.max_by(s, "place").alias(s) for s in ("s1", "s2"))).orderBy("conv_id", "part").collect():
            place, *sums = carried.get(r["conv_id"], (0, 0, 0))
            shift = [pow(base_of(p), place, p) for p in primes]
            if place:
                rows.append((r["conv_id"], r["part"], place, *shift, *sums))
            carried[r["conv_id"]] = (place + r["n"], *((s + x * r[f"s{i + 1}"]) % primes[i] for i, (s, x) in enumerate(zip(sums, shift))))
    before = spark.createDataFrame(rows, "conv_id long, part int, place0 long, x1 long, x2 long, c1 long, c2 long")
    out = scanned.join(F.broadcast(before), ["conv_id", "part"], "left").withColumn("place", F.col("place") + F.coalesce("place0", F.lit(0)))
    return out.withColumns({f"{k}{i}": F.when(F.col("place0").isNull(), F.col(f"{k}{i}")).otherwise((F.col(f"c{i}") + F.col(f"x{i}") * F.col(f"{k}{i}")) % primes[i - 1]) for k in "sq" for i in (1, 2)}).drop("place0", "x1", "x2", "c1", "c2")


def rebuilt(turns: DataFrame, tables: Tables, primes: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """``conv_id, depth, fp, prev`` (fingerprints up to and before the turn) with the turns of the rebuilt conversations, and ``conv_id, length`` of each."""
    fields = [*TURN, "words", "s1", "s2"]
    heads = turns.groupBy("conv_id").agg(F.max("place").alias("n"), *(F.max(F.when(F.col("place") == j, F.col(c))).alias(f"{c}_{j}") for j in range(1, LENT + 1) for c in fields))
    heads = heads.select("conv_id", "n", F.array(*(F.struct(*(F.col(f"{c}_{j}").alias(c) for c in fields)) for j in range(1, LENT + 1))).alias("head"))
    lender = heads.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("lender"), F.col("n").alias("has"), F.col("head").alias("lent"))
    cut = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LENT + 1)).cast("int")
    known = heads.withColumns({"cut": cut, "lender": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(lender, "lender", "left")
    known = known.withColumn("got", F.least("cut", F.coalesce("has", F.lit(0))).cast("int")).withColumn("shift", F.col("cut") - F.col("got"))
    at = lambda array, place, field: F.when(place > 0, F.try_element_at(array, F.greatest(place, F.lit(1)))[field]).otherwise(0)
    known = known.withColumns({f"lent{i}": at(F.col("lent"), F.col("got"), f"s{i}") for i in (1, 2)} | {f"own{i}": at(F.col("head"), F.col("cut"), f"s{i}") for i in (1, 2)})
    known = tables.keep(known.select("conv_id", "cut", "got", "shift", "lent", *(f"{k}{i}" for k in ("lent", "own") for i in (1, 2)), (F.col("got") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).alias("length")))
    joint = lambda a, b: (a * (1 << 31) + b)
    inverse = [F.array(*(F.lit(pow(base_of(p), -j, p)) for j in range(LENT + 1))) for p in primes]

    def moved(k: str, i: int) -> Column:
        """The lent turns' polynomial and that of the own turns after the first, as many places earlier as turns are missing."""
        own = (F.col(f"{k}{i}") - F.col(f"own{i}") + primes[i - 1]) % primes[i - 1]
        return (F.col(f"lent{i}") + inverse[i - 1][F.col("shift")] * own) % primes[i - 1]

    rest = turns.withColumn("first", cut).filter("place > first").join(known.drop("lent", "cut"), "conv_id")
    rest = rest.select("conv_id", (F.col("place") - F.col("shift")).alias("depth"), joint(moved("s", 1), moved("s", 2)).alias("fp"), joint(moved("q", 1), moved("q", 2)).alias("prev"), *TURN, "words", "length")
    lent = known.filter("got > 0").select("conv_id", "length", "lent", F.explode(F.sequence(F.lit(1), "got")).alias("j"))
    s = lambda i, j: at(F.col("lent"), j, f"s{i}")
    turn = F.element_at("lent", F.col("j"))
    lent = lent.select("conv_id", F.col("j").cast("long").alias("depth"), joint(s(1, F.col("j")), s(2, F.col("j"))).alias("fp"), joint(s(1, F.col("j") - 1), s(2, F.col("j") - 1)).alias("prev"), *(turn[c].alias(c) for c in (*TURN, "words")), "length")
    rows = rest.unionByName(lent).withColumns({"last": F.col("depth") == F.col("length"), "split": F.lit(0).cast("long"), "psplit": F.lit(0).cast("long")}).drop("length")
    return rows, known.select("conv_id", "length")


def verified(rows: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The rows, ``split`` where fingerprints collide, and their groups, each equal to its representative in the turn and in the group before it."""
    same = [*TURN, "prev", "psplit"]
    while True:
        rows = tables.keep(rows)
        groups = rows.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *(f(c).alias(f"{c}_{k}") for c in same for k, f in (("least", F.min), ("most", F.max))))
        holds = reduce(Column.__and__, (F.col(f"{c}_least") == F.col(f"{c}_most") for c in same))
        groups = tables.keep(groups.select(*KEY, "owner", "n_convs", "words", F.col("prev_least").alias("prev"), F.col("psplit_least").alias("psplit"), holds.alias("holds")))
        collided = groups.filter("not holds")
        if collided.isEmpty():
            return rows, groups.drop("holds")
        model = rows.join(collided.select(*KEY, F.col("owner").alias("conv_id")), [*KEY, "conv_id"]).select(*KEY, F.struct(*same).alias("model"))
        number = F.when(F.struct(*same) != F.col("model"), F.shiftright(F.xxhash64("depth", "fp", *same), 8)).otherwise(0)  # sums of these stay within 64 bits
        marked = rows.join(model, KEY, "left").withColumn("number", F.coalesce(number, F.lit(0)))
        upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
        run = F.sum("number").over(upto)
        rows = marked.withColumns({"split": F.pmod(F.col("split") + run, F.lit(1 << 61)), "psplit": F.pmod(F.col("psplit") + run - F.col("number"), F.lit(1 << 61))}).drop("model", "number")


def summed(nodes: DataFrame, rows: DataFrame, tables: Tables) -> DataFrame:
    """``depth, fp, split, n_leaves, saved_tokens`` over each node's subtree, from each node's own ``leaf`` and ``saved``."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    paths = rows.select(F.col("conv_id").alias("owner"), F.col("depth").alias("above"), F.col("fp").alias("to_fp"), F.col("split").alias("to_split"))
    sums = nodes.select(*KEY, "owner", "prev", "psplit", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    far = 1
    while far <= deepest:
        lower = sums.filter(F.col("depth") >= far).withColumn("above", F.col("depth") - far)
        if far == 1:
            climbing = lower.withColumns({"to_fp": F.col("prev"), "to_split": F.col("psplit")})
        else:  # the node's ancestor is on its smallest conversation's path: each key stands once on either side
            root = lower.filter("above = 0").withColumns({"to_fp": F.lit(0).cast("long"), "to_split": F.lit(0).cast("long")})
            climbing = lower.filter("above > 0").join(paths, ["owner", "above"]).unionByName(root)
        climbing = climbing.select(F.col("above").alias("depth"), F.col("to_fp").alias("fp"), F.col("to_split").alias("split"), F.lit(None).cast("long").alias("owner"), "n_leaves", "saved_tokens")
        sums = sums.select(*KEY, "owner", "n_leaves", "saved_tokens").unionByName(climbing)
        sums = tables.keep(sums.groupBy(*KEY).agg(F.max("owner").alias("owner"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
        far *= 2
    return sums.select(*KEY, "n_leaves", "saved_tokens")


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, fp, split, ends_sha256`` of ``conv_id`` and keys: ids are joined to pieces of up to PIECE ids, which one task a node hashes as they stream by."""
    block = F.floor(F.col("conv_id") / PIECE)
    pieces = ends.groupBy(*KEY, block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if now != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*KEY, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*KEY, "ends_sha256"])

    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, *KEY).sortWithinPartitions(*KEY, "block").mapInArrow(run, "depth long, fp long, split long, ends_sha256 string")


def nodes(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """A row for each node of the trie of rebuilt ``conversations`` (see the contract of op12).

    Turns follow by ``turn``, null first; those of equal number by the SHA-256 of role and
    text, so that repeated rows are turns each.  Null roles and texts are empty, which is a
    turn like any other; texts of any length are hashed whole.  Rows without a conv_id belong
    to no conversation and are left out.  A table without conversations has no nodes, not even
    a root; other columns are ignored.
    """
    spark = conversations.sparkSession
    tables, tasks = Tables(spark, "trie"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = tables.keep(content(conversations)).withColumn("row", F.monotonically_increasing_id())
    # Rows that are equal in all else are told apart by their number, so that they may lie in several partitions.
    dealt = hashed.repartitionByRange(tasks, "conv_id", F.asc_nulls_first("turn"), "d1", "row").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), *TURN)
    turns = joined_up(tables.keep(scan(dealt.drop("turn", "row"), primes)), primes)
    rows, lengths = rebuilt(turns, tables, primes)
    rows, groups = verified(rows, tables)
    zero = {c: F.lit(0).cast("long") for c in ("depth", "fp", "split", "words")}
    root = lengths.agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).filter("n_convs > 0").withColumns(zero | {c: F.lit(None).cast("long") for c in ("prev", "psplit")})
    found = groups.unionByName(root)
    children = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp"), F.col("psplit").alias("split")).agg(F.count("*").alias("n_children"))
    found = found.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    found = tables.keep(found.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}))
    if found.isEmpty():
        remove_folder(spark, tables.folder)
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    ends = rows.filter("last").select("conv_id", *KEY).unionByName(lengths.filter("length = 0").select("conv_id", *(zero[c].alias(c) for c in KEY)))
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("split").alias("psplit"), F.col("owner").alias("parent_conv_id"))
    out = found.join(summed(found, rows, tables), KEY).join(end_digests(ends), KEY, "left").join(above, ["depth", "prev", "psplit"], "left")
    out = out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    result = Tables(spark, "nodes").keep(out)
    remove_folder(spark, tables.folder)
    return result
