"""Order MinHash: fingerprints whose likeness falls with the edit distance of texts, in DataFrame functions only.

A text's k-mers are the K code points from each of its positions on, fewer at its end.  Equal
ones are numbered by their occurrence, and the hash of k-mer and number gives each a bin and a
rank.  Bins take their minimum, which keeps its place in the text in its lower bits.  A
coordinate of the signature is the tuple of a bin's minimum and that of the next bin that has
one, in the order of the text.  So two texts share a coordinate if they share both k-mers and
have them in the same order; a short text has as many coordinates as it has filled bins.

An edited text shares its first part with the text itself: k-mers within it are hashed once for
both.  A text is shuffled once, and all of this happens where it lies then.  Its k-mers become
one sorted array of numbers, 34 bits of a k-mer's hash above its place, in which equal k-mers
are neighbours: only those that have one are sorted as rows, to be numbered.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparvane.llm.common import Tables, remove_folder

K, BINS, PLACES, LATER = 12, 64, 30, 1 << 29
STEP, TUPLE_BITS = 32, 26
NO_ID = -(2**63)
KEY = ["id", "content"]
HASHED = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


@contextmanager
def text_by_text(spark: SparkSession) -> Iterator[None]:
    """Meanwhile lists are collected from sorted rows: by hashing, a task would hold the k-mers of up to 128 texts at once, however long."""
    before = spark.conf.get(HASHED, None)
    spark.conf.set(HASHED, "1")
    try:
        yield
    finally:
        spark.conf.unset(HASHED) if before is None else spark.conf.set(HASHED, before)


def what(code: Column) -> Column:
    """The hash above the place."""
    return F.shiftright(code, PLACES)


def place(code: Column) -> Column:
    return code.bitwiseAND(F.lit((1 << PLACES) - 1))


def codes(texts: DataFrame) -> DataFrame:
    """``id, content, cut, codes`` of ``id, content, text, edited, kept``: sorted k-mers of both texts; no row where both are empty.

    Places below ``cut`` are of both texts, the others below LATER of the text only, those from LATER on of the edited text only.
    """
    cut = F.greatest(F.col("kept") - (K - 1), F.lit(0))  # the first k-mer that isn't wholly among the kept
    wide = lambda t: F.encode(t, "UTF-32")  # noqa: E731  four bytes a code point: any k-mer is found at once
    sides = F.array(*(F.struct(F.lit(first).cast("bigint").alias("first"), t.alias("wide")) for first, t in ((0, wide(F.col("text"))), (LATER, wide(F.substr("edited", cut + 1))))))
    rows = texts.select(*KEY, cut.alias("cut"), F.inline(sides)).withColumn("n", F.shiftright(F.octet_length("wide"), 2)).filter("n > 0")
    rows = rows.select(*KEY, "cut", "first", "wide", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP))).alias("at"))
    kmer = lambda j: F.xxhash64(F.substring("wide", F.shiftleft(F.col("at") + j, 2) + 1, 4 * K))
    some = F.array(*(F.shiftleft(kmer(j), PLACES).bitwiseOR(F.col("first") + F.col("at") + j) for j in range(STEP)))
    pieces = rows.select(*KEY, "cut", F.slice(some, F.lit(1), F.least(F.col("n") - F.col("at"), F.lit(STEP))).alias("piece"))
    return pieces.groupBy(*KEY, "cut").agg(F.sort_array(F.flatten(F.collect_list("piece"))).alias("codes"))


def ranked(kmer: Column, number: Column, at: Column) -> tuple[Column, Column]:
    """The bin of a numbered k-mer and its rank there above its place."""
    h = F.xxhash64(kmer, number)
    return F.pmod(F.shiftright(h, 40), F.lit(BINS)).cast("int"), F.shiftleft(h.bitwiseAND(F.lit((1 << (63 - PLACES)) - 1)), PLACES).bitwiseOR(at)


def signatures(texts: DataFrame) -> DataFrame:
    """``id, content, own, edited``: signatures of ``id, content, text, edited, kept``, which lie by id and content; no row where both texts are empty."""
    rows = codes(texts).select(*KEY, "cut", "codes", F.posexplode("codes").alias("i", "code"))
    same = lambda i: what(F.get("codes", i)).eqNullSafe(what(F.col("code")))
    rows = rows.select(*KEY, "cut", "code", (same(F.col("i") - 1) | same(F.col("i") + 1)).alias("repeated"))
    code, sides = F.col("code"), (("own", 2), ("edited", 1))
    part = F.when(place(code) >= LATER, 2).when(place(code) >= F.col("cut"), 1).otherwise(0)
    once, value = ranked(what(code), F.lit(1).cast("bigint"), place(code))
    single = rows.select(*KEY, "cut", F.when(~F.col("repeated"), once).alias("bin"), F.when(F.col("repeated"), code).alias("code"), F.when(~F.col("repeated"), value).alias("v"), part.alias("part"))
    few = single.groupBy(*KEY, "cut", "bin", "code").agg(*(F.min(F.when(F.col("part") != other, F.col("v"))).alias(n) for n, other in sides))
    upto = Window.partitionBy(*KEY, what(code)).orderBy("code").rowsBetween(Window.unboundedPreceding, 0)
    number = F.when(part == 2, F.count_if(part != 1).over(upto)).otherwise(F.count_if(part != 2).over(upto))
    again, value = ranked(what(code), F.col("number"), place(code))
    numbered = few.withColumn("number", number)
    binned = numbered.select(*KEY, F.coalesce("bin", again).alias("bin"), *(F.when(code.isNull(), F.col(n)).when(part != other, value).alias(n) for n, other in sides))
    least = binned.groupBy(*KEY, "bin").agg(*(F.min(n).alias(n) for n, _ in sides))
    found = least.groupBy(*KEY).agg(*(F.sort_array(F.collect_list(F.when(F.col(n).isNotNull(), F.struct("bin", F.col(n).alias("v"))))).alias(n) for n, _ in sides))
    return found.select(*KEY, *(tuples(F.col(n)).alias(n) for n, _ in sides))


def tuples(minima: Column) -> Column:
    """For each filled bin its number and the hash of its minimum and the next bin's, in the order of the text."""

    def coordinate(a: Column, b: Column) -> Column:
        v, w = a["v"], b["v"]
        hashed = F.when(place(v) <= place(w), F.hash(what(v), what(w))).otherwise(F.hash(what(w), what(v)))
        return F.shiftleft(a["bin"], TUPLE_BITS).bitwiseOR(hashed.bitwiseAND(F.lit((1 << TUPLE_BITS) - 1)))

    following = F.concat(F.slice(minima, 2, BINS), F.slice(minima, 1, 1))
    return F.zip_with(minima, following, coordinate)


def likeness(a: Column, b: Column) -> Column:
    """Of the bins that either text fills, the share with equal coordinates; empty texts are like each other and unlike all others."""
    a, b = (F.coalesce(x, F.array().cast("array<int>")) for x in (a, b))
    bins = lambda x: F.transform(x, lambda c: F.shiftrightunsigned(c, TUPLE_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1)))


def spelled(signature: Column) -> Column:
    """Eight hexadecimal digits a coordinate; empty without any."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""), F.lit(""))


def followers(ids: DataFrame, tables: Tables) -> DataFrame:
    """``id, next_id, next_content`` of ``id, content``: the next smaller id, for the smallest the largest.

    Ids are range-partitioned; one task sees the first row of each partition.
    """
    tasks = 4 * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tables.keep(ids.repartitionByRange(tasks, F.desc("id")).withColumn("part", F.spark_partition_id()))
    down = Window.partitionBy("part").orderBy(F.desc("id"))
    me = F.struct(F.col("id").alias("next_id"), F.col("content").alias("next_content"))
    rows = tables.keep(dealt.withColumns({"next": F.lead(me).over(down), "at": F.row_number().over(down)}))
    firsts = rows.filter("at = 1").select("part", me.alias("first"))
    after = firsts.select("part", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.first("first").over(Window.orderBy("part"))).alias("after"))
    rows = rows.join(F.broadcast(after), "part")  # a row a partition
    return rows.select("id", F.coalesce("next", "after").alias("next")).select("id", "next.*")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each document (see the contract of op11).

    Null texts are empty and have empty fingerprints.  Texts are taken whole, white space too.  Repeated rows are one document and come out as
    often as they went in; of several texts of one doc_id that with the least hash is the next
    document of its predecessor.  Rows without a doc_id come after the smallest one.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tables, result = Tables(spark, "order"), Tables(spark, "fingerprints")
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    known = tables.keep(text.groupBy(*KEY).agg(F.max(F.length("text")).alias("n_chars"), F.count("*").alias("copies")))
    next_of = followers(known.groupBy("id").agg(F.min("content").alias("content")), tables)
    facts = tables.keep(known.join(next_of, "id"))
    whole = text.groupBy(*KEY).agg(F.first("text").alias("text"))
    need = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = facts.select(F.col("id").alias("to_id"), F.col("content").alias("to_content"), need.alias("need"), F.col("next_id").alias("id"), F.col("next_content").alias("content"))
    heads = whole.join(wanted, KEY).select(F.col("to_id").alias("id"), F.col("to_content").alias("content"), "need", F.col("text").substr(F.lit(1), F.col("need")).alias("head"))
    kept = F.length("text") - F.col("need")
    both = whole.join(heads, KEY).select(*KEY, "text", kept.alias("kept"), F.concat(F.col("text").substr(F.lit(1), kept), F.col("head")).alias("edited"))
    digests = both.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    with text_by_text(spark):
        found = tables.keep(signatures(both).unionByName(digests, allowMissingColumns=True))  # one job: the texts' shuffles serve both
    signed = found.filter("edited_sha256 is null").select(*KEY, "own", "edited")
    following = signed.select(F.col("id").alias("next_id"), F.col("content").alias("next_content"), F.col("own").alias("following"))
    rows = facts.join(found.filter("edited_sha256 is not null").select(*KEY, "edited_sha256"), KEY).join(signed, KEY, "left").join(following, ["next_id", "next_content"], "left")
    rows = rows.select(
        F.nullif(F.col("id"), F.lit(NO_ID)).cast(kind).alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", spelled(F.col("own")).alias("fingerprint"), spelled(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"),
    ).drop("copy")
    out = result.keep(rows)
    remove_folder(spark, tables.folder)
    return out
