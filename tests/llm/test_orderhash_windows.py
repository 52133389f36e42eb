import hashlib
import random
import struct
from collections import Counter

import pytest
import xxhash

from sparvane.llm import orderhash, queries

SF = "/root/testdata/sf0.001"


def signature(text):
    """The tuple of each filled bin, by sorting all numbered k-mers, one from every position of the whole text."""
    seen, bins = Counter(), {}
    for i in range(len(text)):
        kmer = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text[i : i + 12].encode("utf-32-be"), 42) << 30 & (1 << 64) - 1))[0] >> 30
        seen[kmer] += 1
        h = xxhash.xxh64_intdigest(struct.pack("<q", seen[kmer]), xxhash.xxh64_intdigest(struct.pack("<q", kmer), 42))
        bins.setdefault((h >> 40) % 64, []).append((h & (2**33 - 1), i))
    least = sorted((b, min(x)) for b, x in bins.items())
    return {b: tuple(h for h, _ in sorted((x, y), key=lambda p: p[1])) for (b, x), (_, y) in zip(least, least[1:] + least[:1])}


def likeness(a, b):
    return sum(a.get(k) == b.get(k) for k in a.keys() | b.keys()) / len(a.keys() | b.keys()) if a or b else 1.0


def brute_force(docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: -d[0])
    out = {}
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        need = len(text) // 2
        edited = text[: len(text) - need] + following[:need]
        own = signature(text)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, signature(edited)), 9), round(likeness(own, signature(following)), 9))
    return out


def found(frame):
    return {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in frame.collect()}


def test_whole_table_by_every_position(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(queries.QUERIES["op11_order_minhash"](spark, SF)) == brute_force(docs)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_odd_texts_by_every_position(spark, partitions):
    rng = random.Random(4)
    texts = ["", None, " \t\n", "x", "ab", "one two", "z" * 3000, "🙂" * 41, "a b " * 9000, " " * 500, "elevenchars", "twelve chars", "thirteen char", "same " * 3, "same " * 3]
    texts += ["".join(rng.choices("abü🙂 ", k=rng.randint(1, 900))) for _ in range(30)] + ["".join(rng.choices("abcdefgh", k=n)) for n in (21, 22, 23, 24, 25, 31, 32, 33, 63, 64, 65, 4000)]
    docs = [(7 * i - 60, t) for i, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert found(orderhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_force(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_what_differs_within_a_long_word_is_seen(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choices("abcdefghij", k=n))
    base, start = letters(3000), letters(20)
    texts = [base, "X".join(base[i : i + 100] for i in range(0, 3000, 100)), start + letters(150), start + letters(150)]
    got = found(orderhash.fingerprints(spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")))
    assert 0.3 < got[10][3] < 1.0  # 29 letters more in 3,000
    assert got[8][3] < 0.2  # nothing in common but the first 20 of 170 letters
    assert 0.05 < got[10][2] < 0.7  # half of it was replaced


def test_long_texts_are_collected_one_at_a_time(spark, monkeypatch):
    seen, keep, before = [], orderhash.Tables.keep, spark.conf.get(orderhash.HASHED)
    monkeypatch.setattr(orderhash.Tables, "keep", lambda self, rows: seen.append(("edited_sha256" in rows.columns and "own" in rows.columns, spark.conf.get(orderhash.HASHED))) or keep(self, rows))
    orderhash.fingerprints(spark.createDataFrame([(1, "some text"), (2, "another")], "doc_id long, text string"))
    assert (True, "1") in seen and spark.conf.get(orderhash.HASHED) == before
