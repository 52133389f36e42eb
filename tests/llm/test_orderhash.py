import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from sparvane.llm import orderhash, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id int, content string, copies int"


def signature(text):
    """The tuple of each filled bin, by sorting all numbered k-mers of the whole text."""
    seen, bins = Counter(), {}
    for m in re.finditer(r"(?<![^ \t\n\r\x0b\x0c])(?=([^ \t\n\r\x0b\x0c](?s:.){0,11}))[^ \t\n\r\x0b\x0c]+", text):
        kmer = xxhash.xxh64_intdigest(m[1].encode(), 42)
        seen[kmer] += 1
        h = xxhash.xxh64_intdigest(struct.pack("<q", seen[kmer]), xxhash.xxh64_intdigest(struct.pack("<Q", kmer), 42))
        bins.setdefault((h >> 40) % 64, []).append((h & (2**33 - 1), m.start()))
    least = sorted((b, min(x)) for b, x in bins.items())
    return {b: tuple(h for h, _ in sorted((x, y), key=lambda p: p[1])) for (b, x), (_, y) in zip(least, least[1:] + least[:1])}


def likeness(a, b):
    return sum(a.get(k) == b.get(k) for k in a.keys() | b.keys()) / len(a.keys() | b.keys()) if a or b else 1.0


def brute_force(docs):
    """``docs``: (doc_id, text) of different ids."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1]):
        need = len(text) // 2
        edited = text[: len(text) - need] + following[:need]
        own = signature(text)
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, signature(edited)), 9), round(likeness(own, signature(following)), 9))
    return out


def found(frame):
    rows = frame.collect()
    assert all(len(r.fingerprint) % 8 == 0 for r in rows)
    return rows, {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows}


def test_whole_table_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows, got = found(queries.QUERIES["op11_order_minhash"](spark, SF))
    assert len(rows) == len(docs) and got == brute_force(docs)
    assert len({r.fingerprint for r in rows if r.n_chars}) <= len({t for _, t in docs if t})


def test_no_python_on_the_main_path(spark, monkeypatch):
    plans = []
    keep = orderhash.Tables.keep
    monkeypatch.setattr(orderhash.Tables, "keep", lambda self, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or keep(self, rows))
    queries.QUERIES["op11_order_minhash"](spark, SF)
    assert len(plans) == 6 and not any(re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", p) for p in plans)


def test_odd_rows(spark):
    rng = random.Random(2)
    words = ["ab", "cd", "é", "ü x", "🙂🙃", "same", "same"]
    texts = ["", None, " \t\n", "x", "one two", "z" * 3000, "🙂" * 41, "a b " * 9000, "  lead and trail  "] + [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(30)]
    docs = [(7 * i - 60, t) for i, t in enumerate(texts)]
    extra = [(None, "no id at all, " * 9)]
    frame = spark.createDataFrame([(*d, 1, "c", None) for d in docs + extra + docs[4:6] * 40], SCHEMA)
    rows, got = found(orderhash.fingerprints(frame))
    assert len(rows) == len(docs) + 1 + 80 and got == brute_force(docs + extra)
    assert Counter(r.doc_id for r in rows)[docs[4][0]] == 41
    assert orderhash.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_document_is_its_own_successor(spark):
    _, got = found(orderhash.fingerprints(spark.createDataFrame([(5, "some few words here", 0, "", 0)], SCHEMA)))
    assert got == brute_force([(5, "some few words here")]) and got[5][3] == 1.0


def test_likeness_falls_with_edit_distance_and_with_order(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(600)]
    changed = lambda n: [w if i % (600 // n) else "other" + w for i, w in enumerate(words)]
    turned = words[300:] + words[:300]
    shuffled = rng.sample(words, 600)
    near = [likeness(signature(" ".join(words)), signature(" ".join(x))) for x in (words, changed(6), changed(30), changed(120), turned, shuffled)]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[3] > 0 and near[4] < 0.8 and near[5] < 0.1


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitions_make_no_difference(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.createDataFrame([(i, f"text of number {i} " * (i % 5 + 1), 0, "", 0) for i in range(50)], SCHEMA)
        assert found(orderhash.fingerprints(rows))[1] == brute_force([(i, f"text of number {i} " * (i % 5 + 1)) for i in range(50)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
