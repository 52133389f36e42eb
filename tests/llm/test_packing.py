import random
import zlib

import numpy as np

from sparvane.llm import packing
from sparvane.llm.bpe import encoder

SCHEMA = "doc_id long, text string, length string, task string"


def brute_force_bins(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_tree_finds_tightest_open_capacity():
    rng = random.Random(3)
    for capacity in (1, 7, 8, 100):
        tree, open_ = packing.CapacityTree(capacity), set()
        for _ in range(300):
            room = rng.randint(0, capacity)
            (open_.discard if room in open_ else open_.add)(room)
            tree.set(room, room in open_)
            length = rng.randint(1, capacity)
            assert tree.tightest(length) == min((r for r in open_ if r >= length), default=None)


def test_plan_equals_piecewise_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([5, 16, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        rows, bins = packing.plan({x: lengths.count(x) for x in set(lengths)}, capacity)
        assert bins == brute_force_bins(lengths, capacity)
        used = {}
        for length, _, count, first, each, offset in rows.tolist():
            for k in range(count):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert sum(map(len, used.values())) == len(lengths)
        for places in used.values():
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity


def test_pack_cuts_places_and_checksums(spark):
    docs = [(1, "the quick brown fox " * 40, "x", "y"), (2, None, None, None), (2, "", "a", "b"), (None, "hello", "", ""), (3, "word " * 7, "", ""), (3, "word " * 7, "", "")]
    out = packing.pack(spark.createDataFrame(docs, SCHEMA), capacity=16, with_ids=True).toPandas()
    words = encoder()
    wanted = sorted(np.frombuffer(words.words(t or ""), "<u4").tolist() + [1] for _, t, *_ in docs)
    got = {}
    for r in out.itertuples():
        assert len(r.ids) == r.length <= 16
        assert zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32
    for _, bin_ in out.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 16
    for i, d in enumerate(out[out.doc_id == 1].sort_values("start").itertuples()):
        assert (d.piece, d.start) == (i, 16 * i)
        got.setdefault(1, []).extend(d.ids)
    assert got[1] == max(wanted, key=len)
    assert len(out) == sum(-(-len(w) // 16) for w in wanted)
    assert out.sequence_id.nunique() == brute_force_bins(out.length.tolist(), 16)


def test_pack_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
