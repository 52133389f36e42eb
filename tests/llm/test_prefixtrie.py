import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sparvane.llm import prefixtrie, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn int, role string, text string, depth string, fp int"


def brute_force(rows):
    """Nodes of (conv_id, turn, role, text) rows as a dictionary of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = (x or "" for x in (role, text))
            tie = hashlib.sha256(len(role.encode()).to_bytes(8, "little") + (role + text).encode()).digest()
            own[conv].append(((turn is not None, turn or 0), [int.from_bytes(tie[i : i + 8], "little", signed=True) for i in range(0, 32, 8)], (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    trie, members, above, depth, texts, ends = {}, [[]], [None], [0], [""], [[]]
    for c, turns in sorted(own.items()):
        h = zlib.crc32(str(c).encode()) % 4
        at = 0
        members[0].append(c)
        for turn in own.get(c - c % 20, [])[:h] + turns[h:]:
            if (at, turn) not in trie:
                trie[at, turn] = len(members)
                for column, value in ((members, []), (above, at), (depth, depth[at] + 1), (texts, turn[1]), (ends, [])):
                    column.append(value)
            at = trie[at, turn]
            members[at].append(c)
        ends[at].append(c)
    children = [0] * len(members)
    for p in above[1:]:
        children[p] += 1
    leaves = [int(not n) for n in children]
    saved = [(len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", t)) for m, t in zip(members, texts)]
    for i in range(len(members) - 1, 0, -1):  # parents come before their children
        leaves[above[i]] += leaves[i]
        saved[above[i]] += saved[i]
    digest = lambda e: hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
    return sorted((m[0], depth[i], members[above[i]][0] if i else -1, len(m), children[i], leaves[i], saved[i], digest(ends[i])) for i, m in enumerate(members) if m)


def found(frame):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect())


def test_whole_table_equals_brute_force(spark, sf="/root/testdata/sf0.01"):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(queries.QUERIES["op12_prefix_trie"](spark, sf)) == brute_force(rows)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_sql_equals_brute_force(sf):
    import duckdb

    conversations = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'")  # noqa: F841  the SQL names it
    got = duckdb.sql(f"SELECT conv_id, depth, coalesce(parent_conv_id, -1), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({queries.ORACLE_SQL['op12_prefix_trie']})").fetchall()
    assert sorted(got) == brute_force(conversations.fetchall())


def odd_rows(seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), 200, 219, 1000007]:
        if c not in (20, 61):  # a family without its lender
            rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "c", "", None, "\x0b d\n"])) for t in range(rng.choice([1, 2, 3, 5, 9]))]
    rows += rows[:40]  # repeated rows
    rows += [(40, t, "user", f"turn {t % 3} ") for t in range(130)] + [(41, t, "user", f"turn {t % 3} ") for t in range(120)]  # long ones that share a beginning
    rows += [(c, 0, "user", "x " * 50000) for c in (2001, 2002)] + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("primes", [prefixtrie.PRIMES, (5, 7)], ids=str)
def test_odd_rows_and_collisions(spark, primes):
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert found(prefixtrie.nodes(frame, primes)) == brute_force(rows)


def test_a_conversation_over_many_partitions(spark):
    rows = [(c, t, "user", f"{t * t % 11} {c // 60}") for c in (40, 57, 60) for t in range(300)] + [(40, 5, "user", "again")] * 200
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
        assert found(prefixtrie.nodes(frame)) == brute_force(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_conversations(spark):
    assert prefixtrie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefixtrie.nodes(spark.createDataFrame([(None, 1, "user", "a", "", 1)], SCHEMA)).count() == 0


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 1, "user", "a")]
    assert found(prefixtrie.nodes(spark.createDataFrame([(*r, "", 1) for r in rows], SCHEMA))) == brute_force(rows) == [(alone, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
