import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from voltatlas.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, turns string, `key` int, base map<string,int>"


def plain(rows):
    """Every node of the rebuilt conversations, one prefix at a time."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tid = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, tid), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return Counter((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def found(turns):
    got = prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.conversation_rows(turns)))
    assert got.columns == [*prefix_trie.NODE, "ends_sha256"]
    return Counter(tuple(r) for r in got.collect())


def conversations(seed, n=300):
    rng = random.Random(seed)
    roles, words = ["user", "assistant", None, ""], ["a", "b", "hello é", None, "", "日本 🎉"]
    rows = []
    hot = [("user", "very common")] + [("assistant", f"line {i}") for i in range(4)]
    for c in rng.sample(range(n * 2), n):
        kind = rng.random()
        if kind < 0.4:
            path = hot
        elif kind < 0.6:
            path = hot[:rng.randrange(1, 5)] + [(rng.choice(roles), rng.choice(words))] * rng.randrange(3)
        else:
            path = [(rng.choice(roles), rng.choice(words)) for _ in range(rng.randrange(1, 7))]
        for k, (role, text) in enumerate(path):
            rows.append((c, None if rng.random() < 0.05 else k, role, text, "x", 1, None))
    rows += [(None, 0, "user", "no conversation", "x", 1, None)]
    rows += rows[:20]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 60])
def test_nodes_of_random_conversations(spark, partitions):
    rows = conversations(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_of_one_conversation_and_chunks_of_ends(spark, monkeypatch):
    rows = [(c, k, "user", f"turn {k}", "", 0, None) for c in range(400) for k in range(10)]
    rows += [(1_000 + c, 0, "user", "turn 0", "", 0, None) for c in range(5)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    conv = np.arange(100, dtype=np.int64)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    out = prefix_trie.range_nodes(conv, [b"\x01" * 16] * 100, [np.array([3])] * 100, 0)
    chunks = [np.frombuffer(x["ends"][0], "<i8") for x in out if x["kind"] == 2 and x["depth"] == 1]
    assert len(chunks) == 15 and np.concatenate(chunks).tolist() == conv.tolist()


def test_long_conversations_and_texts(spark):
    path = [("user", f"t{i % 37}") for i in range(3_000)]
    rows = [(c, k, role, text + ("!" if c == 7 and k == 2_500 else ""), "", 0, None)
            for c in (0, 5, 7, 10) for k, (role, text) in enumerate(path)]
    rows += [(20, 0, "user", "x" * 500_000, "", 0, None), (21, 0, "user", "", "", 0, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_without_turns_or_conversations(spark):
    # Conversation 7 takes its first turns from conversation 5, which is absent.
    absent = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(absent, 0, "user", "a", "", 0, None), (absent, 1, "user", "b", "", 0, None)]
    digest = hashlib.sha256(str(absent).encode()).hexdigest()
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows) == Counter([(absent, 0, None, 1, 0, 1, 0, digest)])
    assert not found(spark.createDataFrame([], SCHEMA))
    assert not found(spark.createDataFrame([(None, 0, "a", "b", "", 0, None)], SCHEMA))


def test_query_against_every_prefix(spark, sf):
    from voltatlas.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_prefix_trie"](spark, sf)
    assert Counter(tuple(r) for r in got.select(*prefix_trie.NODE, "ends_sha256").collect()) == plain(rows)
