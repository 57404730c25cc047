import random
import re
from collections import defaultdict

import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import mixing


def _size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def _targets(sizes, weights=(3, 1, 2), share=1.5):
    """Sharing by weight again and again until no source is above twice its size."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in free}
        for s in above:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]


def test_awkward_rows(spark):
    rows = awkward_rows()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += _size(r[1])
    targets = _targets(dict(sizes))
    docs = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows if r[0] is not None}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        if r.doc_id is not None:
            source = by_id[r.doc_id][3]
            assert (r.size, r.source_size) == (_size(by_id[r.doc_id][1]), sizes[source])
            assert r.target == pytest.approx(targets[source])
    for r in got:
        taken[round(r.target, 6)] += r.taken
    for t, n in taken.items():
        assert abs(n - t) <= 2 * mixing.BLOCK_WORDS, (t, n)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)


def test_empty_table_and_no_words(spark):
    assert mixing.mix(empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(none).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mixed_documents(empty(spark)).count() == 0
    assert mixing.mixed_documents(none).count() == 2


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(4)
    cells, expected = [], {}
    for shard in range(30):
        n = rng.randrange(1, 9)
        votes = [rng.choice([0, rng.randrange(1, 20_000), rng.randrange(1, 600_000)]) for _ in range(n)]
        if shard == 3:
            votes = [2_500] * n  # ties
        seats = int(sum(votes) / mixing.VOTE_UNITS + 0.5)
        won = [0] * n
        for _ in range(seats):
            k = max(range(n), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[k] += 1
        for i, v in enumerate(votes):
            cells.append((shard, i, v, 10**9))
            expected[shard, i] = won[i] if v else 0
    df = spark.createDataFrame(cells, "shard long, source_no long, votes long, cell_size long")
    got = {(r.shard, r.source_no): r.quota for r in mixing.shard_quotas(df).collect()}
    assert got == expected


def test_hot_source_comes_near_its_target(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 400), "hot" if i % 3 else f"s{i % 7}") for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, shard_words=4_096).join(docs.select("doc_id", "source"), "doc_id")
    out = mixed.groupBy("source", "target").sum("taken").collect()
    assert all(abs(r["sum(taken)"] - r["target"]) <= 0.02 * r["target"] + 64 for r in out)
    copies = mixing.mixed_documents(docs).groupBy("source").count().collect()
    assert len(copies) == len(out)


def test_targets_by_repeated_sharing(spark):
    """Sizes of all kinds, also those where most sources reach their limit."""
    rng = random.Random(12)
    for case in range(12):
        n = rng.randrange(1, 25)
        sizes = {f"s{i:02}": rng.choice([0, 1, rng.randrange(1, 100), rng.randrange(1, 10**6)]) for i in range(n)}
        if case % 3 == 0:
            sizes = {k: 1_000 + rng.randrange(300) for k in sizes}  # even sources
        if case % 4 == 0:
            sizes[None] = rng.randrange(1, 1_000)
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").coalesce(1)
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        expected = _targets(sizes)
        assert got == {k: pytest.approx(v, rel=1e-9, abs=1e-6) for k, v in expected.items()}
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))
