import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import line_dedup

SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars, min_docs):
    """(n_lines, n_dropped, kept text) of each (id, text)."""
    holders = defaultdict(set)
    split = [[(x, x.strip(SPACES).translate(LOWER)) for x in (t or "").split("\n")] for _, t in rows]
    for (i, _), lines in zip(rows, split):
        for _, k in lines:
            if len(k) >= min_chars:
                holders[k].add(i)
    top = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in holders.items()}
    out = []
    for (i, _), lines in zip(rows, split):
        kept = [x for x, k in lines if len(holders.get(k, ())) < min_docs or top[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def found(docs, min_chars=40, min_docs=5):
    maps = line_dedup.line_bitmaps(docs, min_chars=min_chars, min_docs=min_docs)
    got = line_dedup.kept_text(docs, maps)
    return Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect())


def shared_lines(seed, n=400):
    rng = random.Random(seed)
    common = [f"shared line {i} é " + "abcdefgh" * 5 for i in range(6)]
    rows = []
    for i in range(n):
        lines = [f"own line {i} {j} " + "z" * 40 for j in range(rng.randrange(4))]
        lines += [rng.choice(["", " ", "\t"]) + rng.choice([c, c.upper().replace("É", "é"), c]) + rng.choice(["", " \r"])
                  for c in rng.sample(common, rng.randrange(4))]
        lines += ["short"] * rng.randrange(2)
        rng.shuffle(lines)
        if i % 3 == 0:  # one line in a third of all documents, twice in some
            lines += ["hot " * 12] * (1 + i % 2)
        rows.append((rng.choice([i, i, i, None, i // 2]), "\n".join(lines) if i % 50 else None))
    rows += rows[:30] * 3  # repeated rows
    rare = [(1_000 + i, "four documents only " + "q" * 40) for i in range(4)]
    five = [(2_000 + i, "five documents " + "r" * 40 + "\nrest") for i in range(5)]
    return rows + rare + five


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_lines_of_shared_texts(spark, partitions):
    rows = shared_lines(partitions)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(docs) == plain(rows, 40, 5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_batches_cross_runs(spark):
    rows = shared_lines(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows, 40, 5)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in awkward_rows()]
    for min_chars, min_docs in [(40, 5), (1, 2), (3, 3)]:
        assert found(awkward(spark), min_chars, min_docs) == plain(rows, min_chars, min_docs)


def test_ids_of_strings_and_long_texts(spark):
    line = "a line of forty characters and some more of them"
    rows = [(f"d{i}", "\n".join([line, f"own {i}"] * (20_000 if i == 3 else 1))) for i in range(6)]
    assert found(spark.createDataFrame(rows, "doc_id string, text string")) == plain(rows, 40, 5)


def test_empty_table(spark):
    assert line_dedup.line_bitmaps(empty(spark)).count() == 0
    assert not found(empty(spark))


def test_bitmaps_are_small_and_read_back(spark):
    line = "x" * 60
    rows = [(i, "\n".join([line] * 5_000 + ["own"])) for i in range(5)]
    maps = line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in maps} == {0, 1, 2, 3} and all(len(r.keep) < 60 for r in maps)
    mask = line_dedup.keep_mask(maps[0].keep, maps[0].n_lines)
    assert mask.tolist() == [False] * 5_000 + [True] and np.sum(~mask) == maps[0].n_dropped


def test_query_digests(spark, sf):
    from voltatlas.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_line_dedup"](spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter({
        (i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in plain(docs, 40, 5).items()})
