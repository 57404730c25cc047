import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty, prose
from voltatlas.llm import minhash
from voltatlas.llm.components import connected_components
from voltatlas.llm.shingles import shingle_sets, slices, word_hashes


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def shingles(text, k):
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or frozenset([tuple(w)])


def expected_classes(texts, k, percent):
    """Root of each index by all pairs."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))], sets


def check(found, ids, texts, k, percent):
    roots, sets = expected_classes(texts, k, percent)
    least = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    expected = Counter((ids[i], len(sets[i]), least.get(roots[i]) if sets[i] else ids[i]) for i in range(len(ids)))
    rows = found.selectExpr("row.doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == expected
    classes = len({r for i, r in enumerate(roots) if sets[i]}) + sum(not s for s in sets)
    assert sum(r.kept for r in rows) == classes


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_awkward_rows(spark, k, percent):
    rows = awkward_rows()
    found = minhash.near_duplicates(awkward(spark), words=k, percent=percent)
    check(found, [r[0] for r in rows], [r[1] for r in rows], k, percent)


def test_chains_and_scattered_copies(spark):
    """Copies of copies, and copies that are only linked through their common original."""
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        original = prose(rng, 120).split()
        for _ in range(12):  # each with edits of its own
            copy = list(original)
            for _ in range(2):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(original))
        chain = list(original)
        for step in range(8):
            chain = list(chain)
            chain[10 + 12 * step] = f"link{rng.randrange(10**6)}"
            texts.append(" ".join(chain))
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    check(minhash.near_duplicates(docs, words=3, percent=85), list(range(len(texts))), texts, 3, 85)


def test_stage_returns_one_row_of_each_group(spark):
    docs = awkward(spark)
    out = minhash.drop_near_duplicates(docs)
    assert out.schema.names == docs.schema.names
    roots, sets = expected_classes([r[1] for r in awkward_rows()], 5, 80)
    assert out.count() == len({r for i, r in enumerate(roots) if sets[i]}) + sum(not s for s in sets)


def test_empty_table(spark):
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    texts = pa.array(["Aa bbé aa", None, "", "\tBBÉ bbé\n", "aa"])
    hashes, names = [], []
    for start, data, offsets in slices(texts):
        h, bounds = word_hashes(data, offsets)
        assert len(bounds) == len(offsets)
        for i in range(len(offsets) - 1):
            w = words_of(texts[start + i].as_py())
            assert len(w) == bounds[i + 1] - bounds[i]
            hashes += h[bounds[i]:bounds[i + 1]].tolist()
            names += w
    pairs = set(zip(names, hashes, strict=True))
    assert len(pairs) == len(set(names)) == len(set(hashes))


def test_slices_give_the_same_sets():
    rng = random.Random(1)
    texts = pa.array([prose(rng, rng.randrange(0, 50)) for _ in range(60)])
    whole = [shingle_sets(d, o, 3) for _, d, o in slices(texts)]
    small = [shingle_sets(d, o, 3) for _, d, o in slices(texts, limit=100)]
    assert len(small) > 5
    assert np.array_equal(np.concatenate([s for s, _ in whole]), np.concatenate([s for s, _ in small]))


def test_densified_bins_agree_for_equal_sets():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 9).astype(np.uint64) * np.uint64(2))
    both = np.concatenate((a, a))
    bands = minhash.band_hashes(both, np.array([0, len(a), 2 * len(a)]))
    assert np.array_equal(bands[0], bands[1]) and bands.shape == (2, minhash.BINS // minhash.ROWS)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1_000 + i, 1_001 + i) for i in range(40)]
    edges += [(5_000, 5_001 + i) for i in range(50)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {n: find(n) for n in list(root)}
