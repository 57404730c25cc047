import random

import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import token_counts as tc


@pytest.fixture(scope="module")
def known():
    with open(tc.VOCABULARY, "rb") as f:
        return tc._encoding(f.read())


def brute(encoding, sizes, text, sections, rule):
    """Owner and crossing of every token, character by character."""
    data = text.encode()
    char_of = [i for i, c in enumerate(text) for _ in c.encode()]
    owner_of = {}
    for k, (a, b) in enumerate(sections):
        for i in range(a, b):
            owner_of[i] = k
    edges = {e for s in sections for e in s}
    at, out = 0, []
    for t in encoding.encode_ordinary(text):
        chars = sorted(set(char_of[at:at + sizes[t]]))
        at += sizes[t]
        owners = [owner_of.get(c, -1) for c in chars]
        if rule == "first":
            k = owners[0]
        elif rule == "last":
            k = owners[-1]
        else:
            inside = [o for o in owners if o >= 0]
            k = max(sorted(set(inside)), key=lambda o: (inside.count(o), -o)) if inside else -1
            if inside and len(set(owners)) > 1 and inside.count(k) < max(owners.count(-1), 1):
                k = -1
        out.append((k, any(chars[0] < e < chars[-1] + 1 for e in edges)))
    assert at == len(data)
    return out


@pytest.mark.parametrize("rule", tc.RULES)
def test_attribution_against_every_character(known, rule):
    rng = random.Random(3)
    alphabet = ["the ", "lamp", "é", "日本", "🎉", "\n", "  ", "x", "123", "\r\n", "ing", "\n\n\n"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(0, 7))))
        sections = [(a, b) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        first, end = tc.token_spans(*known, text)
        import numpy as np

        starts, ends = (np.array([s[i] for s in sections], dtype=np.int64) for i in (0, 1))
        owner, crosses = tc.attribute(first, end, starts, ends, rule)
        expected = brute(*known, text, sections, rule)
        assert list(zip(owner.tolist(), crosses.tolist(), strict=True)) == [
            (k, c and bool(sections)) for k, c in expected], (text, sections)


def test_lines_add_up_to_the_document(spark, known):
    rows = awkward_rows()
    docs = awkward(spark)
    got = tc.count_tokens(docs).groupBy("row.doc_id").sum("n_tokens").collect()
    expected = {}
    for r in rows:
        expected[r[0]] = expected.get(r[0], 0) + len(known[0].encode_ordinary(r[1] or ""))
    assert {r[0]: r[1] for r in got} == expected
    assert tc.count_tokens(empty(spark)).count() == 0


def test_given_sections(spark, known):
    rows = [(1, "Title here\nBody text follows", [(0, 10), (11, 100), (5, 8)]), (2, "abc", None), (3, None, [(0, 4)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:long,end:long>>")
    got = tc.count_tokens(docs, sections_col="parts", rule="first").collect()
    by = {(r.row.doc_id, r.section): r for r in got}
    total = len(known[0].encode_ordinary(rows[0][1]))
    assert sum(r.n_tokens for (i, _), r in by.items() if i == 1) == total
    assert by[2, -1].n_tokens == len(known[0].encode_ordinary("abc"))
    assert by[3, 0].n_tokens == 0 and (3, -1) not in by
    with pytest.raises(ValueError, match="rule"):
        tc.count_tokens(docs, rule="none")


def test_long_whitespace_is_cut_like_the_pattern(known, monkeypatch):
    import re

    encoding, _ = known
    rng = random.Random(8)
    monkeypatch.setattr(tc, "_LONG_SPACE", re.compile(tc._LONG_SPACE.pattern.replace("10000", "2")))
    for _ in range(400):
        text = "".join(rng.choice(["a", "9", "!", " ", " ", "  ", "\n", "\t", "　", "\x1c", "é", "'s"]) for _ in range(30))
        assert tc.encode(encoding, text) == encoding.encode_ordinary(text)


def test_millions_of_whitespace_characters(spark, known):
    encoding, sizes = known
    texts = [" " * 2_000_000, "\n" * 2_000_000, " \t\n" * 700_000, "a" + " " * 2_000_000 + "b", "x\n" + "\t" * 2_000_000 + "\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = tc.count_tokens(docs).groupBy("row.doc_id").sum("n_tokens").collect()
    for doc_id, n in got:
        ids = tc.encode(encoding, texts[doc_id])
        assert n == len(ids) and encoding.decode(ids) == texts[doc_id]
