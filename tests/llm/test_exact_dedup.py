import hashlib
import re
from collections import Counter, defaultdict

from tests.llm.fixtures import SCHEMA, awkward, awkward_rows, empty
from voltatlas.llm import exact_dedup


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_of_awkward_rows(spark):
    rows = awkward_rows()
    groups = defaultdict(list)
    for r in rows:
        groups[_norm(r[1])].append(r[0])
    got = exact_dedup.exact_groups(awkward(spark)).collect()
    assert len(got) == len(rows)
    expected = Counter()
    for r in rows:
        ids = groups[_norm(r[1])]
        known = [i for i in ids if i is not None]
        expected[(r[0], min(known) if known else None, len(ids), hashlib.sha256(_norm(r[1]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    # Exactly one row of each group stays, and it has the smallest id.
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_that_stay_keep_their_columns(spark):
    docs = awkward(spark)
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.schema.names == docs.schema.names
    rows = out.collect()
    assert Counter(_norm(r.text) for r in rows) == Counter({_norm(r[1]) for r in awkward_rows()})
    byte = {(r[0], r[1]): r for r in awkward_rows()}
    assert all(tuple(r) == byte[(r.doc_id, r.text)] for r in rows)


def test_empty_table(spark):
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty(spark)).count() == 0


def test_filter_has_no_false_negatives_and_stays_exact_when_full(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 0)  # one block for all: many false positives
    rows = [(i, f"text {i % 900}") for i in range(2_000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(i, i % 900, i < 900) for i, _ in rows}


def test_filter_size_is_bounded():
    assert exact_dedup.blocks_for(0) == 1
    assert exact_dedup.blocks_for(10**12) == exact_dedup.MAX_BLOCKS
    sizes = [exact_dedup.blocks_for(n) for n in (10, 10**4, 10**5, 10**6, 10**7)]
    assert sizes == sorted(sizes) and all(s & (s - 1) == 0 for s in sizes)


def test_schema_of_the_fixture_clashes():
    assert "keep_id" in SCHEMA and "__hash" in SCHEMA
