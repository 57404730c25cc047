"""The pipeline's stages on a small table, each against a plain version of its decision."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.fixtures import awkward
from tests.llm.test_minhash import expected_classes
from tests.llm.test_quality import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = docs.toPandas()
    for name in list(steps)[:-1]:
        assert list(steps[name].columns) == COLUMNS
    first = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    good = {r.doc_id for r in first.itertuples() if not base(r.text)[-1]}
    kept = set(steps["quality_rules"].doc_id)
    assert kept <= good and len(kept) >= 0.9 * len(good)

    by_text = {}
    for r in steps["quality_rules"].itertuples():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        by_text[key] = min(by_text.get(key, r.doc_id), r.doc_id)
    assert sorted(steps["exact_dedup"].doc_id) == sorted(by_text.values())

    ordered = steps["exact_dedup"].sort_values("doc_id")
    roots, _ = expected_classes(list(ordered.text), 5, 80)
    ids = list(ordered.doc_id)
    assert sorted(steps["near_dedup"].doc_id) == sorted({ids[r] for r in roots})

    copies = Counter(steps["mixing"].doc_id)
    assert set(copies) <= set(steps["near_dedup"].doc_id) and max(copies.values()) <= 2
    words = steps["near_dedup"].text.str.split().str.len().sum()
    assert abs(steps["mixing"].text.str.split().str.len().sum() - 1.5 * words) < 0.15 * words

    last = steps["sentence_pieces"]
    assert last.round_trip.all() and (last.n_pieces > 0).all() and Counter(last.doc_id) == copies


def test_awkward_rows_pass(spark, tmp_path):
    """NULLs, repeats and clashing names go through every stage."""
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    docs = awkward(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_a_stage_deletes_what_the_one_before_has_left(spark, tmp_path):
    from voltatlas.session import written

    docs, before = awkward(spark), set()
    for name, stage in corpus_pipeline.STAGES[:3]:
        known = set(written())
        docs = stage(spark, docs, "")
        assert before and not before & set(written()) or name == "quality_rules"
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        before = set(written()) - known
    assert before and docs.count() > 0
