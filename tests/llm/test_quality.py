import re

import pytest

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(spark):
    rows = awkward_rows()
    extra = [
        ("a b c d e f g h " * 3, ), ("x " * 8, ), ("x " * 9, ), ("p q r s t u v w z p q r s t u v w", ),
        ("one\n\none\n one\none\n", ), ("<<>> | # é# ÀB", ), ("k " * 500 + "unlike " + "m " * 500, )]
    texts = {r[0]: r[1] for r in rows if r[0] is not None} | {10**6 + i: t for i, (t,) in enumerate(extra)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    got = quality.judge(docs, carry=["doc_id"]).collect()
    assert {r.row.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == {i: base(t) for i, t in texts.items()}


def test_clashing_columns_and_rows(spark):
    docs = awkward(spark)
    assert quality.judge(docs).count() == len(awkward_rows())
    assert quality.keep_good(docs).schema.names == docs.schema.names
    assert quality.judge(empty(spark)).count() == 0
    assert quality.keep_good(empty(spark)).count() == 0


def test_without_references_the_base_rule_decides(spark):
    docs = spark.createDataFrame([(1, "word " * 5, None), (2, " ".join(f"w{i}" for i in range(90)), "xx")],
                                 "doc_id long, text string, lang string")
    got = {r.row.doc_id: r for r in quality.judge(docs).collect()}
    assert not got[1].kept and got[2].kept and got[2].language is None and got[2].word_distance is None


def test_other_languages_stay_in_a_mixed_corpus(spark):
    import random

    rng = random.Random(4)

    def written(letters, n, some=()):
        return " ".join(rng.choice(some) if some and rng.random() < 0.4 else "".join(
            rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n))

    english = "abcdefghilmnorstu"
    rows = [(i, written(english, 150, quality.COMMON_WORDS["en"]), "en", True) for i in range(30)]
    rows.append((30, written("ABCD#$%", 150), "en", False))
    rows += [(40 + i, written("абвгдежзиклмнопрст", 150), lang, True) for i, lang in enumerate(("ru", None, "uk"))]
    rows += [(50, written("αβγδεζηθικλμν", 150), "el", True), (51, written("ابتثجحخدذرز", 150), "ar", True),
             (52, written("कखगघचछजझटठ", 150), "hi", True), (53, "слово " * 150, "ru", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, good boolean")
    got = {r.row.doc_id: r for r in quality.judge(docs).collect()}
    assert {i: r.kept for i, r in got.items()} == {i: good for i, _, _, good in rows}
    assert got[40].language is None and got[40].class_distance is None and got[0].language == "en"
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r[0] for r in rows if r[3]}


def test_junk_goes_and_clean_prose_stays(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.rsplit('/', 1)[0]}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, carry=["doc_id"]).filter("not base_failed").selectExpr("row.doc_id", "kept")
    counts = {(r.quality, r.kept): r["count"] for r in got.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.005 * counts[1, True]
    assert counts[0, False] >= 0.9 * (counts[0, False] + counts.get((0, True), 0))


def test_distance_is_that_of_the_definition(spark):
    import math

    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.0, 0.6, 0.3]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    half = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    expected = math.sqrt((kl(p, half) + kl(q, half)) / 2)
    from pyspark.sql import functions as F

    row = spark.range(1).select(
        quality.jensen_shannon(F.array(*[F.lit(x) for x in p]), q).alias("d"),
        quality.jensen_shannon(F.array(*[F.lit(x) for x in p]), p).alias("same")).first()
    assert row.d == pytest.approx(expected) and row.same == 0.0
