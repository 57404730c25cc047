"""Small document tables with the awkward cases: NULLs, empty and long texts, ties, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "h string, row string, n long, block long, `__hash` string, keep_id string, extra map<string,int>")
WORDS = "the of and to in a is that it on der die und le la les que el y stone river cloud lamp".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (f"{rng.randrange(400)}" if rng.random() < 0.5 else "") for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = prose(rng, 90)
    words = base.split()
    near = [" ".join(words[:k] + ["changed"] + words[k + 1:]) for k in (10, 40, 80)]
    texts = [
        None, "", "   ", "\n\t", "one", "two words", "A b\tC", "a  B c", "a b c", base, base, base.upper(),
        base.replace(" ", "\n"), *near, prose(rng, 400), prose(rng, 3_000), "x" * 20_000, "word " * 300,
        "same line\nsame line\nother\nsame line", "日本語 テキスト 🎉", "é" * 50, "! ? ... ###", "No letters? 12 34"]
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(20)]
    rows = []
    for i, t in enumerate(texts):
        lang = [None, "en", "fr", "de", "zz"][i % 5]
        source = [None, "a", "b", "é", "a"][i % 5]
        rows.append((i * 10, t, lang, source, i, "x", "y", i, i, "z", "w", {"k": i}))
    rows.append((None, "a text without an id", "en", "a", 1, "x", "y", 1, 1, "z", "w", None))
    rows.append((None, base, "en", None, 1, "x", "y", 1, 1, "z", "w", None))
    rows += [rows[9], rows[16], rows[5]]  # repeated rows
    return rows


def awkward(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
