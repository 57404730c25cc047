"""Stripping agrees with Python for every kind of whitespace."""

import sys

from voltatlas.functions.columns import WHITESPACE, strip


def test_whitespace_is_complete():
    assert set(WHITESPACE) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_strip(spark):
    texts = [f"{w}a {w} b{w}{w}" for w in WHITESPACE] + ["", " ", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(strip("t").alias("s")).collect()] == [t.strip() for t in texts]
