"""Fold scores from sums against fits over the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltatlas.operators import least_squares


def data(seed=1, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [1e4, 0, 5]
    y = x @ [0.5, -2, 300] + rng.normal(size=n) * 20
    return x, y, rng.integers(0, 4, n)


@pytest.mark.parametrize("last", [None, 2])
def test_scores_equal_fits_over_rows(spark, last):
    x, y, fold = data()
    rows = [(*map(float, r), float(v), int(k)) for r, v, k in zip(x, y, fold)] + [(None, 1.0, 1.0, 1.0, 2)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, k int").repartition(5)
    got = least_squares.fold_scores(df, ["a", "b", "c"], "y", F.col("k"), [0.0, 7.0], last).collect()
    assert len(got) == 2 * (4 if last is None else 2)
    for r in got:
        train = fold != r.fold if last is None else fold < r.fold
        xt, yt = x[train], y[train]
        s = xt.std(axis=0, ddof=1)
        z = (xt - xt.mean(axis=0)) / s
        b = np.linalg.solve(z.T @ z + r.alpha * np.eye(3), z.T @ (yt - yt.mean()))
        test = fold == r.fold
        e = y[test] - yt.mean() - (x[test] - xt.mean(axis=0)) / s @ b
        assert r.n == test.sum()
        assert r.rmse == pytest.approx(np.sqrt((e**2).mean()), rel=1e-6)
        assert r.r2 == pytest.approx(1 - (e**2).mean() / y[test].var(), abs=1e-8)


def test_constant_label_and_feature(spark):
    df = spark.createDataFrame([(1.0, 2.0, i % 2) for i in range(10)], "x double, y double, k int")
    got = least_squares.fold_scores(df, ["x"], "y", F.col("k")).collect()
    assert [(r.r2, r.rmse) for r in got] == [(None, 0.0)] * 2


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double, y double, k int")
    assert least_squares.fold_scores(df, ["x"], "y", F.col("k")).count() == 0
