"""Least squares and ridge from sums: one aggregate of the rows serves all folds and penalties.

The sums of a fold are its row count, means and covariances, which Spark merges stably. Training
sums are those of the other folds put together, so no fold is read, fitted or scored again. What
remains is a small system of equations for each fold and penalty, over one row of sums a fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, variables: Sequence[str], fold: Column) -> DataFrame:
    """``fold, n, means, covariances`` (upper triangle, row by row); rows with a NULL drop out."""
    rows = df.select(fold.cast("int").alias("fold"), *[F.col(v).cast("double").alias(v) for v in variables])
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i:]]
    return rows.dropna().groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(v) for v in variables]).alias("means"),
        F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("covariances"))


def _together(parts: list[tuple[float, np.ndarray, np.ndarray]]):
    """Count, mean and covariance of all rows of the parts."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    spread = sum(p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts) / n
    return n, mean, spread


def _coefficients(n: float, mean: np.ndarray, spread: np.ndarray, alpha: float):
    """Slopes and intercept; the penalty is on slopes of features scaled to unit deviation."""
    p = len(mean) - 1
    deviation = np.sqrt(np.diag(spread)[:p] * n / max(n - 1, 1))
    scale = np.where(deviation > 0, deviation, 1.0)
    z = spread[:p, :p] / np.outer(scale, scale) * n + alpha * np.eye(p)
    b = np.linalg.lstsq(z, spread[:p, p] / scale * n, rcond=None)[0] / scale
    return b, mean[p] - b @ mean[:p]


def _net(n: float, mean: np.ndarray, spread: np.ndarray, alpha: float, l1_ratio: float,
         tolerance: float = 1e-13, sweeps: int = 100_000):
    """Elastic net by coordinate descent on the covariances of features scaled to unit deviation."""
    p = len(mean) - 1
    deviation = np.sqrt(np.diag(spread)[:p] * n / max(n - 1, 1))
    scale = np.where(deviation > 0, deviation, 1.0)
    g, c = spread[:p, :p] / np.outer(scale, scale), spread[:p, p] / scale
    b = np.zeros(p)
    for _ in range(sweeps):
        before = b.copy()
        for j in range(p):
            left = c[j] - g[j] @ b + g[j, j] * b[j]
            weight = g[j, j] + alpha * (1 - l1_ratio)
            b[j] = np.sign(left) * max(abs(left) - alpha * l1_ratio, 0.0) / weight if weight > 0 else 0.0
        if np.abs(b - before).max(initial=0.0) <= tolerance * max(np.abs(b).max(initial=0.0), 1.0):
            break
    b = b / scale
    return b, mean[p] - b @ mean[:p]


@dataclass(frozen=True)
class Line:
    """A fitted linear model."""

    features: tuple[str, ...]
    slopes: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        out = F.lit(self.intercept)
        for f, b in zip(self.features, self.slopes, strict=True):
            out = out + F.lit(b) * F.col(f)
        return out


def _sums(row, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    spread = np.zeros((size, size))
    spread[np.triu_indices(size)] = row.covariances
    return float(row.n), np.array(row.means), spread + np.triu(spread, 1).T


def fit_line(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0,
             l1_ratio: float | None = None) -> Line:
    """Least squares, ridge (penalty on the sum of squares) or, with ``l1_ratio``, elastic net.

    The net minimises half the mean squared error plus alpha times the mixed penalty. One scan; one
    row of sums comes to the driver. Rows with a NULL drop out; without rows the line is 0.
    """
    row = moments(df, [*features, label], F.lit(0)).first()
    if row is None:
        return Line(tuple(features), (0.0,) * len(features), 0.0)
    sums = _sums(row, len(features) + 1)
    b, a = _coefficients(*sums, alpha) if l1_ratio is None else _net(*sums, alpha, l1_ratio)
    return Line(tuple(features), tuple(map(float, b)), float(a))


def squares(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """L3: adds the products of all pairs of features and returns the names of degree 1 and 2."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    names = {f"{a}__{b}": F.col(a) * F.col(b) for a, b in pairs}
    return df.withColumns(names), [*features, *names]


def fold_scores(df: DataFrame, features: Sequence[str], label: str, fold: Column,
                alphas: Sequence[float] = (0.0,), last: int | None = None) -> DataFrame:
    """``fold, alpha, n, r2, rmse`` of each fold, predicted from others.

    Without ``last`` from all other folds; with it, each of the ``last`` largest fold numbers
    (years) is predicted from all smaller ones. R2 is NULL for a constant label. Lazy.
    """
    size = len(features) + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = {}
        for r in pdf.itertuples():
            sums[int(r.fold)] = _sums(r, size)
        out = []
        for k in sorted(sums) if last is None else sorted(sums)[-last:]:
            train = [s for j, s in sums.items() if (j != k if last is None else j < k)]
            if not train:
                continue
            for alpha in alphas:
                n, left, spread = _errors(sums[k], *_coefficients(*_together(train), alpha))
                r2 = 1 - left / spread if spread > 0 else None
                out.append((k, float(alpha), int(n), r2, float(np.sqrt(max(left, 0.0)))))
        return pd.DataFrame(out, columns=["fold", "alpha", "n", "r2", "rmse"])

    return moments(df, [*features, label], fold).groupBy().applyInPandas(
        solve, "fold int, alpha double, n bigint, r2 double, rmse double")


def pair_scores(df: DataFrame, features: Sequence[str], label: str, fold: Column, alpha: float = 0.0) -> DataFrame:
    """``design, n, r2, rmse``; fold 2k + 1 is predicted from fold 2k, for every design k."""
    size = len(features) + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sums, out = {int(r.fold): _sums(r, size) for r in pdf.itertuples()}, []
        for k in sorted(sums):
            if k % 2 and k - 1 in sums:
                n, left, spread = _errors(sums[k], *_coefficients(*sums[k - 1], alpha))
                out.append((k // 2, int(n), 1 - left / spread if spread > 0 else None, float(np.sqrt(max(left, 0.0)))))
        return pd.DataFrame(out, columns=["design", "n", "r2", "rmse"])

    return moments(df, [*features, label], fold).groupBy().applyInPandas(
        solve, "design int, n bigint, r2 double, rmse double")


def _errors(sums: tuple, b: np.ndarray, a: float) -> tuple[float, float, float]:
    """Rows, mean squared error of a line, and variance of the label, from the rows' sums."""
    n, mean, spread = sums
    off = mean[-1] - a - b @ mean[:-1]
    return n, spread[-1, -1] - 2 * b @ spread[:-1, -1] + b @ spread[:-1, :-1] @ b + off * off, spread[-1, -1]


def grid_scores(scores: DataFrame) -> DataFrame:
    """Mean fold score of each penalty, best first."""
    return scores.groupBy("alpha").agg(F.avg("r2").alias("cv_r2_mean")).orderBy(
        F.col("cv_r2_mean").desc(), "alpha")
