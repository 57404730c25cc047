"""Regression trees and ensembles over one binned summary of the rows.

Every feature is cut into at most ``bins`` bins and the rows are summed up by (group, bins of all
features): count, sum and sum of squares of the label. Rows of one such cell are alike for every
split and every model, so trees grown over the cells are the trees over the binned rows. One pass
over the data serves all folds, grid points and designs; these are then grown side by side, a model
in a task. The summary has ``max_cells`` cells at most: if the rows make more, neighbouring bins
are merged, as in any histogram method.

Labels are whole multiples of a unit and leaves are rounded to it, so all sums are integers. They do
not depend on the order of rows, and equal splits have equal gains; ties go to the first feature and
the lowest cut. Samples of rows for a tree are drawn by cells, from a hash of the cell.

A fitted model compiles to one nested ``Column`` or to the same SQL.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BINS = 256
MAX_CELLS = 200_000
PRIME = 2_147_483_647  # draws are 1 .. PRIME - 1
STEP = 48_271  # a primitive root of PRIME: tree t multiplies a cell's number by STEP ** (t + 1)


@dataclass(frozen=True)
class Params:
    """``subsample`` draws cells for each boosted tree; a forest draws Poisson(1) multiples of each."""

    kind: str = "boost"  # or "forest"
    trees: int = 100
    depth: int = 4
    rate: float = 0.1
    min_split: int = 2
    min_leaf: int = 1
    subsample: float = 1.0
    l2: float = 0.0


@dataclass(frozen=True)
class Summary:
    """Cells in a fixed order: bins (one row a cell), group, count, sum, sum of squares, hash."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]  # of each feature: the largest value of every bin
    unit: float
    bins: np.ndarray
    group: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    h: np.ndarray

    def of(self, keep: np.ndarray) -> Summary:
        return replace(self, **{c: getattr(self, c)[keep] for c in ("bins", "group", "n", "s", "q", "h")})


@dataclass
class Model:
    """``splits`` of a tree: node -> (feature, bin); ``leaves``: node -> units. Children are 2k, 2k+1."""

    params: Params
    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    unit: float
    init: int
    trees: list[tuple[dict[int, tuple[int, int]], dict[int, int]]] = field(default_factory=list)
    gains: np.ndarray | None = None

    def _node(self, tree, k: int, cut: Callable, leaf: Callable):
        splits, leaves = tree
        if k not in splits:
            return leaf(leaves.get(k, 0))
        f, b = splits[k]
        return cut(self.features[f], float(self.edges[f][b]),
                   self._node(tree, 2 * k, cut, leaf), self._node(tree, 2 * k + 1, cut, leaf))

    def sql(self) -> str:
        """The prediction as one SQL expression; NULL features take the upper branch of their splits."""
        trees = [self._node(t, 1, lambda f, x, a, b: f"CASE WHEN {f} <= {x!r}::DOUBLE THEN {a} ELSE {b} END",
                            lambda v: f"({v})") for t in self.trees]
        return self._total([f"({t})::BIGINT" for t in trees])

    def _total(self, trees: list[str]) -> str:
        total = " + ".join([f"{self.init}::BIGINT", *trees])
        if self.params.kind == "forest":
            total = f"({total}) / {float(max(len(self.trees), 1))!r}::DOUBLE"
        return f"({total}) * {self.unit!r}::DOUBLE"

    def column(self) -> Column:
        """The same expression as a ``Column``."""
        return F.expr(self.sql())

    def importances(self) -> list[float]:
        """The gain of each feature's splits as a share of all gains."""
        total = float(self.gains.sum()) or 1.0
        return [float(g) / total for g in self.gains]


# -- the summary ----------------------------------------------------------------------------
def _edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Distinct values of features that have few, quantiles of others; bounded by ``bins``."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(f).alias("v")) for i, f in enumerate(features)])).alias("x")).select("x.*")
    distinct = long.filter("v is not null").distinct()
    few = distinct.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= bins)
    values: dict[int, list[float]] = {r.i: [] for r in few.collect()}
    for r in distinct.join(F.broadcast(few.select("i")), "i").collect():
        values[r.i].append(r.v)
    many = [f for i, f in enumerate(features) if i not in values]
    probs = [(k + 1) / bins for k in range(bins)]
    cuts = dict(zip(many, df.approxQuantile(many, probs, 1.0 / (8 * bins)), strict=True)) if many else {}
    return [np.unique(np.array(values.get(i, cuts.get(f)), dtype=np.float64)) for i, f in enumerate(features)]


def summarise(df: DataFrame, features: Sequence[str], label: str, group: Column | int = 0, unit: float = 1.0,
              bins: int = MAX_BINS, max_cells: int = MAX_CELLS) -> Summary:
    """One pass for the bins and one for the cells; what comes to the driver is bounded.

    Rows with a NULL label or group drop out. Values above the last edge, NULL and NaN are in the
    last bin.
    """
    group = F.lit(group) if isinstance(group, int) else group
    rows = df.select(
        group.cast("int").alias("g"), F.floor(F.col(label).cast("double") / F.lit(unit) + 0.5).cast("long").alias("y"),
        *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).filter("g is not null and y is not null")
    edges = _edges(rows, [f"x{i}" for i in range(len(features))], bins)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((batch.num_rows, len(edges) + 2), dtype=">u2")
            g = batch.column("g").to_numpy().astype(np.int32)
            x[:, 0], x[:, 1] = g >> 16, g & 0xFFFF
            for i, e in enumerate(edges):
                v = batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64)
                x[:, i + 2] = np.minimum(np.searchsorted(e, v), max(len(e) - 1, 0))
            y = batch.column("y").to_numpy()
            keys, at = np.unique(x.view(f"V{x.shape[1] * 2}").ravel(), return_inverse=True)
            n, s, q = np.bincount(at, minlength=len(keys)), np.zeros(len(keys), np.int64), np.zeros(len(keys))
            np.add.at(s, at, y)
            np.add.at(q, at, y.astype(np.float64) ** 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(n), pa.array(s), pa.array(q)],
                names=["k", "n", "s", "q"])

    found = rows.mapInArrow(cells, "k binary, n long, s long, q double")
    sums = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    found = found.groupBy("k").agg(*sums)
    while True:
        held = found.limit(max_cells + 1).toArrow()
        if held.num_rows <= max_cells:
            break
        if max(len(e) for e in edges) <= 1:
            raise ValueError(f"more than {max_cells} cells without any feature: too many groups")
        edges = [np.append(e[1::2], e[-1:]) if len(e) % 2 else e[1::2] for e in edges]

        def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                width = len(edges) + 2
                x = np.frombuffer(b"".join(b.column("k").to_pylist()), dtype=">u2").reshape(-1, width).copy()
                x[:, 2:] >>= 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r.tobytes() for r in x], pa.binary()), *b.columns[1:]], names=["k", "n", "s", "q"])

        found = found.mapInArrow(halved, "k binary, n long, s long, q double").groupBy("k").agg(*sums)
    held = held.sort_by("k")
    x = np.frombuffer(b"".join(held["k"].to_pylist()), dtype=">u2").reshape(-1, len(features) + 2).astype(np.int64)
    bins_, g = x[:, 2:], ((x[:, 0] << 16) | x[:, 1]).astype(np.uint32).astype(np.int32)
    names = ["|".join(map(str, (k, *b))) for k, b in zip(g.tolist(), bins_.tolist(), strict=True)]
    h = [1 + int(hashlib.md5(t.encode()).hexdigest()[:13], 16) % (PRIME - 1) for t in names]
    return Summary(tuple(features), tuple(edges), unit, bins_, g, *(
        held[c].to_numpy() for c in ("n", "s", "q")), np.array(h, np.int64))


# -- growing --------------------------------------------------------------------------------
def draws(h: np.ndarray, tree: int) -> np.ndarray:
    """A number in 1 .. PRIME - 1 for each cell and tree."""
    return h * pow(STEP, tree + 1, PRIME) % PRIME


def poisson_limits(most: int = 8) -> list[int]:
    """A draw below the k-th limit (and not below one before) takes a cell k times."""
    term, total, out = math.exp(-1.0), 0.0, []
    for k in range(most):
        total += term
        out.append(math.floor(total * PRIME))
        term /= k + 1
    return out


def _grow(bins: np.ndarray, offsets: np.ndarray, n: np.ndarray, r: np.ndarray, p: Params, gains: np.ndarray):
    """One tree by levels: splits, leaves, and the node of every cell, drawn or not."""
    width = int(offsets[-1])
    node = np.ones(len(bins), dtype=np.int64)
    splits: dict[int, tuple[int, int]] = {}
    drawn = np.flatnonzero(n > 0)
    flat = bins + offsets[:-1]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least = max(p.min_leaf, 1)
    active = drawn
    for _ in range(p.depth):
        if not len(active):
            break
        ids, at = np.unique(node[active], return_inverse=True)
        hn, hs = (np.zeros(len(ids) * width, dtype=np.int64) for _ in range(2))
        place = (at[:, None] * width + flat[active]).ravel()
        np.add.at(hn, place, np.repeat(n[active], bins.shape[1]))
        np.add.at(hs, place, np.repeat(r[active], bins.shape[1]))
        hn, hs = hn.reshape(len(ids), width), hs.reshape(len(ids), width)
        ln, ls = np.cumsum(hn, axis=1), np.cumsum(hs, axis=1)
        total_n, total_s = ln[:, offsets[1] - 1], ls[:, offsets[1] - 1]
        # Sums of the features before; every feature adds up to the node's totals.
        ln -= owner * total_n[:, None]
        ls -= owner * total_s[:, None]
        rn, rs = total_n[:, None] - ln, total_s[:, None] - ls
        lf, rf = ls.astype(np.float64), rs.astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = lf * lf / (ln + p.l2) + rf * rf / (rn + p.l2)
        gain = np.where((ln >= least) & (rn >= least), gain, -np.inf)
        best = gain.argmax(axis=1)
        top = gain[np.arange(len(ids)), best]
        alone = total_s.astype(np.float64) * total_s / (total_n + p.l2)
        good = (total_n >= p.min_split) & (top > alone)
        keep = []
        for i in np.flatnonzero(good):
            f = int(owner[best[i]])
            splits[int(ids[i])] = (f, int(best[i] - offsets[f]))
            gains[f] += top[i] - alone[i]
            keep.append(int(ids[i]))
        if not keep:
            break
        cut = np.full(int(ids.max()) + 1, -1, dtype=np.int64)
        by = np.zeros(int(ids.max()) + 1, dtype=np.int64)
        for k in keep:
            by[k], cut[k] = splits[k]
        inside = np.flatnonzero((node < len(cut)) & (cut[np.minimum(node, len(cut) - 1)] >= 0))
        k = node[inside]
        node[inside] = 2 * k + (bins[inside, by[k]] > cut[k])
        active = np.intersect1d(drawn, inside, assume_unique=True)
    leaves = {}
    ids, at = np.unique(node[drawn], return_inverse=True)
    sn, ss = (np.zeros(len(ids), dtype=np.int64) for _ in range(2))
    np.add.at(sn, at, n[drawn])
    np.add.at(ss, at, r[drawn])
    rate = p.rate if p.kind == "boost" else 1.0
    for k, a, b in zip(ids.tolist(), sn.tolist(), ss.tolist(), strict=True):
        leaves[k] = math.floor(rate * float(b) / (a + p.l2) + 0.5)
    return splits, leaves, node


def fit(cells: Summary, train: np.ndarray, p: Params) -> tuple[Model, np.ndarray]:
    """A model of the training cells, and the predictions of all cells after every tree, in units.

    The predictions have one row a tree: of the sum so far when boosting, of the tree in a forest.
    """
    n, s = np.where(train, cells.n, 0), np.where(train, cells.s, 0)
    total = int(n.sum())
    model = Model(p, cells.features, cells.edges, cells.unit, 0, gains=np.zeros(len(cells.features)))
    if p.kind == "boost" and total:
        model.init = math.floor(float(int(s.sum())) / total + 0.5)
    offsets = np.concatenate(([0], np.cumsum([max(len(e), 1) for e in cells.edges])))
    now = np.full(len(n), model.init, dtype=np.int64)
    limits = np.array(poisson_limits())
    out = np.empty((p.trees, len(n)), dtype=np.int64)
    for t in range(p.trees):
        if p.kind == "forest":
            times = np.searchsorted(limits, draws(cells.h, t), side="right")
            tn, tr = n * times, s * times
        else:
            times = draws(cells.h, t) < p.subsample * PRIME if p.subsample < 1 else 1
            tn, tr = n * times, (s - n * now) * times
        splits, leaves, node = _grow(cells.bins, offsets, tn, tr, p, model.gains)
        model.trees.append((splits, leaves))
        ids, at = np.unique(node, return_inverse=True)
        value = np.array([leaves.get(int(k), 0) for k in ids], dtype=np.int64)[at]
        now = now + value if p.kind == "boost" else value
        out[t] = now
    return model, out


def predicted(p: Params, steps: np.ndarray, trees: int | None = None) -> np.ndarray:
    """Predictions after ``trees`` trees, in units."""
    trees = p.trees if trees is None else trees
    return steps[trees - 1].astype(np.float64) if p.kind == "boost" else steps[:trees].sum(axis=0) / float(trees)


def scores(cells: Summary, test: np.ndarray, guess: np.ndarray) -> dict:
    """R2, MAE of cell means, and RMSE of the test cells; R2 is NULL for a constant label."""
    n, s, q = cells.n[test].astype(np.float64), cells.s[test].astype(np.float64), cells.q[test]
    g = guess[test]
    rows = float(n.sum())
    if not rows:
        return {"n": 0, "r2": None, "rmse": None}
    left = float((q - 2 * g * s + n * g * g).sum())
    spread = float(q.sum()) - float(s.sum()) ** 2 / rows
    return {"n": int(rows), "r2": 1 - left / spread if spread > 0 else None,
            "rmse": math.sqrt(max(left, 0.0) / rows) * cells.unit}


def score(model: Model, df: DataFrame, name: str = "prediction") -> DataFrame:
    """Adds the prediction, a batch at a time: for ensembles too large for one expression."""
    from pyspark.sql import types as T

    splits = [(sorted(t[0].items()), t[1]) for t in model.trees]
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [batch.column(f"_x{i}").to_numpy(zero_copy_only=False).astype(np.float64)
                 for i in range(len(model.features))]
            total = np.full(batch.num_rows, model.init, dtype=np.int64)
            for cuts, leaves in splits:
                node = np.ones(batch.num_rows, dtype=np.int64)
                for k, (f, b) in cuts:  # parents come before their children
                    at = node == k
                    node[at] = 2 * k + ~(x[f][at] <= model.edges[f][b])
                ids, where = np.unique(node, return_inverse=True)
                total += np.array([leaves.get(int(k), 0) for k in ids], dtype=np.int64)[where]
            out = total.astype(np.float64)
            if model.params.kind == "forest":
                out /= float(max(len(model.trees), 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(out * model.unit)], names=[*names, name])

    rows = df.select(*df.columns, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(model.features)])
    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


# -- many models side by side ---------------------------------------------------------------
def side_by_side(spark: SparkSession, cells: Summary, jobs: Sequence[dict], run: Callable[[Summary, dict], list[dict]],
                 schema: str) -> DataFrame:
    """``run(cells, job)`` for each job, a job in a task; the cells are broadcast (``MAX_CELLS``)."""
    known = spark.sparkContext.broadcast(cells)
    frame = spark.createDataFrame([(json.dumps(j),) for j in jobs], "job string").repartition(max(len(jobs), 1), F.col("job"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for job in f["job"]:
                yield pd.DataFrame(run(known.value, json.loads(job)))

    return frame.mapInPandas(each, schema)


def _train(cells: Summary, fold: int, last: bool) -> np.ndarray:
    return cells.group < fold if last else cells.group != fold


def _grid_job(cells: Summary, job: dict) -> list[dict]:
    p = Params(**{**job["params"], "trees": max(job["trees"])})
    test = cells.group == job["fold"]
    _, steps = fit(cells, _train(cells, job["fold"], job["last"]), p)
    return [{"params": json.dumps({**job["params"], "trees": t}, sort_keys=True), "fold": job["fold"],
             **scores(cells, test, predicted(p, steps, t))} for t in job["trees"]]


def fold_scores(spark: SparkSession, cells: Summary, grid: Sequence[Params], folds: Sequence[int] | None = None,
                last: int | None = None) -> DataFrame:
    """``params, fold, n, r2, rmse`` of every grid point and fold.

    A fold is a group of the summary, predicted from all other groups; with ``last``, the last
    groups (years) are predicted from all smaller ones. Points that differ in the number of trees only are one run: the shorter is its beginning.
    """
    runs: dict[str, set[int]] = {}
    for p in grid:
        rest = {k: v for k, v in asdict(p).items() if k != "trees"}
        runs.setdefault(json.dumps(rest, sort_keys=True), set()).add(p.trees)
    groups = sorted(set(cells.group.tolist()))
    if folds is None:
        folds = groups if last is None else groups[-last:]
    jobs = [{"params": json.loads(k), "trees": sorted(t), "fold": int(i), "last": last is not None}
            for k, t in runs.items() for i in folds]
    return side_by_side(spark, cells, jobs, _grid_job, "params string, fold int, n long, r2 double, rmse double")


def grid_search(spark: SparkSession, cells: Summary, grid: Sequence[Params]) -> DataFrame:
    """Mean score of each grid point over the folds, best first."""
    return fold_scores(spark, cells, grid).groupBy("params").agg(
        F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"), F.count("r2").alias("folds")
    ).orderBy(F.col("cv_r2_mean").desc(), "params")


def best_params(searched: DataFrame) -> Params:
    """The first grid point of a search."""
    return Params(**json.loads(searched.first().params))


# -- permutation importance -----------------------------------------------------------------
def permuted(rows: DataFrame, features: Sequence[str], keys: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Each row once as it is (``permuted`` NULL) and once a feature with another row's value.

    Within a group the values of a feature move one place on in the order of the keys; the first
    row takes the last row's. Choose groups (years, buckets of a hash) of a size for one task.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy(*within).orderBy(*keys)
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    moved = rows.withColumns({
        f"_m_{f}": F.coalesce(F.lag(f).over(order), F.last(f).over(every)) for f in features})
    tagged = moved.withColumn("permuted", F.explode(F.array(
        F.lit(None).cast("string"), *[F.lit(f) for f in features])))
    return tagged.withColumns({
        f: F.when(F.col("permuted") == f, F.col(f"_m_{f}")).otherwise(F.col(f)) for f in features
    }).drop(*[f"_m_{f}" for f in features])


def permutation_importance(model: Model, rows: DataFrame, label: str, keys: Sequence[str],
                           within: Sequence[str]) -> DataFrame:
    """``feature, mse_increase`` when a feature's values move between rows, in one scoring pass."""
    guess = score(model, permuted(rows, model.features, keys, within))
    mse = guess.groupBy("permuted").agg(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)).alias("mse"))
    base = mse.filter("permuted is null").select("mse").scalar()
    return mse.filter("permuted is not null").select(
        F.col("permuted").alias("feature"), (F.col("mse") - base).alias("mse_increase"))


def boosting_grid() -> list[Params]:
    """The 48 combinations of the full search."""
    return [Params("boost", t, d, r, m, 1, s) for t in (100, 200) for d in (3, 5, 7) for r in (0.05, 0.1)
            for m in (5, 10) for s in (0.8, 1.0)]
