"""Binned trees against trees grown row by row, their expressions, and the shared summaries."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voltatlas.operators import least_squares, models, trees

NAMES = ["a", "b", "c"]


def table(seed=0, n=160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.randrange(12), round(rng.uniform(-3, 3), 1), rng.choice([0.0, 1.0])
        rows.append((i, i % 4, float(a), b, c, float(round(1000 * (a * 0.7 + b * b * (1 + c)) + rng.randrange(500)))))
    return rows


SCHEMA = "id long, fold int, a double, b double, c double, y double"


def plain_tree(rows, r, w, p, depth=0):
    """Best split by trying every value of every feature; returns a function of a row."""
    n = sum(w[i] for i in rows)
    s = sum(w[i] * r[i] for i in rows)
    leaf = math.floor((p.rate if p.kind == "boost" else 1.0) * float(s) / (n + p.l2) + 0.5) if n else 0
    best = None
    if depth < p.depth and n >= p.min_split:
        for f in range(len(NAMES)):
            for v in sorted({rows[i][f] for i in rows if w[i]}):
                ln = sum(w[i] for i in rows if rows[i][f] <= v)
                ls = sum(w[i] * r[i] for i in rows if rows[i][f] <= v)
                if ln >= max(1, p.min_leaf) and n - ln >= max(1, p.min_leaf):
                    gain = float(ls) * float(ls) / (ln + p.l2) + float(s - ls) * float(s - ls) / (n - ln + p.l2)
                    if best is None or gain > best[0]:
                        best = (gain, f, v)
    if best is None or not best[0] > float(s) * float(s) / (n + p.l2):
        return lambda x: leaf
    _, f, v = best
    low = plain_tree({i: x for i, x in rows.items() if x[f] <= v}, r, w, p, depth + 1)
    high = plain_tree({i: x for i, x in rows.items() if x[f] > v}, r, w, p, depth + 1)
    return lambda x: low(x) if x[f] <= v else high(x)


def plain_model(rows, train, h, p):
    """Predictions of all rows, in units; ``h`` are the rows' numbers for the draws."""
    x = {i: r[2:5] for i, r in enumerate(rows)}
    y = {i: int(r[5]) for i, r in enumerate(rows)}
    fitted = [i for i in x if train(rows[i])]
    init = math.floor(sum(y[i] for i in fitted) / len(fitted) + 0.5) if p.kind == "boost" else 0
    now = dict.fromkeys(x, init)
    total = dict.fromkeys(x, 0)
    for t in range(p.trees):
        draw = {i: h[i] * pow(trees.STEP, t + 1, trees.PRIME) % trees.PRIME for i in x}
        if p.kind == "forest":
            w = {i: sum(limit <= draw[i] for limit in trees.poisson_limits()) for i in fitted}
            tree = plain_tree({i: x[i] for i in fitted}, y, w, p)
            for i in x:
                total[i] += tree(x[i])
        else:
            w = {i: int(p.subsample >= 1 or draw[i] < p.subsample * trees.PRIME) for i in fitted}
            tree = plain_tree({i: x[i] for i in fitted}, {i: y[i] - now[i] for i in x}, w, p)
            for i in x:
                now[i] += tree(x[i])
    return [now[i] if p.kind == "boost" else total[i] / float(p.trees) for i in x]


PARAMS = [
    trees.Params(trees=12, depth=3, min_leaf=5, l2=1.0),
    trees.Params(trees=10, depth=4, rate=0.05, min_split=10, subsample=0.8),
    trees.Params("forest", trees=9, depth=5, min_split=5),
    trees.Params("forest", trees=5, depth=8, min_leaf=3),
]


def numbers(cells, rows):
    """The hash of each row's cell."""
    place = {(g, *b): h for g, b, h in zip(cells.group.tolist(), map(tuple, cells.bins.tolist()), cells.h.tolist(), strict=True)}
    return [place[(r[1], *(int(np.searchsorted(e, v)) for e, v in zip(cells.edges, r[2:5], strict=True)))] for r in rows]


@pytest.mark.parametrize("p", PARAMS)
def test_cells_give_the_trees_of_the_rows(spark, p):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    cells = trees.summarise(df, NAMES, "y", F.col("fold"))
    assert cells.n.sum() == len(rows) and cells.s.sum() == sum(int(r[5]) for r in rows)
    model, steps = trees.fit(cells, cells.group != 2, p)
    expected = plain_model(rows, lambda r: r[1] != 2, numbers(cells, rows), p)
    scored = {r.id: r.prediction for r in trees.score(model, df).collect()}
    assert [scored[r[0]] for r in rows] == pytest.approx(expected, abs=1e-9)
    # The expression and its SQL text say the same.
    column = {r.id: r.p for r in df.select("id", model.column().alias("p")).collect()}
    assert column == scored
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, a DOUBLE, b DOUBLE, c DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(r[0], *r[2:5]) for r in rows])
    assert dict(con.execute(f"SELECT id, {model.sql()} FROM t").fetchall()) == pytest.approx(scored)
    y = np.array([r[5] for r in rows if r[1] == 2])
    guess = np.array([expected[r[0]] for r in rows if r[1] == 2])
    got = trees.scores(cells, cells.group == 2, trees.predicted(p, steps))
    assert got["n"] == len(y) and got["r2"] == pytest.approx(1 - ((y - guess) ** 2).mean() / y.var())
    assert got["rmse"] == pytest.approx(math.sqrt(((y - guess) ** 2).mean()))


def test_grid_against_a_plain_search(spark):
    rows = table(3, 80)
    df = spark.createDataFrame(rows, SCHEMA)
    cells = trees.summarise(df, NAMES, "y", F.col("fold"))
    grid = [trees.Params("boost", t, d, r, m, 1, s) for t in (4, 8) for d in (2, 3) for r in (0.1,) for m in (5, 10)
            for s in (0.8, 1.0)]
    expected = {}
    h = numbers(cells, rows)
    y = np.array([r[5] for r in rows])
    for p in grid:
        scores = []
        for fold in range(4):
            at = np.array([r[1] == fold for r in rows])
            guess = np.array(plain_model(rows, lambda r: r[1] != fold, h, p))
            scores.append(1 - ((y - guess)[at] ** 2).mean() / y[at].var())
        expected[p] = float(np.mean(scores))
    found = trees.grid_search(spark, cells, grid)
    got = {trees.Params(**__import__("json").loads(r.params)): r.cv_r2_mean for r in found.collect()}
    assert got == pytest.approx(expected)
    assert expected[trees.best_params(found)] == pytest.approx(max(expected.values()))
    assert len(set(trees.boosting_grid())) == 48
    # Without the trees each run is shared: 24 runs for 48 points.
    assert len({tuple(sorted((k, v) for k, v in vars(p).items() if k != "trees")) for p in trees.boosting_grid()}) == 24


def test_the_summary_is_bounded_and_keeps_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, *map(float, rng.normal(size=3)), float(i % 50)) for i in range(5_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for most in (10, 200, 100_000):
        cells = trees.summarise(df, NAMES, "y", bins=64, max_cells=most)
        assert len(cells.n) <= most and cells.n.sum() == 5_000 and cells.s.sum() == sum(i % 50 for i in range(5_000))
        assert all(cells.bins[:, k].max() < len(e) for k, e in enumerate(cells.edges))
    again = trees.summarise(df.repartition(2), NAMES, "y", bins=64, max_cells=100_000)
    assert (again.n.sum(), again.s.sum()) == (5_000, cells.s.sum())


def test_missing_values_and_no_rows(spark):
    rows = [(1, 0, None, 1.0, 0.0, 10.0), (2, 0, 1.0, None, 0.0, 20.0), (3, 0, 2.0, 1.0, None, 30.0),
            (4, 0, 1.0, 1.0, 1.0, None), (5, None, 1.0, 1.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = trees.summarise(df, NAMES, "y", F.col("fold"))
    assert cells.n.sum() == 3
    model, _ = trees.fit(cells, cells.group == 0, trees.Params(trees=3, depth=2, rate=1.0))
    a = [r.prediction for r in trees.score(model, df).orderBy("id").collect()]
    assert a == [r.p for r in df.orderBy("id").select(model.column().alias("p")).collect()] and len(a) == 5
    none = trees.summarise(df.limit(0), NAMES, "y")
    model, steps = trees.fit(none, none.group == 0, trees.Params(trees=2))
    assert steps.shape == (2, 0) and trees.score(model, df).count() == 5
    assert trees.scores(none, none.group == 0, trees.predicted(model.params, steps))["r2"] is None


def test_permutation_importance(spark):
    rows = table(5)
    df = spark.createDataFrame(rows, SCHEMA)
    cells = trees.summarise(df, NAMES, "y")
    model, _ = trees.fit(cells, cells.group == 0, trees.Params(trees=20, depth=3))
    got = {r.feature: r.mse_increase for r in trees.permutation_importance(model, df, "y", ["id"], ["fold"]).collect()}
    x = np.array([r[2:5] for r in rows])
    y = np.array([r[5] for r in rows])

    def mse(x):
        moved = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double")
        guess = [r.prediction for r in trees.score(model, moved).orderBy("id").collect()]
        return ((y - np.array(guess)) ** 2).mean()

    for k, f in enumerate(NAMES):
        other = x.copy()
        for fold in range(4):
            other[fold::4, k] = np.roll(x[fold::4, k], 1)
        assert got[f] == pytest.approx(mse(other) - mse(x))
    assert sum(model.importances()) == pytest.approx(1) and min(got, key=got.get) == "c"


def test_elastic_net_and_ridge_reach_their_optimum(spark):
    rows = table(7, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    x = np.array([r[2:5] for r in rows])
    y = np.array([r[5] for r in rows])
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    for alpha, ratio in [(50.0, 0.5), (500.0, 1.0), (10.0, 0.0), (1e6, 0.5)]:
        line = least_squares.fit_line(df, NAMES, "y", alpha, ratio)
        b = np.array(line.slopes) * x.std(0, ddof=1)
        r = y - y.mean() - z @ b
        slope = z.T @ r / len(y) - alpha * (1 - ratio) * b
        # Conditions of the optimum: the slope is the penalty's sign, or inside it where b is 0.
        assert np.all(np.where(b != 0, np.abs(slope - alpha * ratio * np.sign(b)) < 1e-6, np.abs(slope) <= alpha * ratio + 1e-6))
    line = least_squares.fit_line(df, NAMES, "y", 3.0)
    b = np.linalg.solve(z.T @ z + 3.0 * np.eye(3), z.T @ (y - y.mean())) / x.std(0, ddof=1)
    assert line.slopes == pytest.approx(tuple(b))
    assert line.intercept == pytest.approx(y.mean() - b @ x.mean(0))
    assert least_squares.fit_line(df.limit(0), NAMES, "y").intercept == 0.0


def test_suite_is_each_design_alone(spark):
    rows = table(9, 120)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("z", F.col("y") * 0.001)
    designs = {"first": (df, ["a", "b", "c"], "y"), "second": (df.filter("a > 2"), ["b"], "z")}
    suite = {"boosted": trees.Params(trees=5, depth=3), "line": 1.0}
    got = {(r.design, r.model): r for r in models.run_suite(designs, suite, ["id"], 0.3).collect()}
    assert len(got) == 4
    for name, (part, features, target) in designs.items():
        data = models.prepare(part, features, target, keep=["id"])
        test = (models.key_bucket(["id"], 10_000) < 3_000).cast("int")
        cells = trees.summarise(data, features, target, test, 1e-6)
        _, steps = trees.fit(cells, cells.group == 0, suite["boosted"])
        alone = trees.scores(cells, cells.group == 1, trees.predicted(suite["boosted"], steps))
        assert got[name, "boosted"].r2 == pytest.approx(alone["r2"]) and got[name, "boosted"].n == alone["n"]
        line = least_squares.fold_scores(data, features, target, test, [1.0]).filter("fold = 1").first()
        assert (got[name, "line"].n, got[name, "line"].r2) == (line.n, pytest.approx(line.r2))
