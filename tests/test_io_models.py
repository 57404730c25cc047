"""Sources, sinks, models and plan shapes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voltatlas import params as p
from voltatlas.operators import models
from voltatlas.operators.energy import capacity_benchmark_table
from voltatlas.sources import readers, writers


def test_csv_round_trip_of_hard_text(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(1, 'say "hi", ok', 1.5), (2, "two\nlines", float("nan")), (3, "", None),
            (4, None, 2.0), (5, "back\\slash", -0.25)]
    df = spark.createDataFrame(data, "i int, s string, x double")
    writers.write_csv(df, path, ["x", "s", "i"])
    back = readers.read_csv(spark, path, "x double, s string, i int", multi_line=True)
    got = [(r.i, r.s, r.x) for r in back.orderBy("i").collect()]
    assert got == [(1, 'say "hi", ok', 1.5), (2, "two\nlines", None), (3, None, None),
                   (4, None, 2.0), (5, "back\\slash", -0.25)]  # an empty cell is missing


def test_lines(spark, tmp_path):
    path = str(tmp_path / "l")
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "url string")
    writers.write_lines(df, path)
    assert [r.line for r in readers.read_lines(spark, path).collect()] == ["a", "b"]
    (tmp_path / "raw.txt").write_text(" x \n\n\t\ny\n")
    assert [r.line for r in readers.read_lines(spark, str(tmp_path / "raw.txt")).collect()] == [
        "x", "y"]


def test_json_array_and_nulls(spark, tmp_path):
    f = tmp_path / "map.json"
    f.write_text(json.dumps([{"name": "A", "capacity_mw": None, "has_energy_data": False},
                             {"name": "B", "capacity_mw": 2.5, "year": 2001}]))
    got = readers.read_json_records(spark, str(f), readers.FACILITY_MAP).collect()
    assert [(r.name, r.capacity_mw, r.year) for r in got] == [("A", None, None), ("B", 2.5, 2001)]
    out = str(tmp_path / "out")
    writers.write_json_records(spark.createDataFrame([(1, float("nan"))], "i int, x double"), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert [json.loads(x) for x in lines] == [{"i": 1, "x": None}]


def test_keyed_document(spark):
    df = spark.createDataFrame([("VA", 2, None), ("TX", 1, 0.5), (None, 9, 9.0)],
                               "abbrev string, n int, x double")
    doc = json.loads(writers.keyed_document(df, "abbrev").first().document)
    assert doc == {"TX": {"n": 1, "x": 0.5}, "VA": {"n": 2, "x": None}}


def test_api_response(spark):
    body = json.dumps({"response": {"data": [
        {"period": "2001", "sales": 1.5}, {"period": "2002", "sales": "2"},
        {"period": "2003", "sales": None}, {"period": "2004"}, {"period": "x", "sales": 1}]}})
    df = spark.createDataFrame([("Ohio", body), ("Iowa", "{"), ("Utah", "{}")],
                               "state string, body string")
    got = sorted(tuple(r) for r in readers.flatten_api_response(df).collect())
    assert got == [("Ohio", 2001, 1500.0), ("Ohio", 2002, 2000.0)]


def test_first_available(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert readers.first_available(spark, paths) == paths[1]
    with pytest.raises(FileNotFoundError):
        readers.first_available(spark, paths[:1])


def test_rename_all(spark):
    df = spark.createDataFrame([tuple(range(24))], [f"c{i}" for i in range(24)])
    assert readers.rename_all(df).columns == p.SALES_COLUMNS


def test_split_by_category(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "crypto"), (2, "small"), (3, "big_ai")],
                               "i int, dc_category string")
    writers.write_split_by_category(df, path, ["crypto", "big_ai"])
    assert (tmp_path / "s/by_category/dc_category=crypto").exists()
    assert not (tmp_path / "s/by_category/dc_category=small").exists()
    assert writers.read_back(spark, f"{path}/all", "i int, dc_category string").count() == 3


@pytest.fixture(scope="module")
def linear_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = 5 + x @ [3.0, -2.0, 0.5] + rng.normal(scale=0.1, size=400)
    data = [(i, *map(float, r), float(v), 2000 + i % 8) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double, year int")


def test_ridge_equals_normal_equations(linear_rows):
    pdf = linear_rows.toPandas()
    x = pdf[["a", "b", "c"]].to_numpy()
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    y = pdf["y"].to_numpy()
    alpha = 50.0
    w = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ (y - y.mean()))
    model = models.fit(linear_rows, ["a", "b", "c"], "y",
                       models.ridge(linear_rows, "y", alpha))
    assert model.stages[-1].coefficients.toArray() == pytest.approx(w, rel=1e-6)


def test_scaling(linear_rows):
    pdf = linear_rows.toPandas()
    got = models.standard_scale(linear_rows, ["a"]).orderBy("id").toPandas()["a"]
    assert got.to_numpy() == pytest.approx(((pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0)).to_numpy())
    got = models.robust_scale(linear_rows, ["b"]).orderBy("id").toPandas()["b"]
    iqr = pdf.b.quantile(0.75) - pdf.b.quantile(0.25)
    assert got.to_numpy() == pytest.approx(((pdf.b - pdf.b.median()) / iqr).to_numpy())


def test_splits_are_stable_and_complete(linear_rows):
    train, test = models.holdout_split(linear_rows, ["id"], 0.2)
    again = models.holdout_split(linear_rows.repartition(7), ["id"], 0.2)[1]
    assert train.count() + test.count() == 400 and 40 < test.count() < 120
    assert {r.id for r in test.collect()} == {r.id for r in again.collect()}
    kept, last = models.last_year_split(linear_rows)
    assert {r.year for r in last.collect()} == {2007} and kept.count() == 350


def test_cross_validation_and_metrics(linear_rows):
    folds = models.k_fold(linear_rows, ["a", "b", "c"], "y", models.linear(), ["id"], 4)
    rows = folds.collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2, 3] and sum(r.n for r in rows) == 400
    assert all(r.r2 > 0.99 for r in rows)
    years = models.expanding_window(linear_rows, ["a", "b", "c"], "y", models.linear())
    assert sorted(r.year for r in years.collect()) == [2005, 2006, 2007]
    const = linear_rows.withColumn("y", F.lit(1.0)).withColumn("prediction", F.lit(2.0))
    m = models.regression_metrics(const, "y").first()
    assert m.r2 is None and m.mae == 1.0 and m.rmse == 1.0


def test_trees_importances_and_bundle(spark, linear_rows, tmp_path):
    model = models.fit(linear_rows, ["a", "b", "c"], "y", models.random_forest(10, 4))
    imp = {r.feature: r.importance for r in models.importances(model, ["a", "b", "c"], spark).collect()}
    assert max(imp, key=imp.get) == "a" and sum(imp.values()) == pytest.approx(1.0)
    writers.write_model_bundle(model, str(tmp_path / "m"))
    again = writers.read_model_bundle(str(tmp_path / "m"))
    a = [r.prediction for r in models.score(model, linear_rows).orderBy("id").collect()]
    b = [r.prediction for r in models.score(again, linear_rows).orderBy("id").collect()]
    assert a == b


def test_grid_and_comparison(linear_rows):
    grid = [{"trees": 2, "depth": 1}, {"trees": 6, "depth": 3}]
    out = models.grid_search(linear_rows, ["a", "b", "c"], "y", grid, models.gradient_boosting,
                             ["id"], 2).collect()
    assert len(out) == 2 and out[0].cv_r2_mean > out[1].cv_r2_mean
    assert "('trees', 6)" in out[0].params
    assert len(models.boosting_grid()) == 48
    train, test = models.holdout_split(linear_rows, ["id"])
    scores = models.compare_models(train, test, ["a", "b", "c"], "y",
                                   {"lin": models.linear(), "rf": models.random_forest(5, 3)})
    assert {r.model: r.r2 > 0.99 for r in scores.collect()} == {"lin": True, "rf": False}


def test_capacity_benchmark_table(spark):
    out = capacity_benchmark_table(
        spark, lambda x: x.withColumn("prediction", F.col("total_capacity_mw") * 7971.6 * 1.1))
    got = {r.capacity_mw: r.error_pct for r in out.collect()}
    assert got == {5.0: pytest.approx(10), 20.0: pytest.approx(10), 50.0: pytest.approx(10),
                   100.0: pytest.approx(10)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_is_pruned_and_filtered(spark, sf):
    plan = plan_of(entry.queries()["p07_filter_operational"](spark, sf))
    assert "PushedFilters" in plan
    scan = next(x for x in plan.splitlines() if "orders" in x and "ReadSchema" in x)
    assert "o_totalprice" not in scan.split("ReadSchema")[1]


def test_top_k_within_limits_before_the_shuffle(spark, sf):
    plan = plan_of(entry.queries()["t03_top_k_within"](spark, sf))
    assert plan.count("WindowGroupLimit") == 2
