"""Operators that read their input once or share one summary: plans and plain counterparts."""

import statistics

import pytest
from pyspark.sql import functions as F

from voltatlas.operators import cleaning, energy, models
from voltatlas.operators.quantiles import medians_by
from voltatlas.queries import base, load
from voltatlas.session import remove, shared_folder, stored, written
from voltatlas.sources import readers, writers


QUERIES = load().QUERIES


def scans(df, table):
    """Scans of a table in the plan, scalar subqueries included."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"{table}.parquet")


def test_latest_period_reads_its_input_once(spark, sf):
    e = base.electricity(spark, sf)
    once = cleaning.latest_period(e, keys=["state"])
    assert scans(once, "lineitem") == 1
    assert sorted(map(tuple, once.select("state", "year").collect())) == sorted(
        map(tuple, cleaning.latest_period(e).select("state", "year").collect()))
    for name in ("d03_state_category_mart", "d09_state_share", "e07_capacity_scenarios", "a08_category_by_state"):
        assert scans(QUERIES[name](spark, sf), "lineitem") <= 1, name


def test_yearly_sheets_read_their_own_files(spark, sf):
    """The sales are joined once, before; a sheet reads the files of its year alone."""
    out = QUERIES["s13_sales_sheets"](spark, sf)
    assert scans(out, "lineitem") == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    for year in range(1995, 2002):
        assert f"= {year})" in plan, year
    assert plan.count("PartitionFilters: [isnotnull(year") == 7


def test_models_are_compared_without_reading_the_tables_again(spark, sf):
    assert scans(QUERIES["l14_compare_models"](spark, sf), "lineitem") == 0


def test_compared_models_score_the_held_rows_in_one_read(spark):
    line = spark.range(60).select(
        F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), "id",
        (3.0 * F.col("id") + F.col("id") % 7).alias("y"))
    path = f"{shared_folder(spark, 'held')}/held.parquet"
    line.where("id % 5 = 0").write.parquet(path)
    train, held = line.where("id % 5 > 0"), spark.read.parquet(path)
    estimators = {"line": models.linear(), "forest": models.random_forest(5, 3), "boosted": models.gradient_boosting(3, 2)}
    out = models.compare_models(train, held, ["a", "b"], "y", estimators)
    assert scans(out, "held") == 1
    got = {r.model: r for r in out.collect()}
    assert set(got) == set(estimators)
    for name, est in estimators.items():
        alone = models.regression_metrics(
            models.score(models.fit(train, ["a", "b"], "y", est), held), "y").first()
        assert tuple(got[name])[1:] == pytest.approx(tuple(alone)), name


def test_latest_period_with_missing_years(spark):
    df = spark.createDataFrame(
        [("a", 2000, 1.0), ("a", 2001, None), ("b", 2000, 3.0), ("c", None, 4.0), (None, 2001, 5.0)],
        "state string, year int, x double")
    got = cleaning.latest_period(df, keys=["state"])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 2001, None), (None, 2001, 5.0)]
    assert cleaning.latest_period(df.limit(0), keys=["state"]).count() == 0


def test_medians_of_several_groupings(spark):
    rows = [("a", 1990, 1.0), ("a", 1991, 5.0), ("b", 1990, None), ("b", 1991, 8.0), (None, 1992, 2.0), ("c", None, 4.0)]
    df = spark.createDataFrame(rows, "state string, year_operational int, mw double")
    got = {(r.grouping, r.key): r["median"] for r in medians_by(
        df, "mw", {"state": "state", "year": "year_operational", "": None}).collect()}
    values = [m for *_, m in rows if m is not None]
    assert got["", ""] == statistics.median(values)
    for s in "abc":
        assert got["state", s] == statistics.median([m for t, _, m in rows if t == s and m is not None])
    assert got["year", "1991"] == 6.5 and ("state", "") not in got
    out = {(r.state, r.year_operational): r.capacity_mw_imputed for r in energy.impute_cascade(df, "mw").collect()}
    assert out["b", 1990] == 8.0 and out["a", 1990] == 1.0
    none = energy.impute_cascade(df.withColumn("mw", F.lit(None).cast("double")), "mw", default=15.0)
    assert {r.capacity_mw_imputed for r in none.collect()} == {15.0}


def test_packed_pages_keep_path_and_content(spark):
    pages = [("/x/state/texas/city/austin/dc/one/specs.txt", "line\n\"quoted\" é\r\nend"), ("/x/state/texas/links.txt", ""),
             ("elsewhere", None)]
    root = shared_folder(spark, "pages")
    writers.write_page_store(spark.createDataFrame(pages[:2], "path string, content string"), root)
    writers.write_page_store(spark.createDataFrame(pages[2:], "path string, content string"), root)
    got = {r.path: r for r in readers.read_page_store(spark, root).collect()}
    assert {k: v.content for k, v in got.items()} == dict(pages)
    assert (got[pages[0][0]].state, got[pages[0][0]].city, got[pages[0][0]].dc) == ("texas", "austin", "one")
    assert got["elsewhere"].state is None


@pytest.mark.parametrize("per_file, files", [(7, 15), (1_000, 1)])
def test_arrays_of_records_in_many_files(spark, per_file, files):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("é\n"), "id")).alias("name"))
    path = shared_folder(spark, "arrays")
    writers.write_json_arrays(df, path, ["id"], per_file)
    got = readers.read_json_records(spark, path, "id long, name string")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert 1 <= len(got.inputFiles()) <= files
    empty = shared_folder(spark, "arrays")
    writers.write_json_arrays(df.limit(0), empty, ["id"])


def test_chosen_folders_are_deleted(spark):
    a, b = stored(spark.range(3), "mine"), stored(spark.range(4), "mine")
    first, second = written()[-2:]
    remove(spark, [first])
    assert first not in written() and second in written() and b.count() == 4
    with pytest.raises(Exception, match="(?i)not.*exist|no such file"):
        a.collect()
