"""The table by primary region and the growth rows of a category, on small rows."""

import pytest

from voltatlas.plans import marts
from voltatlas.queries import load

QUERIES = load().QUERIES
SALES = "ba_code string, state string, utility_id int, total_sales_mwh double"


def region_rows(spark, sales, facilities):
    dim = spark.createDataFrame([("Aland", "AL"), ("Bland", "BL"), ("Cland", "CL")], "state string, abbrev string")
    got = marts.primary_region_table(
        spark.createDataFrame(sales, SALES),
        spark.createDataFrame(facilities, "state string, capacity_mw double"),
        dim, {"EAST": ["AL", "BL"], "WEST": ["BL"]})
    assert got.columns == ["ba_code", "total_sales_mwh", "utility_count", "states", "dc_count", "dc_capacity_mw",
                           "mw_per_twh"]
    return {r.ba_code: tuple(r)[1:] for r in got.collect()}


def test_primary_region_table(spark):
    sales = [("EAST", s, u, 5e5) for s, u in [("D", 1), ("A", 1), ("C", 2), ("B", 3)]] + [
        ("WEST", "B", 3, None), (None, "B", 4, 1.0)]
    facilities = [("Aland", 2.0), ("Bland", 3.0), ("bl", None), (" AL ", 5.0), ("Cland", 7.0), ("nowhere", 1.0),
                  (None, 4.0), (None, None)]
    got = region_rows(spark, sales, facilities)
    # A state that two regions serve counts for the first; rows without a state only by their MW.
    assert got["EAST"] == (2e6, 3, "A, B, C", 4, 10.0, 5.0)
    assert got["WEST"] == (0.0, 1, "B", 0, 0.0, None)
    assert got["OTHER"] == (0.0, 0, "", 2, 12.0, None)


def test_primary_region_table_of_empty_tables(spark):
    assert region_rows(spark, [], []) == {}
    assert region_rows(spark, [], [("Aland", None)]) == {"EAST": (0.0, 0, "", 1, 0.0, None)}
    assert region_rows(spark, [("WEST", None, 1, 1e6)], []) == {"WEST": (1e6, 1, "", 0, 0.0, 0.0)}


def test_category_growth_table(spark):
    facilities = spark.createDataFrame(
        [("a", 1999, "big_ai", 9.0, 90.0), ("a", 2001, "big_ai", 1.0, 10.0), ("a", 2001, "big_ai", None, 5.0),
         ("a", 2002, "small", 50.0, 500.0), ("a", None, "big_ai", 8.0, 80.0), (None, 2001, "big_ai", 8.0, 80.0),
         ("z", 2001, "big_ai", 8.0, 80.0)],
        "state string, year_operational int, dc_category string, capacity_mw_est double, estimated_energy_mwh double")
    electricity = spark.createDataFrame(
        [("a", 2000, 100.0), ("a", 2001, 130.0), ("a", 2002, 120.0), ("a", 2004, 999.0), ("b", 2001, 7.0), ("b", 2002, None)],
        "state string, year int, total_consumption_mwh double")
    got = marts.category_growth_table(facilities, electricity)
    assert got.columns == ["state", "year", *marts.GROWTH_FEATURES, "yoy_change_mwh"]
    # The opening of 1999 lies before the first year; 2004 has no year before it.
    assert sorted(map(tuple, got.collect())) == [
        ("a", 2001, 2, 1.0, 15.0, 1.0, 15.0, 130.0, 30.0), ("a", 2002, 0, 0.0, 0.0, 1.0, 15.0, 120.0, -10.0)]
    assert marts.category_growth_table(facilities.limit(0), electricity.limit(0)).count() == 0
    crypto = marts.category_growth_table(facilities, electricity, "crypto").collect()
    assert [r.cumulative_dc_energy for r in crypto] == [0.0, 0.0]


@pytest.mark.parametrize("name, most", [("d08_primary_region_table", {"orders": 1, "lineitem": 2}),
                                        ("m05_category_growth_table", {"orders": 1, "lineitem": 1})])
def test_facts_are_read_once(spark, sf, name, most):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for table, n in most.items():
        assert plan.count(f"{table}.parquet") <= n, table
