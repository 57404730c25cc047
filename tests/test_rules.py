"""Edge rows of classification, cleaning, imputation and energy rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.operators import classify, cleaning, energy
from voltatlas.operators.quantiles import exact_median, exact_quantiles, ordered_bits
from voltatlas.functions.columns import clip, contains_any, finite, ratio, text_to_number, url_slug


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]
            for r in df.orderBy("i").collect()]


def rows(spark, ddl, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, " + ddl)


def test_coerce_numeric(spark):
    df = rows(spark, "s string", [("12x",), ("",), (" 7 ",), ("NaN",), ("inf",), (None,),
                                  ("7d",), ("1e3",), ("-.5",), ("1e999",)])
    assert values(cleaning.coerce_numeric(df, ["s"]), "s") == [
        None, None, 7.0, None, None, None, None, 1000.0, -0.5, None]
    d = rows(spark, "x double", [(float("nan"),), (float("inf"),), (-1.5,), (None,)])
    assert values(cleaning.coerce_numeric(d, ["x"]), "x") == [None, None, -1.5, None]


def test_state_abbrev_and_region(spark):
    df = rows(spark, "state string", [("va",), (" Texas ",), ("texas",), (None,),
                                      ("District of Columbia",)])
    out = cleaning.assign_region(cleaning.state_abbrev(df))
    assert values(out, "state_abbrev") == ["VA", "TX", None, None, "DC"]
    assert values(out, "ba_code") == ["PJM", "ERCO", "OTHER", "OTHER", "PJM"]


def test_primary_region_takes_first_declared(spark):
    df = rows(spark, "state_abbrev string", [("TX",), ("IL",), ("AZ",), ("ZZ",), (None,), ("VA",)])
    assert values(cleaning.primary_region(df), "ba_code") == [
        "ERCO", "PJM", "SRP", "OTHER", "OTHER", "PJM"]


def test_city_to_county(spark):
    df = rows(spark, "city string, state string",
              [(" Ashburn ", "va"), ("Ashburn", "MD"), (None, "VA"), ("The Dalles", "OR")])
    assert values(cleaning.city_to_county(df), "county") == ["Loudoun", None, None, "Wasco"]


@pytest.mark.parametrize("name,mw,expected", [
    ("Riot Rockdale", None, "crypto"), ("Amazon Mining Co", None, "crypto"),
    ("Google Council Bluffs", 8.0, "big_ai"), ("Acme", 50.0, "big_ai"),
    ("Metal Works", None, "big_ai"), ("Acme", 49.9, "decent"), ("Acme", 10.0, "decent"),
    ("Acme", 9.99, "small"), ("Acme", 0.0, "small"), ("Equinix DC1", None, "decent"),
    ("Equinix DC1", 5.0, "small"), (None, None, "small"),
])
def test_classify_category(spark, name, mw, expected):
    df = rows(spark, "name string, mw double", [(name, mw)])
    assert values(df.withColumn("c", classify.classify_category("name", "mw")), "c") == [expected]


def test_whole_word_keywords(spark):
    df = rows(spark, "name string", [("Metal Works",), ("META one",), ("x meta",)])
    out = df.withColumn("c", contains_any("name", ["meta"], whole_words=True))
    assert values(out, "c") == [False, True, True]


def test_classify_facility_type(spark):
    df = rows(spark, "name string, mw double",
              [("Switch Citadel", None), ("Acme", 10.0), ("Acme", None), ("Acme", 50.0),
               ("Facebook", 1.0), ("Colo One", 20.0)])
    assert values(df.withColumn("c", classify.classify_facility_type("name", "mw")), "c") == [
        "colocation", "enterprise", "default", "hyperscale", "hyperscale", "colocation"]


def test_classify_operator(spark):
    df = rows(spark, "name string, city string",
              [("Compass", None), ("Acme", "Aiken"), (None, None), ("Acme", "Boise")])
    assert values(df.withColumn("c", classify.classify_operator("name", "city")), "c") == [
        "crypto", "ai", "general", "general"]


def test_is_planned(spark):
    df = rows(spark, "name string", [("North Campus",), ("Project Blue",), ("Projector Hall",),
                                     (None,)])
    assert values(df.withColumn("c", classify.is_planned("name")), "c") == [
        True, True, False, False]


def test_estimate_year(spark):
    df = rows(spark, "name string, city string, state string", [
        ("Google", "Council Bluffs", "Iowa"), ("Patriot DC", "Austin", "Texas"),
        ("Foo", "Lenoir", "North Carolina"), ("Foo", "Charleston", "West Virginia"),
        ("Google", "Lenoir", "North Carolina"), ("Riot", "Abilene", "Texas"),
        ("AWS", "Ashburn", "Virginia"), (None, None, None), ("Google", "Austin", "Texas")])
    out = df.withColumn("y", classify.estimate_year("name", "city", "state")).withColumn(
        "z", classify.estimate_year("name", "city", "state", compat=True))
    assert values(out, "y") == [2009, 2022, 2010, 2018, 2009, 2022, 2006, 2018, 2018]
    assert values(out, "z") == [2009, 2022, 2018, 2012, 2018, 2022, 2006, 2018, 2018]


def test_fill_missing_year(spark):
    df = rows(spark, "y int", [(None,), (0,), (2001,)])
    out = df.withColumn("y", classify.fill_missing_year("y", F.lit(2018)))
    assert values(out, "y") == [2018, 2018, 2001]


def test_concentration_band(spark):
    df = rows(spark, "s double", [(10.0,), (10.1,), (5.0,), (5.1,)])
    assert values(df.withColumn("b", classify.concentration_band("s")), "b") == [
        "MED", "HIGH", "LOW", "MED"]


def test_verdict_and_fit(spark):
    df = rows(spark, "v double", [(71.0,), (10.4,), (35.0,)])
    assert values(df.withColumn("b", classify.benchmark_verdict("v", F.lit(35.0))), "b") == [
        "HIGH", "LOW", "reasonable"]
    r = rows(spark, "r double", [(0.51,), (0.5,), (0.2,), (0.05,), (-1.0,)])
    assert values(r.withColumn("b", classify.interpret_fit("r")), "b") == [
        "Strong", "Moderate", "Weak", "Weak", "Weak"]
    assert values(r.withColumn("b", classify.interpret_causal("r")), "b") == [
        "Detectable", "Detectable", "Detectable", "Weak", "Weak"]


def test_is_hyperscale_is_never_null(spark):
    df = rows(spark, "c string, mw double", [(None, None), ("big_ai", None), (None, 50.0),
                                             ("small", 49.0)])
    assert values(df.withColumn("h", classify.is_hyperscale("c", "mw")), "h") == [
        False, True, True, False]


def test_peak_growth_year(spark):
    growth = spark.createDataFrame(
        [("A", 2001, 5.0), ("A", 2003, 9.0), ("A", 2005, 9.0), ("A", 2030, 99.0), ("B", 2002, None)],
        "state string, year int, yoy_change_pct double")
    df = rows(spark, "state string, year_operational int",
              [("A", None), ("A", 2010), ("A", 1980), ("B", None), ("C", None)])
    out = classify.estimate_year_from_peak_growth(df, growth)
    assert values(out, "state", "estimated_year", "confidence") == [
        ("A", 2003, "low"), ("A", 2003, "low")]


def test_impute_group_median(spark):
    data = [("A", 10.0), ("A", 20.0), ("A", None), ("B", None), (None, None)]
    out = energy.impute_group_median(rows(spark, "state string, capacity_mw double", data),
                                     "capacity_mw")
    assert values(out, "capacity_mw_est") == [10.0, 20.0, 15.0, 15.0, 15.0]
    none = rows(spark, "state string, capacity_mw double", [("A", None)])
    assert values(energy.impute_group_median(none, "capacity_mw"), "capacity_mw_est") == [10.0]


def test_fill_target_median(spark):
    df = rows(spark, "x double", [(1.0,), (None,), (8.0,), (8.0,), (None,), (2.0,)])
    assert values(energy.fill_target_median(df, "x"), "x") == [1.0, 5.0, 8.0, 8.0, 5.0, 2.0]
    assert values(energy.fill_target_median(df.where("x IS NULL"), "x"), "x") == [None, None]
    assert energy.fill_target_median(df.limit(0), "x").count() == 0


def test_impute_cascade(spark):
    data = [("A", 2001, 10.0), ("A", 2002, None), ("B", 2001, None), ("B", 1990, None)]
    out = energy.impute_cascade(
        rows(spark, "state string, year_operational int, capacity_mw double", data), "capacity_mw")
    assert values(out, "capacity_mw_imputed") == [10.0] * 4


def test_impute_by_operator(spark):
    df = rows(spark, "mw double, t string", [(None, "crypto"), (0.0, "ai"), (-1.0, "x"), (5.0, "ai")])
    out = df.withColumn("m", energy.default_mw_by_operator("mw", "t"))
    assert values(out, "m") == [50.0, 80.0, 12.0, 5.0]


def test_energy_formulas(spark):
    df = rows(spark, "mw double, kind string, year int", [
        (10.0, "colocation", 2010), (10.0, "colocation", 2015), (10.0, "colocation", 2024),
        (10.0, "colocation", 2040), (10.0, "colocation", None), (10.0, "what", 2000)])
    out = df.withColumn("flat", energy.energy_flat("mw")).withColumn(
        "e", energy.energy_by_type_and_vintage("mw", "kind", "year")).withColumn(
        "e4", energy.energy_by_type_and_vintage("mw", "kind", "year", missing_year=2020))
    assert values(out, "flat")[0] == pytest.approx(79716)
    assert values(out, "e") == pytest.approx(
        [72270, 68728.05, 62784.26, 62784.26, 68728.05, 79716], abs=0.01)
    assert values(out, "e4")[4] == pytest.approx(65359.69, abs=0.01)


def test_scenarios(spark):
    elec = spark.createDataFrame(
        [("Virginia", 2023, 1e8), ("Virginia", 2022, 1.0), ("Texas", 2022, 5.0)],
        "state string, year int, total_consumption_mwh double")
    from voltatlas.functions.columns import inline_table

    sc = inline_table(spark, "state string, new_mw double", p.CAPACITY_SCENARIOS)
    out = energy.capacity_scenarios(sc, elec).collect()
    assert [(r.state, r.new_energy_mwh, r.homes) for r in out] == [("Virginia", 3528000.0, 336000.0)]


def test_benchmarks(spark):
    from voltatlas.functions.columns import inline_table

    b = inline_table(spark, "name string, capacity_mw double, reported_twh double, type string",
                     p.ENERGY_BENCHMARKS)
    got = {r["name"]: r.estimated_twh for r in energy.compare_to_benchmarks(b).collect()}
    factor = 0.99**14
    assert got["Google (2022 report)"] == pytest.approx(15000 * 8760 * 0.7 * 1.1 * factor / 1e6)
    assert got["US Data Centers Total (2020)"] == pytest.approx(
        17000 * 8760 * 0.6 * 1.4 * factor / 1e6)


def test_new_facility_uses_state_only_with_enough_rows(spark):
    fac = spark.createDataFrame(
        [("A", 10.0)] * 5 + [("B", 30.0)] * 6, "state string, energy_per_mw double")
    req = spark.createDataFrame(
        [("A", 1.0, "enterprise", 2000), ("B", 1.0, "enterprise", 2000),
         ("Z", 1.0, "enterprise", 2000)],
        "state string, capacity_mw double, dc_type string, year int")
    got = {r.state: r.adjusted_estimate_mwh / r.physics_estimate_mwh
           for r in energy.estimate_new_facility(req, fac).collect()}
    mean = (50 + 180) / 11
    assert got == {"A": 1.0, "B": pytest.approx(30 / mean), "Z": 1.0}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact(spark, by):
    """Values whose ranks take every refinement: neighbours that differ in the last bit."""
    import numpy as np

    rng = np.random.default_rng(7)
    close = [1.0]
    for _ in range(400):
        close.append(float(np.nextafter(close[-1], 2)))
    data = [("hot", float(v)) for v in np.round(rng.lognormal(2, 1.5, 4000), 1)]
    data += [("hot", -float(v)) for v in rng.lognormal(-300, 150, 900)]
    data += [("close", v) for v in close]
    data += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("gone", None), (None, 9.0)]
    data += [("same", 3.0)] * 50 + [("wide", v) for v in (5e-324, -1e308, 0.0, -0.0, 1e308, -5e-324, 2.2e-308)]
    df = spark.createDataFrame(data, "g string, x double").repartition(5)
    probs = {"lo": 0.0, "q1": 0.25, "med": 0.5, "q9": 0.9, "hi": 1.0}
    got = exact_quantiles(df, "x", probs, by).collect()
    groups = {"hot", "close", "one", "two", "same", "wide"} if by else {None}
    assert len(got) == len(groups)
    for g in groups:
        xs = sorted(v for k, v in data if v is not None and k is not None or not by and v is not None
                    if not by or k == g)
        own = [r for r in got if not by or r[0] == g][0][len(by):]
        for q, value in zip(probs.values(), own):
            at = (len(xs) - 1) * q
            lo, hi = xs[int(at)], xs[-int(-at // 1)] if at % 1 else xs[int(at)]
            assert value == lo + (hi - lo) * (at - int(at)), (g, q)


def test_ordered_bits_keep_the_order(spark):
    import struct

    rng = random.Random(3)
    values = {struct.unpack("d", rng.randbytes(8))[0] for _ in range(5000)}
    values = sorted(v for v in values if v == v and abs(v) != float("inf"))
    values = sorted({*values, 0.0, 1.0, 2.0, 4.0, 2.0**52, 2.0**-1022, 5e-324, -5e-324, 1.7976931348623157e308,
                     *[2.0**e for e in range(-1074, 1024)]})
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.v: r.b for r in df.select("v", ordered_bits(F.col("v")).alias("b")).collect()}
    bits = [got[v] for v in values]
    assert all(a < b for a, b in zip(bits, bits[1:]))


def test_quantiles_run_no_job_while_built(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS x")
    spark.sparkContext.setJobGroup("built", "")
    exact_quantiles(df, "x", {"m": 0.5}, ["g"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("built")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_median_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", None)], "g string, x double")
    assert [r.median for r in exact_median(df, "x").collect()] == [None]
    assert exact_median(df, "x", ["g"]).collect() == []


def test_column_helpers(spark):
    df = rows(spark, "a double, b double", [(1.0, 0.0), (None, 1.0), (6.0, 3.0)])
    out = df.withColumn("r", ratio("a", "b")).withColumn("c", clip("a", 2, 5))
    assert values(out, "r") == [None, None, 2.0]
    assert values(out, "c") == [2.0, None, 5.0]
    s = rows(spark, "u string", [("https://x/a/b/",), ("/usa/texas/",), ("plain",)])
    assert values(s.withColumn("v", url_slug("u")), "v") == ["b", "texas", "plain"]
    n = rows(spark, "x double", [(math.nan,), (-math.inf,), (0.0,)])
    assert values(n.withColumn("v", finite("x")), "v") == [None, None, 0.0]
    t = rows(spark, "x string", [(" 1 ",), ("١",), ("+3.",)])
    assert values(t.withColumn("v", text_to_number("x")), "v") == [1.0, None, 3.0]


def test_first_per_key_order_and_nulls(spark):
    df = rows(spark, "k string, v int", [("a", 3), ("a", 1), (None, 5), (None, 4), ("b", None)])
    first = cleaning.first_per_key(df, ["k"], ["i"])
    assert values(first, "k", "v") == [("a", 3), (None, 5), ("b", None)]
    last = cleaning.first_per_key(df, ["k"], ["i"], last=True)
    assert values(last, "k", "v") == [("a", 1), (None, 4), ("b", None)]


def test_future_first_copy_drops_the_id(spark):
    df = rows(spark, "id string, y int", [("a", 2030), ("a", 2001), ("b", 2001), ("c", None)])
    out = cleaning.filter_operational(df, F.lit(False), "id", "y", ["i"])
    assert values(out, "id") == ["b"]
    funnel = cleaning.filter_funnel(df, F.lit(False), "id", "y", ["i"])
    assert [tuple(r) for r in funnel.orderBy("step_no").collect()] == [
        (0, "total", 4), (1, "planned", 0), (2, "no_year", 1), (3, "duplicate", 1),
        (4, "future", 1), (5, "kept", 1)]


def test_find_and_select_columns(spark):
    df = spark.createDataFrame([], "City_Name string, Total_MW double, power string")
    assert cleaning.find_column(df, ["mw", "power"]) == "Total_MW"
    assert cleaning.find_column(df, ["state"]) is None
    assert cleaning.select_available(df, ["power", "x", "Total_MW"]) == ["power", "Total_MW"]


def test_drop_incomplete(spark):
    df = rows(spark, "a double, b string", [(1.0, "x"), (math.inf, "x"), (math.nan, "y"),
                                            (2.0, None)])
    assert values(cleaning.drop_incomplete(df), "i") == [0]
    assert values(cleaning.drop_incomplete(df, ["a"]), "i") == [0, 3]
