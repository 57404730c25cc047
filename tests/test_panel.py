"""Panel operators against brute force over small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from voltatlas.operators import aggregates as agg
from voltatlas.operators import joins, panel
from voltatlas.plans import marts


def brute_panel(data, first, last):
    out = {}
    for region in {r[0] for r in data if r[0] is not None}:
        for year in range(first, last + 1):
            cell = [r for r in data if r[0] == region and (r[1] is None or r[1] <= year)]
            if not cell:
                continue
            mw = [r[2] for r in cell if r[2] is not None]
            out[region, year] = (
                len(cell), sum(mw), sum(mw) / len(mw) if mw else 0, max(mw, default=0),
                sum(r[4] == "crypto" for r in cell), sum(r[4] == "big_ai" for r in cell),
                sum(r[4] == "big_ai" or (r[2] or 0) >= 50 for r in cell),
                sum(r[3] or 0 for r in cell))
    return out


@pytest.mark.parametrize("seed,n", [(1, 300), (2, 12), (3, 3)])
def test_cumulative_panel_equals_pairing(spark, seed, n):
    rnd = random.Random(seed)
    data = [(rnd.choice(["A", "B", "C", None]), rnd.choice([None, 2010, 2018, 2020, 2021, 2025]),
             rnd.choice([None, None, 10.0, 60.0]), rnd.choice([None, 5.0]),
             rnd.choice(["crypto", "big_ai", "small", None])) for _ in range(n)]
    df = spark.createDataFrame(data, "ba_code string, year_built int, capacity_mw double, "
                               "energy_mwh double, category string")
    got = {(r.ba_code, r.year): (r.dc_count, r.total_capacity_mw, r.avg_capacity_mw,
                                 r.max_capacity_mw, r.crypto_count, r.big_ai_count,
                                 r.hyperscale_count, r.total_energy_mwh)
           for r in panel.cumulative_panel(df, 2019, 2021).collect()}
    want = brute_panel(data, 2019, 2021)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_cumulative_panel_edge_rows(spark):
    df = spark.createDataFrame(
        [("A", 2018, 10.0), ("A", 2020, None), ("A", None, 60.0), ("A", 2025, 5.0)],
        "ba_code string, year_built int, capacity_mw double").withColumns(
        {"energy_mwh": F.lit(1.0), "category": F.lit("small")})
    got = panel.cumulative_panel(df, 2019, 2021).orderBy("year").collect()
    assert [r.dc_count for r in got] == [2, 3, 3]
    assert [(r.total_capacity_mw, r.avg_capacity_mw, r.max_capacity_mw, r.hyperscale_count)
            for r in got] == [(70.0, 35.0, 60.0, 1)] * 3


@pytest.mark.parametrize("mode,want", [
    ("complete", [5, 5, 12, 12]), ("forward_fill", [0, 0, 12, 12]), ("zero_fill", [0, 0, 7, 7])])
def test_openings_before_electricity(spark, mode, want):
    openings = spark.createDataFrame(
        [("A", 1999, 1, 5.0, 5.0), ("A", 2003, 1, 7.0, 7.0)],
        "state string, year int, new_dc_count bigint, new_dc_capacity_mw double, "
        "new_dc_energy_mwh double")
    elec = spark.createDataFrame([("A", y, 1.0) for y in range(2001, 2005)],
                                 "state string, year int, total_consumption_mwh double")
    out = panel.attach_openings(elec, openings, mode).orderBy("year").collect()
    assert [r.cumulative_dc_capacity for r in out] == want
    assert [r.new_dc_capacity_mw for r in out] == [0, 0, 7, 0]


def test_yoy(spark):
    df = spark.createDataFrame([("A", 2001, 0.0), ("A", 2002, 5.0), ("A", 2004, 6.0)],
                               "state string, year int, v double")
    got = [(r.prev_year_consumption, r.yoy_change_pct)
           for r in panel.yoy(df, "v").orderBy("year").collect()]
    assert got == [(None, None), (0.0, None), (None, None)]
    by_row = [r.yoy_change_pct for r in panel.yoy(df, "v", calendar=False).orderBy("year").collect()]
    assert by_row == [None, None, pytest.approx(20.0)]


def test_shares(spark):
    df = spark.createDataFrame([(0, 1.0, 0.05), (1, 300.0, -100.0), (2, 5.0, 0.0), (3, 4.0, None)],
                               "i int, e double, d double")
    out = df.select(
        "i", panel.new_share_of_change("e", "d").alias("m8"),
        panel.attributed_impact("e", "d").alias("m9"),
        panel.attributed_share("e", "d").alias("m9s"),
        panel.share_of_total("e", "d").alias("m7")).orderBy("i").collect()
    assert [r.m8 for r in out] == [0, 100, 0, 0]
    assert [r.m9 for r in out] == [0.05, 0, 0, None]
    assert [r.m9s for r in out] == [1.0, 1.0, 1.0, None]
    assert [r.m7 for r in out] == [1.0, 0.0, 0.0, 0.0]


def test_state_year_panel_equals_masks(spark):
    rnd = random.Random(5)
    opened = {(s, y): (rnd.randint(1, 4), float(rnd.randint(1, 90)), float(rnd.randint(1, 9)) * 1e5,
                       rnd.randint(0, 1))
              for s in "AB" for y in rnd.sample(range(1995, 2012), 7)}
    elec = {(s, y): 1e7 + rnd.randint(-10**6, 10**6) for s in "AB" for y in range(2003, 2011)
            if y != 2007}
    o = spark.createDataFrame([(*k, *v) for k, v in opened.items()],
                              "state string, year int, new_dc_count bigint, new_dc_mw double, "
                              "new_dc_energy_mwh double, new_ai_count bigint")
    e = spark.createDataFrame([(*k, float(v)) for k, v in elec.items()],
                              "state string, year int, total_consumption_mwh double")
    dim = spark.createDataFrame([("A", "AA", 2.0, 100.0)],
                                "state string, state_abbr string, population_millions double, "
                                "gdp_billions double")
    got = panel.state_year_panel(o, e, 2002, 2010, dim).collect()
    want_keys = {("A", y) for y in range(2002, 2011) if ("A", y) in elec and ("A", y - 1) in elec}
    assert {(r.state, r.year) for r in got} == want_keys
    for r in got:
        def total(i, upto):
            return sum(v[i] for (s, y), v in opened.items() if s == "A" and y <= upto)

        assert r.cumulative_dc_count == total(0, r.year)
        assert r.cumulative_dc_mw == total(1, r.year)
        assert r.cumulative_dc_mw_lag1 == total(1, r.year - 1)
        assert r.cumulative_dc_mw_lag2 == total(1, r.year - 2)
        assert r.new_dc_mw == opened.get(("A", r.year), (0, 0, 0, 0))[1]
        assert r.cumulative_ai_count == total(3, r.year)
        gwh = elec["A", r.year] / 1000
        assert r.dc_share_of_state_pct == pytest.approx(total(2, r.year) / 1e6 * 1000 / gwh * 100)
        assert r.dc_per_million_pop == r.cumulative_dc_count / 2.0
        assert r.elec_per_capita_mwh == pytest.approx(elec["A", r.year] / 2e6)
        assert r.log_dc_mw == pytest.approx(math.log1p(r.cumulative_dc_mw))


def test_cagr_floors(spark):
    df = spark.createDataFrame([(2019, 0.0, 100.0), (2021, 9.0, 121.0), (2020, 5.0, 1.0)],
                               "year int, n double, mw double")
    r = panel.cagr(df, {"n": 1.0, "mw": None}).first()
    assert r.n_cagr_pct == pytest.approx(200.0) and r.mw_cagr_pct == pytest.approx(10.0)


def test_region_sales_of_missing_values(spark):
    df = spark.createDataFrame(
        [("A", 2020, "u", None, None, None, None, None), (None, 2020, "u", 1.0, 1.0, 1.0, 1.0, 1.0)],
        "ba_code string, year int, utility_id string, total_sales_mwh double, "
        "industrial_sales_mwh double, commercial_sales_mwh double, residential_sales_mwh double, "
        "total_customers double")
    got = agg.region_sales(df).collect()
    assert [(r.ba_code, r.total_mwh, r.ci_ratio, r.utility_count) for r in got] == [("A", 0, 0, 1)]


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, None), (1.0, 6.0, 7.0)],
                               "a double, b double, c double")
    r = agg.pair_correlations(df, {"ab": ("a", "b"), "bc": ("b", "c")}).first()
    assert r.ab is None and r.bc == pytest.approx(1.0)


def test_enrich_by_name_keeps_every_row_once(spark):
    df = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A")], "name string, state string")
    facts = spark.createDataFrame([("x", "A", 1, "small"), ("x", "B", 2, "crypto")],
                                  "dc string, state string, seq int, category string")
    out = joins.enrich_by_name(df, facts.drop("state"), "name", "dc", ["seq"], ["seq", "category"])
    got = sorted((r["name"], r.state, r.seq, r.category, r.has_energy_data) for r in out.collect())
    assert got == [("x", "A", 2, "crypto", True), ("x", "B", 2, "crypto", True),
                   ("y", "A", None, "unknown", False)]
    narrow = joins.enrich_by_name(df, facts, "name", "dc", ["seq"], ["seq", "category"],
                                  extra_keys=["state"]).select("name", "state", "seq", "category")
    assert sorted((r["name"], r.state, r.seq) for r in narrow.where("seq IS NOT NULL").collect()) \
        == [("x", "A", 1), ("x", "B", 2)]


def test_region_panel_over_drifting_sheets(spark):
    head = ["y", "id", "n", "p", "s", "d", "st", "o", "ba"]
    sectors = [f"{a}{b}" for a in ("r", "c", "i") for b in range(3)]
    tail = ["t0", "t1", "t2"]
    wide = ", ".join(f"{c} string" for c in head + sectors + ["x0", "x1", "x2"] + tail)
    narrow = ", ".join(f"{c} string" for c in head + sectors + tail)
    row = ["2019", "u1", "U", "A", "B", "O", "VA", "Inv", "PJM",
           "1", "100", "1", "1", "50", "1", "1", "50", "1"]
    a = spark.createDataFrame([tuple(row + ["9", "9", "9", "3", "2e6", "7"]),
                               tuple(["Data Year"] + ["x"] * 23)], wide)
    b = spark.createDataFrame([tuple(row + ["3", "4e6", "."])], narrow)
    sales = marts.sales_sheets({2019: a, 2020: None, 2021: b})
    got = {r.year: (r.utility_id, r.ba_code, r.total_sales_mwh, r.total_customers,
                    r.industrial_sales_mwh) for r in sales.collect()}
    assert got == {2019: ("u1", "PJM", 2e6, 7.0, 50.0), 2021: ("u1", "PJM", 4e6, None, 50.0)}
    fac = spark.createDataFrame([("PJM", 2018, 60.0, 1e6, "big_ai")],
                                "ba_code string, year_built int, capacity_mw double, "
                                "energy_mwh double, category string")
    grid = {r.year: r for r in marts.region_panel(sales, fac).collect()}
    assert grid[2019].dc_energy_share == 0.5 and grid[2021].dc_energy_share == 0.25
    assert grid[2021].year_rel == 2 and grid[2019].hyperscale_ratio == 1.0
