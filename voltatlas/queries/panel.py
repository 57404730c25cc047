"""M1-M17, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas.operators import aggregates as agg
from voltatlas.operators import cleaning, panel
from voltatlas.operators.quantiles import exact_median
from voltatlas.plans import marts
from voltatlas.queries import base
from voltatlas.queries.aggregates import _REGION_PANEL
from voltatlas.queries.base import sql, table
from voltatlas.queries.cleaning import _YOY_SQL
from voltatlas.queries.registry import query
from voltatlas.session import stored

GROWTH_DIGITS = {"total_consumption_mwh": 2, "prev_year_consumption": 2, "yoy_change_mwh": 2,
                 "yoy_change_pct": 6}
CELL_DIGITS = {"total_capacity_mw": 6, "avg_capacity_mw": 8, "total_energy_mwh": 2,
               "crypto_ratio": 9, "hyperscale_ratio": 9}


@query("m01_yoy", sql("electricity", more=_YOY_SQL) + "SELECT * FROM growth", GROWTH_DIGITS)
def m01(spark, sf):
    return panel.yoy(base.electricity(spark, sf), "total_consumption_mwh")


@query("m01_yoy_by_row", """
    WITH spent AS (SELECT o_custkey AS customer, CAST(year(o_orderdate) AS INTEGER) AS year,
        sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
    p AS (SELECT *, lag(total) OVER (PARTITION BY customer ORDER BY year)
          AS prev_year_consumption FROM spent)
    SELECT *, total - prev_year_consumption AS yoy_change_mwh,
           (total - prev_year_consumption) / prev_year_consumption * 100 AS yoy_change_pct FROM p""",
       {"total": 2, "prev_year_consumption": 2, "yoy_change_mwh": 2, "yoy_change_pct": 5})
def m01_rows(spark, sf):
    # Customers who order nothing in some years leave gaps.
    spent = table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year")
    ).agg(F.sum("o_totalprice").alias("total"))
    return panel.yoy(spent, "total", group="customer", calendar=False)


@query("m02_cumulative_panel", sql("sales", "mapped", more=_REGION_PANEL) + """
    SELECT *, crypto_count / dc_count AS crypto_ratio,
           hyperscale_count / dc_count AS hyperscale_ratio FROM cells""", CELL_DIGITS)
def m02(spark, sf):
    return panel.cumulative_panel(base.mapped(spark, sf), 1996, 2000)


def _openings(spark, sf):
    return panel.openings_by_year(base.categorized(spark, sf))


_OPENINGS = """openings AS (SELECT state, year_operational AS year, count(*) AS new_dc_count,
    sum(capacity_mw_est) AS new_dc_capacity_mw, sum(estimated_energy_mwh) AS new_dc_energy_mwh
    FROM categorized WHERE year_operational IS NOT NULL GROUP BY 1, 2)"""
_CUM = """CAST(sum({n}) OVER w AS BIGINT) AS cumulative_dc_count,
    sum({m}) OVER w AS cumulative_dc_capacity, sum({e}) OVER w AS cumulative_dc_energy"""
OPEN_DIGITS = {"new_dc_capacity_mw": 6, "new_dc_energy_mwh": 2, "cumulative_dc_capacity": 5,
               "cumulative_dc_energy": 2}


@query("m03_cumulative_by_opening_year", sql("categorized", more=_OPENINGS) + f"""
    SELECT *, {_CUM.format(n="new_dc_count", m="new_dc_capacity_mw", e="new_dc_energy_mwh")}
    FROM openings WINDOW w AS (PARTITION BY state ORDER BY year)""", OPEN_DIGITS)
def m03(spark, sf):
    return panel.cumulative_by_opening_year(_openings(spark, sf))


# Electricity of every second year from 1996 on, so openings also fall before and between them.
def _some_years(spark, sf):
    return base.electricity(spark, sf).withColumn("year", 2 * F.col("year") - 1994)


_SOME = """some_years AS (SELECT * REPLACE (2 * year - 1994 AS year) FROM electricity)"""
_ATTACHED = ["state", "year", "new_dc_count", "new_dc_capacity_mw", "new_dc_energy_mwh",
             "cumulative_dc_count", "cumulative_dc_capacity", "cumulative_dc_energy"]


@query("m04_forward_fill", sql("categorized", "electricity", more=f"{_OPENINGS}, {_SOME}," + """
    known AS (SELECT o.* FROM openings o JOIN some_years s ON s.state = o.state AND s.year = o.year),
    last_open AS (SELECT s.state, s.year, max(k.year) AS at FROM some_years s LEFT JOIN known k
        ON s.state = k.state AND k.year <= s.year GROUP BY 1, 2)""") + """
    SELECT l.state, l.year, coalesce(k.new_dc_count, 0) AS new_dc_count,
           coalesce(k.new_dc_capacity_mw, 0) AS new_dc_capacity_mw
    FROM last_open l LEFT JOIN known k ON k.state = l.state AND k.year = l.at""",
       {"new_dc_capacity_mw": 6})
def m04(spark, sf):
    joined = _some_years(spark, sf).join(_openings(spark, sf), ["state", "year"], "left")
    return panel.forward_fill(joined, ["new_dc_count", "new_dc_capacity_mw"]).select(
        "state", "year", "new_dc_count", "new_dc_capacity_mw")


@query("m05_cumulative_after_zero_fill", sql("categorized", "electricity",
                                             more=f"{_OPENINGS}, {_SOME}") + f"""
    SELECT s.state, s.year, coalesce(new_dc_count, 0) AS new_dc_count,
           coalesce(new_dc_capacity_mw, 0) AS new_dc_capacity_mw,
           coalesce(new_dc_energy_mwh, 0) AS new_dc_energy_mwh,
           {_CUM.format(n="coalesce(new_dc_count, 0)", m="coalesce(new_dc_capacity_mw, 0)",
                        e="coalesce(new_dc_energy_mwh, 0)")}
    FROM some_years s LEFT JOIN openings o ON s.state = o.state AND s.year = o.year
    WINDOW w AS (PARTITION BY s.state ORDER BY s.year)""", OPEN_DIGITS)
def m05(spark, sf):
    return panel.attach_openings(_some_years(spark, sf), _openings(spark, sf), "zero_fill").select(
        *_ATTACHED)


@query("m04_openings_carried_forward", sql("categorized", "electricity", more=f"""
    {_OPENINGS}, {_SOME},
    c AS (SELECT *, {_CUM.format(n="new_dc_count", m="new_dc_capacity_mw", e="new_dc_energy_mwh")}
          FROM openings WINDOW w AS (PARTITION BY state ORDER BY year)),
    pos AS (SELECT s.state, s.year, max(c.year) AS last_year FROM some_years s LEFT JOIN c
           ON c.state = s.state AND c.year <= s.year AND c.year IN (SELECT year FROM some_years)
           GROUP BY 1, 2)""") + """
    SELECT a.state, a.year, coalesce(o.new_dc_count, 0) AS new_dc_count,
           coalesce(o.new_dc_capacity_mw, 0) AS new_dc_capacity_mw,
           coalesce(o.new_dc_energy_mwh, 0) AS new_dc_energy_mwh,
           coalesce(c.cumulative_dc_count, 0) AS cumulative_dc_count,
           coalesce(c.cumulative_dc_capacity, 0) AS cumulative_dc_capacity,
           coalesce(c.cumulative_dc_energy, 0) AS cumulative_dc_energy
    FROM pos a LEFT JOIN c ON c.state = a.state AND c.year = a.last_year
    LEFT JOIN openings o ON o.state = a.state AND o.year = a.year""", OPEN_DIGITS)
def m04_openings(spark, sf):
    return panel.attach_openings(
        _some_years(spark, sf), _openings(spark, sf), "forward_fill").select(*_ATTACHED)


@query("m03_openings_complete", sql("categorized", "electricity", more=f"{_OPENINGS}, {_SOME}") + """
    SELECT s.state, s.year,
      coalesce(sum(new_dc_count) FILTER (WHERE o.year = s.year), 0)::BIGINT AS new_dc_count,
      coalesce(sum(new_dc_capacity_mw) FILTER (WHERE o.year = s.year), 0) AS new_dc_capacity_mw,
      coalesce(sum(new_dc_energy_mwh) FILTER (WHERE o.year = s.year), 0) AS new_dc_energy_mwh,
      coalesce(sum(new_dc_count), 0)::BIGINT AS cumulative_dc_count,
      coalesce(sum(new_dc_capacity_mw), 0) AS cumulative_dc_capacity,
      coalesce(sum(new_dc_energy_mwh), 0) AS cumulative_dc_energy
    FROM some_years s LEFT JOIN openings o ON o.state = s.state AND o.year <= s.year
    GROUP BY 1, 2""", OPEN_DIGITS)
def m03_complete(spark, sf):
    return panel.attach_openings(_some_years(spark, sf), _openings(spark, sf)).select(*_ATTACHED)


_PANEL_NUMBERS = {
    "cumulative_dc_mw": 5, "new_dc_mw": 5, "cumulative_dc_energy_twh": 8, "new_dc_energy_twh": 8,
    "ai_ratio": 9, "cumulative_dc_mw_lag1": 5, "cumulative_dc_mw_lag2": 5, "dc_growth_mw": 5,
    "electricity_gwh": 5, "electricity_change_gwh": 5, "electricity_pct_change": 6,
    "dc_share_of_state_pct": 5, "new_dc_share_of_change_pct": 5, "log_dc_mw": 8,
    "log_elec_gwh": 8, "dc_per_million_pop": 6, "dc_mw_per_million_pop": 5,
    "dc_per_billion_gdp": 6, "elec_per_capita_mwh": 6, "dc_intensity": 5,
}
_OPERATOR_OPENINGS = f"""{base.LOWERED}, kinds AS (SELECT *, {base.OPERATOR_SQL} AS dc_type,
        CASE WHEN year_operational IS NULL OR year_operational = 0
            THEN {base.YEAR_GUESS_SQL} ELSE year_operational END AS opened FROM lowered),
    sized AS (SELECT state, opened AS yr, dc_type, CASE WHEN capacity_mw > 0
        THEN capacity_mw ELSE CASE dc_type WHEN 'crypto' THEN 50 WHEN 'ai' THEN 80 ELSE 12 END END
        AS mw FROM kinds),
    powered AS (SELECT *, mw * 8760 * CASE dc_type WHEN 'crypto' THEN 0.95 WHEN 'ai' THEN 0.70
        ELSE 0.55 END * CASE dc_type WHEN 'crypto' THEN 1.10 WHEN 'ai' THEN 1.15 ELSE 1.50 END
        / 1e6 AS twh FROM sized)"""
_STATE_PANEL = f"""{_OPERATOR_OPENINGS},
    grid AS (SELECT d.state, d.state_abbr, CAST(y AS INTEGER) AS year, coalesce(population_millions, 5.0) AS pop,
        coalesce(gdp_billions, 300.0) AS gdp FROM nation_dim d, (SELECT unnest(range(1997, 2002)) AS y)
        WHERE d.state IN (SELECT state FROM powered)),
    cell AS (SELECT g.state, g.year,
        coalesce(sum(mw), 0) AS cum_mw, count(p.state) AS cum_n, coalesce(sum(twh), 0) AS cum_twh,
        coalesce(sum(mw) FILTER (WHERE yr = g.year), 0) AS new_mw,
        count(*) FILTER (WHERE yr = g.year) AS new_n,
        coalesce(sum(twh) FILTER (WHERE yr = g.year), 0) AS new_twh,
        count(*) FILTER (WHERE dc_type = 'ai') AS cum_ai,
        coalesce(sum(mw) FILTER (WHERE yr <= g.year - 1), 0) AS lag1,
        coalesce(sum(mw) FILTER (WHERE yr <= g.year - 2), 0) AS lag2
      FROM grid g LEFT JOIN powered p ON p.state = g.state AND yr <= g.year GROUP BY 1, 2),
    panel AS (SELECT g.state, g.state_abbr, g.year, cum_mw AS cumulative_dc_mw,
        cum_n AS cumulative_dc_count, new_mw AS new_dc_mw, new_n AS new_dc_count,
        cum_twh AS cumulative_dc_energy_twh, new_twh AS new_dc_energy_twh,
        cum_ai AS cumulative_ai_count, coalesce(cum_ai / nullif(cum_n, 0), 0) AS ai_ratio,
        lag1 AS cumulative_dc_mw_lag1, lag2 AS cumulative_dc_mw_lag2,
        cum_mw - lag1 AS dc_growth_mw, a.total_consumption_mwh / 1000 AS electricity_gwh,
        (a.total_consumption_mwh - b.total_consumption_mwh) / 1000 AS electricity_change_gwh,
        (a.total_consumption_mwh - b.total_consumption_mwh) / b.total_consumption_mwh * 100
            AS electricity_pct_change,
        pop AS population_millions, gdp AS gdp_billions,
        cum_twh * 1000 / (a.total_consumption_mwh / 1000) * 100 AS dc_share_of_state_pct,
        CASE WHEN abs(a.total_consumption_mwh - b.total_consumption_mwh) / 1000 > 0.1
          THEN least(new_twh * 1000 / (abs(a.total_consumption_mwh - b.total_consumption_mwh)
            / 1000) * 100, 100) ELSE 0 END AS new_dc_share_of_change_pct,
        ln(1 + cum_mw) AS log_dc_mw, ln(1 + a.total_consumption_mwh / 1000) AS log_elec_gwh,
        cum_n / pop AS dc_per_million_pop, cum_mw / pop AS dc_mw_per_million_pop,
        cum_n / gdp AS dc_per_billion_gdp,
        a.total_consumption_mwh / (pop * 1e6) AS elec_per_capita_mwh,
        cum_mw / (gdp / 100) AS dc_intensity
      FROM grid g JOIN cell c ON c.state = g.state AND c.year = g.year
      JOIN electricity a ON a.state = g.state AND a.year = g.year
      JOIN electricity b ON b.state = g.state AND b.year = g.year - 1)"""


def state_panel(spark, sf):
    openings = marts.operator_openings(
        base.facilities(spark, sf), base.operator_of(), base.year_guess())
    return panel.state_year_panel(
        openings, base.electricity(spark, sf), 1997, 2001, base.nation_dim(spark, sf).drop("abbrev"))


@query("m06_state_year_panel", sql("facility", "electricity", "nation_dim", more=_STATE_PANEL)
       + "SELECT * FROM panel", _PANEL_NUMBERS)
def m06(spark, sf):
    return state_panel(spark, sf)


@query("m07_share_of_total", sql("categorized", "electricity") + """
    SELECT state, least(greatest(coalesce(e / c, 0), 0), 1) AS share FROM (
        SELECT state, sum(estimated_energy_mwh) AS e FROM categorized GROUP BY 1)
    LEFT JOIN (SELECT state, sum(total_consumption_mwh) AS c FROM electricity GROUP BY 1)
    USING (state)""", {"share": 8})
def m07(spark, sf):
    total = base.electricity(spark, sf).groupBy("state").agg(
        F.sum("total_consumption_mwh").alias("c"))
    return agg.state_rollup(base.categorized(spark, sf)).join(total, "state", "left").select(
        "state", panel.share_of_total("total_energy_mwh", "c").alias("share"))


def _change_table(spark, sf):
    return panel.yoy(base.electricity(spark, sf), "total_consumption_mwh").join(
        _openings(spark, sf), ["state", "year"])


_CHANGES = f"""{_OPENINGS}, {_YOY_SQL}, changes AS (SELECT * FROM growth
    JOIN openings USING (state, year))"""


@query("m08_new_share_of_change", sql("categorized", "electricity", more=_CHANGES) + """
    SELECT state, year, CASE WHEN abs(yoy_change_mwh) > 1000000
        THEN least(new_dc_energy_mwh / abs(yoy_change_mwh) * 100, 100) ELSE 0 END AS share
    FROM changes""", {"share": 6})
def m08(spark, sf):
    return _change_table(spark, sf).select("state", "year", panel.new_share_of_change(
        "new_dc_energy_mwh", "yoy_change_mwh", smallest=1_000_000).alias("share"))


@query("m09_attributed_impact", sql("categorized", "electricity", more=_CHANGES) + """
    SELECT state, year,
        CASE WHEN yoy_change_mwh IS NOT NULL THEN least(new_dc_energy_mwh,
            greatest(yoy_change_mwh, 0)) END AS impact,
        CASE WHEN yoy_change_mwh IS NOT NULL THEN least(new_dc_energy_mwh
            / greatest(abs(yoy_change_mwh), 1), 1) END AS share FROM changes""",
       {"impact": 2, "share": 8})
def m09(spark, sf):
    return _change_table(spark, sf).select(
        "state", "year",
        panel.attributed_impact("new_dc_energy_mwh", "yoy_change_mwh").alias("impact"),
        panel.attributed_share("new_dc_energy_mwh", "yoy_change_mwh").alias("share"))


@query("m10_derived_ratios", sql("categorized", "electricity", more=_CHANGES) + """
    SELECT state, year, yoy_change_mwh / new_dc_count AS change_per_dc_mwh,
           new_dc_capacity_mw / new_dc_count AS capacity_per_dc,
           yoy_change_mwh / new_dc_capacity_mw AS impact_per_mw,
           yoy_change_mwh / prev_year_consumption AS normalized_change FROM changes""",
       {"change_per_dc_mwh": 4, "capacity_per_dc": 7, "impact_per_mw": 4, "normalized_change": 8})
def m10(spark, sf):
    out = panel.derived_ratios(_change_table(spark, sf), "yoy_change_mwh", "new_dc_count",
                               "new_dc_capacity_mw", "prev_year_consumption")
    return out.select("state", "year", "change_per_dc_mwh", "capacity_per_dc", "impact_per_mw",
                      "normalized_change")


@query("m11_per_capita", sql("categorized", "electricity", "nation_dim", more="""
    f AS (SELECT state, count(*) AS n, sum(capacity_mw_est) AS mw FROM categorized GROUP BY 1),
    e AS (SELECT state, sum(total_consumption_mwh) / 1000 AS gwh FROM electricity GROUP BY 1),
    j AS (SELECT f.state, n, mw, gwh, coalesce(population_millions, 5.0) AS pop,
          coalesce(gdp_billions, 300.0) AS gdp
          FROM f JOIN e ON e.state = f.state LEFT JOIN nation_dim d ON d.state = f.state)""") + """
    SELECT state, n / pop AS dc_per_million_pop, mw / pop AS dc_mw_per_million_pop,
           n / gdp AS dc_per_billion_gdp, gwh * 1000 / (pop * 1e6) AS elec_per_capita_mwh,
           mw / (gdp / 100) AS dc_intensity FROM j""",
       {"dc_per_million_pop": 6, "dc_mw_per_million_pop": 6, "dc_per_billion_gdp": 7,
        "elec_per_capita_mwh": 6, "dc_intensity": 6})
def m11(spark, sf):
    gwh = base.electricity(spark, sf).groupBy("state").agg(
        (F.sum("total_consumption_mwh") / 1000).alias("electricity_gwh"))
    df = agg.state_rollup(base.categorized(spark, sf)).select(
        "state", F.col("dc_count").alias("cumulative_dc_count"),
        F.col("total_capacity_mw").alias("cumulative_dc_mw")).join(gwh, "state")
    return panel.per_capita(df, base.nation_dim(spark, sf)).select(
        "state", "dc_per_million_pop", "dc_mw_per_million_pop", "dc_per_billion_gdp",
        "elec_per_capita_mwh", "dc_intensity")


@query("m12_first_difference", sql("categorized", "electricity", more=_OPENINGS) + """
    SELECT a.state, a.year, a.new_dc_count - b.new_dc_count AS delta_count,
           a.new_dc_capacity_mw - b.new_dc_capacity_mw AS delta_mw
    FROM openings a JOIN openings b ON a.state = b.state AND b.year = (
        SELECT max(c.year) FROM openings c WHERE c.state = a.state AND c.year < a.year)""",
       {"delta_mw": 6})
def m12(spark, sf):
    return panel.first_difference(
        _openings(spark, sf), {"new_dc_count": "delta_count", "new_dc_capacity_mw": "delta_mw"}
    ).select("state", "year", "delta_count", "delta_mw")


@query("m13_cagr", sql("categorized", more=f"""{_OPENINGS},
    y AS (SELECT year, sum(new_dc_count) AS n, sum(new_dc_capacity_mw) AS mw FROM openings
          GROUP BY 1),
    a AS (SELECT * FROM y WHERE year = (SELECT min(year) FROM y)),
    b AS (SELECT * FROM y WHERE year = (SELECT max(year) FROM y))""") + """
    SELECT a.year AS first_year, b.year AS last_year,
        (pow(b.n / greatest(a.n, 1), 1.0 / (b.year - a.year)) - 1) * 100 AS n_cagr_pct,
        (pow(b.mw / a.mw, 1.0 / (b.year - a.year)) - 1) * 100 AS mw_cagr_pct FROM a, b""",
       {"n_cagr_pct": 7, "mw_cagr_pct": 7})
def m13(spark, sf):
    yearly = _openings(spark, sf).groupBy("year").agg(
        F.sum("new_dc_count").alias("n"), F.sum("new_dc_capacity_mw").alias("mw"))
    return panel.cagr(yearly, {"n": 1.0, "mw": None})


@query("m14_time_and_log_features", sql("electricity") + """
    SELECT state, year, ln(1 + total_consumption_mwh) AS log_total, year - 1998 AS year_rel
    FROM electricity""", {"log_total": 9})
def m14(spark, sf):
    return panel.time_and_log_features(
        base.electricity(spark, sf), {"total_consumption_mwh": "log_total"}, 1998
    ).drop("total_consumption_mwh")


def written_panel(spark, sf):
    """The panel, written once for all that read it."""
    return stored(state_panel(spark, sf), "state-panel")


def _projected(spark, sf):
    return panel.project_forward(written_panel(spark, sf), [2002, 2003, 2005])


_PROJECTED = f"""{_STATE_PANEL}, last AS (SELECT * FROM panel
      WHERE year = (SELECT max(year) FROM panel)),
    projected AS (SELECT state, CAST(y AS INTEGER) AS year,
        cumulative_dc_mw * pow(1.15, y - year) AS cumulative_dc_mw,
        cumulative_dc_count * pow(1.15, y - year) AS cumulative_dc_count,
        dc_intensity * pow(1.15, y - year) AS dc_intensity,
        population_millions * pow(1.005, y - year) AS population_millions,
        gdp_billions * pow(1.025, y - year) AS gdp_billions, electricity_gwh
      FROM last, (SELECT unnest([2002, 2003, 2005]) AS y))"""


@query("m15_project_forward", sql("facility", "electricity", "nation_dim", more=_PROJECTED) + """
    SELECT * FROM projected""",
       {"cumulative_dc_mw": 5, "cumulative_dc_count": 6, "dc_intensity": 5,
        "population_millions": 7, "gdp_billions": 6, "electricity_gwh": 5})
def m15(spark, sf):
    return _projected(spark, sf).select(
        "state", "year", "cumulative_dc_mw", "cumulative_dc_count", "dc_intensity",
        "population_millions", "gdp_billions", "electricity_gwh")


@query("m16_projection_summary", sql("facility", "electricity", "nation_dim", more=f"""{_PROJECTED},
    s AS (SELECT *, electricity_gwh + cumulative_dc_mw AS pred FROM projected),
    b AS (SELECT sum(electricity_gwh) AS b FROM last)""") + """
    SELECT year, sum(pred) AS total_us_gwh, sum(population_millions) AS us_population_millions,
        max_by(state, pred) AS top_state, max(pred) AS top_state_gwh,
        sum(pred) / (sum(population_millions) * 1000) AS per_capita_mwh,
        (sum(pred) / any_value(b) - 1) * 100 AS growth_pct
    FROM s, b GROUP BY 1""",
       {"total_us_gwh": 4, "us_population_millions": 6, "top_state_gwh": 4, "per_capita_mwh": 6,
        "growth_pct": 6})
def m16(spark, sf):
    grid = written_panel(spark, sf)
    baseline = cleaning.latest_period(grid).agg(F.sum("electricity_gwh")).scalar()
    scored = panel.project_forward(grid, [2002, 2003, 2005]).withColumn(
        "predicted_electricity_gwh", F.col("electricity_gwh") + F.col("cumulative_dc_mw"))
    return panel.projection_summary(scored, baseline)


@query("m17_previous_year_consumption", sql("facility", "electricity") + """
    SELECT data_center_id, coalesce(e.total_consumption_mwh,
        (SELECT median(total_consumption_mwh) FROM electricity)) AS prev_consumption
    FROM facility f LEFT JOIN electricity e
      ON e.state = f.state AND e.year = f.year_operational - 1""", {"prev_consumption": 2})
def m17(spark, sf):
    elec = base.electricity(spark, sf)
    requests = base.facilities(spark, sf).select(
        "data_center_id", "state", F.col("year_operational").alias("year"))
    return panel.previous_year_consumption(
        requests, elec, exact_median(elec, "total_consumption_mwh").scalar()
    ).select("data_center_id", "prev_consumption")


