"""A1-A22, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas.operators import aggregates as agg
from voltatlas.operators import cleaning, energy
from voltatlas.queries import base
from voltatlas.queries.base import sql, table
from voltatlas.queries.cleaning import _COUNTIES
from voltatlas.queries.registry import query



@query("a01_state_rollup", sql("categorized") + """
    SELECT state, count(*) AS dc_count, sum(capacity_mw_est) AS total_capacity_mw,
           sum(estimated_energy_mwh) AS total_energy_mwh FROM categorized GROUP BY 1""",
       {"total_capacity_mw": 6, "total_energy_mwh": 1})
def a01(spark, sf):
    return agg.state_rollup(base.categorized(spark, sf))


@query("a02_state_year_capacity", sql("facility") + """
    SELECT state, year_operational AS year, count(*) AS num_dcs,
           coalesce(sum(capacity_mw), 0) AS total_capacity_mw, avg(capacity_mw) AS avg_capacity_mw,
           max(capacity_mw) AS max_capacity_mw, min(capacity_mw) AS min_capacity_mw,
           avg(latitude) AS avg_lat, avg(longitude) AS avg_lon,
           avg(CASE WHEN capacity_mw IS NULL THEN 1.0 ELSE 0.0 END) AS imputation_fraction
    FROM facility WHERE year_operational IS NOT NULL GROUP BY 1, 2""",
       {"total_capacity_mw": 6, "avg_capacity_mw": 8, "avg_lat": 6, "avg_lon": 6,
        "imputation_fraction": 8})
def a02(spark, sf):
    df = base.facilities(spark, sf).withColumn(
        "capacity_imputed", energy.imputation_flag("capacity_mw"))
    return agg.state_year_capacity(df, mw="capacity_mw")


@query("a03_state_year_operator", sql("facility", more=f"""
    k AS (SELECT *, {base.OPERATOR_SQL} AS dc_type FROM facility)""") + """
    SELECT state, year_operational AS year, coalesce(sum(capacity_mw), 0) AS total_mw,
           coalesce(sum(latitude), 0) AS total_energy_twh, count(*) AS dc_count,
           count(*) FILTER (WHERE dc_type = 'ai') AS ai_dc_count
    FROM k WHERE year_operational IS NOT NULL GROUP BY 1, 2""",
       {"total_mw": 6, "total_energy_twh": 2})
def a03(spark, sf):
    df = base.facilities(spark, sf).withColumn("dc_type", base.operator_of())
    return agg.state_year_operator(df, mw="capacity_mw", twh="latitude")


_REGION_SALES = """
    SELECT ba_code, year, sum(total_sales_mwh) AS total_mwh,
           coalesce(sum(industrial_sales_mwh), 0) AS industrial_mwh,
           coalesce(sum(commercial_sales_mwh), 0) AS commercial_mwh,
           coalesce(sum(residential_sales_mwh), 0) AS residential_mwh,
           count(DISTINCT utility_id) AS utility_count, sum(total_customers) AS customers,
           least(greatest(coalesce((coalesce(sum(industrial_sales_mwh), 0)
               + coalesce(sum(commercial_sales_mwh), 0)) / nullif(sum(total_sales_mwh), 0), 0), 0),
               1) AS ci_ratio
    FROM sales GROUP BY 1, 2"""
SALES_DIGITS = {"total_mwh": 2, "industrial_mwh": 2, "commercial_mwh": 2, "residential_mwh": 2,
                "customers": 1, "ci_ratio": 9}


@query("a04_region_sales", sql("sales") + _REGION_SALES, SALES_DIGITS)
def a04(spark, sf):
    return agg.region_sales(base.sales(spark, sf))


@query("a05_region_sales_with_states", sql("sales", more="""
    t AS (SELECT ba_code, state, row_number() OVER (PARTITION BY ba_code ORDER BY state) AS r
          FROM (SELECT DISTINCT ba_code, state FROM sales)),
    n AS (SELECT ba_code, string_agg(state, ', ' ORDER BY state) AS states FROM t
          WHERE r <= 3 GROUP BY 1)""") + """
    SELECT s.ba_code, sum(total_sales_mwh) AS total_sales_mwh,
           count(DISTINCT utility_id) AS utility_count, any_value(states) AS states
    FROM sales s JOIN n ON s.ba_code = n.ba_code GROUP BY 1""", {"total_sales_mwh": 2})
def a05(spark, sf):
    return agg.region_sales_with_states(base.sales(spark, sf))


@query("a06_region_facilities", sql("mapped") + """
    SELECT ba_code, count(*) AS dc_count, coalesce(sum(capacity_mw), 0) AS total_capacity_mw,
           coalesce(avg(capacity_mw), 0) AS avg_capacity_mw,
           coalesce(max(capacity_mw), 0) AS max_capacity_mw,
           coalesce(sum(energy_mwh), 0) AS total_energy_mwh,
           count(*) FILTER (WHERE category = 'crypto') AS crypto_count,
           count(*) FILTER (WHERE category = 'big_ai') AS big_ai_count,
           count(*) FILTER (WHERE has_energy_data) AS energy_data_count,
           count(*) FILTER (WHERE category = 'crypto') / count(*) AS crypto_ratio,
           count(*) FILTER (WHERE has_energy_data) / count(*) AS avg_with_data
    FROM mapped GROUP BY 1""",
       {"total_capacity_mw": 6, "avg_capacity_mw": 8, "total_energy_mwh": 1})
def a06(spark, sf):
    return agg.region_facilities(base.mapped(spark, sf))


@query("a07_category_summary", sql("categorized") + """
    SELECT dc_category, count(*) AS dc_count, count(capacity_mw) AS known_capacity,
           sum(capacity_mw_est) AS total_mw, sum(estimated_energy_mwh) AS total_energy_mwh,
           count(*) / (SELECT count(*) FROM categorized) * 100 AS pct_of_rows,
           sum(estimated_energy_mwh) / 1e6 AS energy_twh
    FROM categorized GROUP BY 1""",
       {"total_mw": 6, "total_energy_mwh": 1, "pct_of_rows": 8, "energy_twh": 9})
def a07(spark, sf):
    return agg.category_summary(base.categorized(spark, sf))


_LATEST = """latest AS (SELECT state, total_consumption_mwh FROM electricity
    WHERE year = (SELECT max(year) FROM electricity))"""


@query("a08_category_by_state", sql("categorized", "electricity", more=_LATEST) + """
    SELECT c.state, count(*) AS dc_count, sum(capacity_mw_est) AS total_capacity_mw,
           sum(estimated_energy_mwh) AS total_energy_mwh,
           any_value(total_consumption_mwh) AS total_consumption_mwh,
           sum(estimated_energy_mwh) / any_value(total_consumption_mwh) * 100 AS pct_of_state
    FROM categorized c LEFT JOIN latest l ON c.state = l.state
    WHERE dc_category = 'big_ai' GROUP BY 1""",
       {"total_capacity_mw": 6, "total_energy_mwh": 1, "total_consumption_mwh": 2,
        "pct_of_state": 5})
def a08(spark, sf):
    latest = cleaning.latest_period(base.electricity(spark, sf), keys=["state"])
    return agg.category_by_state(base.categorized(spark, sf), latest)


@query("a09_type_summary", sql("facility", more=f"""
    t AS (SELECT *, {base.TYPE_SQL} AS dc_type, coalesce(capacity_mw, 10) AS mw FROM facility),
    e AS (SELECT *, mw * 8760 * CASE dc_type WHEN 'hyperscale' THEN 0.70 * 1.10
          WHEN 'enterprise' THEN 0.60 * 1.40 WHEN 'colocation' THEN 0.55 * 1.50
          ELSE 0.65 * 1.40 END AS mwh FROM t)""") + """
    SELECT dc_type, count(*) AS dc_count, sum(mw) AS total_mw, sum(mwh) AS total_energy_mwh,
           avg(mwh / mw) AS mean_intensity FROM e GROUP BY 1""",
       {"total_mw": 6, "total_energy_mwh": 2, "mean_intensity": 6})
def a09(spark, sf):
    df = (
        base.facilities(spark, sf).withColumn("dc_type", base.type_of())
        .withColumn("capacity_mw_est", F.coalesce("capacity_mw", F.lit(10.0)))
        .withColumn("estimated_energy_mwh", energy.energy_by_type_and_vintage(
            "capacity_mw_est", "dc_type", F.col("year_operational"), missing_year=2000))
        .withColumn("energy_per_mw",
                    energy.energy_intensity("estimated_energy_mwh", "capacity_mw_est"))
    )
    return agg.type_summary(df)


@query("a10_national_totals", sql("categorized") + """
    SELECT count(*) AS total_dcs,
        count(*) FILTER (WHERE dc_category = 'small') AS small_dcs,
        count(*) FILTER (WHERE dc_category = 'decent') AS decent_dcs,
        count(*) FILTER (WHERE dc_category = 'crypto') AS crypto_dcs,
        count(*) FILTER (WHERE dc_category = 'big_ai') AS big_ai_dcs,
        sum(capacity_mw_est) AS total_capacity_mw,
        sum(capacity_mw_est) FILTER (WHERE dc_category = 'crypto') AS crypto_capacity_mw,
        sum(capacity_mw_est) FILTER (WHERE dc_category = 'big_ai') AS ai_capacity_mw,
        sum(estimated_energy_mwh) / 1e6 AS total_energy_twh,
        sum(estimated_energy_mwh) FILTER (WHERE dc_category = 'crypto') / 1e6 AS crypto_energy_twh,
        sum(estimated_energy_mwh) FILTER (WHERE dc_category = 'big_ai') / 1e6 AS ai_energy_twh
    FROM categorized""",
       {"total_capacity_mw": 6, "crypto_capacity_mw": 6, "ai_capacity_mw": 6,
        "total_energy_twh": 9, "crypto_energy_twh": 9, "ai_energy_twh": 9})
def a10(spark, sf):
    return agg.national_totals(base.categorized(spark, sf))


@query("a10_state_table_totals", sql("categorized", more="""
    s AS (SELECT count(*) AS n, sum(capacity_mw_est) AS mw, sum(estimated_energy_mwh) AS mwh
          FROM categorized GROUP BY state)""") + """
    SELECT CAST(sum(n) AS BIGINT) AS total_datacenters, sum(mw) / 1000 AS total_capacity_gw,
           sum(mwh) / 1e6 AS total_energy_twh, max(mwh) / 1e6 AS max_energy_twh,
           max(n) AS max_dc_count FROM s""",
       {"total_capacity_gw": 9, "total_energy_twh": 9, "max_energy_twh": 9})
def a10_states(spark, sf):
    return agg.state_table_totals(agg.state_rollup(base.categorized(spark, sf)))


_CATS = ["small", "decent", "crypto", "big_ai"]


@query("a11_category_breakdown", sql("categorized") + """
    SELECT state, count(*) AS dc_count, sum(capacity_mw_est) AS capacity_mw,
           sum(estimated_energy_mwh) AS energy_mwh, """ + ", ".join(
    f"count(*) FILTER (WHERE dc_category = '{c}') AS {c}_count, "
    f"coalesce(sum(capacity_mw_est) FILTER (WHERE dc_category = '{c}'), 0) AS {c}_capacity_mw, "
    f"coalesce(sum(estimated_energy_mwh) FILTER (WHERE dc_category = '{c}'), 0) AS {c}_energy_mwh"
    for c in _CATS) + " FROM categorized GROUP BY 1",
       {"capacity_mw": 6, "energy_mwh": 1,
        **{f"{c}_capacity_mw": 6 for c in _CATS}, **{f"{c}_energy_mwh": 1 for c in _CATS}})
def a11(spark, sf):
    return agg.category_breakdown(base.categorized(spark, sf))


_REGION_PANEL = """grid AS (SELECT ba_code, year, sum(total_sales_mwh) AS total_mwh FROM sales
        GROUP BY 1, 2),
    regions AS (SELECT DISTINCT ba_code FROM mapped),
    spine AS (SELECT ba_code, CAST(y AS INTEGER) AS year FROM regions,
              (SELECT unnest(range(1996, 2001)) AS y)),
    cells AS (SELECT s.ba_code, s.year, count(*) AS dc_count,
        coalesce(sum(capacity_mw), 0) AS total_capacity_mw,
        coalesce(avg(capacity_mw), 0) AS avg_capacity_mw,
        coalesce(max(capacity_mw), 0) AS max_capacity_mw,
        count(*) FILTER (WHERE category = 'crypto') AS crypto_count,
        count(*) FILTER (WHERE category = 'big_ai') AS big_ai_count,
        count(*) FILTER (WHERE category = 'big_ai' OR coalesce(capacity_mw, 0) >= 50)
            AS hyperscale_count,
        coalesce(sum(energy_mwh), 0) AS total_energy_mwh
      FROM spine s JOIN mapped m ON m.ba_code = s.ba_code
        AND (m.year_built IS NULL OR m.year_built <= s.year) GROUP BY 1, 2)"""


# The same cells at the years of the sales.
_REGION_CELLS = _REGION_PANEL.replace(
    """SELECT ba_code, CAST(y AS INTEGER) AS year FROM regions,
              (SELECT unnest(range(1996, 2001)) AS y)""", "SELECT ba_code, year FROM grid")


@query("a12_yearly_trends", sql("sales", "mapped", more=_REGION_CELLS) + """
    SELECT g.year, sum(total_mwh) AS total_mwh,
           CAST(sum(coalesce(dc_count, 0)) AS BIGINT) AS dc_count,
           sum(coalesce(total_capacity_mw, 0)) AS total_capacity_mw,
           sum(coalesce(total_energy_mwh, 0)) AS total_energy_mwh,
           count(DISTINCT g.ba_code) AS region_count,
           sum(coalesce(total_energy_mwh, 0)) / sum(total_mwh) * 100 AS dc_share
    FROM grid g LEFT JOIN cells c ON g.ba_code = c.ba_code AND g.year = c.year GROUP BY 1""",
       {"total_mwh": 2, "total_capacity_mw": 5, "total_energy_mwh": 2, "dc_share": 6})
def a12(spark, sf):
    from voltatlas.plans import marts

    df = marts.region_panel(base.sales(spark, sf), base.mapped(spark, sf), minimum=0)
    return agg.yearly_trends(df)


@query("a13_county_counts", sql("facility") + """
    SELECT county, state, count(*) AS dc_count FROM (
        SELECT state, CASE WHEN city = 'BUILDING' AND state = 'NATION_3' THEN 'Stone'
            WHEN city = 'MACHINERY' AND state = 'NATION_3' THEN 'Iron'
            WHEN city = 'BUILDING' AND state = 'NATION_8' THEN 'Brick' END AS county FROM facility)
    WHERE county IS NOT NULL GROUP BY 1, 2""")
def a13(spark, sf):
    return agg.county_counts(cleaning.city_to_county(base.facilities(spark, sf), mapping=_COUNTIES))


@query("a13_state_utilities", sql("sales") + """
    SELECT state, sum(total_sales_mwh) AS total_sales_mwh,
           count(DISTINCT utility_id) AS utility_count FROM sales GROUP BY 1""",
       {"total_sales_mwh": 2})
def a13_utilities(spark, sf):
    return agg.state_utilities(base.sales(spark, sf))


@query("a14_state_capacity", sql("facility", "nation_dim") + """
    SELECT coalesce(abbrev, state) AS state_abbrev, count(*) AS dc_count,
           coalesce(sum(capacity_mw), 0) AS dc_capacity_mw
    FROM facility LEFT JOIN nation_dim USING (state) GROUP BY 1""", {"dc_capacity_mw": 6})
def a14(spark, sf):
    df = cleaning.state_abbrev(base.facilities(spark, sf), dim=base.nation_dim(spark, sf),
                               keep_unmapped=True)
    return agg.state_capacity(df)


@query("a15_state_data_counts", sql("mapped") + """
    SELECT state, count(*) AS total, count(*) FILTER (WHERE has_energy_data) AS with_data
    FROM mapped GROUP BY 1""")
def a15(spark, sf):
    return agg.state_data_counts(base.mapped(spark, sf))


@query("a16_value_counts", sql("facility", more=f"""
    k AS (SELECT {base.OPERATOR_SQL} AS dc_type FROM facility)""") + """
    SELECT dc_type, count(*) AS n FROM k GROUP BY 1""")
def a16(spark, sf):
    return agg.value_counts(
        base.facilities(spark, sf).withColumn("dc_type", base.operator_of()), "dc_type")


@query("a16_null_counts", sql("facility") + """
    SELECT 'capacity_mw' AS column_name, count(*) - count(capacity_mw) AS missing,
           count(capacity_mw) AS present FROM facility UNION ALL
    SELECT 'year_operational', count(*) - count(year_operational), count(year_operational)
    FROM facility UNION ALL
    SELECT 'state', count(*) - count(state), count(state) FROM facility""")
def a16_nulls(spark, sf):
    return agg.null_counts(base.facilities(spark, sf), ["capacity_mw", "year_operational", "state"])


@query("a17_pair_correlations", """
    SELECT corr(l_quantity, l_extendedprice) AS price_by_quantity,
           corr(l_tax, l_discount) AS tax_by_discount, CAST(NULL AS DOUBLE) AS constant
    FROM lineitem""", {"price_by_quantity": 9, "tax_by_discount": 9, "constant": 9})
def a17(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0))
    return agg.pair_correlations(df, {
        "price_by_quantity": ("l_quantity", "l_extendedprice"),
        "tax_by_discount": ("l_tax", "l_discount"), "constant": ("one", "l_tax")})


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("a18_feature_correlations", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, l_extendedprice) AS correlation FROM lineitem"
    for f in _FEATURES), {"correlation": 9})
def a18(spark, sf):
    return agg.feature_correlations(table(spark, sf, "lineitem"), _FEATURES, "l_extendedprice")


@query("a19_describe", """
    SELECT count(l_extendedprice) AS n, avg(l_extendedprice) AS mean,
           stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS min,
           quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS q50,
           quantile_cont(l_extendedprice, 0.75) AS q75, max(l_extendedprice) AS max
    FROM lineitem""", {"mean": 5, "std": 5, "q25": 4, "q50": 4, "q75": 4})
def a19(spark, sf):
    return agg.describe(table(spark, sf, "lineitem"), "l_extendedprice")


@query("a20_share_of_national", sql("categorized", "electricity", more="""
    t AS (SELECT sum(estimated_energy_mwh) / 1e6 AS a,
        sum(estimated_energy_mwh) FILTER (WHERE dc_category = 'crypto') / 1e6 AS c,
        sum(estimated_energy_mwh) FILTER (WHERE dc_category = 'big_ai') / 1e6 AS b
        FROM categorized),
    u AS (SELECT sum(total_consumption_mwh) / 1e6 AS u FROM electricity WHERE year = 1999)""") + """
    SELECT u AS national_twh, a / u * 100 AS total_energy_pct, c / u * 100 AS crypto_energy_pct,
           b / u * 100 AS ai_energy_pct FROM t, u""",
       {"national_twh": 6, "total_energy_pct": 6, "crypto_energy_pct": 6, "ai_energy_pct": 6})
def a20(spark, sf):
    return agg.share_of_national(
        agg.national_totals(base.categorized(spark, sf)), base.electricity(spark, sf), 1999
    ).select("national_twh", "total_energy_pct", "crypto_energy_pct", "ai_energy_pct")


@query("a21_importance_of_family", """
    SELECT sum(abs(correlation)) AS family_sum FROM (
        SELECT 'dc_quantity' AS feature, corr(l_quantity, l_extendedprice) AS correlation
        FROM lineitem UNION ALL SELECT 'l_tax', corr(l_tax, l_extendedprice) FROM lineitem
        UNION ALL SELECT 'energy_discount', corr(l_discount, l_extendedprice) FROM lineitem)
    WHERE regexp_matches(feature, 'dc_|capacity|crypto|hyperscale|big_ai|energy')""",
       {"family_sum": 9})
def a21(spark, sf):
    df = table(spark, sf, "lineitem").withColumnsRenamed(
        {"l_quantity": "dc_quantity", "l_discount": "energy_discount"})
    ranked = agg.feature_correlations(df, ["dc_quantity", "l_tax", "energy_discount"],
                                      "l_extendedprice")
    return agg.importance_of_family(ranked.withColumn("importance", F.abs("correlation")))


@query("a22_state_means", sql("facility", more="""
    y AS (SELECT state, year_operational, count(*) AS n, avg(capacity_mw) AS a FROM facility
          WHERE year_operational IS NOT NULL GROUP BY 1, 2)""") + """
    SELECT state, CAST(sum(n) AS BIGINT) AS num_dcs, avg(a) AS avg_capacity_mw FROM y GROUP BY 1""",
       {"avg_capacity_mw": 8})
def a22(spark, sf):
    df = base.facilities(spark, sf).withColumn(
        "capacity_imputed", energy.imputation_flag("capacity_mw"))
    return agg.state_means(agg.state_year_capacity(df, mw="capacity_mw"))
