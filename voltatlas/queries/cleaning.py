"""P1-P16, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas.functions.columns import inline_table
from voltatlas.operators import aggregates as agg
from voltatlas.operators import cleaning, panel
from voltatlas.queries import base
from voltatlas.queries.base import sql, table
from voltatlas.queries.registry import query

_RAW_NUMBERS = """raw AS (
    SELECT o_orderkey AS id, o_totalprice AS price,
           CASE o_orderkey % 7
               WHEN 0 THEN CAST(o_custkey AS VARCHAR) || 'x' WHEN 1 THEN ''
               WHEN 2 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' '
               WHEN 3 THEN 'NaN' WHEN 4 THEN 'inf'
               WHEN 5 THEN CAST(o_custkey AS VARCHAR) || '.5'
               ELSE '-' || CAST(o_custkey AS VARCHAR) END AS text_mw
    FROM orders)"""


def _raw_numbers(spark, sf):
    k = F.col("o_custkey").cast("string")
    m = F.col("o_orderkey") % 7
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(m == 0, F.concat(k, F.lit("x"))).when(m == 1, "")
        .when(m == 2, F.concat(F.lit(" "), k, F.lit(" "))).when(m == 3, "NaN")
        .when(m == 4, "inf").when(m == 5, F.concat(k, F.lit(".5")))
        .otherwise(F.concat(F.lit("-"), k)).alias("text_mw"),
        F.when(m == 3, F.lit(float("nan"))).when(m == 4, F.lit(float("-inf")))
        .otherwise(F.col("o_totalprice")).alias("price"))


@query("p01_coerce_numeric", sql("facility", more=_RAW_NUMBERS) + """
    SELECT id, CASE WHEN id % 7 IN (2, 5, 6) THEN CAST(trim(text_mw) AS DOUBLE) END AS text_mw,
           CASE WHEN id % 7 NOT IN (3, 4) THEN price END AS price FROM raw""")
def p01(spark, sf):
    return cleaning.coerce_numeric(_raw_numbers(spark, sf), ["text_mw", "price"])


@query("p02_state_abbrev", sql("facility", "nation_dim") + """
    SELECT data_center_id, CASE WHEN data_center_id % 5 = 0 THEN upper(left(city, 2))
        ELSE abbrev END AS state_abbrev
    FROM facility LEFT JOIN nation_dim USING (state)""")
def p02(spark, sf):
    odd = F.col("data_center_id") % 5 == 0
    df = base.facilities(spark, sf).select(
        "data_center_id",
        F.when(odd, F.concat(F.lower(F.substring("city", 1, 2)), F.lit(" ")))
        .otherwise(F.concat(F.lit(" "), F.col("state"))).alias("state"))
    return cleaning.state_abbrev(df, dim=base.nation_dim(spark, sf)).select(
        "data_center_id", "state_abbrev")


_REGIONS = {f"N{i}": f"GRID_{i % 4}" for i in range(0, 25, 2)}
_REGION_STATES = {
    "EAST": ["N1", "N2", "N3", "N4"], "WEST": ["N3", "N4", "N6"], "SOUTH": ["N6", "N7", "N1"]}


def _abbreviated(spark, sf):
    return cleaning.state_abbrev(
        base.facilities(spark, sf).select("data_center_id", "state"),
        dim=base.nation_dim(spark, sf))


@query("p03_assign_region", sql("facility", "nation_dim") + """
    SELECT data_center_id, coalesce(CASE WHEN CAST(substr(abbrev, 2) AS INTEGER) % 2 = 0
        THEN 'GRID_' || CAST(CAST(substr(abbrev, 2) AS INTEGER) % 4 AS VARCHAR) END, 'OTHER')
        AS ba_code
    FROM facility LEFT JOIN nation_dim USING (state)""")
def p03(spark, sf):
    return cleaning.assign_region(_abbreviated(spark, sf), mapping=_REGIONS).select(
        "data_center_id", "ba_code")


@query("p04_primary_region", sql("facility", "nation_dim") + """
    SELECT data_center_id, CASE WHEN abbrev IN ('N1', 'N2', 'N3', 'N4') THEN 'EAST'
        WHEN abbrev = 'N6' THEN 'WEST' WHEN abbrev = 'N7' THEN 'SOUTH' ELSE 'OTHER' END AS ba_code
    FROM facility LEFT JOIN nation_dim USING (state)""")
def p04(spark, sf):
    return cleaning.primary_region(_abbreviated(spark, sf), mapping=_REGION_STATES).select(
        "data_center_id", "ba_code")


_COUNTIES = {("building", "NATION_3"): "Stone", ("machinery", "NATION_3"): "Iron",
             ("building", "NATION_8"): "Brick"}


@query("p05_city_to_county", sql("facility") + """
    SELECT data_center_id, CASE WHEN city = 'BUILDING' AND state = 'NATION_3' THEN 'Stone'
        WHEN city = 'MACHINERY' AND state = 'NATION_3' THEN 'Iron'
        WHEN city = 'BUILDING' AND state = 'NATION_8' THEN 'Brick' END AS county FROM facility""")
def p05(spark, sf):
    df = base.facilities(spark, sf).select(
        "data_center_id", F.concat(F.lit(" "), F.col("city")).alias("city"),
        F.concat(F.lower("state"), F.lit(" ")).alias("state"))
    return cleaning.city_to_county(df, mapping=_COUNTIES).select("data_center_id", "county")


@query("p06_filter_valid_years", sql("facility") + """
    SELECT data_center_id, year_operational FROM facility
    WHERE year_operational >= 1996 AND year_operational <= 1999""")
def p06(spark, sf):
    return cleaning.filter_valid_years(
        base.facilities(spark, sf), "year_operational", 1996, 1999
    ).select("data_center_id", "year_operational")


_ORDER = ["data_center_id"]


@query("p07_filter_operational", sql("facility") + """
    SELECT owner_id, data_center_id, year_operational FROM (
        SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY data_center_id) AS r
        FROM facility WHERE lower(data_center_name) NOT LIKE '%1-urgent%'
          AND year_operational IS NOT NULL)
    WHERE r = 1 AND year_operational <= 1999""")
def p07(spark, sf):
    df = base.facilities(spark, sf).select(
        "owner_id", "data_center_id", "data_center_name", "year_operational")
    return cleaning.filter_operational(
        df, base.planned_of(), "owner_id", "year_operational", _ORDER, 1999
    ).select("owner_id", "data_center_id", "year_operational")


@query("p08_dedupe_by_id", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r
        FROM orders) WHERE r = 1""")
def p08(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return cleaning.dedupe_by_id(df, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("p09_filter_funnel", sql("facility", more="""
    a AS (SELECT *, lower(data_center_name) LIKE '%1-urgent%' AS planned FROM facility),
    b AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY data_center_id) AS r
          FROM a WHERE NOT planned AND year_operational IS NOT NULL),
    c AS (SELECT
        (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a WHERE planned) AS planned,
        (SELECT count(*) FROM a WHERE NOT planned AND year_operational IS NULL) AS no_year,
        (SELECT count(*) FROM b WHERE r > 1) AS duplicate,
        (SELECT count(*) FROM b WHERE r = 1 AND year_operational > 1999) AS future)""") + """
    SELECT 0 AS step_no, 'total' AS step, total AS n_rows FROM c UNION ALL
    SELECT 1, 'planned', planned FROM c UNION ALL SELECT 2, 'no_year', no_year FROM c UNION ALL
    SELECT 3, 'duplicate', duplicate FROM c UNION ALL SELECT 4, 'future', future FROM c UNION ALL
    SELECT 5, 'kept', total - planned - no_year - duplicate - future FROM c""")
def p09(spark, sf):
    return cleaning.filter_funnel(
        base.facilities(spark, sf), base.planned_of(), "owner_id", "year_operational", _ORDER, 1999)


def _growth(spark, sf):
    return panel.yoy(base.electricity(spark, sf), "total_consumption_mwh")


_YOY_SQL = """growth AS (
    SELECT a.state, a.year, a.total_consumption_mwh,
           b.total_consumption_mwh AS prev_year_consumption,
           a.total_consumption_mwh - b.total_consumption_mwh AS yoy_change_mwh,
           (a.total_consumption_mwh - b.total_consumption_mwh)
               / nullif(b.total_consumption_mwh, 0) * 100 AS yoy_change_pct
    FROM electricity a LEFT JOIN electricity b ON a.state = b.state AND a.year = b.year + 1)"""


@query("p10_outlier_masks", sql("electricity", more=_YOY_SQL) + """
    SELECT state, year, yoy_change_mwh, yoy_change_pct FROM growth
    WHERE yoy_change_mwh > 0 AND abs(yoy_change_pct) < 15""",
       {"yoy_change_mwh": 2, "yoy_change_pct": 6})
def p10(spark, sf):
    up = cleaning.positive_change_only(_growth(spark, sf), "yoy_change_mwh")
    return cleaning.within(up, "yoy_change_pct", high=15, absolute=True).select(
        "state", "year", "yoy_change_mwh", "yoy_change_pct")


@query("p11_drop_incomplete", sql("facility") + """
    SELECT data_center_id, capacity_mw, year_operational FROM facility
    WHERE capacity_mw IS NOT NULL AND year_operational IS NOT NULL""")
def p11(spark, sf):
    df = base.facilities(spark, sf).withColumn(
        "capacity_mw", F.coalesce("capacity_mw", F.lit(float("nan"))))
    return cleaning.drop_incomplete(df, ["capacity_mw", "year_operational"]).select(
        "data_center_id", "capacity_mw", "year_operational")


@query("p12_min_volume_filter", sql("sales") + """
    SELECT ba_code, year, sum(total_sales_mwh) AS total_mwh FROM sales GROUP BY 1, 2
    HAVING sum(total_sales_mwh) > 1e6""", {"total_mwh": 2})
def p12(spark, sf):
    return cleaning.min_volume_filter(agg.region_sales(base.sales(spark, sf))).select(
        "ba_code", "year", "total_mwh")


@query("p13_latest_period", sql("electricity") + """
    SELECT * FROM electricity WHERE year = (SELECT max(year) FROM electricity)""",
       {"total_consumption_mwh": 2})
def p13(spark, sf):
    return cleaning.latest_period(base.electricity(spark, sf), keys=["state"])


@query("p14_find_column", """
    SELECT o_orderkey AS id, o_totalprice AS found FROM orders""")
def p14(spark, sf):
    df = table(spark, sf, "orders")
    return df.select(F.col("o_orderkey").alias("id"),
                     F.col(cleaning.find_column(df, ["capacity", "price"])).alias("found"))


@query("p15_select_available", """
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders""")
def p15(spark, sf):
    df = table(spark, sf, "orders")
    wanted = ["o_orderkey", "capacity_mw", "o_totalprice", "o_orderstatus", "o_clerk"]
    return df.select(*cleaning.select_available(df, wanted))


_PROFILE_COLS = ["data_center_name", "state", "city", "year_operational", "owner_id"]


@query("p16_column_profile", sql("facility", more="""
    v AS (""" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM facility"
        for c in _PROFILE_COLS) + """),
    s AS (SELECT DISTINCT column_name, v FROM v WHERE v IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY v) AS r FROM s)""") + """
    SELECT t.column_name, t.non_null, t.n_distinct, string_agg(r.v, '|' ORDER BY r.v) AS samples
    FROM (SELECT column_name, count(v) AS non_null, count(DISTINCT v) AS n_distinct FROM v
          GROUP BY 1) t
    JOIN r ON r.column_name = t.column_name AND r.r <= 3 GROUP BY 1, 2, 3""")
def p16(spark, sf):
    return cleaning.column_profile(
        base.facilities(spark, sf).select(*_PROFILE_COLS)
    ).withColumn("samples", F.array_join("samples", "|"))


@query("p02_builtin_states", """
    SELECT doc_id, 'TX' AS state_abbrev, 'ERCO' AS ba_code FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'VA', 'PJM' FROM documents WHERE doc_id % 3 = 1
    UNION ALL SELECT doc_id, NULL, 'OTHER' FROM documents WHERE doc_id % 3 = 2""")
def p02_builtin(spark, sf):
    names = inline_table(spark, "m int, state string", [(0, " Texas "), (1, "va"), (2, "texas")])
    df = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("m")).join(
        names, "m")
    return cleaning.assign_region(cleaning.state_abbrev(df)).select(
        "doc_id", "state_abbrev", "ba_code")


