"""J1-J9, T1-T6, U1-U2, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas.operators import aggregates as agg
from voltatlas.operators import cleaning, joins
from voltatlas.queries import base
from voltatlas.queries.base import sql, table
from voltatlas.queries.panel import _OPENINGS, _openings
from voltatlas.queries.registry import query

JOINED = {"new_dc_capacity_mw": 6, "total_consumption_mwh": 2}
_SOME = """few AS (SELECT * REPLACE (
    CASE WHEN state = 'NATION_4' THEN 'elsewhere' ELSE state END AS state,
    CASE WHEN year > 1999 THEN year + 100 ELSE year END AS year) FROM electricity)"""


def _renamed(column: str, value: str, new: str):
    """One value gets a name that the other side does not have: a gap without dropping rows."""
    return F.when(F.col(column) == value, new).otherwise(F.col(column))


def _few(spark, sf):
    return base.electricity(spark, sf).withColumns({
        "state": _renamed("state", "NATION_4", "elsewhere"),
        "year": F.when(F.col("year") > 1999, F.col("year") + 100).otherwise(F.col("year"))})


@query("j01_inner_on_state_year", sql("categorized", "electricity", more=f"{_OPENINGS}, {_SOME}")
       + """SELECT o.state, o.year, new_dc_count, new_dc_capacity_mw, total_consumption_mwh
    FROM openings o JOIN few e ON o.state = e.state AND o.year = e.year""", JOINED)
def j01(spark, sf):
    return joins.inner_on(_openings(spark, sf), _few(spark, sf)).select(
        "state", "year", "new_dc_count", "new_dc_capacity_mw", "total_consumption_mwh")


@query("j02_left_zero_filled", sql("categorized", "electricity", more=f"{_OPENINGS}, {_SOME}")
       + """SELECT o.state, o.year, new_dc_count, new_dc_capacity_mw,
           coalesce(total_consumption_mwh, 0) AS total_consumption_mwh
    FROM openings o LEFT JOIN few e ON o.state = e.state AND o.year = e.year""", JOINED)
def j02(spark, sf):
    return joins.left_zero_filled(_openings(spark, sf), _few(spark, sf), ["state", "year"]).select(
        "state", "year", "new_dc_count", "new_dc_capacity_mw", "total_consumption_mwh")


@query("j03_left_on_state", sql("categorized", "electricity") + """
    SELECT c.state, count(*) AS dc_count, coalesce(any_value(t), 0) AS total_consumption_mwh
    FROM categorized c LEFT JOIN (SELECT CASE WHEN state = 'NATION_4'
        THEN 'elsewhere' ELSE state END AS state, sum(total_consumption_mwh) AS t FROM electricity
        GROUP BY 1) e ON c.state = e.state GROUP BY 1""",
       {"total_consumption_mwh": 2})
def j03(spark, sf):
    total = base.electricity(spark, sf).groupBy(
        _renamed("state", "NATION_4", "elsewhere").alias("state")).agg(
        F.sum("total_consumption_mwh").alias("total_consumption_mwh"))
    return joins.left_zero_filled(agg.state_rollup(base.categorized(spark, sf)), total,
                                  ["state"]).select("state", "dc_count", "total_consumption_mwh")


@query("j04_full_then_complete", sql("categorized", "electricity") + """
    SELECT state, dc_count, total_consumption_mwh FROM (
        SELECT CASE WHEN state = 'NATION_2' THEN 'other' ELSE state END AS state,
            count(*) AS dc_count FROM categorized GROUP BY 1)
    JOIN (SELECT CASE WHEN state = 'NATION_4' THEN 'elsewhere' ELSE state END AS state,
            sum(total_consumption_mwh) AS total_consumption_mwh FROM electricity GROUP BY 1)
    USING (state)""", {"total_consumption_mwh": 2})
def j04(spark, sf):
    total = base.electricity(spark, sf).groupBy(
        _renamed("state", "NATION_4", "elsewhere").alias("state")).agg(
        F.sum("total_consumption_mwh").alias("total_consumption_mwh"))
    counts = agg.state_rollup(base.categorized(spark, sf).withColumn(
        "state", _renamed("state", "NATION_2", "other")))
    return joins.full_then_complete(counts.select("state", "dc_count"), total)


@query("j05_pivot_categories", sql("categorized", more="".join(
    f"{c} AS (SELECT state, count(*) AS n, sum(capacity_mw_est) AS mw FROM categorized "
    f"WHERE dc_category = '{c}' GROUP BY 1), " for c in ("small", "decent", "crypto"))
    + """big_ai AS (SELECT state, count(*) AS n, sum(capacity_mw_est) AS mw FROM categorized
        WHERE dc_category = 'big_ai' GROUP BY 1),
    s AS (SELECT DISTINCT state FROM categorized)""") + """
    SELECT s.state, """ + ", ".join(
        f"coalesce({c}.n, 0) AS {c}_count, coalesce({c}.mw, 0) AS {c}_capacity_mw"
        for c in ("small", "decent", "crypto", "big_ai")) + " FROM s " + " ".join(
        f"LEFT JOIN {c} ON {c}.state = s.state" for c in ("small", "decent", "crypto", "big_ai")),
       {f"{c}_capacity_mw": 6 for c in ("small", "decent", "crypto", "big_ai")})
def j05(spark, sf):
    wide = agg.category_breakdown(base.categorized(spark, sf))
    return wide.select("state", *[
        f"{c}_{m}" for c in ("small", "decent", "crypto", "big_ai")
        for m in ("count", "capacity_mw")])


@query("j06_enrich_by_name", sql("facility", more="""
    facts AS (SELECT * FROM (SELECT city, data_center_id, capacity_mw, row_number() OVER (
        PARTITION BY owner_id ORDER BY data_center_id DESC) AS r, owner_id FROM facility
        WHERE capacity_mw IS NOT NULL) WHERE r = 1)""") + """
    SELECT c_custkey AS id, f.data_center_id AS fact_id, f.capacity_mw,
        coalesce(f.city, 'unknown') AS category, f.owner_id IS NOT NULL AS has_energy_data
    FROM customer LEFT JOIN facts f ON f.owner_id = c_custkey""")
def j06(spark, sf):
    facts = base.facilities(spark, sf).where(F.col("capacity_mw").isNotNull()).select(
        "owner_id", F.col("data_center_id").alias("fact_id"), "capacity_mw",
        F.col("city").alias("category"))
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return joins.enrich_by_name(df, facts, "id", "owner_id", ["fact_id"],
                                ["fact_id", "capacity_mw", "category"])


@query("j07_add_group_count", sql("categorized") + """
    SELECT r_name AS ba_code, coalesce(n, 0) AS big_ai_count FROM region LEFT JOIN (
        SELECT CASE WHEN ba_code = 'ASIA' THEN 'FAR' ELSE ba_code END AS ba_code, count(*) AS n
        FROM categorized WHERE dc_category = 'big_ai' GROUP BY 1) ON ba_code = r_name""")
def j07(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_name").alias("ba_code"))
    rows = base.categorized(spark, sf).where(F.col("dc_category") == "big_ai").withColumn(
        "ba_code", _renamed("ba_code", "ASIA", "FAR"))
    return joins.add_group_count(regions, rows, "ba_code", "big_ai_count")


@query("j08_membership_flag", """
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem
        WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS returned FROM orders""")
def j08(spark, sf):
    members = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return joins.membership_flag(table(spark, sf, "orders").select("o_orderkey"), members,
                                 "o_orderkey", "returned")


@query("j09_upsert_totals", sql("mapped", "nation_dim", more="""
    mart AS (SELECT CASE WHEN abbrev = 'N3' THEN 'X3' ELSE abbrev END AS abbrev, state AS name,
             CAST(7 AS BIGINT) AS dc_count, population_millions FROM nation_dim),
    t AS (SELECT CASE WHEN abbrev = 'N4' THEN 'X4' ELSE abbrev END AS abbrev, state,
          count(*) AS total, count(*) FILTER (WHERE has_energy_data) AS with_data
          FROM mapped JOIN nation_dim USING (state) GROUP BY 1, 2)""") + """
    SELECT coalesce(m.abbrev, t.abbrev) AS abbrev, coalesce(m.name, t.state) AS name,
        CASE WHEN m.abbrev IS NULL THEN with_data ELSE dc_count END AS dc_count,
        total AS total_dc_count, with_data AS dc_with_data,
        CASE WHEN m.abbrev IS NULL THEN 0 ELSE population_millions END AS population_millions
    FROM mart m FULL JOIN t ON m.abbrev = t.abbrev""")
def j09(spark, sf):
    dim = base.nation_dim(spark, sf)
    mart = dim.select(
        _renamed("abbrev", "N3", "X3").alias("abbrev"), F.col("state").alias("name"), F.lit(7).cast("long").alias("dc_count"),
        "population_millions")
    counts = agg.state_data_counts(base.mapped(spark, sf))
    totals = cleaning.state_abbrev(counts, out="abbrev", dim=dim).withColumn(
        "abbrev", _renamed("abbrev", "N4", "X4")).withColumnRenamed("state", "name")
    return joins.upsert_totals(mart, totals)


@query("t01_sort_rows", sql("electricity") + """
    SELECT state, year, total_consumption_mwh FROM electricity
    ORDER BY total_consumption_mwh DESC, state, year""", {"total_consumption_mwh": 2})
def t01(spark, sf):
    return joins.sort_rows(base.electricity(spark, sf), [F.col("total_consumption_mwh").desc()],
                           ["state", "year"])


@query("t02_top_k", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def t02(spark, sf):
    return joins.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"),
                       "o_totalprice", 15, "o_orderkey")


@query("t03_top_k_within", sql("categorized") + """
    SELECT dc_category, data_center_id, capacity_mw_est, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY dc_category
            ORDER BY capacity_mw_est DESC, data_center_id) AS INTEGER) AS rank FROM categorized)
    WHERE rank <= 15""")
def t03(spark, sf):
    return joins.top_k_within(
        base.categorized(spark, sf).select("dc_category", "data_center_id", "capacity_mw_est"),
        "dc_category", "capacity_mw_est", 15, ["data_center_id"])


@query("t04_top_state_per_year", sql("electricity") + """
    SELECT year, state AS top_state, total_consumption_mwh AS top_value FROM (
        SELECT *, row_number() OVER (PARTITION BY year ORDER BY total_consumption_mwh DESC, state)
            AS r FROM electricity) WHERE r = 1""", {"top_value": 2})
def t04(spark, sf):
    return joins.top_state_per_year(base.electricity(spark, sf), "total_consumption_mwh")


_STRENGTH = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(corr({f}, l_extendedprice)) AS importance FROM lineitem"
    for f in ("l_quantity", "l_discount", "l_tax", "l_linenumber"))


def _strengths(spark, sf):
    found = agg.feature_correlations(
        table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
        "l_extendedprice")
    return found.select("feature", F.abs("correlation").alias("importance"))


@query("t05_rank_importances", f"""
    SELECT CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank, feature,
        round(importance * 100, 2) AS importance_pct FROM ({_STRENGTH})
    ORDER BY importance DESC, feature LIMIT 3""")
def t05(spark, sf):
    return joins.rank_importances(_strengths(spark, sf), 3)


@query("t06_best_by_score", f"""
    SELECT arg_max(feature, importance) AS best_model, max(importance) AS best_score
    FROM ({_STRENGTH})""", {"best_score": 9})
def t06(spark, sf):
    return joins.best_by_score(_strengths(spark, sf), "importance", "feature")


@query("u01_union_all", """
    SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F' UNION ALL
    SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_orderstatus = 'O' UNION ALL
    SELECT o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderstatus = 'P'""")
def u01(spark, sf):
    o = table(spark, sf, "orders")
    return joins.union_all([
        o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus"),
        o.where("o_orderstatus = 'O'").select("o_orderstatus", "o_orderkey"),
        o.where("o_orderstatus = 'P'").select("o_orderkey", "o_totalprice")])


@query("u02_distinct_values", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def u02(spark, sf):
    return joins.distinct_values(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag")


