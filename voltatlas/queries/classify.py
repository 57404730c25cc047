"""C1-C12, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import inline_table
from voltatlas.operators import aggregates as agg
from voltatlas.operators import classify, panel
from voltatlas.queries import base
from voltatlas.queries.base import sql, table
from voltatlas.queries.cleaning import _YOY_SQL
from voltatlas.queries.registry import query


def _like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query("c01_classify_category", sql("categorized") + """
    SELECT data_center_id, dc_category FROM categorized""")
def c01(spark, sf):
    return base.categorized(spark, sf).select("data_center_id", "dc_category")


@query("c01_category_of_documents", f"""
    SELECT doc_id, CASE WHEN {_like("text", p.CATEGORY_CRYPTO_KEYWORDS)} THEN 'crypto'
        WHEN mw >= 50 OR {_like("text", p.CATEGORY_HYPERSCALER_KEYWORDS)} THEN 'big_ai'
        WHEN mw >= 10 THEN 'decent'
        WHEN mw IS NULL AND {_like("text", p.CATEGORY_COLO_KEYWORDS)} THEN 'decent'
        ELSE 'small' END AS dc_category
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 <> 0 THEN n_chars / 100.0 END AS mw
          FROM documents)""")
def c01_documents(spark, sf):
    mw = F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / 100.0)
    return table(spark, sf, "documents").select(
        "doc_id", classify.classify_category("text", mw).alias("dc_category"))


@query("c02_classify_facility_type", sql("facility") + f"""
    SELECT data_center_id, {base.TYPE_SQL} AS dc_type FROM facility""")
def c02(spark, sf):
    return base.facilities(spark, sf).select("data_center_id", base.type_of().alias("dc_type"))


@query("c03_classify_operator", sql("facility") + f"""
    SELECT data_center_id, {base.OPERATOR_SQL} AS dc_type FROM facility""")
def c03(spark, sf):
    return base.facilities(spark, sf).select("data_center_id", base.operator_of().alias("dc_type"))


@query("c03_operator_of_documents", f"""
    SELECT doc_id, CASE WHEN {_like("text || ' ' || lang", p.OPERATOR_CRYPTO_KEYWORDS)}
        THEN 'crypto' WHEN {_like("text || ' ' || lang", p.OPERATOR_AI_KEYWORDS)} THEN 'ai'
        ELSE 'general' END AS dc_type FROM documents""")
def c03_documents(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", classify.classify_operator("text", "lang").alias("dc_type"))


@query("c04_is_planned", sql("facility") + """
    SELECT data_center_id, lower(data_center_name) LIKE '%1-urgent%' AS is_planned
    FROM facility""")
def c04(spark, sf):
    return base.facilities(spark, sf).select(
        "data_center_id", base.planned_of().alias("is_planned"))


@query("c05_estimate_year", sql("facility", more=base.LOWERED) + f"""
    SELECT data_center_id, CAST({base.YEAR_GUESS_SQL} AS INTEGER) AS estimated_year FROM lowered""")
def c05(spark, sf):
    return base.facilities(spark, sf).select(
        "data_center_id", base.year_guess().alias("estimated_year"))


@query("c06_fill_missing_year", sql("facility", more=base.LOWERED) + f"""
    SELECT data_center_id, CAST(CASE WHEN year_operational IS NULL OR year_operational = 1995
        THEN {base.YEAR_GUESS_SQL} ELSE year_operational END AS INTEGER) AS year_operational
    FROM lowered""")
def c06(spark, sf):
    zeroed = F.when(F.col("year_operational") == 1995, 0).otherwise(F.col("year_operational"))
    return base.facilities(spark, sf).select(
        "data_center_id",
        classify.fill_missing_year(zeroed, base.year_guess()).alias("year_operational"))


@query("c07_estimate_year_from_peak_growth", sql("facility", "electricity", more=_YOY_SQL + """,
    best AS (SELECT state, year, row_number() OVER (
        PARTITION BY state ORDER BY yoy_change_pct DESC, year) AS r
      FROM growth WHERE yoy_change_pct IS NOT NULL AND year BETWEEN 1996 AND 2000)""") + """
    SELECT data_center_id, f.state, b.year AS estimated_year, 'low' AS confidence
    FROM facility f JOIN best b ON f.state = b.state AND b.r = 1
    WHERE year_operational IS NULL OR year_operational NOT BETWEEN 1996 AND 2000""")
def c07(spark, sf):
    growth = panel.yoy(base.electricity(spark, sf), "total_consumption_mwh")
    return classify.estimate_year_from_peak_growth(
        base.facilities(spark, sf), growth, low=1996, high=2000, data_low=1996, data_high=2000
    ).select("data_center_id", "state", "estimated_year", "confidence")


@query("c08_concentration_band", sql("categorized") + """
    SELECT state, CASE WHEN share > 5 THEN 'HIGH' WHEN share > 3.8 THEN 'MED' ELSE 'LOW' END AS band
    FROM (SELECT state, sum(capacity_mw_est) / (SELECT sum(capacity_mw_est) FROM categorized) * 100
          AS share FROM categorized GROUP BY state)""")
def c08(spark, sf):
    cat = base.categorized(spark, sf)
    total = cat.agg(F.sum("capacity_mw_est")).scalar()
    share = agg.state_rollup(cat).withColumn("share", F.col("total_capacity_mw") / total * 100)
    return share.select("state", classify.concentration_band("share", 5, 3.8).alias("band"))


@query("c09_benchmark_verdict", sql("categorized") + """
    SELECT dc_category, CASE WHEN twh > ref * 2 THEN 'HIGH' WHEN twh < ref * 0.3 THEN 'LOW'
        ELSE 'reasonable' END AS verdict
    FROM (SELECT dc_category, sum(estimated_energy_mwh) / 1e6 AS twh FROM categorized GROUP BY 1)
    JOIN (VALUES ('crypto', 35.0), ('big_ai', 30.0)) AS v(kind, ref) ON dc_category = kind""")
def c09(spark, sf):
    refs = inline_table(spark, "dc_category string, reference_twh double",
                        list(p.INDUSTRY_TWH.items()))
    return agg.category_summary(base.categorized(spark, sf)).join(refs, "dc_category").select(
        "dc_category",
        classify.benchmark_verdict("energy_twh", "reference_twh").alias("verdict"))


@query("c10_is_hyperscale", sql("categorized") + """
    SELECT data_center_id, dc_category = 'big_ai' OR coalesce(capacity_mw, 0) >= 50 AS flag
    FROM categorized""")
def c10(spark, sf):
    return base.categorized(spark, sf).select(
        "data_center_id", classify.is_hyperscale("dc_category", "capacity_mw").alias("flag"))


@query("c11_flag_top_groups", sql("electricity") + """
    SELECT state, year, CASE WHEN state IN (SELECT state FROM (SELECT state,
        max(total_consumption_mwh) AS m FROM electricity GROUP BY 1 ORDER BY m DESC, state LIMIT 5))
        THEN 1 ELSE 0 END AS is_high_dc_state FROM electricity""")
def c11(spark, sf):
    return classify.flag_top_groups(
        base.electricity(spark, sf), "state", "total_consumption_mwh", 5
    ).select("state", "year", "is_high_dc_state")


@query("c12_interpret_fit", sql("categorized") + """
    SELECT state, CASE WHEN r2 > 0.5 THEN 'Strong' WHEN r2 > 0.2 THEN 'Moderate' ELSE 'Weak' END
        AS fit, CASE WHEN r2 > 0.05 THEN 'Detectable' ELSE 'Weak' END AS causal
    FROM (SELECT state, pow(corr(capacity_mw_est, estimated_energy_mwh), 2)
          * (ascii(right(state, 1)) % 10) / 9 AS r2 FROM categorized GROUP BY state)""")
def c12(spark, sf):
    r2 = F.pow(agg.safe_corr("capacity_mw_est", "estimated_energy_mwh"), 2)
    df = base.categorized(spark, sf).groupBy("state").agg(r2.alias("r2")).withColumn(
        "r2", F.col("r2") * (F.ascii(F.right("state", F.lit(1))) % 10) / 9)
    return df.select("state", classify.interpret_fit("r2").alias("fit"),
                     classify.interpret_causal("r2").alias("causal"))
