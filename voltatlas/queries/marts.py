"""D1-D9, bound to the given tables."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voltatlas.functions.columns import ratio
from voltatlas.operators import aggregates as agg
from voltatlas.operators import joins
from voltatlas.plans import marts
from voltatlas.queries import base
from voltatlas.queries.aggregates import _LATEST, _REGION_CELLS, _REGION_SALES, SALES_DIGITS
from voltatlas.queries.base import sql, table
from voltatlas.queries.pages import _LISTED, _SPECS, city_pages, spec_pages
from voltatlas.queries.panel import _PANEL_NUMBERS, _STATE_PANEL
from voltatlas.queries.registry import query


@query("d00_top_states_by_region_share", """
    SELECT n_name AS state, r_name AS ba_code, count(*) AS dc_count, sum(o_totalprice) AS total,
        sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY r_name) AS region_share
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
    ORDER BY total DESC, state LIMIT 10""", {"total": 2, "region_share": 9})
def d00(spark, sf):
    owners = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf, "orders").join(
        owners, F.col("o_custkey") == F.col("c_custkey")
    ).groupBy("n_name", "n_regionkey").agg(
        F.count(F.lit(1)).alias("dc_count"), F.sum("o_totalprice").alias("total"))
    named = rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    shares = named.select(
        F.col("n_name").alias("state"), F.col("r_name").alias("ba_code"), "dc_count", "total",
        ratio("total", F.sum("total").over(W.partitionBy("r_name"))).alias("region_share"))
    return joins.top_k(shares, "total", 10, "state")


@query("d01_facility_listing", f"""WITH {_LISTED}, {_SPECS}
    SELECT name, company, address, postal, city, state, country,
        coalesce(capacity, 'NA') AS capacity, coalesce(operational_date, 'NA') AS operational_date
    FROM uniq LEFT JOIN specs ON dc = link""")
def d01(spark, sf):
    return marts.facility_listing(city_pages(spark, sf), spec_pages(spark, sf))


_OPERATIONAL = f"""once AS (SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY data_center_id) AS r
      FROM facility WHERE lower(data_center_name) NOT LIKE '%1-urgent%'
        AND year_operational IS NOT NULL) WHERE r = 1 AND year_operational <= 1999),
  kept0 AS (SELECT *, {base.CATEGORY_SQL} AS dc_category FROM once),
  kept1 AS (SELECT *, CAST(coalesce(capacity_mw, {base.DEFAULT_MW_SQL}) AS DOUBLE)
      AS capacity_mw_est FROM kept0),
  kept AS (SELECT *, capacity_mw_est * CAST({base.FACTOR_SQL} AS DOUBLE) AS estimated_energy_mwh
      FROM kept1)"""


def _kept(spark, sf):
    """Facilities of which an owner counts as the id, so ids repeat."""
    raw = base.facilities(spark, sf).select(
        F.col("owner_id").alias("data_center_id"), "owner_id",
        F.col("data_center_id").alias("seq"), "data_center_name", "year_operational",
        "capacity_mw")
    return marts.facility_categorized(
        raw, ["seq"], base.category_of(), base.planned_of(), cutoff=1999)


@query("d02_facility_categorized", sql("facility", more=_OPERATIONAL) + """
    SELECT owner_id, data_center_id AS seq, false AS is_planned, dc_category, capacity_mw_est,
        estimated_energy_mwh FROM kept""")
def d02(spark, sf):
    return _kept(spark, sf).select("owner_id", "seq", "is_planned", "dc_category",
                                   "capacity_mw_est", "estimated_energy_mwh")


@query("d02_summary", sql("facility", more=_OPERATIONAL) + """
    SELECT count(*) AS total_dcs, count(*) FILTER (WHERE dc_category = 'small') AS small_dcs,
        count(*) FILTER (WHERE dc_category = 'decent') AS decent_dcs,
        count(*) FILTER (WHERE dc_category = 'crypto') AS crypto_dcs,
        count(*) FILTER (WHERE dc_category = 'big_ai') AS big_ai_dcs,
        sum(capacity_mw_est) AS total_capacity_mw,
        sum(estimated_energy_mwh) / 1e6 AS total_energy_twh FROM kept""",
       {"total_capacity_mw": 6, "total_energy_twh": 9})
def d02_summary(spark, sf):
    return agg.national_totals(_kept(spark, sf)).select(
        "total_dcs", "small_dcs", "decent_dcs", "crypto_dcs", "big_ai_dcs", "total_capacity_mw",
        "total_energy_twh")


@query("d03_state_mart", sql("categorized", "nation_dim") + """
    SELECT coalesce(abbrev, state) AS abbrev, state AS name, count(*) AS dc_count,
        round_even(round(sum(capacity_mw_est), 5), 1) AS capacity_mw,
        round_even(round(sum(estimated_energy_mwh), 4), 0) AS energy_mwh,
        round_even(round(sum(estimated_energy_mwh) / 1e6, 6), 2) AS energy_twh
    FROM categorized LEFT JOIN nation_dim USING (state) GROUP BY 1, 2""")
def d03(spark, sf):
    return marts.state_mart(agg.state_rollup(base.categorized(spark, sf)),
                            base.nation_dim(spark, sf))


@query("d03_state_category_mart", sql("categorized", "electricity", "nation_dim", more=_LATEST) + """
    SELECT abbrev, c.state AS name, count(*) AS dc_count,
        round_even(round(sum(capacity_mw_est), 5), 1) AS capacity_mw,
        round_even(round(sum(estimated_energy_mwh), 4), 0) AS energy_mwh,
        round_even(round(sum(estimated_energy_mwh) / 1e6, 6), 2) AS energy_twh,
        count(*) FILTER (WHERE dc_category = 'small') AS small_count,
        count(*) FILTER (WHERE dc_category = 'decent') AS decent_count,
        count(*) FILTER (WHERE dc_category = 'crypto') AS crypto_count,
        count(*) FILTER (WHERE dc_category = 'big_ai') AS ai_count,
        round_even(round(coalesce(sum(estimated_energy_mwh) FILTER (WHERE dc_category = 'crypto'), 0), 4), 0)
            AS crypto_energy_mwh,
        round_even(round(coalesce(sum(estimated_energy_mwh) FILTER (WHERE dc_category = 'big_ai'), 0), 4), 0)
            AS ai_energy_mwh,
        round_even(round(any_value(total_consumption_mwh), 4), 0) AS state_total_mwh
    FROM categorized c JOIN nation_dim d ON d.state = c.state
    LEFT JOIN latest l ON l.state = c.state GROUP BY 1, 2""")
def d03_category(spark, sf):
    return marts.state_category_mart(base.categorized(spark, sf), base.electricity(spark, sf),
                                     base.nation_dim(spark, sf))


_FACTS = """facts AS (SELECT * FROM (SELECT CAST(owner_id AS VARCHAR) AS fact_name,
        year_operational, capacity_mw_est, estimated_energy_mwh, dc_category,
        row_number() OVER (PARTITION BY owner_id ORDER BY data_center_id DESC) AS r
      FROM categorized WHERE year_operational IS NOT NULL) WHERE r = 1),
  map AS (SELECT coalesce(CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_custkey AS VARCHAR) END,
        'Unknown') AS name, n_name AS state, c_mktsegment AS city
    FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _listed(spark, sf):
    return table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey").cast("string")).alias("name"),
        F.col("n_name").alias("state"), F.col("c_mktsegment").alias("city"))


def _map(spark, sf):
    facts = base.categorized(spark, sf).where(F.col("year_operational").isNotNull()).withColumn(
        "data_center_name", F.col("owner_id").cast("string"))
    return marts.facility_map(_listed(spark, sf), facts, ["data_center_id"])


@query("d04_facility_map", sql("categorized", more=_FACTS) + """
    SELECT name, state, city, year_operational AS year,
        round_even(round(capacity_mw_est, 5), 1) AS capacity_mw,
        round_even(round(estimated_energy_mwh, 4), 0) AS energy_mwh,
        coalesce(dc_category, 'unknown') AS category, fact_name IS NOT NULL AS has_energy_data
    FROM map LEFT JOIN facts ON fact_name = name""")
def d04(spark, sf):
    return _map(spark, sf)


@query("d04_state_totals_upsert", sql("categorized", "nation_dim", more=_FACTS + """,
  mart AS (SELECT CASE WHEN abbrev = 'N3' THEN 'X3' ELSE abbrev END AS abbrev, d.state AS name,
      count(*) AS dc_count, round_even(round(sum(capacity_mw_est), 5), 1) AS capacity_mw
      FROM categorized c JOIN nation_dim d ON d.state = c.state GROUP BY 1, 2),
  totals AS (SELECT abbrev, m.state AS name, count(*) AS total, count(fact_name) AS with_data
      FROM map m JOIN nation_dim d ON d.state = m.state LEFT JOIN facts f ON f.fact_name = m.name
      GROUP BY 1, 2)""") + """
    SELECT coalesce(m.abbrev, t.abbrev) AS abbrev, coalesce(m.name, t.name) AS name,
        CASE WHEN m.abbrev IS NULL THEN with_data ELSE dc_count END AS dc_count,
        total AS total_dc_count, with_data AS dc_with_data,
        CASE WHEN m.abbrev IS NULL THEN 0 ELSE capacity_mw END AS capacity_mw
    FROM mart m FULL JOIN totals t ON m.abbrev = t.abbrev""")
def d04_upsert(spark, sf):
    dim = base.nation_dim(spark, sf)
    rolled = marts.state_mart(agg.state_rollup(base.categorized(spark, sf)), dim)
    mart = rolled.where(F.col("abbrev").rlike("^N[0-9]+$")).select(
        F.when(F.col("abbrev") == "N3", "X3").otherwise(F.col("abbrev")).alias("abbrev"),
        "name", "dc_count", "capacity_mw")
    return marts.state_totals_upsert(mart, _map(spark, sf), dim)


@query("d05_opening_training_table", sql("facility", "electricity", more=f"""
    m AS (SELECT state, median(capacity_mw) AS m FROM facility GROUP BY 1),
    o AS (SELECT median(capacity_mw) AS o FROM facility),
    f AS (SELECT f.*, {base.TYPE_SQL} AS dc_type, coalesce(capacity_mw, m, o, 10) AS mw
          FROM facility f LEFT JOIN m USING (state), o WHERE year_operational IS NOT NULL),
    e AS (SELECT *, mw * 8760 * CASE dc_type WHEN 'hyperscale' THEN 0.70 * 1.10
          WHEN 'enterprise' THEN 0.60 * 1.40 WHEN 'colocation' THEN 0.55 * 1.50
          ELSE 0.65 * 1.40 END AS mwh FROM f)""") + """
    SELECT x.state, x.year, any_value(x.total_consumption_mwh) AS total_consumption_mwh,
        count(*) FILTER (WHERE e.year_operational = x.year) AS new_dc_count,
        coalesce(sum(mw) FILTER (WHERE e.year_operational = x.year), 0) AS new_dc_capacity_mw,
        coalesce(sum(mwh) FILTER (WHERE e.year_operational = x.year), 0) AS new_dc_energy_mwh,
        count(e.state) AS cumulative_dc_count, coalesce(sum(mw), 0) AS cumulative_dc_capacity,
        coalesce(sum(mwh), 0) AS cumulative_dc_energy
    FROM electricity x LEFT JOIN e ON e.state = x.state AND e.year_operational <= x.year
    GROUP BY 1, 2""",
       {"total_consumption_mwh": 2, "new_dc_capacity_mw": 5, "new_dc_energy_mwh": 1,
        "cumulative_dc_capacity": 5, "cumulative_dc_energy": 1})
def d05(spark, sf):
    return marts.opening_training_table(
        base.facilities(spark, sf), base.electricity(spark, sf), base.type_of()
    ).select("state", "year", "total_consumption_mwh", "new_dc_count", "new_dc_capacity_mw",
             "new_dc_energy_mwh", "cumulative_dc_count", "cumulative_dc_capacity",
             "cumulative_dc_energy")


@query("d06_state_year_features", sql("facility", "electricity", "nation_dim", more=f"""
    {_STATE_PANEL}, top AS (SELECT state FROM (SELECT state, max(cumulative_dc_count) AS m
        FROM panel GROUP BY 1 ORDER BY m DESC, state LIMIT 5))""") + """
    SELECT *, CASE WHEN state IN (SELECT state FROM top) THEN 1 ELSE 0 END AS is_high_dc_state
    FROM panel""", _PANEL_NUMBERS)
def d06(spark, sf):
    return marts.state_year_features(
        base.facilities(spark, sf), base.electricity(spark, sf), 1997, 2001,
        base.nation_dim(spark, sf).drop("abbrev"), base.operator_of(), base.year_guess(), 5)


_SALES_GRID = f"""gridded AS ({_REGION_SALES})"""


REGION_PANEL = """
    SELECT g.*, coalesce(dc_count, 0) AS dc_count,
        coalesce(total_capacity_mw, 0) AS total_capacity_mw,
        coalesce(avg_capacity_mw, 0) AS avg_capacity_mw,
        coalesce(max_capacity_mw, 0) AS max_capacity_mw, coalesce(crypto_count, 0) AS crypto_count,
        coalesce(big_ai_count, 0) AS big_ai_count,
        coalesce(hyperscale_count, 0) AS hyperscale_count,
        coalesce(total_energy_mwh, 0) AS total_energy_mwh,
        coalesce(crypto_count / dc_count, 0) AS crypto_ratio,
        coalesce(hyperscale_count / dc_count, 0) AS hyperscale_ratio,
        least(coalesce(total_energy_mwh, 0) / g.total_mwh, 1) AS dc_energy_share,
        ln(1 + g.total_mwh) AS log_total_mwh, ln(1 + coalesce(total_capacity_mw, 0)) AS log_capacity,
        g.year - 1996 AS year_rel
    FROM gridded g LEFT JOIN cells c ON c.ba_code = g.ba_code AND c.year = g.year"""


@query("d07_region_panel", sql("sales", "mapped", more=f"{_REGION_CELLS}, {_SALES_GRID}") + REGION_PANEL,
       {**SALES_DIGITS, "total_capacity_mw": 5, "avg_capacity_mw": 7, "total_energy_mwh": 2,
        "crypto_ratio": 9, "hyperscale_ratio": 9, "dc_energy_share": 8, "log_total_mwh": 9,
        "log_capacity": 9})
def d07(spark, sf):
    return marts.region_panel(
        base.sales(spark, sf), base.mapped(spark, sf), minimum=0, base_year=1996)


@query("d07_top_regions", sql("sales", "mapped", more=_REGION_CELLS) + """
    SELECT g.ba_code, dc_count, total_capacity_mw AS capacity_mw,
        total_mwh / 1e6 AS electricity_twh, least(total_energy_mwh / total_mwh, 1) * 100
            AS dc_share_pct,
        CASE WHEN total_energy_mwh / total_mwh * 100 > 5 THEN 'HIGH'
             WHEN total_energy_mwh / total_mwh * 100 > 2 THEN 'MED' ELSE 'LOW' END AS band
    FROM grid g JOIN cells c ON c.ba_code = g.ba_code AND c.year = g.year
    WHERE g.year = (SELECT max(year) FROM grid) ORDER BY dc_share_pct DESC, g.ba_code LIMIT 10""",
       {"capacity_mw": 5, "electricity_twh": 8, "dc_share_pct": 6})
def d07_top(spark, sf):
    return marts.top_regions(
        marts.region_panel(base.sales(spark, sf), base.mapped(spark, sf), minimum=0))


@query("d08_region_snapshot", sql("sales", "mapped", more="""
    s AS (SELECT ba_code, sum(total_sales_mwh) AS total_mwh,
          count(DISTINCT utility_id) AS utility_count FROM sales GROUP BY 1),
    f AS (SELECT ba_code, count(*) AS dc_count, sum(capacity_mw) AS total_capacity_mw,
          sum(energy_mwh) AS e FROM mapped GROUP BY 1)""") + """
    SELECT ba_code, total_mwh, utility_count, dc_count, total_capacity_mw,
        least(e / total_mwh, 1) AS dc_energy_share, ln(1 + total_mwh) AS log_sales,
        CASE WHEN least(e / total_mwh, 1) * 100 > 10 THEN 'HIGH'
             WHEN least(e / total_mwh, 1) * 100 > 5 THEN 'MED' ELSE 'LOW' END AS band
    FROM s JOIN f USING (ba_code) WHERE total_mwh > 1e6""",
       {"total_mwh": 2, "total_capacity_mw": 5, "dc_energy_share": 8, "log_sales": 9})
def d08(spark, sf):
    return marts.region_snapshot(base.sales(spark, sf), base.mapped(spark, sf)).select(
        "ba_code", "total_mwh", "utility_count", "dc_count", "total_capacity_mw",
        "dc_energy_share", "log_sales", "band")


_SHARES = f"""{_LATEST}, shares AS (
    SELECT c.state, any_value(total_consumption_mwh) AS total_consumption_mwh, count(*) AS dc_count,
        sum(capacity_mw_est) AS total_capacity_mw, sum(estimated_energy_mwh) AS total_energy_mwh
    FROM categorized c JOIN latest l ON l.state = c.state GROUP BY 1)"""


# The regions that serve a state, in order: the first one counts.
_SERVED = {"ASIA": ["N2", "N7", "N12", "N17", "N1"], "AMERICA": ["N1", "N6", "N7", "N11", "N16"],
           "EUROPE": ["N3", "N8", "N16", "N13"], "MIDDLE EAST": ["N4", "N9", "N13", "N3", "N14"]}
_SERVED_SQL = ", ".join(
    f"({i}, '{r}', '{s}')" for i, (r, states) in enumerate(_SERVED.items()) for s in states)


@query("d08_primary_region_table", sql("sales", "facility", "nation_dim", more=f"""
    served(ordinal, region, abbrev) AS (VALUES {_SERVED_SQL}),
    home AS (SELECT abbrev, arg_min(region, ordinal) AS region FROM served GROUP BY 1),
    own AS (SELECT coalesce(region, 'OTHER') AS ba_code, count(*) AS dc_count, sum(capacity_mw) AS mw
      FROM facility LEFT JOIN nation_dim USING (state) LEFT JOIN home USING (abbrev) GROUP BY 1),
    sold AS (SELECT ba_code, sum(total_sales_mwh) AS mwh, count(DISTINCT utility_id) AS utilities,
        array_to_string(list_sort(list(DISTINCT state))[1:3], ', ') AS states FROM sales GROUP BY 1)""") + """
    SELECT coalesce(s.ba_code, o.ba_code) AS ba_code, coalesce(mwh, 0) AS total_sales_mwh,
        coalesce(utilities, 0) AS utility_count, coalesce(states, '') AS states,
        coalesce(dc_count, 0) AS dc_count, coalesce(mw, 0) AS dc_capacity_mw,
        coalesce(mw, 0) * 1e6 / nullif(mwh, 0) AS mw_per_twh
    FROM sold s FULL JOIN own o ON s.ba_code = o.ba_code""",
       {"total_sales_mwh": 2, "dc_capacity_mw": 5, "mw_per_twh": 4})
def d08_primary(spark, sf):
    return marts.primary_region_table(base.sales(spark, sf), base.facilities(spark, sf).select("state", "capacity_mw"),
                                      base.nation_dim(spark, sf), _SERVED)


GROWTH = """growth AS (
      SELECT e.state, e.year, coalesce(n, 0) AS new_dc_count, coalesce(mw, 0) AS new_dc_capacity_mw,
        coalesce(mwh, 0) AS new_dc_energy_mwh, sum(coalesce(mw, 0)) OVER w AS cumulative_dc_capacity,
        sum(coalesce(mwh, 0)) OVER w AS cumulative_dc_energy, e.total_consumption_mwh,
        e.total_consumption_mwh - b.total_consumption_mwh AS yoy_change_mwh
      FROM electricity e LEFT JOIN (
        SELECT state, year_operational AS year, count(*) AS n, sum(capacity_mw_est) AS mw,
          sum(estimated_energy_mwh) AS mwh FROM categorized WHERE dc_category = 'big_ai' GROUP BY 1, 2) o
        ON o.state = e.state AND o.year = e.year
      LEFT JOIN electricity b ON b.state = e.state AND b.year = e.year - 1
      WINDOW w AS (PARTITION BY e.state ORDER BY e.year)),
    growth_rows AS (SELECT * FROM growth WHERE yoy_change_mwh IS NOT NULL)"""


@query("m05_category_growth_table", sql("categorized", "electricity", more=GROWTH) + "SELECT * FROM growth_rows",
       {"new_dc_capacity_mw": 5, "new_dc_energy_mwh": 2, "cumulative_dc_capacity": 5, "cumulative_dc_energy": 2,
        "total_consumption_mwh": 2, "yoy_change_mwh": 2})
def m05_growth(spark, sf):
    return marts.category_growth_table(base.categorized(spark, sf), base.electricity(spark, sf))


@query("d09_state_share", sql("categorized", "electricity", more=_SHARES) + """
    SELECT *, total_energy_mwh / total_consumption_mwh * 100 AS dc_pct_of_state FROM shares""",
       {"total_consumption_mwh": 2, "total_capacity_mw": 6, "total_energy_mwh": 1,
        "dc_pct_of_state": 5})
def d09(spark, sf):
    return marts.state_share(base.categorized(spark, sf), base.electricity(spark, sf))


@query("d09_national_share", sql("categorized", "electricity", more=_SHARES) + """
    SELECT CAST(sum(dc_count) AS BIGINT) AS dc_count, sum(total_energy_mwh) AS total_energy_mwh,
        sum(total_consumption_mwh) AS total_consumption_mwh,
        sum(total_energy_mwh) / sum(total_consumption_mwh) * 100 AS dc_pct FROM shares""",
       {"total_energy_mwh": 2, "total_consumption_mwh": 2, "dc_pct": 6})
def d09_national(spark, sf):
    return marts.national_share(
        marts.state_share(base.categorized(spark, sf), base.electricity(spark, sf)))


@query("d08_unmatched_regions", sql("facility", "sales") + """
    SELECT ba_code, count(*) AS dc_count FROM facility WHERE ba_code NOT IN (
        SELECT CASE WHEN ba_code = 'ASIA' THEN 'FAR' ELSE ba_code END FROM sales) GROUP BY 1""")
def d08_unmatched(spark, sf):
    sales = base.sales(spark, sf).withColumn(
        "ba_code", F.when(F.col("ba_code") == "ASIA", "FAR").otherwise(F.col("ba_code")))
    return marts.unmatched_regions(base.facilities(spark, sf), sales)


