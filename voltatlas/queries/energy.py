"""I1-I5 and E1-E9, bound to the given tables."""

from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import inline_table
from voltatlas.operators import energy, least_squares, trees
from voltatlas.operators.quantiles import exact_quantiles
from voltatlas.queries import base, tree_sql
from voltatlas.queries.base import sql, table
from voltatlas.queries.registry import query
from voltatlas.session import stored


@query("i01_impute_group_median", sql("facility", more="""
    m AS (SELECT state, median(capacity_mw) AS m FROM facility
          WHERE state <> 'NATION_7' GROUP BY 1),
    o AS (SELECT median(capacity_mw) AS o FROM facility WHERE state <> 'NATION_7')""") + """
    SELECT data_center_id, coalesce(CASE WHEN state <> 'NATION_7' THEN capacity_mw END, m, o, 10)
        AS capacity_mw_est
    FROM facility LEFT JOIN m USING (state), o""", {"capacity_mw_est": 6})
def i01(spark, sf):
    df = base.facilities(spark, sf).withColumn(
        "capacity_mw", F.when(F.col("state") != "NATION_7", F.col("capacity_mw")))
    return energy.impute_group_median(df, "capacity_mw").select("data_center_id", "capacity_mw_est")


@query("i02_impute_cascade", sql("facility", more="""
    f AS (SELECT data_center_id, state, year_operational,
                 CASE WHEN state <> 'NATION_7' THEN capacity_mw END AS mw FROM facility),
    s AS (SELECT state, median(mw) AS s FROM f GROUP BY 1),
    y AS (SELECT year_operational AS yr, median(mw) AS y FROM f
          WHERE year_operational IS NOT NULL GROUP BY 1),
    o AS (SELECT median(mw) AS o FROM f)""") + """
    SELECT data_center_id, coalesce(mw, s, y, o, 15) AS capacity_mw_imputed
    FROM f LEFT JOIN s USING (state) LEFT JOIN y ON yr = year_operational, o""",
       {"capacity_mw_imputed": 6})
def i02(spark, sf):
    df = base.facilities(spark, sf).withColumn(
        "capacity_mw", F.when(F.col("state") != "NATION_7", F.col("capacity_mw")))
    return energy.impute_cascade(df, "capacity_mw").select("data_center_id", "capacity_mw_imputed")


@query("i03_impute_by_category", sql("categorized") + """
    SELECT data_center_id, capacity_mw_est FROM categorized""")
def i03(spark, sf):
    return base.categorized(spark, sf).select("data_center_id", "capacity_mw_est")


@query("i03_impute_by_operator", sql("facility", more=f"""
    k AS (SELECT *, {base.OPERATOR_SQL} AS dc_type,
          CASE WHEN capacity_mw < 2 THEN 0 ELSE capacity_mw END AS mw FROM facility)""") + """
    SELECT data_center_id, CAST(CASE WHEN mw > 0 THEN mw ELSE CASE dc_type WHEN 'crypto' THEN 50
        WHEN 'ai' THEN 80 ELSE 12 END END AS DOUBLE) AS estimated_capacity_mw FROM k""")
def i03_operator(spark, sf):
    mw = F.when(F.col("capacity_mw") < 2, 0.0).otherwise(F.col("capacity_mw"))
    return base.facilities(spark, sf).select(
        "data_center_id",
        energy.default_mw_by_operator(mw, base.operator_of()).alias("estimated_capacity_mw"))


@query("i04_imputation_fraction", sql("facility") + """
    SELECT state, avg(CASE WHEN capacity_mw IS NULL THEN 1.0 ELSE 0.0 END) AS imputation_fraction
    FROM facility GROUP BY 1""", {"imputation_fraction": 8})
def i04(spark, sf):
    return base.facilities(spark, sf).groupBy("state").agg(
        F.avg(energy.imputation_flag("capacity_mw")).alias("imputation_fraction"))


@query("i05_fill_zero", sql("facility") + """
    SELECT data_center_id, coalesce(capacity_mw, 0) AS capacity_mw,
           coalesce(year_operational, 0) AS year_operational FROM facility""")
def i05(spark, sf):
    return energy.fill_zero(base.facilities(spark, sf).select(
        "data_center_id", "capacity_mw", "year_operational"))


@query("i05_fill_target_median", sql("facility") + """
    SELECT data_center_id, coalesce(capacity_mw, (SELECT median(capacity_mw) FROM facility))
        AS capacity_mw FROM facility""", {"capacity_mw": 6})
def i05_median(spark, sf):
    return energy.fill_target_median(
        base.facilities(spark, sf).select("data_center_id", "capacity_mw"), "capacity_mw")


@query("i01_exact_quantiles", """
    SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) AS q25,
           quantile_cont(l_extendedprice, 0.5) AS q50, quantile_cont(l_extendedprice, 0.9) AS q90
    FROM lineitem GROUP BY 1, 2""", {"q25": 4, "q50": 4, "q90": 4})
def exact(spark, sf):
    return exact_quantiles(
        table(spark, sf, "lineitem"), "l_extendedprice",
        {"q25": 0.25, "q50": 0.5, "q90": 0.9}, ["l_returnflag", "l_linestatus"])


@query("e01_energy_flat", sql("facility") + """
    SELECT data_center_id, capacity_mw * 8760 * 0.65 * 1.4 AS energy_mwh FROM facility""")
def e01(spark, sf):
    return base.facilities(spark, sf).select(
        "data_center_id", energy.energy_flat("capacity_mw").alias("energy_mwh"))


@query("e02_energy_by_category", sql("categorized") + """
    SELECT data_center_id, estimated_energy_mwh FROM categorized""")
def e02(spark, sf):
    return base.categorized(spark, sf).select("data_center_id", "estimated_energy_mwh")


_VINTAGE = """CAST(mw AS DOUBLE) * 8760
    * CASE dc_type WHEN 'hyperscale' THEN 0.70 WHEN 'enterprise' THEN 0.60
        WHEN 'colocation' THEN 0.55 ELSE 0.65 END
    * (CASE dc_type WHEN 'hyperscale' THEN 1.10 WHEN 'enterprise' THEN 1.40
        WHEN 'colocation' THEN 1.50 ELSE 1.40 END
       * pow(0.99, CASE WHEN y > 2010 THEN least(y - 2010, 14) ELSE 0 END))"""


@query("e03_energy_by_type_and_vintage", sql("facility", more=f"""
    t AS (SELECT data_center_id, coalesce(capacity_mw, 10) AS mw, {base.TYPE_SQL} AS dc_type,
          coalesce(year_operational + 14, 2015) AS y FROM facility)""") + f"""
    SELECT data_center_id, {_VINTAGE} AS energy_mwh FROM t""", {"energy_mwh": 1})
def e03(spark, sf):
    return base.facilities(spark, sf).select(
        "data_center_id",
        energy.energy_by_type_and_vintage(
            F.coalesce("capacity_mw", F.lit(10.0)), base.type_of(),
            F.col("year_operational") + 14).alias("energy_mwh"))


@query("e04_energy_twh_by_operator", sql("facility", more=f"""
    k AS (SELECT *, {base.OPERATOR_SQL} AS dc_type FROM facility)""") + """
    SELECT data_center_id, capacity_mw * 8760 * CASE dc_type WHEN 'crypto' THEN 0.95
        WHEN 'ai' THEN 0.70 ELSE 0.55 END * CASE dc_type WHEN 'crypto' THEN 1.10
        WHEN 'ai' THEN 1.15 ELSE 1.50 END / 1000000 AS energy_twh FROM k""")
def e04(spark, sf):
    return base.facilities(spark, sf).select(
        "data_center_id",
        energy.energy_twh_by_operator("capacity_mw", base.operator_of()).alias("energy_twh"))


@query("e05_energy_intensity", sql("categorized") + """
    SELECT data_center_id, estimated_energy_mwh / nullif(CASE WHEN data_center_id % 9 = 0 THEN 0
        ELSE capacity_mw_est END, 0) AS energy_per_mw FROM categorized""")
def e05(spark, sf):
    mw = F.when(F.col("data_center_id") % 9 == 0, 0.0).otherwise(F.col("capacity_mw_est"))
    return base.categorized(spark, sf).select(
        "data_center_id", energy.energy_intensity("estimated_energy_mwh", mw)
        .alias("energy_per_mw"))


def _intensities(spark, sf):
    return base.categorized(spark, sf).select(
        "state",
        energy.energy_intensity("estimated_energy_mwh", "capacity_mw_est").alias("energy_per_mw"))


@query("e06_estimate_new_facility", sql("categorized", more="""
    i AS (SELECT state, estimated_energy_mwh / capacity_mw_est AS e FROM categorized),
    req AS (SELECT c_custkey AS request_id, n_name AS state, CAST(c_custkey % 90 + 1 AS DOUBLE)
              AS mw, CASE c_custkey % 4 WHEN 0 THEN 'hyperscale' WHEN 1 THEN 'colocation'
              WHEN 2 THEN 'enterprise' ELSE 'other' END AS dc_type,
              CAST(2005 + c_custkey % 25 AS INTEGER) AS y
            FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT state, count(*) AS n, avg(e) AS m FROM i GROUP BY 1),
    o AS (SELECT avg(e) AS o FROM i)""") + f"""
    SELECT request_id, phys AS physics_estimate_mwh, phys * f AS adjusted_estimate_mwh,
           phys * f * 0.85 AS lower_bound_mwh, phys * f * 1.15 AS upper_bound_mwh,
           phys * f / mw AS energy_per_mw
    FROM (SELECT *, {_VINTAGE} AS phys,
                 CASE WHEN n > 5 THEN m / o ELSE 1.0 END AS f
          FROM req LEFT JOIN s USING (state), o)""",
       {"physics_estimate_mwh": 3, "adjusted_estimate_mwh": 3, "lower_bound_mwh": 3,
        "upper_bound_mwh": 3, "energy_per_mw": 4})
def e06(spark, sf):
    k = F.col("c_custkey")
    requests = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        k.alias("request_id"), F.col("n_name").alias("state"),
        (k % 90 + 1).cast("double").alias("capacity_mw"),
        F.when(k % 4 == 0, "hyperscale").when(k % 4 == 1, "colocation")
        .when(k % 4 == 2, "enterprise").otherwise("other").alias("dc_type"),
        (k % 25 + 2005).cast("int").alias("year"))
    return energy.estimate_new_facility(requests, _intensities(spark, sf)).select(
        "request_id", "physics_estimate_mwh", "adjusted_estimate_mwh", "lower_bound_mwh",
        "upper_bound_mwh", "energy_per_mw")


@query("e07_capacity_scenarios", sql("electricity") + """
    SELECT state, mw AS new_mw, mw * 7056 AS new_energy_mwh, mw * 7056 / 1000 AS new_energy_gwh,
           mw * 7056 * 1000 / 10500 AS homes,
           mw * 7056 / total_consumption_mwh * 100 AS pct_of_state
    FROM electricity JOIN (SELECT n_name AS state, CAST(n_nationkey * 100 + 50 AS DOUBLE) AS mw
        FROM nation UNION ALL SELECT 'NOWHERE', 5.0) USING (state)
    WHERE year = (SELECT max(year) FROM electricity)""",
       {"new_energy_mwh": 2, "new_energy_gwh": 4, "homes": 2, "pct_of_state": 4})
def e07(spark, sf):
    scenarios = table(spark, sf, "nation").select(
        F.col("n_name").alias("state"),
        (F.col("n_nationkey") * 100 + 50).cast("double").alias("new_mw"),
    ).unionByName(inline_table(spark, "state string, new_mw double", [("NOWHERE", 5.0)]))
    return energy.capacity_scenarios(scenarios, base.electricity(spark, sf))


@query("e08_compare_to_benchmarks", """
    SELECT p_partkey, est AS estimated_twh, (est - reported) / reported * 100 AS difference_pct
    FROM (SELECT p_partkey, p_retailprice / 1000 AS reported,
        p_retailprice * 8760 * CASE p_size % 3 WHEN 0 THEN 0.70 WHEN 1 THEN 0.60 ELSE 0.55 END
        * (CASE p_size % 3 WHEN 0 THEN 1.10 WHEN 1 THEN 1.40 ELSE 1.50 END * pow(0.99, 14)) / 1e6
        AS est FROM part)""", {"estimated_twh": 6, "difference_pct": 6})
def e08(spark, sf):
    m = F.col("p_size") % 3
    bench = table(spark, sf, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_retailprice").alias("capacity_mw"),
        (F.col("p_retailprice") / 1000).alias("reported_twh"),
        F.when(m == 0, "hyperscale").when(m == 1, "mix").otherwise("colocation").alias("type"))
    return energy.compare_to_benchmarks(bench).select(
        "p_partkey", "estimated_twh", "difference_pct")


_OPENED = ["num_dcs", "total_capacity_mw", "avg_lat", "avg_lon", "consumption_mwh"]
_IMPACT = trees.Params("boost", 100, 4, 0.1, min_leaf=5)
_ROUNDED = ", ".join(f"floor({f} * 1e4 + 0.501::DOUBLE) / 1e4 AS {f}" for f in _OPENED)


# The four capacities go through the trees as rows that are not fitted.
@query("e09_capacity_benchmark_table", sql("facility", "electricity", more=f"""
    own AS (SELECT state, median(capacity_mw) AS med FROM facility GROUP BY 1),
    imputed AS (SELECT f.*, coalesce(capacity_mw, med, (SELECT median(capacity_mw) FROM facility), 15) AS mw
      FROM facility f LEFT JOIN own USING (state)),
    opened AS (SELECT state, year_operational AS year, count(*)::DOUBLE AS num_dcs, sum(mw) AS total_capacity_mw,
        avg(latitude) AS avg_lat, avg(longitude) AS avg_lon, sum(mw * 8760 * 0.65 * 1.4) AS impact
      FROM imputed WHERE year_operational IS NOT NULL GROUP BY 1, 2),
    fitting AS (SELECT o.*, total_consumption_mwh AS consumption_mwh FROM opened o JOIN electricity USING (state, year)),
    asked(name, mw) AS (VALUES {", ".join(f"('{n}', {mw}::DOUBLE)" for n, mw in p.CAPACITY_BENCHMARKS)}),
    rows AS (SELECT row_number() OVER (ORDER BY state, year) AS id, NULL::VARCHAR AS name, 0 AS g, true AS train,
        floor(impact + 0.501::DOUBLE) AS y, {_ROUNDED} FROM fitting
      UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY mw), name, 0, false, 0, 1, mw, 38, -77, 100e9 FROM asked),
    {tree_sql.points(_OPENED)}, {tree_sql.boosted(_IMPACT)}""").replace("WITH ", "WITH RECURSIVE ", 1) + """
    SELECT name, total_capacity_mw AS capacity_mw, total_capacity_mw * 8760 * 0.65 * 1.4 AS expected_mwh,
        units AS predicted_mwh, (units - total_capacity_mw * 8760 * 0.65 * 1.4)
          / (total_capacity_mw * 8760 * 0.65 * 1.4) * 100 AS error_pct
    FROM rows JOIN fitted USING (id) WHERE NOT train""", {"expected_mwh": 2, "predicted_mwh": 1, "error_pct": 4})
def e09(spark, sf):
    """Boosted trees of the full model's size, fitted to the openings' impact."""
    df = energy.impute_group_median(base.facilities(spark, sf), "capacity_mw", default=15.0)
    rows = (
        df.where(F.col("year_operational").isNotNull())
        .groupBy("state", F.col("year_operational").alias("year"))
        .agg(F.count(F.lit(1)).cast("double").alias("num_dcs"),
             F.sum("capacity_mw_est").alias("total_capacity_mw"),
             F.avg("latitude").alias("avg_lat"), F.avg("longitude").alias("avg_lon"),
             F.sum(energy.energy_flat("capacity_mw_est")).alias("impact"))
        .join(base.electricity(spark, sf)
              .withColumnRenamed("total_consumption_mwh", "consumption_mwh"), ["state", "year"])
        .withColumns({f: F.floor(F.col(f) * 1e4 + 0.501) / 1e4 for f in _OPENED})
        .withColumn("impact", F.floor(F.col("impact") + 0.501).cast("double"))
    )
    cells = trees.summarise(stored(rows.select(*_OPENED, "impact"), "opened"), _OPENED, "impact")
    model, _ = trees.fit(cells, cells.group == 0, _IMPACT)
    return energy.capacity_benchmark_table(spark, lambda x: trees.score(model, x))


# Capacity against the state's electricity: the line is not known beforehand.
@query("e09_linear_model", sql("categorized", "electricity", more="""
    opened AS (SELECT state, year_operational AS year, sum(capacity_mw_est) AS mw FROM categorized GROUP BY 1, 2),
    line AS (SELECT regr_intercept(total_consumption_mwh, mw) AS a, regr_slope(total_consumption_mwh, mw) AS b
      FROM opened JOIN electricity USING (state, year))""") + """
    SELECT name, mw AS capacity_mw, mw * 8760 * 0.65 * 1.4 AS expected_mwh, a + b * mw AS predicted_mwh,
        (a + b * mw - mw * 8760 * 0.65 * 1.4) / (mw * 8760 * 0.65 * 1.4) * 100 AS error_pct
    FROM (VALUES """ + ", ".join(f"('{n}', {mw}::DOUBLE)" for n, mw in p.CAPACITY_BENCHMARKS) + """) AS t(name, mw), line""",
       {"expected_mwh": 2, "predicted_mwh": 1, "error_pct": 3})
def e09_linear(spark, sf):
    rows = base.categorized(spark, sf).groupBy("state", F.col("year_operational").alias("year")).agg(
        F.sum("capacity_mw_est").alias("total_capacity_mw")).join(base.electricity(spark, sf), ["state", "year"])
    line = least_squares.fit_line(rows, ["total_capacity_mw"], "total_consumption_mwh")
    return energy.capacity_benchmark_table(spark, lambda x: x.withColumn("prediction", line.column()))
