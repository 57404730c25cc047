"""The energy notions of the library, bound to the given tables.

A facility is an order: its customer's nation and region are the state and grid region, the
order year its opening year (unknown for status P), its price the capacity (unknown for
priority 4). Utility sales and state electricity are line items by supplier nation and ship
year, with the return flag as the sector. ``SQL`` holds the same bindings for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltatlas.operators import classify, energy

# Keywords that occur in the names of the bound facilities.
CRYPTO = ["machinery"]
HYPER = ["automobile"]
COLO = ["building"]
PLANNED = ["1-urgent"]
FIRST, LAST = 1996, 2000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def category_of(name="data_center_name", mw="capacity_mw"):
    return classify.classify_category(name, mw, CRYPTO, HYPER, COLO)


def type_of(name="data_center_name", mw="capacity_mw"):
    return classify.classify_facility_type(name, mw, HYPER, COLO)


def operator_of(name="data_center_name", city="city"):
    return classify.classify_operator(name, city, CRYPTO, HYPER)


def planned_of(name="data_center_name"):
    return classify.is_planned(name, PLANNED)


def year_guess():
    """Opening-year estimate of the bound facilities: rules by segment and nation."""
    return classify.estimate_year(
        "data_center_name", "city", "state", year_rules=YEAR_RULES, crypto_rules=CRYPTO_RULES,
        boom_years=BOOM_YEARS, crypto_default=1998, fallback=1997, operator=operator_of())


YEAR_RULES = [
    ("auto", ["automobile"], {"nation_1": {"2-high": 1996, "automobile": 1999},
                              "nation_2": {"auto": 1995}}),
    ("house", ["household"], {"nation_1": {"3-medium": 1996}, "nation_10": {"household": 2000}}),
]
CRYPTO_RULES = {"nation_3": {"machinery": 2001}, "nation_4": {"5-low": 1999}}
BOOM_YEARS = {"nation_5": 1996, "nation_6": 2000}


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    places = (
        table(spark, sf, "nation")
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("ba_code"))
    )
    owners = table(spark, sf, "customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, sf, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("data_center_id"),
            F.concat_ws(" ", "c_mktsegment", "o_orderpriority").alias("data_center_name"),
            "state", "ba_code", F.col("c_mktsegment").alias("city"),
            F.col("c_acctbal").alias("latitude"), (-F.col("c_acctbal")).alias("longitude"),
            F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate"))
            .alias("year_operational"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice") / 5000)
            .alias("capacity_mw"),
            F.col("o_custkey").alias("owner_id"),
        )
    )


def categorized(spark: SparkSession, sf: str) -> DataFrame:
    """Every bound facility with category, estimated capacity and energy."""
    return (
        facilities(spark, sf)
        .withColumn("dc_category", category_of())
        .withColumn("capacity_mw_est", energy.default_mw_by_category("capacity_mw", "dc_category"))
        .withColumn("estimated_energy_mwh",
                    energy.energy_by_category("capacity_mw_est", "dc_category"))
    )


# Brings facility energy to a few percent of the sales, so that shares spread over all bands.
MAP_SCALE = 150.0


def mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities in the columns of the facility map."""
    return categorized(spark, sf).select(
        F.col("data_center_name").alias("name"), "state", "city", "ba_code",
        F.col("year_operational").alias("year_built"), "capacity_mw",
        F.when(F.col("capacity_mw").isNotNull(), F.col("estimated_energy_mwh") / MAP_SCALE)
        .alias("energy_mwh"),
        F.col("dc_category").alias("category"),
        F.col("capacity_mw").isNotNull().alias("has_energy_data"),
    )


def electricity(spark: SparkSession, sf: str) -> DataFrame:
    """State electricity by year."""
    places = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, sf, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("n_name").alias("state"), F.year("l_shipdate").alias("year"))
        .agg((F.sum("l_extendedprice") * 10).alias("total_consumption_mwh"))
    )


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Utility sales: one row for each line item."""
    places = (
        table(spark, sf, "supplier")
        .join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    price = F.col("l_extendedprice")

    def sector(flag: str):
        return F.when(F.col("l_returnflag") == flag, price)

    return (
        table(spark, sf, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("utility_id"),
            F.col("n_name").alias("state"), F.col("r_name").alias("ba_code"),
            sector("A").alias("residential_sales_mwh"),
            sector("N").alias("commercial_sales_mwh"),
            sector("R").alias("industrial_sales_mwh"),
            price.alias("total_sales_mwh"), F.col("l_quantity").alias("total_customers"),
        )
    )


def nation_dim(spark: SparkSession, sf: str) -> DataFrame:
    """States with an abbreviation; population and GDP are unknown for those named ..5."""
    k = F.col("n_nationkey")
    known = ~F.endswith("n_name", F.lit("5"))
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("state"), F.concat(F.lit("N"), k.cast("string")).alias("abbrev"),
        F.concat(F.lit("N"), k.cast("string")).alias("state_abbr"),
        F.when(known, ((k + 1) * 0.5).cast("double")).alias("population_millions"),
        F.when(known, ((k + 1) * 30).cast("double")).alias("gdp_billions"))


CATEGORY_SQL = """CASE
    WHEN lower(data_center_name) LIKE '%machinery%' THEN 'crypto'
    WHEN capacity_mw >= 50 OR lower(data_center_name) LIKE '%automobile%' THEN 'big_ai'
    WHEN capacity_mw >= 10 THEN 'decent'
    WHEN capacity_mw IS NULL AND lower(data_center_name) LIKE '%building%' THEN 'decent'
    ELSE 'small' END"""
DEFAULT_MW_SQL = """CASE dc_category WHEN 'small' THEN 2.0 WHEN 'decent' THEN 15.0
    ELSE 50.0 END"""
FACTOR_SQL = """CASE dc_category WHEN 'small' THEN 7000.0 WHEN 'decent' THEN 7350.0
    WHEN 'crypto' THEN 8322.0 ELSE 7056.0 END"""
TYPE_SQL = """CASE
    WHEN lower(data_center_name) LIKE '%automobile%' OR coalesce(capacity_mw, 0) >= 50
        THEN 'hyperscale'
    WHEN lower(data_center_name) LIKE '%building%' THEN 'colocation'
    WHEN coalesce(capacity_mw, 0) >= 10 THEN 'enterprise' ELSE 'default' END"""
OPERATOR_SQL = """CASE
    WHEN lower(data_center_name || ' ' || city) LIKE '%machinery%' THEN 'crypto'
    WHEN lower(data_center_name || ' ' || city) LIKE '%automobile%' THEN 'ai'
    ELSE 'general' END"""

YEAR_GUESS_SQL = f"""coalesce(
    CASE WHEN n LIKE '%automobile%' AND s = 'nation_1' AND (c LIKE '%2-high%' OR n LIKE '%2-high%')
        THEN 1996
      WHEN n LIKE '%automobile%' AND s = 'nation_1' THEN 1999
      WHEN n LIKE '%automobile%' AND s = 'nation_2' THEN 1995 END,
    CASE WHEN n LIKE '%household%' AND s = 'nation_1' AND n LIKE '%3-medium%' THEN 1996
      WHEN n LIKE '%household%' AND s = 'nation_10' THEN 2000 END,
    CASE WHEN {OPERATOR_SQL} = 'crypto' THEN
      CASE WHEN s = 'nation_3' THEN 2001 WHEN s = 'nation_4' AND n LIKE '%5-low%' THEN 1999
        ELSE 1998 END END,
    CASE s WHEN 'nation_5' THEN 1996 WHEN 'nation_6' THEN 2000 END, 1997)"""
LOWERED = """lowered AS (SELECT *, lower(data_center_name) AS n, lower(city) AS c,
    replace(lower(state), '-', ' ') AS s FROM facility)"""

_FACILITY = """facility AS (
    SELECT o_orderkey AS data_center_id,
           c_mktsegment || ' ' || o_orderpriority AS data_center_name,
           n_name AS state, r_name AS ba_code, c_mktsegment AS city,
           c_acctbal AS latitude, -c_acctbal AS longitude,
           CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END
               AS year_operational,
           CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_totalprice / 5000 END
               AS capacity_mw,
           o_custkey AS owner_id
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_CATEGORIZED = f"""categorized0 AS (SELECT *, {CATEGORY_SQL} AS dc_category FROM facility),
categorized1 AS (SELECT *, CAST(coalesce(capacity_mw, {DEFAULT_MW_SQL}) AS DOUBLE)
    AS capacity_mw_est FROM categorized0),
categorized AS (SELECT *, capacity_mw_est * CAST({FACTOR_SQL} AS DOUBLE) AS estimated_energy_mwh
    FROM categorized1)"""
_MAPPED = """mapped AS (
    SELECT data_center_name AS name, state, city, ba_code, year_operational AS year_built,
           capacity_mw, CASE WHEN capacity_mw IS NOT NULL THEN estimated_energy_mwh / 150.0::DOUBLE END
               AS energy_mwh,
           dc_category AS category, capacity_mw IS NOT NULL AS has_energy_data
    FROM categorized)"""
_ELECTRICITY = """electricity AS (
    SELECT n_name AS state, CAST(year(l_shipdate) AS INTEGER) AS year,
           sum(l_extendedprice) * 10 AS total_consumption_mwh
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    GROUP BY 1, 2)"""
_SALES = """sales AS (
    SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_suppkey AS utility_id, n_name AS state,
           r_name AS ba_code,
           CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS residential_sales_mwh,
           CASE WHEN l_returnflag = 'N' THEN l_extendedprice END AS commercial_sales_mwh,
           CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS industrial_sales_mwh,
           l_extendedprice AS total_sales_mwh, l_quantity AS total_customers
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_NATION_DIM = """nation_dim AS (
    SELECT n_name AS state, 'N' || CAST(n_nationkey AS VARCHAR) AS abbrev,
           'N' || CAST(n_nationkey AS VARCHAR) AS state_abbr,
           CASE WHEN n_name NOT LIKE '%5' THEN CAST((n_nationkey + 1) * 0.5 AS DOUBLE) END
               AS population_millions,
           CASE WHEN n_name NOT LIKE '%5' THEN CAST((n_nationkey + 1) * 30 AS DOUBLE) END
               AS gdp_billions
    FROM nation)"""
_PARTS = {
    "facility": [_FACILITY],
    "categorized": [_FACILITY, _CATEGORIZED],
    "mapped": [_FACILITY, _CATEGORIZED, _MAPPED],
    "electricity": [_ELECTRICITY],
    "sales": [_SALES],
    "nation_dim": [_NATION_DIM],
}


def sql(*views: str, more: str = "") -> str:
    """WITH clause for the named views, without repeats, plus further named queries."""
    parts = list(dict.fromkeys(x for v in views for x in _PARTS[v]))
    if more:
        parts.append(more)
    return "WITH " + ",\n".join(parts) + "\n"
