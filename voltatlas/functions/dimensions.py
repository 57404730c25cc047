"""Literal dimension tables. Their size is fixed by ``params``, so broadcasting them is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import inline_table


def state_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (
            s, a, p.STATE_REGION[a], p.STATE_POPULATION[s], float(p.STATE_GDP[s]),
            p.STATE_BOOM_YEARS.get(s.lower()),
        )
        for s, a in p.STATE_ABBREV.items()
    ]
    return inline_table(
        spark,
        "state string, abbrev string, ba_code string, population_millions double, "
        "gdp_billions double, boom_year int",
        rows,
    )


def region_state_dim(spark: SparkSession, mapping: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per region with its states, plus the declared order of the region."""
    mapping = mapping or p.REGION_STATES
    rows = [(i, r, ",".join(states)) for i, (r, states) in enumerate(mapping.items())]
    t = inline_table(spark, "ordinal int, ba_code string, states string", rows)
    return t.withColumn("states", F.split("states", ","))


def county_dim(spark: SparkSession, mapping: dict[tuple[str, str], str] | None = None) -> DataFrame:
    rows = [(c, s, county) for (c, s), county in (mapping or p.CITY_COUNTY).items()]
    return inline_table(spark, "city_key string, state_key string, county string", rows)


def category_dim(spark: SparkSession, mapping: dict[str, dict] | None = None) -> DataFrame:
    rows = [
        (c, v["pue"], v["utilization"], v["default_mw"], v["mwh_per_mw"])
        for c, v in (mapping or p.CATEGORY_PARAMS).items()
    ]
    return inline_table(
        spark,
        "category string, pue double, utilization double, default_mw double, mwh_per_mw double",
        rows,
    )
