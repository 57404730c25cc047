"""Aggregations (A1-A22). NULL keys are dropped and an all-missing sum is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voltatlas import params as p
from voltatlas.functions.columns import clip, col, finite, not_null, or_zero, ratio, sum0
from voltatlas.operators.quantiles import exact_quantiles


def _grouped(df: DataFrame, keys: Sequence[str]):
    return df.where(not_null(*keys)).groupBy(*keys)


def state_rollup(df: DataFrame, state: str = "state", mw: str = "capacity_mw_est",
                 energy: str = "estimated_energy_mwh") -> DataFrame:
    """A1: count, MW and MWh."""
    return _grouped(df, [state]).agg(
        F.count(F.lit(1)).alias("dc_count"),
        sum0(mw).alias("total_capacity_mw"),
        sum0(energy).alias("total_energy_mwh"),
    )


def state_year_capacity(df: DataFrame, state: str = "state", year: str = "year_operational",
                        mw: str = "capacity_mw_imputed", lat: str = "latitude",
                        lon: str = "longitude", imputed: str = "capacity_imputed") -> DataFrame:
    """A2 (with I4)."""
    return _grouped(df, [state, year]).agg(
        F.count(F.lit(1)).alias("num_dcs"),
        sum0(mw).alias("total_capacity_mw"),
        F.avg(mw).alias("avg_capacity_mw"),
        F.max(mw).alias("max_capacity_mw"),
        F.min(mw).alias("min_capacity_mw"),
        F.avg(lat).alias("avg_lat"),
        F.avg(lon).alias("avg_lon"),
        F.avg(imputed).alias("imputation_fraction"),
    ).withColumnRenamed(year, "year")


def state_year_operator(df: DataFrame, state: str = "state", year: str = "year_operational",
                        mw: str = "estimated_capacity_mw", twh: str = "estimated_energy_twh",
                        kind: str = "dc_type") -> DataFrame:
    """A3: state and year with a conditional count."""
    return _grouped(df, [state, year]).agg(
        sum0(mw).alias("total_mw"),
        sum0(twh).alias("total_energy_twh"),
        F.count(F.lit(1)).alias("dc_count"),
        F.count_if(F.col(kind) == "ai").alias("ai_dc_count"),
    ).withColumnRenamed(year, "year")


def region_sales(df: DataFrame, keys: Sequence[str] = ("ba_code", "year"),
                 utility: str = "utility_id") -> DataFrame:
    """A4: sales by sector, distinct utilities, customers, commercial and industrial ratio."""
    return _grouped(df, list(keys)).agg(
        sum0("total_sales_mwh").alias("total_mwh"),
        sum0("industrial_sales_mwh").alias("industrial_mwh"),
        sum0("commercial_sales_mwh").alias("commercial_mwh"),
        sum0("residential_sales_mwh").alias("residential_mwh"),
        F.count_distinct(utility).alias("utility_count"),
        sum0("total_customers").alias("customers"),
    ).withColumn(
        "ci_ratio",
        clip(or_zero(ratio(F.col("industrial_mwh") + F.col("commercial_mwh"), "total_mwh")), 0, 1))


def region_sales_with_states(df: DataFrame, region: str = "ba_code", state: str = "state",
                             utility: str = "utility_id", total: str = "total_sales_mwh",
                             k: int = 3) -> DataFrame:
    """A5: sales with the first k states by name as text.

    Distinct states are cut to k by a row_number limit before they are gathered.
    """
    sales = _grouped(df, [region]).agg(
        sum0(total).alias("total_sales_mwh"), F.count_distinct(utility).alias("utility_count"))
    names = (
        df.where(not_null(region, state)).select(region, state).distinct()
        .withColumn("r", F.row_number().over(W.partitionBy(region).orderBy(state)))
        .where(F.col("r") <= k)
        .groupBy(region)
        .agg(F.array_join(F.array_sort(F.collect_list(state)), ", ").alias("states"))
    )
    return sales.join(names, region, "left").withColumn("states", F.coalesce("states", F.lit("")))


def region_facilities(df: DataFrame, region: str = "ba_code", mw: str = "capacity_mw",
                      energy: str = "energy_mwh", category: str = "category",
                      has_data: str = "has_energy_data") -> DataFrame:
    """A6."""
    return (
        _grouped(df, [region]).agg(
            F.count(F.lit(1)).alias("dc_count"),
            sum0(mw).alias("total_capacity_mw"),
            or_zero(F.avg(mw)).alias("avg_capacity_mw"),
            or_zero(F.max(mw)).alias("max_capacity_mw"),
            sum0(energy).alias("total_energy_mwh"),
            F.count_if(F.col(category) == "crypto").alias("crypto_count"),
            F.count_if(F.col(category) == "big_ai").alias("big_ai_count"),
            F.count_if(F.col(has_data)).alias("energy_data_count"),
        )
        .withColumn("crypto_ratio", ratio("crypto_count", "dc_count"))
        .withColumn("avg_with_data", ratio("energy_data_count", "dc_count"))
    )


def category_summary(df: DataFrame, category: str = "dc_category", mw: str = "capacity_mw",
                     mw_est: str = "capacity_mw_est",
                     energy: str = "estimated_energy_mwh") -> DataFrame:
    """The percent window runs over one row for each category."""
    return (
        _grouped(df, [category]).agg(
            F.count(F.lit(1)).alias("dc_count"),
            F.count(mw).alias("known_capacity"),
            sum0(mw_est).alias("total_mw"),
            sum0(energy).alias("total_energy_mwh"),
        )
        .withColumn("pct_of_rows",
                    ratio("dc_count", F.sum("dc_count").over(W.partitionBy())) * 100)
        .withColumn("energy_twh", F.col("total_energy_mwh") / 1e6)
    )


def category_by_state(df: DataFrame, electricity_latest: DataFrame, category: str = "big_ai",
                      column: str = "dc_category") -> DataFrame:
    """One category by state, with its share of the state's electricity."""
    by_state = state_rollup(df.where(F.col(column) == category))
    return by_state.join(
        electricity_latest.select("state", "total_consumption_mwh"), "state", "left"
    ).withColumn("pct_of_state", ratio("total_energy_mwh", "total_consumption_mwh") * 100)


def type_summary(df: DataFrame, kind: str = "dc_type", mw: str = "capacity_mw_est",
                 energy: str = "estimated_energy_mwh",
                 intensity: str = "energy_per_mw") -> DataFrame:
    """A9."""
    return _grouped(df, [kind]).agg(
        F.count(F.lit(1)).alias("dc_count"),
        sum0(mw).alias("total_mw"),
        sum0(energy).alias("total_energy_mwh"),
        F.avg(intensity).alias("mean_intensity"),
    )


def national_totals(df: DataFrame, category: str = "dc_category", mw: str = "capacity_mw_est",
                    energy: str = "estimated_energy_mwh") -> DataFrame:
    """A10: totals and totals by category in one row and one pass."""
    def of(c: str, v: str) -> Column:
        return sum0(F.when(F.col(category) == c, F.col(v)))

    def n(c: str) -> Column:
        return F.count_if(F.col(category) == c)

    return df.agg(
        F.count(F.lit(1)).alias("total_dcs"),
        n("small").alias("small_dcs"), n("decent").alias("decent_dcs"),
        n("crypto").alias("crypto_dcs"), n("big_ai").alias("big_ai_dcs"),
        sum0(mw).alias("total_capacity_mw"),
        of("crypto", mw).alias("crypto_capacity_mw"),
        of("big_ai", mw).alias("ai_capacity_mw"),
        (sum0(energy) / 1e6).alias("total_energy_twh"),
        (of("crypto", energy) / 1e6).alias("crypto_energy_twh"),
        (of("big_ai", energy) / 1e6).alias("ai_energy_twh"),
    )


def state_table_totals(by_state: DataFrame) -> DataFrame:
    """A10 over a state roll-up: totals and the largest state."""
    return by_state.agg(
        F.sum("dc_count").alias("total_datacenters"),
        (F.sum("total_capacity_mw") / 1000).alias("total_capacity_gw"),
        (F.sum("total_energy_mwh") / 1e6).alias("total_energy_twh"),
        (F.max("total_energy_mwh") / 1e6).alias("max_energy_twh"),
        F.max("dc_count").alias("max_dc_count"),
    )


def category_breakdown(df: DataFrame, state: str = "state", category: str = "dc_category",
                       mw: str = "capacity_mw_est", energy: str = "estimated_energy_mwh",
                       categories: Sequence[str] = ("small", "decent", "crypto", "big_ai"),
                       ) -> DataFrame:
    """One conditional aggregate instead of a join for each category."""
    aggs = [
        F.count(F.lit(1)).alias("dc_count"),
        sum0(mw).alias("capacity_mw"),
        sum0(energy).alias("energy_mwh"),
    ]
    for c in categories:
        hit = F.col(category) == c
        aggs += [
            F.count_if(hit).alias(f"{c}_count"),
            sum0(F.when(hit, F.col(mw))).alias(f"{c}_capacity_mw"),
            sum0(F.when(hit, F.col(energy))).alias(f"{c}_energy_mwh"),
        ]
    return _grouped(df, [state]).agg(*aggs)


def yearly_trends(panel: DataFrame, region: str = "ba_code") -> DataFrame:
    """A12."""
    return panel.groupBy("year").agg(
        F.sum("total_mwh").alias("total_mwh"),
        F.sum("dc_count").alias("dc_count"),
        F.sum("total_capacity_mw").alias("total_capacity_mw"),
        F.sum("total_energy_mwh").alias("total_energy_mwh"),
        F.count_distinct(region).alias("region_count"),
    ).withColumn("dc_share", ratio("total_energy_mwh", "total_mwh") * 100)


def county_counts(df: DataFrame, county: str = "county", state: str = "state") -> DataFrame:
    """A13."""
    return _grouped(df, [county, state]).agg(F.count(F.lit(1)).alias("dc_count"))


def state_utilities(df: DataFrame, state: str = "state", total: str = "total_sales_mwh",
                    utility: str = "utility_id") -> DataFrame:
    """A13."""
    return _grouped(df, [state]).agg(
        sum0(total).alias("total_sales_mwh"), F.count_distinct(utility).alias("utility_count"))


def state_capacity(df: DataFrame, state: str = "state_abbrev",
                   mw: str = "capacity_mw") -> DataFrame:
    """A14."""
    return _grouped(df, [state]).agg(
        F.count(F.lit(1)).alias("dc_count"), sum0(mw).alias("dc_capacity_mw"))


def state_data_counts(df: DataFrame, state: str = "state",
                      has_data: str = "has_energy_data") -> DataFrame:
    """A15."""
    return _grouped(df, [state]).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(has_data)).alias("with_data"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Missing values are no class."""
    return _grouped(df, [c]).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row for each column."""
    one = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing"),
                 (F.col("_n") - F.col(c)).alias("present")) for c in cols
    ])).alias("x")).select("x.*")


def safe_corr(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant side."""
    a, b = col(a).cast("double"), col(b).cast("double")
    pair = a.isNotNull() & b.isNotNull()
    x, y = F.when(pair, a), F.when(pair, b)
    covar = F.covar_pop(x, y)
    return ratio(covar, F.stddev_pop(x) * F.stddev_pop(y))


def pair_correlations(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A17."""
    return df.agg(*[safe_corr(a, b).alias(name) for name, (a, b) in pairs.items()])


def feature_correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One pass, one row for each feature."""
    one = df.agg(*[safe_corr(f, target).alias(f) for f in features])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features
    ])).alias("x")).select("x.*")


def describe(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max."""
    v = finite(c)
    q = exact_quantiles(df, c, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, written=True)
    stats = df.agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    # Both sides are one row; the quartiles come in as one scalar struct.
    quart = q.select(F.struct("q25", "q50", "q75").alias("q")).scalar()
    return stats.withColumn("_q", quart).select(
        "n", "mean", "std", "min", "_q.q25", "_q.q50", "_q.q75", "max")


def share_of_national(totals: DataFrame, electricity: DataFrame, year: int,
                      columns: Sequence[str] = ("total_energy_twh", "crypto_energy_twh",
                                                "ai_energy_twh")) -> DataFrame:
    """Totals against the national electricity of a year, in percent."""
    us = (electricity.where(F.col("year") == year)
          .agg((F.sum("total_consumption_mwh") / 1e6).alias("twh")).scalar())
    return totals.withColumn("national_twh", us).withColumns({
        c.replace("_twh", "_pct"): ratio(c, "national_twh") * 100 for c in columns})


def importance_of_family(importances: DataFrame,
                         pattern: str = p.FACILITY_FAMILY,
                         value: str = "importance") -> DataFrame:
    """A21."""
    return importances.where(F.col("feature").rlike(pattern)).agg(sum0(value).alias("family_sum"))


def state_means(df: DataFrame, state: str = "state") -> DataFrame:
    """Over a state-year table, the mean of yearly means and the number of facilities."""
    return _grouped(df, [state]).agg(
        F.sum("num_dcs").alias("num_dcs"), F.avg("avg_capacity_mw").alias("avg_capacity_mw"))
