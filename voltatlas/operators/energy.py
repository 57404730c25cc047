"""Capacity imputation (I1-I5) and energy formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import col, inline_table, ratio
from voltatlas.operators.cleaning import latest_period
from voltatlas.operators.quantiles import exact_median, medians_by
from voltatlas.session import stored


def _imputed(df: DataFrame, value: str, groupings: Sequence[str], default: float, out: str) -> DataFrame:
    """The value, else the median of the first grouping that has one, the overall one, a constant.

    All medians come from one table, written once: one row for each group.
    """
    medians = stored(
        medians_by(df, value, {**{g: g for g in groupings}, "": None}), "medians")
    overall = medians.where(F.col("grouping") == "").select("median").scalar()
    names = []
    for i, g in enumerate(groupings):
        own = medians.where(F.col("grouping") == g).select(
            F.col("key").alias(f"_k{i}"), F.col("median").alias(f"_m{i}"))
        df = df.join(own, F.col(g).cast("string") == F.col(f"_k{i}"), "left")
        names += [f"_k{i}", f"_m{i}"]
    return df.withColumn(out, F.coalesce(
        F.col(value), *[F.col(f"_m{i}") for i in range(len(groupings))], overall, F.lit(default))).drop(*names)


def impute_group_median(df: DataFrame, value: str, group: str = "state",
                        default: float = 10.0, out: str = "capacity_mw_est") -> DataFrame:
    """Value, median of its group, overall median, constant."""
    return _imputed(df, value, [group], default, out)


def impute_cascade(df: DataFrame, value: str, state: str = "state",
                   year: str = "year_operational", default: float = 15.0,
                   out: str = "capacity_mw_imputed") -> DataFrame:
    """Value, state median, year median, overall median, constant."""
    return _imputed(df, value, [state, year], default, out)


def _lookup(key: Column | str, table: dict[str, dict], field: str,
            default: str | None = None) -> Column:
    k = col(key)
    out = None
    for name, row in table.items():
        out = (F.when(k == name, row[field]) if out is None else out.when(k == name, row[field]))
    return out.otherwise(table[default][field]) if default else out


def default_mw_by_category(mw: Column | str, category: Column | str) -> Column:
    """Unknown capacity takes the default of the category."""
    return F.coalesce(col(mw), _lookup(category, p.CATEGORY_PARAMS, "default_mw"))


def default_mw_by_operator(mw: Column | str, operator: Column | str) -> Column:
    """As above by operator class, also replacing capacities that are not positive."""
    m = col(mw)
    return F.when(m > 0, m).otherwise(_lookup(operator, p.OPERATOR_PARAMS, "default_mw", "general"))


def imputation_flag(value: Column | str) -> Column:
    """I4: its group mean is the imputed fraction."""
    return col(value).isNull().cast("int")


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Zero for missing numbers; text columns are left alone."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint")
    names = cols or [n for n, t in df.dtypes if t in numeric or t.startswith("decimal")]
    return df.na.fill(0, subset=list(names))


def fill_target_median(df: DataFrame, target: str) -> DataFrame:
    """The median of all rows for missing targets, which stay missing if no row has one."""
    return df.withColumn(target, F.coalesce(F.col(target), exact_median(df, target, written=True).scalar()))


def energy_flat(mw: Column | str) -> Column:
    """MWh per year at the industry-average load and overhead."""
    return col(mw) * p.HOURS_PER_YEAR * p.FLAT_UTILIZATION * p.FLAT_PUE


def energy_by_category(mw: Column | str, category: Column | str) -> Column:
    """E2."""
    return col(mw) * _lookup(category, p.CATEGORY_PARAMS, "mwh_per_mw")


def pue_of_type(kind: Column | str) -> Column:
    return _lookup(kind, p.TYPE_PARAMS, "pue", "default")


def utilization_of_type(kind: Column | str) -> Column:
    return _lookup(kind, p.TYPE_PARAMS, "utilization", "default")


def energy_by_type_and_vintage(mw: Column | str, kind: Column | str, year: Column | str,
                               missing_year: int = 2015) -> Column:
    """Overhead falls 1 % for each year after 2010, for 14 years at most."""
    y = F.coalesce(col(year), F.lit(missing_year))
    years = F.least(F.greatest(y - p.VINTAGE_BASE_YEAR, F.lit(0)), F.lit(p.VINTAGE_MAX_YEARS))
    pue = pue_of_type(kind) * F.pow(F.lit(p.VINTAGE_YEARLY_FACTOR), years)
    return col(mw) * p.HOURS_PER_YEAR * utilization_of_type(kind) * pue


def energy_twh_by_operator(mw: Column | str, operator: Column | str) -> Column:
    """E4."""
    util = _lookup(operator, p.OPERATOR_PARAMS, "utilization", "general")
    pue = _lookup(operator, p.OPERATOR_PARAMS, "pue", "general")
    return col(mw) * p.HOURS_PER_YEAR * util * pue / 1_000_000


def energy_intensity(energy: Column | str, mw: Column | str) -> Column:
    """E5: MWh per MW."""
    return ratio(energy, mw)


def estimate_new_facility(requests: DataFrame, facilities: DataFrame,
                          uncertainty: float = p.ESTIMATE_UNCERTAINTY,
                          min_facilities: int = 5) -> DataFrame:
    """Formula estimate scaled by the state's intensity, with bounds.

    ``requests`` has capacity_mw, state, dc_type, year; ``facilities`` has state, energy_per_mw.
    A state counts only with more than ``min_facilities`` facilities.
    """
    # Every facility counts towards the minimum, also one without an intensity.
    by_state = facilities.groupBy("state").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("energy_per_mw").alias("_state_mean"))
    overall = facilities.agg(F.avg("energy_per_mw")).scalar()
    base = energy_by_type_and_vintage("capacity_mw", "dc_type", "year")
    factor = F.when(F.col("_n") > min_facilities,
                    ratio(F.col("_state_mean"), overall)).otherwise(F.lit(1.0))
    return (
        requests.join(by_state, "state", "left")
        .withColumn("physics_estimate_mwh", base)
        .withColumn("adjusted_estimate_mwh", F.col("physics_estimate_mwh") * factor)
        .withColumn("lower_bound_mwh", F.col("adjusted_estimate_mwh") * (1 - uncertainty))
        .withColumn("upper_bound_mwh", F.col("adjusted_estimate_mwh") * (1 + uncertainty))
        .withColumn("energy_per_mw", ratio("adjusted_estimate_mwh", "capacity_mw"))
        .withColumn("pue_used", pue_of_type("dc_type"))
        .withColumn("utilization_used", utilization_of_type("dc_type"))
        .drop("_n", "_state_mean")
    )


def capacity_scenarios(scenarios: DataFrame, electricity: DataFrame,
                       mwh_per_mw: float = p.CATEGORY_PARAMS["big_ai"]["mwh_per_mw"]) -> DataFrame:
    """What added MW in a state mean; states without data drop out."""
    latest = latest_period(electricity, keys=["state"]).select("state", "total_consumption_mwh")
    mwh = F.col("new_mw") * mwh_per_mw
    return scenarios.join(latest, "state").select(
        "state", "new_mw",
        mwh.alias("new_energy_mwh"),
        (mwh / 1000).alias("new_energy_gwh"),
        (mwh * 1000 / p.HOME_KWH_PER_YEAR).alias("homes"),
        (ratio(mwh, "total_consumption_mwh") * 100).alias("pct_of_state"),
    )


def compare_to_benchmarks(benchmarks: DataFrame, year: int = 2024) -> DataFrame:
    """Estimate against a reported figure; a mixed fleet is treated as enterprise.

    ``benchmarks`` has name, capacity_mw, reported_twh, type.
    """
    kind = F.when(F.col("type") == "mix", "enterprise").otherwise(F.col("type"))
    est = energy_by_type_and_vintage("capacity_mw", kind, F.lit(year)) / 1e6
    return benchmarks.withColumn("estimated_twh", est).withColumn(
        "difference_pct",
        ratio(F.col("estimated_twh") - F.col("reported_twh"), "reported_twh") * 100)


def capacity_benchmark_table(spark, transform, latitude: float = 38.0, longitude: float = -77.0,
                             consumption_mwh: float = 100e9) -> DataFrame:
    """Formula against a fitted model at 5, 20, 50 and 100 MW.

    ``transform`` maps a frame of model inputs to one with a ``prediction`` column.
    """
    rows = inline_table(spark, "name string, total_capacity_mw double", p.CAPACITY_BENCHMARKS)
    rows = rows.select(
        "name", "total_capacity_mw", F.lit(1.0).alias("num_dcs"),
        F.lit(latitude).alias("avg_lat"), F.lit(longitude).alias("avg_lon"),
        F.lit(consumption_mwh).alias("consumption_mwh"))
    scored = transform(rows).withColumn("expected_mwh", energy_flat("total_capacity_mw"))
    return scored.select(
        "name", F.col("total_capacity_mw").alias("capacity_mw"), "expected_mwh",
        F.col("prediction").alias("predicted_mwh"),
        (ratio(F.col("prediction") - F.col("expected_mwh"), "expected_mwh") * 100)
        .alias("error_pct"))
