"""Window, time-series and panel operators.

Windows here run over frames that are already one row for each (group, year), so a partition
holds as many rows as there are years. Facility rows are always aggregated first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voltatlas import params as p
from voltatlas.functions.columns import clip, col, not_null, or_zero, ratio, sum0
from voltatlas.functions.dimensions import state_dim
from voltatlas.operators.classify import is_hyperscale


def _upto(keys: Sequence[str], year: str):
    return W.partitionBy(*keys).orderBy(year).rowsBetween(W.unboundedPreceding, W.currentRow)


def yoy(df: DataFrame, value: str, group: str = "state", year: str = "year",
        calendar: bool = True) -> DataFrame:
    """M1: previous value, change and change in percent for each group.

    ``calendar`` compares only with the year before; off, with the previous row.
    """
    w = W.partitionBy(group).orderBy(year)
    prev = F.lag(value).over(w)
    if calendar:
        prev = F.when(F.lag(year).over(w) == F.col(year) - 1, prev)
    return (
        df.withColumn("prev_year_consumption", prev)
        .withColumn("yoy_change_mwh", F.col(value) - F.col("prev_year_consumption"))
        .withColumn("yoy_change_pct", ratio("yoy_change_mwh", "prev_year_consumption") * 100)
    )


def cumulative_panel(df: DataFrame, first: int, last: int, region: str = "ba_code",
                     year: str = "year_built", mw: str = "capacity_mw",
                     energy: str = "energy_mwh", category: str = "category") -> DataFrame:
    """M2: for each region and year, the facilities opened by then or of unknown year.

    An unknown or earlier opening counts from the first panel year on, so one aggregate per
    (region, opening year) and running windows replace the pairing of years with facilities.
    Cells without a facility are left out.
    """
    opening = F.greatest(F.coalesce(F.col(year), F.lit(first)), F.lit(first)).cast("int")
    per = _openings_of_regions(df, opening, region, mw, energy, category).where(F.col("year") <= last)
    spine = per.select("ba_code").distinct().select(
        "ba_code", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    out = _running_totals(spine.join(per, ["ba_code", "year"], "left"), ["ba_code", "year"])
    return out.where(F.col("dc_count").isNotNull())


def cumulative_at(grid: DataFrame, df: DataFrame, region: str = "ba_code", year: str = "year_built",
                  mw: str = "capacity_mw", energy: str = "energy_mwh", category: str = "category") -> DataFrame:
    """M2 at the rows of ``grid`` (ba_code, year): facilities opened by then or of unknown year.

    Openings and grid meet in one table of (region, year) rows, so any years of the grid will do,
    with gaps or beyond the openings; rows of the grid without a facility have zeros.
    """
    opening = F.coalesce(F.col(year), F.lit(-9999)).cast("int")
    per = _openings_of_regions(df, opening, region, mw, energy, category)
    both = grid.withColumn("_kept", F.lit(True)).join(per, ["ba_code", "year"], "full")
    out = _running_totals(both, [*grid.columns, "_kept"]).where(F.col("_kept")).drop("_kept")
    return out.withColumns({c: or_zero(c) for c in out.columns if c not in grid.columns})


def _openings_of_regions(df: DataFrame, opening: Column, region: str, mw: str, energy: str,
                         category: str) -> DataFrame:
    """One row for each region and opening year."""
    return (
        df.where(F.col(region).isNotNull())
        .withColumn("_opening", opening)
        .groupBy(F.col(region).alias("ba_code"), F.col("_opening").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(mw).alias("_mw"),
            F.count(mw).alias("_mw_n"),
            F.max(mw).alias("_mw_max"),
            F.count_if(F.col(category) == "crypto").alias("_crypto"),
            F.count_if(F.col(category) == "big_ai").alias("_big_ai"),
            F.count_if(is_hyperscale(category, mw)).alias("_hyper"),
            F.sum(energy).alias("_energy"),
        )
    )


def _running_totals(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Facility features up to each year of a region."""
    w = _upto(["ba_code"], "year")

    def running(c):
        return F.sum(c).over(w)

    return (
        df.select(
            *keep,
            running("_n").alias("dc_count"),
            or_zero(running("_mw")).alias("total_capacity_mw"),
            or_zero(ratio(running("_mw"), running("_mw_n"))).alias("avg_capacity_mw"),
            or_zero(F.max("_mw_max").over(w)).alias("max_capacity_mw"),
            running("_crypto").alias("crypto_count"),
            running("_big_ai").alias("big_ai_count"),
            running("_hyper").alias("hyperscale_count"),
            or_zero(running("_energy")).alias("total_energy_mwh"),
        )
        .withColumn("crypto_ratio", ratio("crypto_count", "dc_count"))
        .withColumn("hyperscale_ratio", ratio("hyperscale_count", "dc_count"))
    )


def openings_by_year(df: DataFrame, mw: str = "capacity_mw_est",
                     energy: str = "estimated_energy_mwh", state: str = "state",
                     year: str = "year_operational") -> DataFrame:
    """Facilities, MW and MWh that opened in each (state, year); unknown years drop out."""
    return (
        df.where(not_null(state, year))
        .groupBy(F.col(state).alias("state"), F.col(year).cast("int").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("new_dc_count"),
            sum0(mw).alias("new_dc_capacity_mw"),
            sum0(energy).alias("new_dc_energy_mwh"),
        )
    )


_RUNNING = {
    "new_dc_count": "cumulative_dc_count",
    "new_dc_capacity_mw": "cumulative_dc_capacity",
    "new_dc_energy_mwh": "cumulative_dc_energy",
}


def cumulative_by_opening_year(openings: DataFrame, group: str = "state",
                               year: str = "year") -> DataFrame:
    """M3: running count, MW and MWh over the opening years of a state."""
    w = _upto([group], year)
    return openings.withColumns({out: F.sum(c).over(w) for c, out in _RUNNING.items()})


def forward_fill(df: DataFrame, cols: Sequence[str], group: str = "state",
                 year: str = "year") -> DataFrame:
    """M4: last known value of the group; leading gaps become 0."""
    w = _upto([group], year)
    return df.withColumns({c: or_zero(F.last(c, ignorenulls=True).over(w)) for c in cols})


def cumulative_after_zero_fill(df: DataFrame, measures: dict[str, str], group: str = "state",
                               year: str = "year") -> DataFrame:
    """M5: gaps become 0, then running sums."""
    w = _upto([group], year)
    filled = df.withColumns({c: or_zero(c) for c in measures})
    return filled.withColumns({out: F.sum(c).over(w) for c, out in measures.items()})


def attach_openings(electricity: DataFrame, openings: DataFrame,
                    mode: str = "complete") -> DataFrame:
    """M3 with M4 or M5: openings and their running totals next to each electricity year.

    ``complete``      every opening counts from its own year on, also one before the first or
                      between electricity years;
    ``forward_fill``  totals known at opening years, carried forward: an opening before the
                      first electricity year shows only from the next opening on;
    ``zero_fill``     running sums over electricity years only: such an opening is lost.
    """
    new = list(_RUNNING)
    if mode == "forward_fill":
        joined = electricity.join(cumulative_by_opening_year(openings), ["state", "year"], "left")
        return forward_fill(joined.withColumns({c: or_zero(c) for c in new}),
                            list(_RUNNING.values()))
    if mode == "zero_fill":
        return cumulative_after_zero_fill(
            electricity.join(openings, ["state", "year"], "left"), _RUNNING)
    if mode != "complete":
        raise ValueError(f"unknown mode {mode!r}")
    both = electricity.withColumn("_kept", F.lit(True)).join(
        openings, ["state", "year"], "full")
    return cumulative_after_zero_fill(both, _RUNNING).where(F.col("_kept")).drop("_kept")


def state_year_panel(openings: DataFrame, electricity: DataFrame, first: int = 2005,
                     last: int = 2023, dim: DataFrame | None = None,
                     default_population: float = p.DEFAULT_POPULATION,
                     default_gdp: float = p.DEFAULT_GDP) -> DataFrame:
    """M6 (with M8 and M11): a dense state-year grid of running totals, lags and shares.

    ``openings``: state, year, new_dc_count, new_dc_mw, new_dc_energy_mwh, new_ai_count.
    ``electricity``: state, year, total_consumption_mwh. ``dim``: state, state_abbr,
    population_millions, gdp_billions; states it lacks are dropped. A year is kept only if
    this and the last year have electricity.
    """
    if dim is None:
        dim = F.broadcast(state_dim(openings.sparkSession)).select(
            "state", F.col("abbrev").alias("state_abbr"), "population_millions", "gdp_billions")
    start = first - 2
    clamped = F.greatest(F.col("year"), F.lit(start))
    measures = ["new_dc_count", "new_dc_mw", "new_dc_energy_mwh", "new_ai_count"]
    per = (
        openings.where(F.col("year") <= last)
        .groupBy("state", clamped.alias("year"))
        .agg(*[F.sum(c).alias(c) for c in measures])
    )
    spine = openings.select("state").distinct().select(
        "state", F.explode(F.sequence(F.lit(start), F.lit(last))).alias("year"))
    w, order = _upto(["state"], "year"), W.partitionBy("state").orderBy("year")
    grid = (
        spine.join(per, ["state", "year"], "left")
        .withColumns({c: or_zero(c) for c in measures})
        .withColumns({
            "cumulative_dc_mw": F.sum("new_dc_mw").over(w),
            "cumulative_dc_count": F.sum("new_dc_count").over(w),
            "cumulative_dc_energy_mwh": F.sum("new_dc_energy_mwh").over(w),
            "cumulative_ai_count": F.sum("new_ai_count").over(w),
        })
        .withColumns({
            "cumulative_dc_mw_lag1": F.lag("cumulative_dc_mw", 1).over(order),
            "cumulative_dc_mw_lag2": F.lag("cumulative_dc_mw", 2).over(order),
        })
        .where(F.col("year") >= first)
    )
    elec = yoy(electricity.select("state", "year", "total_consumption_mwh"),
               "total_consumption_mwh").where(F.col("prev_year_consumption").isNotNull())
    change = F.col("electricity_change_gwh")
    new_energy = F.col("new_dc_energy_twh") * 1000
    pop, gdp = F.col("population_millions"), F.col("gdp_billions")
    return (
        grid.join(elec, ["state", "year"]).join(dim, "state")
        .select(
            "state", "state_abbr", "year",
            "cumulative_dc_mw", "cumulative_dc_count", "new_dc_mw", "new_dc_count",
            (F.col("cumulative_dc_energy_mwh") / 1e6).alias("cumulative_dc_energy_twh"),
            (F.col("new_dc_energy_mwh") / 1e6).alias("new_dc_energy_twh"),
            "cumulative_ai_count",
            or_zero(ratio("cumulative_ai_count", "cumulative_dc_count")).alias("ai_ratio"),
            "cumulative_dc_mw_lag1", "cumulative_dc_mw_lag2",
            (F.col("cumulative_dc_mw") - F.col("cumulative_dc_mw_lag1")).alias("dc_growth_mw"),
            (F.col("total_consumption_mwh") / 1000).alias("electricity_gwh"),
            (F.col("yoy_change_mwh") / 1000).alias("electricity_change_gwh"),
            or_zero("yoy_change_pct").alias("electricity_pct_change"),
            F.coalesce("population_millions", F.lit(default_population))
            .alias("population_millions"),
            F.coalesce("gdp_billions", F.lit(default_gdp)).alias("gdp_billions"),
        )
        .withColumns({
            "dc_share_of_state_pct": or_zero(
                ratio(F.col("cumulative_dc_energy_twh") * 1000, "electricity_gwh") * 100),
            "new_dc_share_of_change_pct": new_share_of_change(new_energy, change),
            "log_dc_mw": F.log1p("cumulative_dc_mw"),
            "log_elec_gwh": F.log1p("electricity_gwh"),
            "dc_per_million_pop": ratio("cumulative_dc_count", pop),
            "dc_mw_per_million_pop": ratio("cumulative_dc_mw", pop),
            "dc_per_billion_gdp": ratio("cumulative_dc_count", gdp),
            "elec_per_capita_mwh": ratio(F.col("electricity_gwh") * 1000, pop * 1e6),
            "dc_intensity": ratio("cumulative_dc_mw", gdp / 100),
        })
    )


def share_of_total(part: Column | str, total: Column | str) -> Column:
    """M7: within 0..1, 0 for an empty total."""
    return clip(or_zero(ratio(part, total)), 0, 1)


def new_share_of_change(new_energy: Column | str, change: Column | str,
                        smallest: float = 0.1, cap: float = 100.0) -> Column:
    """M8: percent of the absolute change; 0 for a tiny change."""
    size = F.abs(col(change))
    return F.when(size > smallest, F.least(ratio(new_energy, size) * 100, F.lit(cap))).otherwise(
        F.lit(0.0))


def attributed_impact(expected: Column | str, change: Column | str) -> Column:
    """M9: expected energy, at most the growth."""
    c = col(change)
    return F.when(c.isNotNull(), F.least(col(expected), F.greatest(c, F.lit(0.0))))


def attributed_share(expected: Column | str, change: Column | str) -> Column:
    """M9."""
    size = clip(F.abs(col(change)), low=1)
    return clip(ratio(expected, size), high=1)


def derived_ratios(df: DataFrame, change: str = "yoy_change_mwh", count: str = "num_dcs",
                   mw: str = "total_capacity_mw", previous: str = "prev_consumption") -> DataFrame:
    """M10."""
    return df.withColumns({
        "change_per_dc_mwh": ratio(change, count),
        "capacity_per_dc": ratio(mw, count),
        "impact_per_mw": ratio(change, mw),
        "normalized_change": ratio(change, previous),
    })


def per_capita(df: DataFrame, dim: DataFrame, state: str = "state",
               default_population: float = p.DEFAULT_POPULATION,
               default_gdp: float = p.DEFAULT_GDP) -> DataFrame:
    """Figures per million people and billion of GDP, with defaults for unknown states.

    ``df`` has cumulative_dc_count, cumulative_dc_mw, electricity_gwh.
    """
    joined = df.join(dim.select(state, "population_millions", "gdp_billions"), state, "left")
    pop = F.col("population_millions")
    gdp = F.col("gdp_billions")
    return joined.withColumns({
        "population_millions": F.coalesce(pop, F.lit(default_population)),
        "gdp_billions": F.coalesce(gdp, F.lit(default_gdp)),
    }).withColumns({
        "dc_per_million_pop": ratio("cumulative_dc_count", pop),
        "dc_mw_per_million_pop": ratio("cumulative_dc_mw", pop),
        "dc_per_billion_gdp": ratio("cumulative_dc_count", gdp),
        "elec_per_capita_mwh": ratio(F.col("electricity_gwh") * 1000, pop * 1e6),
        "dc_intensity": ratio("cumulative_dc_mw", gdp / 100),
    })


def first_difference(df: DataFrame, deltas: dict[str, str], group: str = "state",
                     year: str = "year") -> DataFrame:
    """Change against the row before; the first row of a group drops out."""
    w = W.partitionBy(group).orderBy(year)
    return (
        df.withColumn("_nth", F.row_number().over(w))
        .withColumns({out: F.col(c) - F.lag(c).over(w) for c, out in deltas.items()})
        .where(F.col("_nth") > 1)
        .drop("_nth")
    )


def cagr(df: DataFrame, measures: dict[str, float | None], year: str = "year") -> DataFrame:
    """Yearly growth in percent between the first and the last year.

    ``measures`` maps a column to the floor of its first value (None for no floor).
    """
    first_year, last_year = F.min(year), F.max(year)
    aggs = [first_year.alias("first_year"), last_year.alias("last_year")]
    for c in measures:
        aggs += [F.min_by(c, year).alias(f"_a_{c}"), F.max_by(c, year).alias(f"_b_{c}")]
    span = F.col("last_year") - F.col("first_year")
    out = []
    for c, floor in measures.items():
        a = F.col(f"_a_{c}").cast("double")
        a = F.greatest(a, F.lit(float(floor))) if floor is not None else a
        growth = F.pow(ratio(F.col(f"_b_{c}"), a), ratio(F.lit(1.0), span)) - 1
        out.append((growth * 100).alias(f"{c}_cagr_pct"))
    return df.agg(*aggs).select("first_year", "last_year", *out)


def time_and_log_features(df: DataFrame, logs: dict[str, str], base_year: int = 2019,
                          year: str = "year") -> DataFrame:
    """M14."""
    return df.withColumns({
        **{out: F.log1p(c) for c, out in logs.items()},
        "year_rel": F.col(year) - base_year,
    })


_FACILITY_GROWS = [
    "cumulative_dc_mw", "cumulative_dc_count", "cumulative_dc_energy_twh",
    "dc_mw_per_million_pop", "dc_intensity",
]


def project_forward(df: DataFrame, years: Sequence[int] = tuple(p.HORIZON_YEARS),
                    year: str = "year") -> DataFrame:
    """The last year's rows carried to each horizon year with fixed growth rates."""
    last = df.where(F.col(year) == df.agg(F.max(year)).scalar())
    ahead = F.col("_to") - F.col(year)
    rates = {
        **{c: p.FACILITY_YEARLY_GROWTH for c in _FACILITY_GROWS},
        "population_millions": p.POPULATION_YEARLY_GROWTH,
        "gdp_billions": p.GDP_YEARLY_GROWTH,
    }
    grown = {c: F.col(c) * F.pow(F.lit(r), ahead) for c, r in rates.items() if c in df.columns}
    return (
        last.withColumn("_to", F.explode(F.array(*[F.lit(y) for y in years])))
        .withColumns(grown)
        .withColumn(year, F.col("_to"))
        .drop("_to")
    )


def projection_summary(projected: DataFrame, baseline_gwh: Column,
                       predicted: str = "predicted_electricity_gwh") -> DataFrame:
    """M16 (and T4): total, population, per head, growth and top state of each year."""
    return (
        projected.groupBy("year")
        .agg(
            F.sum(predicted).alias("total_us_gwh"),
            F.sum("population_millions").alias("us_population_millions"),
            F.max_by("state", F.struct(F.col(predicted), F.col("state"))).alias("top_state"),
            F.max(predicted).alias("top_state_gwh"),
        )
        .withColumn("per_capita_mwh",
                    ratio("total_us_gwh", F.col("us_population_millions") * 1000))
        .withColumn("growth_pct", (ratio("total_us_gwh", baseline_gwh) - 1) * 100)
    )


def previous_year_consumption(requests: DataFrame, electricity: DataFrame,
                              fallback: Column, value: str = "total_consumption_mwh",
                              out: str = "prev_consumption") -> DataFrame:
    """Consumption of the state in the year before, else ``fallback`` (a scalar)."""
    prev = electricity.select(
        "state", (F.col("year") + 1).alias("year"), F.col(value).alias("_prev"))
    return (
        requests.join(prev, ["state", "year"], "left")
        .withColumn(out, F.coalesce(F.col("_prev"), fallback))
        .drop("_prev")
    )
