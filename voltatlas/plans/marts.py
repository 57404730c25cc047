"""Published marts (D1-D9): compositions of the operators, each one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import not_null, or_zero, published, ratio
from voltatlas.operators import aggregates as agg
from voltatlas.operators import classify, cleaning, energy, extraction, joins, panel
from voltatlas.sources import readers


def facility_listing(city_pages: DataFrame, spec_pages: DataFrame) -> DataFrame:
    """Listed facilities without copies, each with its specs.

    ``city_pages`` has path, content; ``spec_pages`` has path, dc, content. Page paths give
    the order in which the first listing and the last spec of a facility win.
    """
    listed = extraction.explode_listings(extraction.valid_pages(city_pages))
    unique = extraction.dedupe_listings(listed, ["path", "position"])
    specs = extraction.extract_capacity_and_year(spec_pages).select(
        F.col("dc").alias("dc_link"), "path", "capacity", "operational_date")
    with_specs = extraction.attach_specs(unique, specs, ["path"])
    return extraction.restore_missing_text(with_specs, ["capacity", "operational_date"]).select(
        "name", "company", "address", "postal", "city", "state", "country", "capacity",
        "operational_date")


def facility_specs(spec_pages: DataFrame) -> DataFrame:
    """Facility table of stored spec pages: valid pages, embedded data, one flat row each."""
    docs = extraction.embedded_json(extraction.valid_pages(spec_pages, spec_pages=True))
    return extraction.detail_record(docs)


def facility_categorized(specs: DataFrame, order: Sequence[Column | str],
                         category: Column | None = None, planned: Column | None = None,
                         cutoff: int = 2026) -> DataFrame:
    """Operational facilities with category, capacity and energy."""
    name, mw = "data_center_name", "capacity_mw"
    planned = classify.is_planned(name) if planned is None else planned
    kind = classify.classify_category(name, mw) if category is None else category
    typed = cleaning.coerce_numeric(specs, ["year_operational", mw])
    kept = cleaning.filter_operational(
        typed, planned, "data_center_id", "year_operational", order, cutoff)
    return (
        kept.withColumn("is_planned", F.lit(False))
        .withColumn("dc_category", kind)
        .withColumn("capacity_mw_est", energy.default_mw_by_category(mw, "dc_category"))
        .withColumn("estimated_energy_mwh",
                    energy.energy_by_category("capacity_mw_est", "dc_category"))
    )


def state_mart(by_state: DataFrame, dim: DataFrame | None = None) -> DataFrame:
    """D3 (basic): roll-up keyed by abbreviation, or by name for a state that has none."""
    keyed = cleaning.state_abbrev(by_state, out="abbrev", dim=dim, keep_unmapped=True)
    return keyed.select(
        "abbrev", F.col("state").alias("name"), "dc_count",
        published("total_capacity_mw", 1).alias("capacity_mw"),
        published("total_energy_mwh", 0).alias("energy_mwh"),
        published(F.col("total_energy_mwh") / 1e6, 2).alias("energy_twh"),
    )


def state_category_mart(categorized: DataFrame, electricity: DataFrame,
                        dim: DataFrame | None = None) -> DataFrame:
    """D3: with categories and the state's latest electricity; unmapped states drop out."""
    latest = cleaning.latest_period(electricity, keys=["state"]).select("state", "total_consumption_mwh")
    wide = agg.category_breakdown(categorized).join(latest, "state", "left")
    keyed = cleaning.state_abbrev(wide, out="abbrev", dim=dim)
    return keyed.where(F.col("abbrev").isNotNull()).select(
        "abbrev", F.col("state").alias("name"), "dc_count",
        published("capacity_mw", 1).alias("capacity_mw"),
        published("energy_mwh", 0).alias("energy_mwh"),
        published(F.col("energy_mwh") / 1e6, 2).alias("energy_twh"),
        "small_count", "decent_count", "crypto_count", F.col("big_ai_count").alias("ai_count"),
        published("crypto_energy_mwh", 0).alias("crypto_energy_mwh"),
        published("big_ai_energy_mwh", 0).alias("ai_energy_mwh"),
        published("total_consumption_mwh", 0).alias("state_total_mwh"),
    )


def facility_map(listings: DataFrame, categorized: DataFrame, order: Sequence[Column | str],
                 extra_keys: Sequence[str] = ()) -> DataFrame:
    """Every listed facility, with facts where its name is known."""
    facts = categorized.select(
        "data_center_name", *extra_keys,
        F.col("year_operational").cast("int").alias("year"),
        published("capacity_mw_est", 1).alias("capacity_mw"),
        published("estimated_energy_mwh", 0).alias("energy_mwh"),
        F.col("dc_category").alias("category"),
        F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order]).alias("_order"),
    )
    named = listings.select(*[
        F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in ("name", "state", "city")])
    return joins.enrich_by_name(
        named, facts, "name", "data_center_name", ["_order"],
        ["year", "capacity_mw", "energy_mwh", "category"], extra_keys=extra_keys,
    ).select("name", "state", "city", "year", "capacity_mw", "energy_mwh", "category",
             "has_energy_data")


def state_totals_upsert(mart: DataFrame, mapped: DataFrame,
                        dim: DataFrame | None = None) -> DataFrame:
    """Total and with-data counts of the map written into a state mart."""
    counts = agg.state_data_counts(mapped)
    keyed = cleaning.state_abbrev(counts, out="abbrev", dim=dim).withColumnRenamed("state", "name")
    return joins.upsert_totals(mart, keyed)


def opening_training_table(specs: DataFrame, electricity: DataFrame, kind: Column | None = None,
                           mode: str = "complete") -> DataFrame:
    """Electricity years of each state with openings and running totals."""
    imputed = energy.impute_group_median(specs, "capacity_mw")
    dc_type = classify.classify_facility_type(
        "data_center_name", "capacity_mw") if kind is None else kind
    est = imputed.withColumn("dc_type", dc_type).withColumn(
        "estimated_energy_mwh",
        energy.energy_by_type_and_vintage("capacity_mw_est", "dc_type", "year_operational"))
    return panel.attach_openings(electricity, panel.openings_by_year(est), mode)


def operator_openings(specs: DataFrame, kind: Column, year_estimate: Column) -> DataFrame:
    """Openings by state and year with operator class, defaults and energy."""
    full = (
        specs.withColumn("dc_type", kind)
        .withColumn("year_operational",
                    classify.fill_missing_year("year_operational", year_estimate))
        .withColumn("estimated_capacity_mw",
                    energy.default_mw_by_operator("capacity_mw", "dc_type"))
        .withColumn("estimated_energy_twh",
                    energy.energy_twh_by_operator("estimated_capacity_mw", "dc_type"))
    )
    return agg.state_year_operator(full).select(
        "state", F.col("year").cast("int").alias("year"),
        F.col("dc_count").alias("new_dc_count"), F.col("total_mw").alias("new_dc_mw"),
        (F.col("total_energy_twh") * 1e6).alias("new_dc_energy_mwh"),
        F.col("ai_dc_count").alias("new_ai_count"))


def state_year_features(specs: DataFrame, electricity: DataFrame, first: int = 2005,
                        last: int = 2023, dim: DataFrame | None = None,
                        kind: Column | None = None, year_estimate: Column | None = None,
                        top_states: int = 15) -> DataFrame:
    """D6."""
    kind = classify.classify_operator("data_center_name", "city") if kind is None else kind
    guess = classify.estimate_year(
        "data_center_name", "city", "state") if year_estimate is None else year_estimate
    grid = panel.state_year_panel(
        operator_openings(specs, kind, guess), electricity, first, last, dim)
    return classify.flag_top_groups(grid, "state", "cumulative_dc_count", top_states)


def region_panel(sales: DataFrame, facilities: DataFrame,
                 minimum: float = p.MIN_REGION_MWH, base_year: int = 2019) -> DataFrame:
    """Region-year electricity with cumulative facility features and shares.

    ``facilities`` has ba_code, year_built, capacity_mw, energy_mwh, category. Every year with
    sales has its running totals.
    """
    grid = cleaning.min_volume_filter(agg.region_sales(sales), "ba_code", "total_mwh", minimum)
    merged = panel.cumulative_at(grid, facilities).withColumn(
        "dc_energy_share", panel.share_of_total("total_energy_mwh", "total_mwh"))
    return panel.time_and_log_features(
        merged, {"total_mwh": "log_total_mwh", "total_capacity_mw": "log_capacity"}, base_year)


REGION_FEATURES = p.REGION_FEATURES


def top_regions(panel_df: DataFrame, k: int = 10) -> DataFrame:
    """Regions with the highest facility share in the last year."""
    last = cleaning.latest_period(panel_df, keys=["ba_code"])
    return joins.top_k(last, "dc_energy_share", k, "ba_code").select(
        "ba_code", "dc_count", F.col("total_capacity_mw").alias("capacity_mw"),
        (F.col("total_mwh") / 1e6).alias("electricity_twh"),
        (F.col("dc_energy_share") * 100).alias("dc_share_pct"),
        classify.concentration_band(F.col("dc_energy_share") * 100, 5, 2).alias("band"))


def region_snapshot(sales: DataFrame, facilities: DataFrame,
                    minimum: float = p.MIN_REGION_MWH) -> DataFrame:
    """One year of region electricity with facility features and a concentration band."""
    grid = agg.region_sales(sales, ["ba_code"])
    both = joins.left_zero_filled(
        grid, agg.region_facilities(facilities), ["ba_code"])
    return (
        cleaning.min_volume_filter(both, "ba_code", "total_mwh", minimum)
        .withColumn("dc_energy_share", panel.share_of_total("total_energy_mwh", "total_mwh"))
        .withColumn("log_sales", F.log1p("total_mwh"))
        .withColumn("log_capacity", F.log1p("total_capacity_mw"))
        .withColumn("band", classify.concentration_band(F.col("dc_energy_share") * 100))
    )


def primary_region_table(sales: DataFrame, facilities: DataFrame, dim: DataFrame | None = None,
                         mapping: dict[str, list[str]] | None = None,
                         mw: str = "capacity_mw") -> DataFrame:
    """D8 by state: sales, utilities and first states of each region next to its facilities.

    A facility counts for the primary region of its state, one of an unknown state for the default
    region, one without a state only by its MW. Facilities are summed up by state before the lookups.
    Regions with only sales or only facilities stay, with zeros and no states.
    """
    by_state = facilities.groupBy("state").agg(
        F.count("state").alias("dc_count"), F.sum(mw).alias("dc_capacity_mw"))
    placed = cleaning.primary_region(cleaning.state_abbrev(by_state, dim=dim), mapping=mapping)
    own = placed.groupBy("ba_code").agg(
        F.sum("dc_count").alias("dc_count"), F.sum("dc_capacity_mw").alias("dc_capacity_mw"))
    both = agg.region_sales_with_states(sales).join(own, "ba_code", "full")
    return both.withColumn("states", F.coalesce("states", F.lit(""))).withColumns({
        c: or_zero(c) for c in ("total_sales_mwh", "utility_count", "dc_count", "dc_capacity_mw")
    }).withColumn("mw_per_twh", ratio(F.col("dc_capacity_mw") * 1e6, "total_sales_mwh"))


GROWTH_FEATURES = [
    "new_dc_count", "new_dc_capacity_mw", "new_dc_energy_mwh", "cumulative_dc_capacity",
    "cumulative_dc_energy", "total_consumption_mwh"]


def category_growth_table(categorized: DataFrame, electricity: DataFrame,
                          category: str = "big_ai") -> DataFrame:
    """Training rows of a category's growth: openings and running totals by state and year.

    One row for each electricity year whose change against the year before is known. Gaps become 0
    before the running sums, so openings before a state's first electricity year do not count.
    """
    openings = panel.openings_by_year(categorized.where(F.col("dc_category") == category))
    rows = panel.attach_openings(electricity, openings, "zero_fill")
    return panel.yoy(rows, "total_consumption_mwh").where("yoy_change_mwh is not null").select(
        "state", "year", *GROWTH_FEATURES, "yoy_change_mwh")


def state_share(facilities: DataFrame, electricity: DataFrame) -> DataFrame:
    """Facility energy as a part of each state's latest electricity."""
    latest = cleaning.latest_period(electricity, keys=["state"]).select("state", "total_consumption_mwh")
    return joins.full_then_complete(latest, agg.state_rollup(facilities)).withColumn(
        "dc_pct_of_state", ratio("total_energy_mwh", "total_consumption_mwh") * 100)


def national_share(shares: DataFrame) -> DataFrame:
    """The national total of the table above."""
    return shares.agg(
        F.sum("dc_count").alias("dc_count"),
        F.sum("total_energy_mwh").alias("total_energy_mwh"),
        F.sum("total_consumption_mwh").alias("total_consumption_mwh"),
    ).withColumn("dc_pct", ratio("total_energy_mwh", "total_consumption_mwh") * 100)


def sales_sheets(sheets: dict[int, DataFrame | None]) -> DataFrame:
    """Yearly sheets with drifting headers to one sales table."""
    def one(df: DataFrame) -> DataFrame:
        named = readers.drop_non_data_rows(
            readers.rename_by_position(df, p.SALES_POSITIONS))
        numbers = [c for c in named.columns if c.endswith(("_mwh", "_customers", "_revenue"))]
        return cleaning.coerce_numeric(named, numbers)

    wide = readers.union_years({y: one(df) if df is not None else None
                                for y, df in sheets.items()})
    return wide.select(*[c for c in p.SALES_COLUMNS if c in wide.columns])


def unmatched_regions(facilities: DataFrame, sales: DataFrame,
                      region: str = "ba_code") -> DataFrame:
    """Regions of facilities that no sales row has, with the facilities concerned."""
    return (
        facilities.where(not_null(region))
        .join(sales.select(region).distinct(), region, "left_anti")
        .groupBy(region).agg(or_zero(F.count(F.lit(1))).alias("dc_count"))
    )
