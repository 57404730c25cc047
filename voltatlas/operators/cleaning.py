"""Typed coercion, filters, lookups and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voltatlas import params as p
from voltatlas.functions.columns import (
    col, dtype_of, finite, inline_table, not_null, strip, text_to_number,
)
from voltatlas.functions.dimensions import county_dim, region_state_dim, state_dim


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text that is no number, NaN and infinities become NULL."""
    return df.withColumns(
        {
            c: text_to_number(c) if dtype_of(df, c) == "string" else finite(c)
            for c in cols
        }
    )


def state_abbrev(df: DataFrame, state: str = "state", out: str = "state_abbrev",
                 dim: DataFrame | None = None, keep_unmapped: bool = False) -> DataFrame:
    """Two letters are upper-cased, full names are looked up, the rest is NULL.

    ``dim`` (state, abbrev) replaces the built-in states; only the built-in one is broadcast
    by hint. With ``keep_unmapped`` the original text stands in for a missing match.
    """
    names = dim if dim is not None else F.broadcast(state_dim(df.sparkSession))
    names = names.select(F.col("state").alias("_state_name"), F.col("abbrev").alias("_abbrev"))
    s = strip(state)
    matched = F.when(F.length(s) == 2, F.upper(s)).otherwise(F.col("_abbrev"))
    out_col = F.coalesce(matched, s) if keep_unmapped else matched
    return (
        df.join(names, s == F.col("_state_name"), "left")
        .withColumn(out, out_col)
        .drop("_state_name", "_abbrev")
    )


def assign_region(df: DataFrame, abbrev: str = "state_abbrev", out: str = "ba_code",
                  mapping: dict[str, str] | None = None,
                  default: str = p.OTHER_REGION) -> DataFrame:
    """Region of a state, with a default for states that have none."""
    rows = list((mapping or p.STATE_REGION).items())
    dim = F.broadcast(inline_table(df.sparkSession, "_abbrev string, _region string", rows))
    return (
        df.join(dim, F.col(abbrev) == F.col("_abbrev"), "left")
        .withColumn(out, F.coalesce("_region", F.lit(default)))
        .drop("_abbrev", "_region")
    )


def primary_region(df: DataFrame, abbrev: str = "state_abbrev", out: str = "ba_code",
                   mapping: dict[str, list[str]] | None = None,
                   default: str = p.OTHER_REGION) -> DataFrame:
    """The first declared region among those that serve a state."""
    first = (
        region_state_dim(df.sparkSession, mapping)
        .select("ordinal", "ba_code", F.explode("states").alias("_abbrev"))
        .groupBy("_abbrev")
        .agg(F.min_by("ba_code", "ordinal").alias("_region"))
    )
    return (
        df.join(F.broadcast(first), F.col(abbrev) == F.col("_abbrev"), "left")
        .withColumn(out, F.coalesce("_region", F.lit(default)))
        .drop("_abbrev", "_region")
    )


def city_to_county(df: DataFrame, city: str = "city", state: str = "state", out: str = "county",
                   mapping: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """P5: exact match of the normalised (city, state) pair, else NULL."""
    dim = F.broadcast(county_dim(df.sparkSession, mapping).withColumnRenamed("county", "_county"))
    on = (F.lower(strip(city)) == F.col("city_key")) & (
        F.upper(strip(state)) == F.col("state_key"))
    return df.join(dim, on, "left").withColumn(out, F.col("_county")).drop(
        "city_key", "state_key", "_county")


def filter_valid_years(df: DataFrame, year: str, low: int = 1990, high: int = 2025) -> DataFrame:
    """P6."""
    return df.where(F.col(year).between(low, high))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                  last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in an explicit order.

    An aggregate, not a window: copies of one key are combined before the shuffle, so a key
    that holds a large part of all rows costs no more than any other. NULL keys are one key.
    Every column of ``df`` travels with its row, so select the needed ones first.
    """
    pick = F.max_by if last else F.min_by
    others = [c for c in df.columns if c not in keys]
    rank = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)])
    if not others:
        return df.distinct()
    best = df.groupBy(*keys).agg(pick(F.struct(*others), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def dedupe_by_id(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """P8."""
    return first_per_key(df, [key], order)


def operational_flags(planned: Column, year: Column | str, cutoff: int) -> list[tuple[str, Column]]:
    """The filter steps in order, each with the condition for keeping a row."""
    y = col(year)
    return [
        ("planned", ~planned),
        ("no_year", y.isNotNull()),
        ("future", y <= cutoff),
    ]


def filter_operational(df: DataFrame, planned: Column, key: str, year: str,
                       order: Sequence[Column | str], cutoff: int = 2026) -> DataFrame:
    """Not planned, year known, one row per id, opened by the cutoff year.

    The first copy of an id is chosen before the cutoff test, so a future first copy drops
    the id; an order in the data decides, as in the original sequence of filters.
    """
    steps = dict(operational_flags(planned, year, cutoff))
    kept = df.where(steps["planned"]).where(steps["no_year"])
    return first_per_key(kept, [key], order).where(steps["future"])


def filter_funnel(df: DataFrame, planned: Column, key: str, year: str,
                  order: Sequence[Column | str], cutoff: int = 2026) -> DataFrame:
    """Rows removed by each filter step.

    Copies are first reduced to counts per id next to the year of the first kept copy, so the
    totals need one shuffle on the id and one tiny one.
    """
    y = F.col(year)
    is_planned = F.coalesce(planned, F.lit(False))
    stays = ~is_planned & y.isNotNull()
    rank = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)])
    per_id = df.groupBy(F.col(key).alias("_id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_planned).alias("planned"),
        F.count_if(~is_planned & y.isNull()).alias("no_year"),
        F.count_if(stays).alias("candidates"),
        F.min_by(F.when(stays, y), F.when(stays, rank)).alias("first_year"),
    )
    has = (F.col("candidates") > 0).cast("long")
    future = ((F.col("candidates") > 0) & (F.col("first_year") > cutoff)).cast("long")
    t = per_id.agg(
        F.sum("n").alias("total"),
        F.sum("planned").alias("planned"),
        F.sum("no_year").alias("no_year"),
        F.sum(F.col("candidates") - has).alias("duplicate"),
        F.sum(future).alias("future"),
    )
    kept = F.expr("total - planned - no_year - duplicate - future")
    return t.select(
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), c.alias("n_rows"))
            for i, (n, c) in enumerate([
                ("total", F.col("total")), ("planned", F.col("planned")),
                ("no_year", F.col("no_year")), ("duplicate", F.col("duplicate")),
                ("future", F.col("future")), ("kept", kept)])
        ])).alias("s")
    ).select("s.*")


def positive_change_only(df: DataFrame, change: str) -> DataFrame:
    """P10."""
    return df.where(F.col(change) > 0)


def within(df: DataFrame, c: str, low: float | None = None, high: float | None = None,
           absolute: bool = False) -> DataFrame:
    """P10: open-interval outlier mask, on the value or its magnitude."""
    v = F.abs(F.col(c)) if absolute else F.col(c)
    out = df
    if low is not None:
        out = out.where(v > low)
    if high is not None:
        out = out.where(v < high)
    return out


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities count as missing."""
    cols = list(subset or df.columns)
    types = dict(df.dtypes)
    fixed = {c: finite(c) for c in cols if types[c] in ("double", "float")}
    return df.withColumns(fixed).na.drop(subset=cols) if fixed else df.na.drop(subset=cols)


def min_volume_filter(df: DataFrame, region: str = "ba_code", total: str = "total_mwh",
                      minimum: float = p.MIN_REGION_MWH) -> DataFrame:
    """P12."""
    return df.where((F.col(region) != "") & (F.col(total) > minimum))


def latest_period(df: DataFrame, year: str = "year", keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the last year.

    With ``keys`` that name a row together with the year, ``df`` is read once: each key's last row
    is an aggregate, and the last year of all is found among these (one row a key, so keys are
    states or regions). Without keys the maximum is a scalar subquery, a second read.
    """
    if not keys:
        return df.where(F.col(year) == df.agg(F.max(year)).scalar())
    last = (
        df.where(F.col(year).isNotNull()).groupBy(*keys)
        .agg(F.max_by(F.struct(*df.columns), year).alias("_row"), F.max(year).alias("_own"))
        .withColumn("_all", F.max("_own").over(W.partitionBy())))
    return last.where(F.col("_own") == F.col("_all")).select("_row.*")


def find_column(df: DataFrame, patterns: Sequence[str]) -> str | None:
    """First column, in table order, whose name contains a pattern."""
    return next((c for c in df.columns if any(x in c.lower() for x in patterns)), None)


def select_available(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns the table has, in wanted order."""
    return [c for c in wanted if c in set(df.columns)]


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """Non-null count, distinct count and up to three sample values of each column.

    Samples are the smallest values as text, so the answer does not depend on row order. The
    table is unpivoted and reduced to value counts before anything is gathered; the top-k
    per column is a row_number limit, which Spark also applies ahead of the shuffle.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"))
        for c in df.columns]))
    values = df.select(pairs.alias("x")).select("x.*").groupBy("column_name", "v").agg(
        F.count(F.lit(1)).alias("n"))
    counts = values.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("n_distinct"),
    )
    first = (
        values.where(F.col("v").isNotNull())
        .withColumn("r", F.row_number().over(W.partitionBy("column_name").orderBy("v")))
        .where(F.col("r") <= samples)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list("v")).alias("samples"))
    )
    return counts.join(first, "column_name", "left")


def complete_rows(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(not_null(*cols))
