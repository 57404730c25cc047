"""Joins (J1-J9), ranking (T1-T6) and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voltatlas.functions.columns import col, or_zero
from voltatlas.operators.cleaning import drop_incomplete, first_per_key
from voltatlas.operators.energy import fill_zero


def inner_on(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("state", "year")) -> DataFrame:
    """J1. NULL keys match nothing."""
    return a.join(b, list(keys))


def left_zero_filled(a: DataFrame, b: DataFrame,
                     keys: Sequence[str] = ("ba_code", "year")) -> DataFrame:
    """Left join; missing numbers of either side become 0, text stays missing."""
    return fill_zero(a.join(b, list(keys), "left"))


def full_then_complete(a: DataFrame, b: DataFrame, key: str = "state") -> DataFrame:
    """Full outer join of which only complete rows stay."""
    return drop_incomplete(a.join(b, key, "full"))


def enrich_by_name(df: DataFrame, facts: DataFrame, name: str, fact_name: str,
                   order: Sequence[Column | str], columns: Sequence[str],
                   category: str = "category", default: str = "unknown",
                   extra_keys: Sequence[str] = ()) -> DataFrame:
    """Facts of the last record with the same name, a default category and a found flag.

    Names are unique on the fact side before the join, so no row is multiplied.
    ``extra_keys`` (for instance the state) narrows the match.
    """
    last = first_per_key(facts, [fact_name, *extra_keys], order, last=True).select(
        F.col(fact_name).alias("_name"),
        *[F.col(k).alias(f"_k_{k}") for k in extra_keys],
        *[F.col(c) for c in columns], F.lit(True).alias("_hit"))
    on = F.col(name) == F.col("_name")
    for k in extra_keys:
        on = on & (df[k] == F.col(f"_k_{k}"))
    return (
        df.join(last, on, "left")
        .withColumn("has_energy_data", F.col("_hit").isNotNull())
        .withColumn(category, F.when(F.col("_hit"), F.col(category)).otherwise(F.lit(default)))
        .drop("_name", "_hit", *[f"_k_{k}" for k in extra_keys])
    )


def add_group_count(df: DataFrame, rows: DataFrame, key: str, out: str) -> DataFrame:
    """Count of matching rows, 0 if there is none."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, key, "left").withColumn(out, or_zero(out))


def membership_flag(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """J8."""
    m = members.select(F.col(key).alias("_m")).distinct()
    return (
        df.join(m, F.col(key) == F.col("_m"), "left")
        .withColumn(out, F.col("_m").isNotNull().cast("int"))
        .drop("_m")
    )


def upsert_totals(mart: DataFrame, totals: DataFrame, key: str = "abbrev") -> DataFrame:
    """Totals written into a keyed mart.

    Known keys get new totals; unknown ones are added, with the counts at hand and 0 for the
    rest. ``totals`` has the key, name, total, with_data.
    """
    t = totals.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col("name").alias("_name"), "total", "with_data")
    zero = [c for c in mart.columns if c not in (key, "name", "dc_count")]
    return mart.join(t, F.col(key) == F.col("_key"), "full").select(
        F.coalesce(F.col(key), F.col("_key")).alias(key),
        F.coalesce(F.col("name"), F.col("_name")).alias("name"),
        F.when(F.col(key).isNull(), F.col("with_data")).otherwise(F.col("dc_count"))
        .alias("dc_count"),
        F.col("total").alias("total_dc_count"),
        F.col("with_data").alias("dc_with_data"),
        *[F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.col(c)).alias(c) for c in zero],
    )


def sort_rows(df: DataFrame, by: Sequence[Column | str], tie: Sequence[str]) -> DataFrame:
    """A tie-breaker makes the order total."""
    return df.orderBy(*[col(c) for c in by], *tie)


def top_k(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    """T2."""
    return df.orderBy(F.col(value).desc_nulls_last(), F.col(tie)).limit(k)


def top_k_within(df: DataFrame, group: str, value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The rank limit is also applied on each task before the shuffle."""
    w = W.partitionBy(group).orderBy(F.col(value).desc_nulls_last(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_state_per_year(df: DataFrame, value: str, year: str = "year",
                       state: str = "state") -> DataFrame:
    """T4: ties go to the first state by name."""
    w = W.partitionBy(year).orderBy(F.col(value).desc_nulls_last(), state)
    return (
        df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
        .select(year, F.col(state).alias("top_state"), F.col(value).alias("top_value"))
    )


def rank_importances(importances: DataFrame, k: int = 10,
                     value: str = "importance") -> DataFrame:
    """T5: the first k features with their rank and percent."""
    top = importances.orderBy(F.col(value).desc(), "feature").limit(k)
    w = W.partitionBy().orderBy(F.col(value).desc(), "feature")
    return top.select(F.row_number().over(w).alias("rank"), "feature",
                      F.round(F.col(value) * 100, 2).alias("importance_pct"))


def best_by_score(metrics: DataFrame, score: str, name: str = "model") -> DataFrame:
    """T6."""
    return metrics.agg(
        F.max_by(name, F.struct(F.col(score), F.col(name))).alias("best_model"),
        F.max(score).alias("best_score"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """By name, columns one side lacks are missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    """U2."""
    return df.select(*cols).distinct()
