"""Keyword and threshold rules (C1-C12), as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import col, contains_any


def classify_category(name: Column | str, mw: Column | str,
                      crypto: Sequence[str] = p.CATEGORY_CRYPTO_KEYWORDS,
                      hyperscaler: Sequence[str] = p.CATEGORY_HYPERSCALER_KEYWORDS,
                      colo: Sequence[str] = p.CATEGORY_COLO_KEYWORDS,
                      whole_words: bool = False) -> Column:
    """Crypto by name first, then size or hyperscaler name, colo names only without size."""
    mw = col(mw)
    known = mw.isNotNull()
    is_hyper = contains_any(name, hyperscaler, whole_words)
    return (
        F.when(contains_any(name, crypto, whole_words), "crypto")
        .when((known & (mw >= 50)) | is_hyper, "big_ai")
        .when(known & (mw >= 10), "decent")
        .when(~known & contains_any(name, colo, whole_words), "decent")
        .otherwise("small")
    )


def classify_facility_type(name: Column | str, mw: Column | str,
                           hyperscale: Sequence[str] = p.TYPE_HYPERSCALE_KEYWORDS,
                           colo: Sequence[str] = p.TYPE_COLO_KEYWORDS) -> Column:
    """An unknown size counts as 0."""
    mw = F.coalesce(col(mw), F.lit(0.0))
    return (
        F.when(contains_any(name, hyperscale) | (mw >= 50), "hyperscale")
        .when(contains_any(name, colo), "colocation")
        .when(mw >= 10, "enterprise")
        .otherwise("default")
    )


def classify_operator(name: Column | str, city: Column | str,
                      crypto: Sequence[str] = p.OPERATOR_CRYPTO_KEYWORDS,
                      ai: Sequence[str] = p.OPERATOR_AI_KEYWORDS) -> Column:
    """Keywords are looked for in "name city"."""
    both = F.concat_ws(" ", F.coalesce(col(name), F.lit("")), F.coalesce(col(city), F.lit("")))
    return (
        F.when(contains_any(both, crypto), "crypto")
        .when(contains_any(both, ai), "ai")
        .otherwise("general")
    )


def is_planned(name: Column | str, keywords: Sequence[str] = p.PLANNED_KEYWORDS) -> Column:
    """C4."""
    return contains_any(name, keywords)


def _place_rules(rules: dict[str, dict[str, int]], state: Column, place_texts: Sequence[Column],
                 compat: bool) -> Column:
    """Year of the first matching place, in declared order, within the matching states."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for state_key, places in rules.items():
        in_state = F.contains(state, F.lit(state_key)) if compat else (state == state_key)
        for place, year in places.items():
            hit = F.lit(False)
            for t in place_texts:
                hit = hit | F.contains(t, F.lit(place))
            out = out.when(in_state & hit, year)
    return out


def estimate_year(name: Column | str, city: Column | str, state: Column | str,
                  compat: bool = False, year_rules=p.YEAR_RULES,
                  crypto_rules=p.CRYPTO_YEAR_RULES, boom_years=p.STATE_BOOM_YEARS,
                  crypto_default: int = p.CRYPTO_DEFAULT_YEAR,
                  fallback: int = p.FALLBACK_YEAR, operator: Column | None = None) -> Column:
    """Brand rules in order, then crypto rules and default, state boom year, fallback.

    States are normalised and compared for equality. ``compat`` keeps the original behaviour:
    blanks of the state turn into hyphens and state keys match as substrings, so two-word
    keys never match and 'virginia' also matches West Virginia.

    The rules are one expression, so no facility row is ever shuffled or multiplied.
    """
    n = F.lower(F.coalesce(col(name), F.lit("")))
    c = F.lower(F.coalesce(col(city), F.lit("")))
    s = F.lower(F.coalesce(col(state), F.lit("")))
    s = F.replace(s, F.lit(" "), F.lit("-")) if compat else F.replace(s, F.lit("-"), F.lit(" "))
    steps = [
        F.when(contains_any(name, words), _place_rules(rules, s, (c, n), compat))
        for _, words, rules in year_rules
    ]
    kind = operator if operator is not None else classify_operator(name, city)
    steps.append(F.when(
        kind == "crypto",
        F.coalesce(_place_rules(crypto_rules, s, (c, n), compat), F.lit(crypto_default))))
    boom = F.when(F.lit(False), F.lit(None).cast("int"))
    for key, year in boom_years.items():
        boom = boom.when(F.contains(s, F.lit(key)) if compat else (s == key), year)
    return F.coalesce(*steps, boom, F.lit(fallback))


def fill_missing_year(year: Column | str, estimate: Column) -> Column:
    """A year that is missing or 0 is replaced."""
    y = col(year)
    return F.when(y.isNull() | (y == 0), estimate).otherwise(y)


def estimate_year_from_peak_growth(df: DataFrame, electricity: DataFrame, state: str = "state",
                                   year: str = "year_operational", low: int = 1990,
                                   high: int = 2025, data_low: int = 2000,
                                   data_high: int = 2024) -> DataFrame:
    """Facilities without a valid year get the year of their state's fastest growth.

    The earliest year wins a tie. States without growth figures are dropped.
    """
    growth = electricity.where(
        F.col("year").between(data_low, data_high) & F.col("yoy_change_pct").isNotNull())
    peak = growth.groupBy(F.col("state").alias(state)).agg(
        F.max_by("year", F.struct("yoy_change_pct", -F.col("year"))).alias("estimated_year"))
    bad = df.where(F.col(year).isNull() | ~F.col(year).between(low, high))
    return bad.join(peak, state).withColumn("confidence", F.lit("low"))


def concentration_band(share_pct: Column | str, high: float = 10.0, medium: float = 5.0) -> Column:
    """C8."""
    s = col(share_pct)
    return F.when(s > high, "HIGH").when(s > medium, "MED").otherwise("LOW")


def benchmark_verdict(value: Column | str, reference: Column | str) -> Column:
    """C9."""
    v, r = col(value), col(reference)
    return F.when(v > r * 2, "HIGH").when(v < r * 0.3, "LOW").otherwise("reasonable")


def is_hyperscale(category: Column | str, mw: Column | str) -> Column:
    """Never NULL, so it can be counted."""
    return F.coalesce(col(category) == "big_ai", F.lit(False)) | F.coalesce(
        col(mw) >= 50, F.lit(False))


def flag_top_groups(df: DataFrame, group: str, measure: str, k: int = 15,
                    out: str = "is_high_dc_state") -> DataFrame:
    """C11: 1 if the group is among the k with the largest maximum (ties by name)."""
    top = (
        df.groupBy(group).agg(F.max(measure).alias("_m"))
        .orderBy(F.col("_m").desc(), F.col(group)).limit(k)
        .select(F.col(group).alias("_top"))
    )
    return (
        df.join(top, F.col(group) == F.col("_top"), "left")
        .withColumn(out, F.col("_top").isNotNull().cast("int"))
        .drop("_top")
    )


def interpret_fit(r2: Column | str) -> Column:
    """C12."""
    r = col(r2)
    return F.when(r > 0.5, "Strong").when(r > 0.2, "Moderate").otherwise("Weak")


def interpret_causal(r2: Column | str) -> Column:
    """C12."""
    return F.when(col(r2) > 0.05, "Detectable").otherwise("Weak")
