"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voltatlas.functions.columns import finite, not_null
from voltatlas.session import stored

# Lowest bit that each step finds of a rank's place: a window has at most 2**22 rows.
_STEPS = (44, 22, 0)


def ordered_bits(v: Column) -> Column:
    """A bigint in the order of finite doubles: exponent and mantissa, negative below zero.

    Scaling by a power of two is exact, so different doubles have different numbers.
    """
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    # The logarithm may be off by one next to a power of two.
    e = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(
        F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    e = F.least(F.greatest(e, F.lit(-1022)), F.lit(1023)).cast("long")
    # Two factors, as 2**1074 is no double.
    scaled = a * F.pow(F.lit(2.0), -e) * F.lit(2.0**52)
    normal = (e + 1022) * F.lit(1 << 52) + scaled.cast("long")
    return F.when(v == 0, F.lit(0).cast("long")).when(v < 0, -normal).otherwise(normal)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), written: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles (the pandas definition) of ``value`` for each group.

    Values are counted by group and value, then each wanted rank is found by its place in an
    order-preserving number, some 20 bits at a time: counts by the leading bits tell which part of
    the group holds the rank, and only that part is counted by the next bits. So no task sorts
    more than 4 million counts of a group, whatever the values are, and there is one way for
    every size. All is lazy, unless ``written``: then ``df`` is read once, now; the counts are written
    to the shared folder for all steps, and so is what each step has found (two rows for each group
    and quantile), which keeps the plan of each step short.

    Rows with a missing value or key are left out. Without ``by`` the result has one row.
    """
    keep = stored if written else (lambda frame, name: frame)
    keys = list(by)
    base = df.select(*keys, finite(value).cast("double").alias("_v")).where(not_null("_v", *keys))
    counts = keep(
        base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_bits", ordered_bits(F.col("_v"))), "quantile-counts")

    def place(name: str) -> Column:
        return (F.col("_n") - 1) * F.lit(float(probs[name]))

    # Two ranks for each quantile.
    wanted = F.array(*[
        F.struct(F.lit(f"{side}{i}").alias("name"), (edge(place(name)).cast("long") + 1).alias("rank"))
        for i, name in enumerate(probs)
        for side, edge in (("lo", F.floor), ("hi", F.ceil))
    ])
    ranks = None  # _part is what is known of a rank's place so far
    for before, shift in zip((None, *_STEPS), _STEPS):
        placed = counts.withColumn("_next", F.shiftright("_bits", shift))
        within = [*keys] if ranks is None else [*keys, "_part"]
        if ranks is not None:
            placed = placed.withColumn("_part", F.shiftright("_bits", before)).join(
                ranks.select(*within).distinct(), within, "left_semi")
        steps = placed.groupBy(*within, "_next").agg(F.sum("_c").alias("_m"), F.max("_v").alias("_v"))
        steps = steps.withColumn("_upto", F.sum("_m").over(
            W.partitionBy(*within).orderBy("_next").rowsBetween(W.unboundedPreceding, W.currentRow)))
        if ranks is None:
            both = steps.withColumn("_n", F.sum("_m").over(W.partitionBy(*keys))).withColumn(
                "_w", F.explode(wanted)).select(
                "*", F.col("_w.name").alias("_name"), F.col("_w.rank").alias("_rank"))
        else:
            both = steps.join(ranks, within)
        hit = (F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_m"))
        ranks = keep(both.where(hit).select(
            *keys, "_n", "_name", (F.col("_rank") - F.col("_upto") + F.col("_m")).alias("_rank"),
            F.col("_next").alias("_part"), *(["_v"] if shift == 0 else [])), "quantile-ranks")
    wide = ranks.groupBy(*keys).agg(
        F.max("_n").alias("_n"),
        *[F.max(F.when(F.col("_name") == f"{s}{i}", F.col("_v"))).alias(f"_{s}{i}")
          for i in range(len(probs)) for s in ("lo", "hi")])
    out = []
    for i, name in enumerate(probs):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * (place(name) - F.floor(place(name)))).alias(name))
    return wide.select(*keys, *out)


def medians_by(df: DataFrame, value: str, groupings: dict[str, str | None]) -> DataFrame:
    """``grouping, key, median`` for several groupings of one table, from one read of it.

    ``groupings`` maps a name to the column whose values, as text, are its keys; None puts all rows
    into one group, whose key is empty. Every grouping is counted before the shuffle.
    """
    each = F.array(*[
        F.struct(F.lit(name).alias("grouping"),
                 (F.lit("") if c is None else F.col(c).cast("string")).alias("key"))
        for name, c in groupings.items()])
    long = df.select(F.col(value).alias("_value"), F.explode(each).alias("_at"))
    return exact_median(long.select("_value", "_at.grouping", "_at.key"), "_value", ["grouping", "key"], written=True)


def exact_median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median", written: bool = False):
    return exact_quantiles(df, value, {name: 0.5}, by, written)
