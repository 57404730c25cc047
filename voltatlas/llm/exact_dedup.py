"""Exact duplicates by a two-pass Bloom filter.

Pass 1 marks, for every row, a few bit positions that follow from its text's hash, and keeps the
positions that at least two rows have marked. Pass 2 tests every row against these bits. A row
with an unmarked bit has a text of its own and passes straight through. Only rows whose bits are
all marked are grouped by their hash, which is exact, so false positives cost time and never a
result.

The filter is cut into blocks of 32,768 bits (one 4 KiB bitmap each); all bits of a row lie in
one block, so a test is one lookup. Its size follows the row count up to ``MAX_BLOCKS`` blocks.
That is the proven bound of what is broadcast (32 MiB). Above about 20 million rows the share of
false positives grows with the input, and with it the rows that are grouped; they carry an id
and a hash, not a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas.llm.tables import SPACE_CLASS, fresh, stored

BLOCK_BITS = 32_768  # of one bitmap of bitmap_construct_agg
BITS_PER_ROW = 12
MAX_BLOCKS = 8_192  # of 4 KiB each


def normalised(text: Column) -> Column:
    """The text with each run of whitespace as one space; NULL counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def text_hash(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def blocks_for(rows: int) -> int:
    """Blocks of the filter: a power of two for about ``BITS_PER_ROW`` bits a row, bounded."""
    wanted = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
    return min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), h), F.lit(blocks)).cast("int")


def _positions(h: Column) -> list[Column]:
    x = F.xxhash64(F.lit("bit"), h)
    return [F.pmod(F.shiftrightunsigned(x, s), F.lit(BLOCK_BITS)) for s in (0, 20)]


def repeat_filter(hashes: DataFrame, blocks: int, col: str = "h", least: int = 2) -> DataFrame:
    """Pass 1: ``block int, bits binary`` of the positions that ``least`` or more rows marked."""
    h = F.col(col)
    marks = hashes.select(
        _block(h, blocks).alias("block"), F.explode(F.array_distinct(F.array(*_positions(h)))).alias("pos"))
    return (
        marks.groupBy("block", "pos").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
        .groupBy("block").agg(F.bitmap_construct_agg("pos").alias("bits")))


def _bit(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.call_function("shiftright", byte, F.pmod(pos, F.lit(8)).cast("int")), F.lit(2)) == 1


def maybe_repeated(df: DataFrame, bloom: DataFrame, blocks: int, col: str, into: str) -> DataFrame:
    """Pass 2: adds the boolean ``into``; false proves that no other row has the hash."""
    h = F.col(col)
    at, block, bits = (fresh(df, f"__{c}") for c in ("at", "block", "bits"))
    marks = bloom.select(F.col("block").alias(block), F.col("bits").alias(bits))
    tested = df.withColumn(at, _block(h, blocks)).join(
        F.broadcast(marks), F.col(at) == F.col(block), "left")
    both = F.col(bits).isNotNull()
    for pos in _positions(h):
        both = both & _bit(F.col(bits), pos)
    return tested.withColumn(into, F.coalesce(both, F.lit(False))).drop(at, block, bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id, group_size, kept, text_sha256``.

    Equal normalised texts form a group; the row with the smallest id stays (NULL ids after all
    others). Of rows that share both the smallest id and the text, one stays. NULL texts are
    empty texts and form a group with them. An empty table gives an empty result. Other columns
    are not read.
    """
    hashes = stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
            text_hash(F.col(text_col)).alias("h")),
        "exact-hashes")
    blocks = blocks_for(hashes.count())
    bloom = stored(repeat_filter(hashes, blocks), "exact-filter")
    tested = maybe_repeated(hashes, bloom, blocks, "h", "maybe")
    # NULL ids sort last: the flag comes first in the struct.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    groups = stored(
        tested.filter("maybe").groupBy("h").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n >= 2").select(F.col("h").alias("gh"), "first", "n"),
        "exact-groups")
    alone = tested.filter("not maybe").select(
        F.col("id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "h")
    # The table of repeated groups is read from its folder: a hot hash can be split at run time.
    grouped = (
        tested.filter("maybe").join(groups, F.col("h") == F.col("gh"), "left")
        .select(
            "id",
            F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
            F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
            F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"), "h"))
    return alone.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("h")).alias("text_sha256"))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are.

    Rows that the filter proves unique go straight from the scan to the result. Of the others,
    hash and id are grouped; rows that are not the first of their group are dropped, and one of
    several rows with the same id and text stays.
    """
    h, maybe = fresh(docs, "__hash"), fresh(docs, "__maybe")
    hashed = docs.withColumn(h, text_hash(F.col(text_col)))
    ids = stored(
        hashed.select(F.col(id_col).alias("id"), F.col(h).alias("h")), "exact-hashes")
    blocks = blocks_for(ids.count())
    bloom = stored(repeat_filter(ids, blocks), "exact-filter")
    tested = maybe_repeated(hashed, bloom, blocks, h, maybe)
    group, keep = fresh(docs, "__group"), fresh(docs, "__keep")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    groups = stored(
        maybe_repeated(ids, bloom, blocks, "h", "maybe").filter("maybe")
        .groupBy("h").agg(first["id"].alias(keep), F.count(F.lit(1)).alias("n"))
        .filter("n >= 2").select(F.col("h").alias(group), keep),
        "exact-groups")
    alone = tested.filter(~F.col(maybe)).select(*docs.columns)
    firsts = (
        tested.filter(F.col(maybe)).join(groups, F.col(h) == F.col(group), "left")
        .filter(F.col(group).isNull() | F.col(id_col).eqNullSafe(F.col(keep))))
    return alone.unionByName(firsts.dropDuplicates([h]).select(*docs.columns))
