"""Mixing sources to target weights by Sainte-Lague quotas of equal-token blocks.

1. Targets. Sources by code point (NULL last) weigh ``weights`` in turn and share ``share`` times
   all words. A source may give at most ``repeat`` times its words; what it cannot take is shared
   among the others by weight until no source is above its limit. Sorted by limit over weight,
   the sources at their limit are a prefix, so this has a closed form.
2. Quotas. The corpus is dealt by a hash of the id into shards of about ``SHARD_WORDS`` words. In
   each shard, blocks of ``BLOCK_WORDS`` words (the last one of a source may be shorter) are
   allocated to the sources by the highest quotients votes / (2 seats + 1). A source's votes are
   its blocks of the shard times target over size: what it should give. A shard has a row for
   each source at most, whatever the size of the sources.
3. Selection. A source's documents of a shard, in seeded order, are cut into blocks. A quota of q
   out of n blocks takes each block floor(q / n) times and q mod n blocks once more, spread evenly
   from a seeded start. A document's taken words are those of its parts of the selected blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltatlas.llm.tables import SPACE_CLASS, fresh, stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEAT = 2
BLOCK_WORDS = 16
SHARD_WORDS = 32_768
SEED = "mix-1"
VOTE_UNITS = 1_024  # votes are whole numbers of 1/1024 block, so that sums are exact


def word_count(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009 to U+000D; NULL has none."""
    return F.coalesce(
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
) -> DataFrame:
    """``source, source_size`` -> with ``source_no, target double``; one row per source.

    The sources of a corpus are a dimension: the running sums see one row for each of them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(
        (F.col("source_size") * repeat / F.col("weight")).asc(), F.col("source_no"))
    everyone = Window.partitionBy()
    turn = F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int")
    ranked = (
        sizes.withColumn("source_no", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1))
        .withColumn("limit_words", F.col("source_size") * repeat)
        .withColumn("all_words", F.sum("source_size").over(everyone))
        .withColumn("all_weight", F.sum("weight").over(everyone)))
    # Words for one unit of weight if exactly the sources before this one are at their limit.
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        (F.col("all_words") * F.lit(float(share)) - F.coalesce(F.sum("limit_words").over(before), F.lit(0)))
        / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    fits = F.col("level") <= F.col("limit_words") / F.col("weight")
    # Only the first level that fits counts: beyond it, the sources before have more than the share.
    first = F.min(F.when(fits, F.struct("place", "level"))).over(everyone)
    return (
        ranked.withColumn("place", F.row_number().over(by_limit))
        .withColumn("level", level).withColumn("level", first["level"])
        .select(
            "source", "source_no", "source_size",
            F.least(
                F.col("limit_words").cast("double"),
                F.coalesce(F.col("level") * F.col("weight"), F.col("limit_words").cast("double")),
            ).alias("target")))


def shard_quotas(cells: DataFrame, block: int = BLOCK_WORDS, repeat: int = REPEAT) -> DataFrame:
    """Sainte-Lague within each shard: ``shard, source_no, votes, cell_size`` -> ``quota``.

    Equal to awarding the shard's blocks one by one to the highest quotient votes / (2 seats + 1),
    the smaller source number winning ties. With n sources and V votes, a source's seats differ
    from its share v of the blocks by at most 1/2 + v / V * (n + 1) / 2, so only the quotients in
    that band are ranked: in all at most a few for each source.
    """
    shard = Window.partitionBy("shard")
    slack = (F.col("v") / F.col("all_votes")) * (F.col("n") + 1) / 2 + 2
    exact = F.col("v") / F.lit(VOTE_UNITS)
    banded = (
        cells.withColumn("v", F.col("votes"))
        .withColumn("all_votes", F.sum("v").over(shard))
        .withColumn("n", F.count(F.lit(1)).over(shard))
        .withColumn("seats", F.floor(F.col("all_votes") / F.lit(VOTE_UNITS) + 0.5))
        .withColumn("low", F.when(F.col("v") > 0, F.greatest(
            F.lit(0), F.floor(exact - slack))).otherwise(F.lit(0)).cast("long"))
        .withColumn("high", F.when(F.col("v") > 0, F.ceil(exact + slack)).otherwise(F.lit(-1)).cast("long"))
        .withColumn("left", F.col("seats") - F.sum("low").over(shard)))
    candidates = banded.filter("high >= low").select(
        "shard", "source_no", "v", "left", F.explode(F.sequence("low", "high")).alias("seat"))
    best = Window.partitionBy("shard").orderBy(
        (F.col("v") / (2 * F.col("seat") + 1)).desc(), "source_no", "seat")
    won = (
        candidates.withColumn("rank", F.row_number().over(best)).filter("rank <= left")
        .groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("more")))
    most = F.ceil(F.col("cell_size") / F.lit(block)) * repeat
    return (
        banded.join(won, ["shard", "source_no"], "left")
        .select(
            "shard", "source_no", "cell_size",
            F.least(F.col("low") + F.coalesce("more", F.lit(0)), most).cast("long").alias("quota")))


def _taken_up_to(x: Column, picked: Column, blocks: Column, start: Column, block: int) -> Column:
    """Words of the once-more blocks among the first ``x`` words of a cell.

    Block j is picked if floor((j + start) * picked / blocks) steps up at j; the count of picked
    blocks before j is then a difference of two floors.
    """
    def upto(j):
        return F.floor(((j + start) * picked) / blocks) - F.floor((start * picked) / blocks)

    j = F.floor(x / F.lit(block))
    return upto(j) * block + F.pmod(x, F.lit(block)) * (upto(j + 1) - upto(j))


def hash_number(value: Column, seed: str) -> Column:
    """The first 52 bits of the MD5 of ``seed:value``, as bigint."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT,
    seed: str = SEED, shard_words: int = SHARD_WORDS, block: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size, source_size, target, taken``.

    ``taken`` counts words with repeats, between 0 and ``repeat`` times the size. Reruns agree:
    orders and starts come from hashes of the id and the seed. A NULL text has size 0 and takes
    nothing; a NULL source is a source of its own, the last one; NULL ids are allowed. Rows with
    the same id, source and size lie next to each other and share the words taken from their
    place in the order. An empty table gives an empty result. Other columns are not read.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            hash_number(F.col(id_col), seed).alias("draw")),
        "mix-sizes")
    # A source's sum is taken over partial sums: a hot source sends one row for each task.
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(totals, weights, share, repeat), "mix-targets")
    all_words = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    shards = max(1, -(-all_words // shard_words))
    named = targets.select(
        F.col("source").alias("name"), "source_no", "source_size", "target")
    dealt = sized.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
        "id", "size", "draw", "source_no", "source_size", "target",
        F.pmod(F.col("draw"), F.lit(shards)).alias("shard"))
    cells = dealt.groupBy("shard", "source_no", "source_size", "target").agg(
        F.sum("size").alias("cell_size")).withColumn("votes", F.when(
            F.col("source_size") > 0,
            F.floor(F.col("target") * F.ceil(F.col("cell_size") / F.lit(block)) / F.col("source_size")
                    * VOTE_UNITS))
            .otherwise(F.lit(0)).cast("long"))
    quotas = shard_quotas(cells, block, repeat).select(
        F.col("shard").alias("q_shard"), F.col("source_no").alias("q_source"), "cell_size", "quota")
    order = Window.partitionBy("shard", "source_no").orderBy("draw", "id", "size")
    placed = dealt.withColumn("ends", F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(
        quotas, (F.col("shard") == F.col("q_shard")) & (F.col("source_no") == F.col("q_source")))
    n = F.greatest(F.ceil(F.col("cell_size") / F.lit(block)), F.lit(1))
    start = F.pmod(hash_number(F.concat_ws("/", "shard", "source_no"), seed), n)
    whole, once = F.floor(F.col("quota") / n), F.pmod(F.col("quota"), n)
    taken = whole * F.col("size") + _taken_up_to(F.col("ends"), once, n, start, block) - _taken_up_to(
        F.col("ends") - F.col("size"), once, n, start, block)
    return joined.select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    A row is emitted floor(taken / size) times, and once more with the probability of the rest,
    drawn from a hash of its id, so that a source's words stay near its target. Rows without
    words stay once: they weigh nothing. Rows with the same id are taken alike. The texts move once,
    to meet their counts, in a merge join at every size: the counts grow with the documents.
    """
    key, times, copy = (fresh(docs, f"__{c}") for c in ("key", "times", "copy"))
    shares = mix(docs, id_col, text_col, source_col, seed=seed)
    draw = F.pmod(hash_number(F.col(key), f"{seed}:copies"), F.lit(1_000_000)) / 1_000_000.0
    counts = stored(
        shares.groupBy(F.col(id_col).alias(key)).agg(
            F.sum("size").alias("s"), F.sum("taken").alias("t"))
        .select(key, F.when(F.col("s") == 0, F.lit(1)).otherwise(
            F.floor(F.col("t") / F.col("s") + draw)).cast("int").alias(times))
        .filter(F.col(times) > 0), "mix-times")
    out = docs.join(counts.hint("merge"), F.col(id_col).eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
