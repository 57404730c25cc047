"""Documents drawn by importance weights towards the word n-grams of a target table.

Features are runs of one to three consecutive words of a text, hashed into buckets by CRC-32. A
bucket's gain is the log ratio of its smoothed shares in the target and in the documents, and a
document's weight the sum of its features' gains. With a seeded Gumbel draw added, the highest
scores are a sample without replacement in proportion to the weights.

Newlines cut the texts into lines. For the counts, each distinct line of the table is featurised
once and its counts are multiplied by its occurrences; equal lines are counted before they move, so
a hot line is one row of each task. Features that cross a line break need only the first and last
two words of each line and are counted separately. For the weights, each distinct line of a batch
is featurised once.

An n-gram's CRC follows from those of its words, as appending bytes to a text is a linear map of
its CRC (``shifted``): strings of n-grams are never built, and all words of a batch go at once.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import row_struct, stored, with_row

BUCKETS = 10_000
MIN_WORDS = 20
SHARE_PERCENT = 5
SEED = 42
UNIT = 1_000  # gains and draws are whole thousandths
SLICE_BYTES = 1 << 20  # lines handled together; a longer line is handled alone
_SHORT = 32  # words up to this many bytes go through the loop over byte positions
_POLYNOMIAL = 0xEDB88320


# -- CRC-32 of words and of their sequences -------------------------------------------------
@functools.cache
def _byte_steps() -> np.ndarray:
    """The CRC register after each byte value from a register of 0."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(_POLYNOMIAL), c >> 1)
    return c


def _zero_byte(c: np.ndarray) -> np.ndarray:
    return _byte_steps()[c & 255] ^ (c >> 8)


@functools.lru_cache(maxsize=256)
def _zero_bytes(n: int) -> np.ndarray:
    """The map of a register by ``n`` zero bytes, as tables of its four bytes."""
    tables = (np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    power, done = [], n
    while done:  # n = sum of powers of two; squares of the one-byte map
        power.append(done & 1)
        done >>= 1
    square = _zero_byte(tables)
    for bit in power:
        if bit:
            tables = _through(square, tables)
        square = _through(square, square)
    return tables


def _through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


@functools.cache
def _short_tables() -> np.ndarray:
    return np.stack([_zero_bytes(n) for n in range(_SHORT + 1)])


def shifted(c: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What a text's CRC adds to the CRC of that text followed by ``sizes`` bytes."""
    t, n = _short_tables(), np.minimum(sizes, _SHORT)
    out = t[n, 0, c & 255] ^ t[n, 1, (c >> 8) & 255] ^ t[n, 2, (c >> 16) & 255] ^ t[n, 3, c >> 24]
    for size in np.unique(sizes[sizes > _SHORT]):
        at = sizes == size
        out[at] = _through(_zero_bytes(int(size)), c[at])
    return out


def _then_space(c: np.ndarray) -> np.ndarray:
    raw = c ^ np.uint32(0xFFFFFFFF)
    return _byte_steps()[(raw ^ 32) & 255] ^ (raw >> 8) ^ np.uint32(0xFFFFFFFF)


def _word_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


_IS_WORD = _word_table()


def words_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and size of every word of the lines, and each line's first word (one more at the end).

    Words are runs of bytes 0-9, a-z and from 0x80; A-Z are lower-cased.
    """
    data = np.frombuffer(b"\n".join(lines).lower() + b"\n", dtype=np.uint8)
    ends_of_lines = np.cumsum([len(x) + 1 for x in lines])
    inside = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, sizes = edges[0::2], edges[1::2] - edges[0::2]
    order = np.argsort(-np.minimum(sizes, _SHORT + 1), kind="stable")
    crc = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    short = order[np.searchsorted(-sizes[order].clip(max=_SHORT + 1), -_SHORT):]
    at, left, steps = starts[short], sizes[short], _byte_steps()
    reg = crc[short]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, side="left"))  # words of more than k bytes
        c = reg[:n]
        reg[:n] = steps[(c ^ data[at[:n] + k]) & 255] ^ (c >> 8)
    crc[short] = reg ^ np.uint32(0xFFFFFFFF)
    for i in order[:len(order) - len(short)]:
        crc[i] = zlib.crc32(data[starts[i]:starts[i] + sizes[i]].tobytes())
    return crc, sizes, np.concatenate(([0], np.searchsorted(starts, ends_of_lines)))


def n_gram_buckets(crc: np.ndarray, sizes: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Buckets of all runs of one, two and three words; run ``i`` of each begins at word ``i``."""
    out = [crc % np.uint32(buckets)]
    c = crc
    for n in (1, 2):
        if len(crc) <= n:
            out.append(np.empty(0, np.uint32))
            continue
        c = shifted(_then_space(c[:-1]), sizes[n:]) ^ crc[n:]
        out.append(c % np.uint32(buckets))
    return out


def inner_features(first: np.ndarray, grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(line, bucket) of every feature that lies within one line."""
    line = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lines, buckets = [line], [grams[0]]
    for n in (1, 2):
        whole = line[:-n] == line[n:] if len(line) > n else np.empty(0, bool)
        lines.append(line[:len(whole)][whole])
        buckets.append(grams[n][whole])
    return np.concatenate(lines), np.concatenate(buckets)


def crossing_features(
    used: np.ndarray, owner: np.ndarray, crc: np.ndarray, sizes: np.ndarray, first: np.ndarray, buckets: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of the features that cross a line break.

    ``used`` are the lines of the texts in order, as numbers of distinct lines, and ``owner`` the
    text of each. The first and last two words of a line are all that such a feature can hold.
    """
    n = first[used + 1] - first[used]
    used, owner, n = used[n > 0], owner[n > 0], n[n > 0]
    kept = np.minimum(n, 4)
    place = np.repeat(np.arange(len(used)), kept)
    k = np.arange(len(place)) - np.repeat(np.cumsum(kept) - kept, kept)
    k = np.where((k >= 2) & (n[place] > 4), n[place] - 4 + k, k)
    word = first[used][place] + k
    grams = n_gram_buckets(crc[word], sizes[word], buckets)
    text, owners, found = owner[place], [], []
    for m in (1, 2):
        if len(word) <= m:
            continue
        across = (text[:-m] == text[m:]) & (place[:-m] != place[m:])
        owners.append(text[:-m][across])
        found.append(grams[m][across])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    return np.concatenate(owners), np.concatenate(found)


def _distinct_lines(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct lines of the texts, and for all lines in order their number and their text."""
    known: dict[str, int] = {}
    used, counts = [], []
    for text in texts:
        lines = (text or "").split("\n")
        counts.append(len(lines))
        used += [known.setdefault(x, len(known)) for x in lines]
    return [x.encode() for x in known], np.array(used, np.int64), np.repeat(np.arange(len(texts)), counts)


def _slices(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes together; a larger row is alone."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, end
        start = end


def _text_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    sizes = np.array(pc.fill_null(pc.binary_length(batch.column("text")), 0))
    for start, end in _slices(sizes):
        part = batch.slice(start, end - start)
        yield part, part.column("text").to_pylist()


# -- counts ---------------------------------------------------------------------------------
_COUNTS = "bucket int, n long"


def _counted(totals: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(totals)
    return pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(totals[at])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket int, n long`` of all features of a table; each distinct line is featurised once.

    A task returns at most one row for each bucket.
    """

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            occurrences = whole.column("n").to_numpy()
            sizes = np.array(pc.binary_length(whole.column("line")))
            for start, end in _slices(sizes):
                part = [x.encode() for x in whole.column("line").slice(start, end - start).to_pylist()]
                crc, size, first = words_of(part)
                line, bucket = inner_features(first, n_gram_buckets(crc, size, buckets))
                np.add.at(totals, bucket, occurrences[start:end][line])
        yield _counted(totals)

    def breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _text_slices(batch):
                distinct, used, owner = _distinct_lines(texts)
                crc, size, first = words_of(distinct)
                totals += np.bincount(
                    crossing_features(used, owner, crc, size, first, buckets)[1], minlength=buckets)
        yield _counted(totals)

    text = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    distinct = (
        text.select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
        .groupBy("line").agg(F.count(F.lit(1)).alias("n")))
    within = distinct.mapInArrow(lines, _COUNTS)
    across = text.filter(F.contains("text", F.lit("\n"))).mapInArrow(breaks, _COUNTS)
    return within.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket in whole thousandths; one row a bucket comes to the driver."""
    counts = []
    for df in (docs, target):
        n = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(df, text_col, buckets).collect():
            n[r.bucket] = r.n
        counts.append(n)
    s, t = counts
    total_s, total_t = float(s.sum()), float(t.sum())
    return np.array([
        math.floor(UNIT * math.log((b + 1.0) * (total_s + buckets) / ((a + 1.0) * (total_t + buckets))))
        for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


# -- weights, scores and the draw -----------------------------------------------------------
def _draw(id_col: Column, seed: int) -> Column:
    """Seeded Gumbel draw of an id, in whole thousandths."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(UNIT)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weigh(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
    carry: Sequence[str] = ("doc_id",), seed: int = SEED,
) -> DataFrame:
    """``row`` (struct of carried columns), ``id, n_words, n_features, weight, score`` of every row.

    NULL and empty texts have no features and weight 0. A NULL id draws as an empty one.
    """
    known = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = known.value
        for batch in batches:
            for part, texts in _text_slices(batch):
                lines, used, owner = _distinct_lines(texts)
                crc, size, first = words_of(lines)
                line, bucket = inner_features(first, n_gram_buckets(crc, size, len(gain)))
                of_line = np.zeros(len(lines), dtype=np.int64)
                np.add.at(of_line, line, gain[bucket])
                weight = np.zeros(len(texts), dtype=np.int64)
                np.add.at(weight, owner, of_line[used])
                by, bucket = crossing_features(used, owner, crc, size, first, len(gain))
                np.add.at(weight, by, gain[bucket])
                n = np.zeros(len(texts), dtype=np.int64)
                np.add.at(n, owner, np.diff(first)[used])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("id"), pa.array(n),
                     pa.array(n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)), pa.array(weight)],
                    names=["row", "id", "n_words", "n_features", "weight"])

    rows = docs.select(row_struct(docs, carry), docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = with_row(docs, carry, id=docs.schema[id_col].dataType, **{
        c: T.LongType() for c in ("n_words", "n_features", "weight")})
    return rows.mapInArrow(run, schema).withColumn("score", F.col("weight") + _draw(F.col("id"), seed))


def draw_highest(scored: DataFrame, eligible: Column, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """Adds the long ``rank``: 1, 2, ... of the floor(share * N / 100) highest of N eligible rows.

    Ties go to the smaller id; NULL ids come last. ``scored`` is a written table, as it is read
    more than once. The eligible rows are sorted by ranges; the number of rows in the ranges before
    (one row a range) makes a row's place in its range a rank.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    ranged = (
        scored.filter(eligible).repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()))
    ranged = stored(ranged, "resample-order")
    part = F.shiftright("_at", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(
        F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(
        "_part", before.alias("_before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    rank = (F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1 + F.col("_before")).cast("long")
    ranked = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(
        "rank", F.when(rank * 100 <= F.col("_all") * share_percent, rank)
    ).drop("_at", "_part", "_before", "_all")
    rest = scored.filter(~eligible).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    carry: Sequence[str] = ("doc_id",), buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    share_percent: int = SHARE_PERCENT, seed: int = SEED,
) -> DataFrame:
    """``row`` (struct of carried columns), ``id, n_words, n_features, weight, score, rank``.

    One row for each row of ``docs``; ``rank`` is NULL for rows that are not drawn. Rows of at least
    ``min_words`` words can be drawn. Repeated rows score alike and are drawn one by one. An empty
    target or table of documents counts no features; the smoothing keeps gains finite. The carried
    columns travel with the sort, so carry ids rather than texts.
    """
    gains = bucket_gains(docs, target, text_col, buckets)
    scored = stored(weigh(docs, gains, id_col, text_col, carry, seed), "resample-scores")
    return draw_highest(scored, F.col("n_words") >= min_words, share_percent)
