"""Lines that many documents share, dropped everywhere but in one document.

Every long line becomes a row of a 128-bit hash, the document and its line numbers; no text
travels with it. The rows are dealt out by ranges of (hash, document from the largest id down) and
sorted within each range, so the first occurrence of a hash is that of the document that keeps it.
Each range is read as a stream: a run of equal hashes counts its documents, and once enough have
passed, all but the first lose their lines. A hot line spreads over as many ranges as it needs.
Runs at the ends of a range may go on in the next; such a range reports one mark for each of its
two end runs, and the marks (two rows a range) decide these rows.

The result is a compressed bitmap of kept lines for each document that loses any. ``kept_text``
applies the bitmaps to the texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import row_struct, stored, with_row

MIN_CHARS = 40
MIN_DOCS = 5
_SPACES = " \t\n\x0b\x0c\r"
_DROP, _OPEN, _MARK = 0, 1, 2


def line_keys(text: str, min_chars: int = MIN_CHARS) -> dict[bytes, list[int]]:
    """Hash of each key of at least ``min_chars`` code points, with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.split("\n")):
        if len(line) >= min_chars and len(key := line.strip(_SPACES)) >= min_chars:
            # bytes.lower() changes A-Z only
            h = hashlib.blake2b(key.encode().lower(), digest_size=16).digest()
            found.setdefault(h, []).append(i)
    return found


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``h, id, text_key, n_lines, at``: one row for each document and long key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                take, hashes, sizes, at, ends = [], [], [], [], [0]
                for k, text in enumerate(batch.column("text").to_pylist()):
                    n_lines = text.count("\n") + 1
                    for h, places in line_keys(text, min_chars).items():
                        take.append(k)
                        hashes.append(h)
                        sizes.append(n_lines)
                        at += places
                        ends.append(len(at))
                rows = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.binary()), batch.column("id").take(rows),
                     batch.column("text_key").take(rows), pa.array(sizes, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))],
                    names=["h", "id", "text_key", "n_lines", "at"])

    rows = docs.select(
        F.col(id_col).alias("id"), _text(text_col).alias("text"), F.xxhash64(_text(text_col)).alias("text_key"))
    schema = T.StructType([
        T.StructField("h", T.BinaryType()), T.StructField("id", docs.schema[id_col].dataType),
        T.StructField("text_key", T.LongType()), T.StructField("n_lines", T.IntegerType()),
        T.StructField("at", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def _changes(column: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Whether each value differs from the one before it; NULL equals NULL."""
    out = np.ones(len(column), dtype=bool)
    if before is not None and len(column):
        out[0] = before.as_py() != column[0].as_py()
    a, b = column[1:], column[:-1]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    out[1:] = ~same.to_numpy(zero_copy_only=False)
    return out


class _Run:
    """A run of equal hashes at an end of a batch, which may go on in the next."""

    def __init__(self, h: bytes, first, opening: bool):
        self.h, self.first, self.opening = h, first, opening
        self.n_docs, self.last, self.held = 0, None, []


def _streamed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows to drop, rows left open, and the marks of the end runs of one sorted range.

    The first run may have begun in the range before, so its rows stay open. Others are decided
    here, but for a last run that has not had enough documents yet. Held in memory are a batch
    and, for one run, the rows of its second to ``min_docs - 1``-th document.
    """
    part = TaskContext.get().partitionId()
    run: _Run | None = None
    before: dict[str, pa.Scalar | None] = {"h": None, "id": None, "text_key": None}
    kind = None

    def rows(batch: pa.RecordBatch, what: int) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, what, np.int8)), *batch.columns, pa.nulls(n, pa.int32()),
             pa.nulls(n, pa.int64()), pa.nulls(n, kind)],
            names=["kind", *batch.schema.names, "part", "n_docs", "last_id"])

    def mark(r: _Run) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([_MARK], pa.int8()), pa.array([r.h], pa.binary()), pa.array([r.first], kind),
             pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int32())),
             pa.array([part], pa.int32()), pa.array([r.n_docs], pa.int64()), pa.array([r.last], kind)],
            names=["kind", "h", "id", "text_key", "n_lines", "at", "part", "n_docs", "last_id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("id").type
        new_run = _changes(batch.column("h"), before["h"])
        new_doc = new_run | _changes(batch.column("id"), before["id"])
        new_row = new_doc | _changes(batch.column("text_key"), before["text_key"])
        before = {c: batch.column(c)[batch.num_rows - 1] for c in before}
        starts = np.unique(np.append(np.flatnonzero(new_run), 0))
        ends = np.append(starts[1:], batch.num_rows)
        docs = np.cumsum(new_doc)
        base = np.where(starts > 0, docs[starts - 1], 0 if new_run[0] else -run.n_docs)
        number = docs - np.repeat(base, ends - starts)  # of the document within its run, from 1
        totals = number[ends - 1]

        def step(j: int, r: _Run) -> Iterator[pa.RecordBatch]:
            """The part of run ``r`` that lies in this batch."""
            s, e = int(starts[j]), int(ends[j])
            r.n_docs, r.last = int(totals[j]), batch.column("id")[e - 1].as_py()
            pick = s + np.flatnonzero(new_row[s:e] & (r.opening | (number[s:e] >= 2)))
            taken = batch.take(pa.array(pick))
            if r.opening:
                yield rows(taken, _OPEN)
            elif r.n_docs < min_docs:
                r.held.append(taken)
            else:
                for b in [*r.held, taken]:
                    yield rows(b, _DROP)
                r.held = []

        if new_run[0]:
            if run is not None and run.opening:
                yield mark(run)
            run = _Run(batch.column("h")[0].as_py(), batch.column("id")[0].as_py(), run is None)
        yield from step(0, run)
        if len(starts) > 1:
            if run.opening:
                yield mark(run)
            enough = totals >= min_docs
            enough[[0, -1]] = False
            pick = np.flatnonzero(np.repeat(enough, ends - starts) & (number >= 2) & new_row)
            yield rows(batch.take(pa.array(pick)), _DROP)
            s = int(starts[-1])
            run = _Run(batch.column("h")[s].as_py(), batch.column("id")[s].as_py(), False)
            yield from step(len(starts) - 1, run)
    if run is not None:
        for b in run.held:
            yield rows(b, _OPEN)
        yield mark(run)


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``id_col, text_key, n_lines, n_dropped, keep`` of every document that loses a line.

    A line's key is the line without U+0020 and U+0009 to U+000D at its ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all lines
    but those in the largest id that holds them. ``keep`` has a bit for each line, the first line
    in the highest bit of the first byte, deflated. ``text_key`` is the 64-bit hash of the text.

    Rows with one id are one document, and so are all rows without an id, which come before every
    id; each of these rows keeps or loses the line. Repeated rows share one bitmap. NULL and empty
    texts are one empty line. An empty table gives an empty result. Other columns are not read.
    """
    lines = _line_rows(docs, id_col, text_col, min_chars)
    order = [F.col("h"), F.col("id").desc_nulls_last(), F.col("text_key")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([
        T.StructField("kind", T.ByteType()), *lines.schema.fields, T.StructField("part", T.IntegerType()),
        T.StructField("n_docs", T.LongType()), T.StructField("last_id", docs.schema[id_col].dataType)])
    found = stored(ranged.mapInArrow(lambda batches: _streamed(batches, min_docs), schema), "line-runs")

    # Two rows a range at most: a run over several ranges has its first document in the first.
    by_part = Window.partitionBy("h").orderBy("part")
    goes_on = F.col("id").eqNullSafe(F.lag("last_id").over(by_part)) & (F.row_number().over(by_part) > 1)
    decided = (
        found.filter(F.col("kind") == _MARK)
        .withColumn("n", F.col("n_docs") - goes_on.cast("long"))
        .groupBy("h").agg(F.sum("n").alias("n"), F.min_by("id", "part").alias("top"))
        .filter(F.col("n") >= min_docs).select(F.col("h").alias("hot"), "top"))
    columns = ["id", "text_key", "n_lines", "at"]
    rest = (
        found.filter(F.col("kind") == _OPEN).join(F.broadcast(decided), F.col("h") == F.col("hot"))
        .filter(~F.col("id").eqNullSafe(F.col("top"))).select(*columns))
    drops = (
        found.filter(F.col("kind") == _DROP).select(*columns).unionByName(rest)
        .groupBy("id", "text_key", "n_lines").agg(F.flatten(F.collect_list("at")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keeps, dropped = [], []
            sizes = batch.column("n_lines").to_pylist()
            lists = batch.column("at")
            for k, n in enumerate(sizes):
                keep = np.ones(n, dtype=bool)
                keep[lists[k].values.to_numpy()] = False
                dropped.append(n - int(keep.sum()))
                keeps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(dropped, pa.int64()), pa.array(keeps, pa.binary())],
                names=[id_col, "text_key", "n_lines", "n_dropped", "keep"])

    return drops.mapInArrow(run, T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()),
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("keep", T.BinaryType())]))


def keep_mask(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The bits of ``keep`` as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def kept_text(
    docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """``row`` (struct of carried columns), ``n_lines, n_dropped, kept`` for every row of ``docs``.

    ``kept`` has the lines that stay, joined by a newline. The texts move once, to meet their
    bitmaps by id and text hash; rows without a bitmap keep their text. The join is a merge at
    every size, as the bitmaps grow with the documents.
    """
    marks = bitmaps.select(
        F.col(id_col).alias("_id"), F.col("text_key").alias("_key"), F.col("keep").alias("keep"))
    rows = docs.select(
        row_struct(docs, carry), F.col(id_col).alias("id"), _text(text_col).alias("text"),
        F.xxhash64(_text(text_col)).alias("text_key"))
    met = rows.join(
        marks.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                batch = whole.slice(i, 1_000)
                sizes, dropped, kept = [], [], []
                for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
                    n = text.count("\n") + 1
                    sizes.append(n)
                    if keep is None:
                        dropped.append(0)
                        kept.append(text)
                        continue
                    mask = keep_mask(keep, n)
                    dropped.append(n - int(mask.sum()))
                    kept.append("\n".join(line for line, k in zip(text.split("\n"), mask, strict=True) if k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()),
                     pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept"])

    return met.select("row", "text", "keep").mapInArrow(
        run, with_row(docs, carry, n_lines=T.LongType(), n_dropped=T.LongType(), kept=T.StringType()))
