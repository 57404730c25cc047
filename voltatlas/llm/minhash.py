"""Near duplicates: one-permutation MinHash, banded buckets, star-shaped candidates.

1. Sketch. Every shingle hash falls into one of ``BINS`` bins by its leading bits; a bin's value
   is its smallest hash. Empty bins copy the value of another bin, found by probing bins in an
   order that depends on the empty bin alone (optimal densification).
2. Texts with the same shingle set (size and two 64-bit sums of remixed hashes) are one node.
3. Buckets. ``ROWS`` values make a band; nodes with an equal band share a bucket. With 32 bands of
   4, two sets of similarity 0.8 miss every bucket with a probability of 5e-8.
4. Stars. Each bucket links its members to one centre, the member that meets most others over all
   its buckets. Pairs are confirmed on the full shingle sets of both texts; linked nodes form
   components.
5. The rest. A bucket whose members ended in several components may hide links that its centre did
   not show. In a bucket of up to ``SMALL`` members all pairs of components are compared. The
   members of larger ones are joined exactly: shingles are put in order of rarity, and two sets
   that are similar enough must share one of the first few. Positions and sizes bound the common
   part from above, so that pairs that cannot reach the share are not formed. So no link between
   texts that share a bucket is lost, whatever the buckets' sizes.

Only hashes and ids are grouped. Texts are written once; those that may be in a pair (a Bloom filter
of bounded size tells) are joined with the pairs. A hot centre is split by adaptive execution, as the
joins read written tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.components import connected_components
from voltatlas.llm.exact_dedup import blocks_for, maybe_repeated, repeat_filter
from voltatlas.llm.shingles import mix, shingle_sets, slices
from voltatlas.llm.tables import row_struct, stored, with_row

BINS = 128
ROWS = 4
SMALL = 8
_CLASS = 1.02  # sizes of sets within this factor make a class


def densified(bins: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill empty bins of each row that has a filled one; probes depend on bin and attempt only."""
    out = bins.copy()
    rows, cols = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        probe = (mix(np.arange(bins.shape[1], dtype=np.uint64) + np.uint64(attempt << 20))
                 % np.uint64(bins.shape[1])).astype(np.int64)
        found = filled[rows, probe[cols]]
        out[rows[found], cols[found]] = bins[rows[found], probe[cols[found]]]
        rows, cols = rows[~found], cols[~found]
    return out


def band_hashes(hashes: np.ndarray, bounds: np.ndarray, bins: int = BINS, rows: int = ROWS) -> np.ndarray:
    """One row of ``bins / rows`` band hashes for each set of sorted distinct hashes."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    at = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = owner * bins + at
    # Hashes are sorted inside a set, so the first of each cell is its minimum.
    first = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else cell
    values = np.zeros(n * bins, dtype=np.uint64)
    filled = np.zeros(n * bins, dtype=bool)
    values[cell[first]] = hashes[first]
    filled[cell[first]] = True
    sketch = densified(values.reshape(n, bins), filled.reshape(n, bins))
    out = np.empty((n, bins // rows), dtype=np.uint64)
    for b in range(bins // rows):
        h = np.full(n, b + 1, dtype=np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, b * rows + r])
        out[:, b] = h
    return out


def _set_sums(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = []
    for salt in (0x51, 0xA7):
        total = np.concatenate(([0], np.cumsum(mix(hashes + np.uint64(salt))))).astype(np.uint64)
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return sums[0], sums[1]


def _sketched(words: int, dropped: Sequence[str] = ()):
    """Adds ``n, f1, f2, bands`` to batches that have a column ``text``, which may be dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, offsets in slices(batch.column("text")):
                hashes, bounds = shingle_sets(data, offsets, words)
                f1, f2 = _set_sums(hashes, bounds)
                bands = band_hashes(hashes, bounds)
                part = batch.slice(start, len(offsets) - 1).drop_columns(list(dropped))
                lists = pa.ListArray.from_arrays(
                    np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32),
                    bands.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2), lists],
                    names=[*part.schema.names, "n", "f1", "f2", "bands"])

    return run


def _confirmed(words: int, percent: int):
    """Keeps the pairs ``a, text_a, b, text_b`` with 100 * common >= percent * union."""
    def sets_of(ids: pa.Array, texts: pa.Array) -> dict[int, np.ndarray]:
        keys = ids.to_numpy()
        _, at = np.unique(keys, return_index=True)
        own = texts.take(pa.array(at))
        out = {}
        for start, data, offsets in slices(own):
            hashes, bounds = shingle_sets(data, offsets, words)
            for i in range(len(offsets) - 1):
                out[int(keys[at[start + i]])] = hashes[bounds[i]:bounds[i + 1]]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                left = sets_of(batch.column("a"), batch.column("text_a"))
                right = sets_of(batch.column("b"), batch.column("text_b"))
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                good = np.zeros(len(a), dtype=bool)
                for k in range(len(a)):
                    x, y = left[int(a[k])], right[int(b[k])]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good[k] = 100 * common >= percent * (len(x) + len(y) - common)
                yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return run


def _texts_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of ``texts`` that may be among ``nodes``, by a bounded Bloom filter: no text is moved."""
    nodes = stored(nodes.distinct(), "near-nodes")
    blocks = blocks_for(nodes.count())
    bloom = stored(repeat_filter(nodes, blocks, "node", least=1), "near-filter")
    return maybe_repeated(texts, bloom, blocks, "node", "maybe").filter("maybe").drop("maybe")


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed pairs. The member's text is joined first, then the centre's, which may be hot."""
    texts = _texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), texts)
    member = texts.select(F.col("node").alias("node_b"), F.col("text").alias("text_b"))
    centre = texts.select(F.col("node").alias("node_a"), F.col("text").alias("text_a"))
    joined = (
        pairs.join(member, F.col("b") == F.col("node_b")).select("a", "b", "text_b")
        .join(centre, F.col("a") == F.col("node_a")).select("a", "b", "text_a", "text_b"))
    return joined.mapInArrow(_confirmed(words, percent), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
    percent: int = 80, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of id and carried columns), and its class.

    ``n_shingles`` (size of the set), ``component_id`` (smallest id that it reaches through links,
    its own included) and ``kept`` (the one row of the component that stays: smallest id, NULL ids
    last; of equal ids, the first row written). Texts are linked if 100 times the common shingles
    are at least ``percent`` times all shingles of both. A NULL or wordless text has an empty set
    and is linked with nothing. Repeated rows share a set and so a component. Columns that are not
    carried are not read, and carried names stay inside the struct, so that none can clash.
    """
    kept = [id_col, *(c for c in carry if c != id_col)]
    # A carried text is stored once, inside the struct.
    inside = text_col in kept
    text = {} if inside else {"text": T.StringType()}
    rows = stored(
        docs.select(
            row_struct(docs, kept), F.monotonically_increasing_id().alias("number"),
            docs[id_col].alias("id"), docs[text_col].alias("text"))
        .mapInArrow(_sketched(words, ["text"] if inside else []), with_row(
            docs, kept, number=T.LongType(), id=docs.schema[id_col].dataType, **text, n=T.LongType(),
            f1=T.LongType(), f2=T.LongType(), bands=T.ArrayType(T.LongType()))),
        "near-rows")
    texts = rows.select(
        F.col("number").alias("node"), (F.col("row")[text_col] if inside else F.col("text")).alias("text"))
    # One node for each distinct non-empty set, named by the number of one of its rows.
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "number"))
    sets = stored(
        rows.filter("n > 0").groupBy("n", "f1", "f2")
        .agg(F.min("number").alias("node"), first.alias("first"), F.min_by("bands", "number").alias("bands")),
        "near-sets")
    comp = _components(texts, sets, words, percent)
    firsts = sets.select("node", "n", "f1", "f2", "first").join(
        comp.select(F.col("node").alias("linked"), "root"), F.col("node") == F.col("linked"), "left")
    firsts = stored(
        firsts.select("n", "f1", "f2", F.coalesce("root", "node").alias("root"), "first"), "near-firsts")
    least = firsts.groupBy("root").agg(F.min("first").alias("least"))
    classes = stored(
        firsts.select(F.col("n").alias("c_n"), F.col("f1").alias("c_f1"), F.col("f2").alias("c_f2"), "root")
        .join(stored(least.select(F.col("root").alias("r"), "least"), "near-least"), F.col("root") == F.col("r"))
        .select("c_n", "c_f1", "c_f2", F.col("least.id").alias("component"), F.col("least.number").alias("stays")),
        "near-classes")
    alone = rows.filter("n = 0").select(
        "row", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"),
        F.lit(True).alias("kept"))
    grouped = rows.filter("n > 0").select("row", "number", "n", "f1", "f2").join(
        classes, (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2")) & (F.col("n") == F.col("c_n")))
    return alone.unionByName(grouped.select(
        "row", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        (F.col("number") == F.col("stays")).alias("kept")))


def _components(texts: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    members = sets.select("node", "n", F.explode("bands").alias("key"))
    sizes = stored(
        members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        .select(F.col("key").alias("k"), "size"), "near-buckets")
    shared = stored(
        members.join(sizes, F.col("key") == F.col("k")).select("key", "size", "node", "n"), "near-members")
    meets = shared.groupBy("node").agg(F.sum(F.col("size") - 1).alias("meets"))
    meets = stored(meets.select(F.col("node").alias("m_node"), "meets"), "near-meets")
    # A set that is too small cannot reach the share, whatever the texts are.
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # The number breaks ties towards the smaller node.
    rated = shared.join(meets, F.col("node") == F.col("m_node"))
    hubs = stored(
        rated.groupBy("key").agg(
            F.max(F.struct("meets", (-F.col("node")).alias("minus"), "n")).alias("hub"))
        .select(F.col("key").alias("k"), (-F.col("hub.minus")).alias("a"), F.col("hub.n").alias("n_a")),
        "near-hubs")
    pairs = stored(
        shared.join(hubs, F.col("key") == F.col("k"))
        .select("a", "n_a", F.col("node").alias("b"), F.col("n").alias("n_b"))
        .filter(alike & (F.col("a") != F.col("b"))).select("a", "b").distinct(), "near-pairs")
    links = stored(_links(pairs, texts, words, percent), "near-links")
    comp = connected_components(links)

    few = _open_members(shared.filter(F.col("size") <= SMALL), comp)
    other = few.select(
        F.col("key").alias("k"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    pairs = stored(
        few.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), "root")
        .join(other, F.col("key") == F.col("k"))
        .filter(alike & (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_a")))
        .select("a", "b").distinct(), "near-pairs")
    links = links.unionByName(stored(_links(pairs, texts, words, percent), "near-links"))
    comp = connected_components(links)

    many = _open_members(shared.filter(F.col("size") > SMALL), comp).select("node", "n", "root").distinct()
    pairs = stored(_rare_pairs(stored(many, "near-rest"), texts, words, percent), "near-pairs")
    links = links.unionByName(stored(_links(pairs, texts, words, percent), "near-links"))
    return connected_components(links)


def _open_members(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of the buckets that still hold several components, with their root."""
    rooted = stored(
        shared.join(comp.select(F.col("node").alias("c_node"), "root"), F.col("node") == F.col("c_node"), "left")
        .select("key", "node", "n", F.coalesce("root", "node").alias("root")), "near-rooted")
    split = stored(
        rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .filter("low <> high").select(F.col("key").alias("s_key")), "near-split")
    return rooted.join(split, F.col("key") == F.col("s_key")).drop("s_key")


def _shingle_rows(words: int):
    """``node, n, root, text`` -> a row ``node, n, root, h`` for each shingle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, offsets in slices(batch.column("text")):
                hashes, bounds = shingle_sets(data, offsets, words)
                part = batch.slice(start, len(offsets) - 1)
                take = pa.array(np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in ("node", "n", "root")), pa.array(hashes.view(np.int64))],
                    names=["node", "n", "root", "h"])

    return run


def _rare_pairs(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of members of different components that may reach the share; all that do are among them.

    Of sets x and y, y not larger, the common part must be percent / (100 + percent) of both sizes.
    With all shingles in one order, their first common shingle then lies so early in both that
    what follows can hold the common part. Shingles that one member has alone come first in the
    order and are never joined. Probes list the size classes that their position still allows.
    """
    own = _texts_of(members.select("node"), texts)
    rows = members.join(
        own.select(F.col("node").alias("t_node"), "text"), F.col("node") == F.col("t_node")
    ).select("node", "n", "root", "text").mapInArrow(
        _shingle_rows(words), "node long, n long, root long, h long")
    rows = stored(rows, "near-shingles")
    seen = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
                  .select(F.col("h").alias("s_h"), "df"), "near-frequencies")
    # Positions count from the rarest; those of a member's own shingles are its first ones.
    common = rows.join(seen, F.col("h") == F.col("s_h"))
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    order = Window.partitionBy("node").orderBy("df", "h")
    placed = common.withColumn("at", alone + F.row_number().over(order) - 1)
    probing = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1
    placed = stored(placed.filter(F.col("at") < probing).select("node", "n", "root", "h", "at"), "near-prefixes")

    def size_class(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / float(np.log(_CLASS)))

    index = placed.filter(
        F.col("at") <= F.col("n") - F.ceil(F.col("n") * 2.0 * percent / (100 + percent) - 1e-6)
    ).select(
        F.col("h").alias("i_h"), size_class(F.col("n")).alias("i_class"), F.col("node").alias("b"),
        F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("at").alias("at_b"))
    largest = F.least(F.col("n"), F.floor(
        (F.col("n") - F.col("at")) * (100.0 + percent) / percent + 1e-6) - F.col("n"))
    smallest = F.ceil(F.col("n") * percent / 100.0 - 1e-6)
    probe = placed.withColumns({"most": largest, "least": smallest}).filter("most >= least").select(
        "h", "node", "n", "root", "at",
        F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))).alias("class"))
    needed = F.ceil((F.col("n") + F.col("n_b")) * float(percent) / (100 + percent) - 1e-6)
    may = (
        (F.col("root") != F.col("root_b"))
        & ((F.col("n_b") < F.col("n")) | ((F.col("n_b") == F.col("n")) & (F.col("b") != F.col("node"))))
        & (F.col("n") - F.col("at") >= needed) & (F.col("n_b") - F.col("at_b") >= needed))
    return (
        probe.join(index, (F.col("h") == F.col("i_h")) & (F.col("class") == F.col("i_class")) & may)
        .select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct())


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """One row of each component of near duplicates, with its columns as they are."""
    found = near_duplicates(docs, id_col, text_col, words, percent, carry=docs.columns)
    return found.filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
