"""The trie of conversation prefixes, with the statistics of every node and its subtree.

A conversation becomes one row: its turns as 128-bit ids, 16 bytes each, and the sizes of their
texts; texts do not travel. The rows are dealt out by ranges of (turn ids, conversation id), so the
conversations below a node lie in consecutive ranges, and copies of one conversation spread over as
many ranges as they need.

In a range, numpy sorts padded matrices of turn numbers (``sorted_rows``), marks where a column or
one before it changes, which is where a node starts, and aggregates each depth by ``reduceat``
(``range_nodes``). Only nodes on the paths of a range's first and last conversation can go on in
another range. These are left open: a range reports what it holds of them, two paths a range at
most, and equal nodes of all ranges are put together (``combined``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import stored

WIDTH = 16  # columns of a padded matrix
_NONE = hashlib.sha256(b"").digest()
_ROOT = b"\x00" * 16
_CLOSED, _OPEN, _ENDS = 0, 1, 2
CHUNK_IDS = 1 << 15  # ids of a chunk that an open node's ends are handed on in


# -- conversations as rows ------------------------------------------------------------------
def turn_id(role: Column, text: Column) -> Column:
    """Hex MD5 of role and text; the role's length keeps the two apart."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def conversation_rows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``conv_id, turns``: one row for each conversation, its turns as (turn, tid, size) in order.

    NULL turn numbers come first; turns of one number are ordered by their id. NULL roles and
    texts are empty. Turns without a conversation id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        turn_id(role, text).alias("tid"), F.octet_length(text).cast("long").alias("size"))
    return rows.filter("conv_id is not null").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "tid", "size"))).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 5, modulus: int = 9) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % block.

    h is the CRC-32 of the decimal c modulo ``modulus``. All of a block's conversations meet in one
    partition; the block's first conversation hands on ``modulus - 1`` turns at most.
    """
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("base")
    together = conversations.select(base, "conv_id", "turns")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, modulus - 1))).over(
        Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus)).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    taken = F.coalesce(F.slice(head, F.lit(1), h), F.slice("turns", 1, 0))
    return together.select("conv_id", F.concat(taken, own).alias("turns"))


# -- one range ------------------------------------------------------------------------------
def _matrix(rows: np.ndarray, first: np.ndarray, sizes: np.ndarray, ids: np.ndarray, at: int) -> np.ndarray:
    """Turn numbers ``at`` to ``at + WIDTH`` of the rows, padded with -1."""
    place = at + np.arange(WIDTH)
    inside = place < sizes[rows][:, None]
    out = np.full((len(rows), WIDTH), -1, dtype=np.int64)
    out[inside] = ids[(first[rows][:, None] + place)[inside]]
    return out


def sorted_rows(first: np.ndarray, sizes: np.ndarray, ids: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Order of the rows by turn numbers, shorter rows first, then by conversation.

    Rows that agree in all columns of a matrix and go on meet again in the next one.
    """
    order = np.arange(len(sizes))
    tied, segment, at = order, np.zeros(len(order), dtype=np.int64), 0
    places = np.arange(len(order))  # of the tied rows in the result
    while len(tied):
        m = _matrix(tied, first, sizes, ids, at)
        by = np.lexsort((conv[tied], *m.T[::-1], segment))
        tied, m, segment = tied[by], m[by], segment[by]
        order[places] = tied
        changes = np.ones(len(tied), dtype=bool)
        changes[1:] = (segment[1:] != segment[:-1]) | (m[1:] != m[:-1]).any(axis=1)
        group = np.cumsum(changes) - 1
        at += WIDTH
        again = (np.bincount(group)[group] > 1) & np.isin(group, group[sizes[tied] > at])
        tied, segment, places = tied[again], group[again], places[again]
    return order


def _digest(conv: np.ndarray) -> bytes:
    if not len(conv):
        return _NONE
    return hashlib.sha256(",".join(map(str, conv.tolist())).encode()).digest()


def range_nodes(conv: np.ndarray, paths: list[bytes], sizes: list[np.ndarray], part: int) -> list[dict]:
    """The nodes of one range, depth by depth, as columns (see ``_SCHEMA``)."""
    n_turns = np.array([len(p) // 16 for p in paths], dtype=np.int64)
    raw = np.frombuffer(b"".join(paths), dtype=">u8").reshape(-1, 2).astype(np.uint64)
    text_sizes = np.concatenate([*sizes, np.empty(0, np.int64)]).astype(np.int64)
    first = np.cumsum(n_turns) - n_turns
    by = np.lexsort((raw[:, 1], raw[:, 0]))
    new = np.ones(len(raw), dtype=bool)
    new[1:] = (raw[by][1:] != raw[by][:-1]).any(axis=1)
    ids = np.empty(len(raw), dtype=np.int64)
    ids[by] = np.cumsum(new) - 1
    order = sorted_rows(first, n_turns, ids, conv)
    conv, n_turns, first = conv[order], n_turns[order], first[order]

    # Node starts of each depth: a column change there, or one of any column before it.
    alive = np.arange(len(conv))
    node = np.zeros(len(conv), dtype=np.int64)  # of each row that is alive, at its depth
    starts = np.zeros(1, dtype=np.int64)
    levels = [{"starts": starts, "alive": alive, "parent": np.empty(0, np.int64), "size": np.zeros(1, np.int64)}]
    depth = 0
    while True:
        depth += 1
        going = n_turns[alive] >= depth
        alive, above = alive[going], node[going]
        if not len(alive):
            break
        turn = first[alive] + depth - 1
        changes = np.ones(len(alive), dtype=bool)
        changes[1:] = (above[1:] != above[:-1]) | (ids[turn[1:]] != ids[turn[:-1]])
        starts = np.flatnonzero(changes)
        node = np.cumsum(changes) - 1
        levels.append({"starts": starts, "alive": alive, "parent": above[starts], "size": text_sizes[turn[starts]]})

    open_nodes: list[list[int]] = []  # of each depth: the first and the last row's node
    for d, level in enumerate(levels):
        both = []
        if n_turns[0] >= d:
            both.append(0)
        if n_turns[-1] >= d and len(level["starts"]) - 1 not in both:
            both.append(len(level["starts"]) - 1)
        open_nodes.append(both)

    # Subtree sums from the deepest level up, without the open nodes' own parts.
    below = None
    for d in range(len(levels) - 1, -1, -1):
        level = levels[d]
        starts, alive = level["starts"], level["alive"]
        count = len(starts)
        level["n_convs"] = np.diff(np.append(starts, len(alive)))
        level["conv"] = np.minimum.reduceat(conv[alive], starts)
        level["n_ends"] = np.add.reduceat((n_turns[alive] == d).astype(np.int64), starts)
        children, leaves, saved = (np.zeros(count, dtype=np.int64) for _ in range(3))
        if below is not None:
            closed = np.ones(len(below["starts"]), dtype=bool)
            closed[open_nodes[d + 1]] = False
            up = below["parent"][closed]
            np.add.at(children, up, 1)
            np.add.at(leaves, up, below["leaves"][closed])
            np.add.at(saved, up, below["saved"][closed])
        own = np.ones(count, dtype=bool)
        own[open_nodes[d]] = False
        level["children"] = children
        level["leaves"] = np.where(own & (children == 0), 1, leaves)
        level["saved"] = saved + np.where(own, (level["n_convs"] - 1) * level["size"], 0)
        below = level

    keys = [{0: _ROOT}]  # of open nodes: a hash chained along the path
    out = []
    for d, level in enumerate(levels):
        starts, alive, both = level["starts"], level["alive"], open_nodes[d]
        if d:
            keys.append({k: hashlib.blake2b(
                keys[d - 1][int(level["parent"][k])] + raw[first[alive[starts[k]]] + d - 1].tobytes(),
                digest_size=16).digest() for k in both})
        closed = np.ones(len(starts), dtype=bool)
        closed[both] = False
        at = np.flatnonzero(closed)
        if len(at):
            parent = level["parent"][at]
            begin, n_ends = alive[starts[at]], level["n_ends"][at]
            parent_keys = [keys[d - 1].get(int(k)) for k in parent] if open_nodes[d - 1] else [None] * len(at)
            out.append({
                "kind": _CLOSED, "part": part, "depth": d, "conv_id": level["conv"][at],
                "parent_conv_id": levels[d - 1]["conv"][parent], "parent_key": parent_keys,
                "n_convs": level["n_convs"][at], "n_children": level["children"][at],
                "n_leaves": level["leaves"][at], "saved_tokens": level["saved"][at],
                "ends": [_digest(conv[b:b + n]) for b, n in zip(begin.tolist(), n_ends.tolist(), strict=True)]})
        for k in both:
            s = int(alive[starts[k]])
            out.append({
                "kind": _OPEN, "part": part, "depth": d, "conv_id": level["conv"][[k]], "key": [keys[d][k]],
                "parent_key": [keys[d - 1][int(level["parent"][k])] if d else None],
                "n_convs": level["n_convs"][[k]], "n_children": level["children"][[k]],
                "n_leaves": level["leaves"][[k]], "saved_tokens": level["saved"][[k]], "size": level["size"][[k]]})
            for i in range(0, int(level["n_ends"][k]), CHUNK_IDS):
                ids_here = conv[s + i:s + min(i + CHUNK_IDS, int(level["n_ends"][k]))]
                out.append({
                    "kind": _ENDS, "part": part, "depth": d, "key": [keys[d][k]], "chunk": [i // CHUNK_IDS],
                    "ends": [ids_here.astype("<i8").tobytes()]})
    return out


_SCHEMA = T.StructType([
    T.StructField("kind", T.ByteType()), T.StructField("part", T.IntegerType()), T.StructField("depth", T.LongType()),
    T.StructField("conv_id", T.LongType()), T.StructField("parent_conv_id", T.LongType()),
    T.StructField("key", T.BinaryType()), T.StructField("parent_key", T.BinaryType()),
    T.StructField("n_convs", T.LongType()), T.StructField("n_children", T.LongType()),
    T.StructField("n_leaves", T.LongType()), T.StructField("saved_tokens", T.LongType()),
    T.StructField("size", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("ends", T.BinaryType())])
_ARROW = pa.schema([
    ("kind", pa.int8()), ("part", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()),
    ("chunk", pa.int64()), ("ends", pa.binary())])


def _batch(columns: dict) -> pa.RecordBatch:
    n = max(len(v) for v in columns.values() if not np.isscalar(v))
    arrays = []
    for field in _ARROW:
        v = columns.get(field.name)
        if v is None:
            arrays.append(pa.nulls(n, field.type))
        elif np.isscalar(v):
            arrays.append(pa.array(np.full(n, v), field.type))
        else:
            arrays.append(pa.array(v, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, paths, sizes = [], [], []
    for b in batches:
        conv.append(b.column("conv_id").to_numpy())
        paths += b.column("path").to_pylist()
        lists = b.column("sizes")
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        sizes += np.split(flat, ends[:-1]) if len(ends) else []
    if not paths:
        return
    for columns in range_nodes(np.concatenate(conv), paths, sizes, TaskContext.get().partitionId()):
        yield _batch(columns)


# -- open nodes -----------------------------------------------------------------------------
def _whole(nodes: pd.DataFrame) -> pd.DataFrame:
    """Open nodes, put together from all ranges: adds what open children hold, deepest first."""
    nodes = nodes.sort_values("depth", ascending=False)
    at = {k: i for i, k in enumerate(nodes["key"])}
    children, leaves, saved = (nodes[c].tolist() for c in ("n_children", "n_leaves", "saved_tokens"))
    convs, sizes, conv = nodes["n_convs"].tolist(), nodes["size"].tolist(), nodes["conv_id"].tolist()
    parents = [None] * len(nodes)
    for i, up in enumerate(nodes["parent_key"]):
        if not children[i]:
            leaves[i] = 1
        saved[i] += (convs[i] - 1) * sizes[i]
        if up is not None:
            j = at[up]
            parents[i] = conv[j]
            children[j] += 1
            leaves[j] += leaves[i]
            saved[j] += saved[i]
    return pd.DataFrame({
        "key": nodes["key"], "conv_id": conv, "depth": nodes["depth"],
        "parent_conv_id": pd.array(parents, dtype="Int64"), "n_convs": convs, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved})


def combined(found: DataFrame) -> DataFrame:
    """Open nodes of all ranges put together, ``key`` and the node's columns without its ends.

    Sums and minima come first; what remains are the distinct nodes on two paths a range, of which
    one task forms the subtree sums.
    """
    nodes = found.filter(F.col("kind") == _OPEN).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.first("size").alias("size"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    return nodes.groupBy().applyInPandas(
        _whole, "key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long")


def _open_ends(found: DataFrame) -> DataFrame:
    """``key, ends`` of open nodes with ends: chunks in order of range, hashed as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k, ids in zip(batch.column("key"), batch.column("ends"), strict=True):
                text = ",".join(map(str, np.frombuffer(ids.as_py(), "<i8").tolist())).encode()
                if k.as_py() != key:
                    if state is not None:
                        yield _one(key, state)
                    key, state = k.as_py(), hashlib.sha256(text)
                else:
                    state.update(b"," + text)
        if state is not None:
            yield _one(key, state)

    def _one(key, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([key], pa.binary()), pa.array([state.digest()], pa.binary())], names=["key", "ends"])

    return (
        found.filter(F.col("kind") == _ENDS).select("key", "part", "chunk", "ends")
        .repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "ends")
        .mapInArrow(run, "key binary, ends binary"))


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id, turns`` rows (``conversation_rows``, ``rebuilt``).

    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``:
    a node is a distinct sequence of the first ``depth`` turns, the root has depth 0; ``conv_id`` is
    its smallest member, ``parent_conv_id`` its parent's (NULL for the root). Leaves and saved
    bytes cover the subtree with its top. ``ends_sha256`` is the digest of the ascending decimal
    ids of the members that end there. Conversations without turns are members of the root alone;
    without any conversation there is no node.
    """
    rows = conversations.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: t["tid"]), "")).alias("path"),
        F.transform("turns", lambda t: t["size"]).alias("sizes"))
    found = stored(rows.repartitionByRange("path", "conv_id").mapInArrow(_range, _SCHEMA), "trie-ranges")
    whole = stored(combined(found), "trie-open")
    closed = found.filter(F.col("kind") == _CLOSED)
    inner = closed.filter("parent_key is null").select(*NODE, "ends")
    # Children of open nodes ask by range and parent, so that a hot parent is split by ranges.
    parents = (
        found.filter(F.col("kind") == _OPEN).select("part", "key")
        .join(whole.select("key", F.col("conv_id").alias("up")), "key")
        .select(F.col("part").alias("_part"), F.col("key").alias("_key"), "up"))
    outer = (
        closed.filter("parent_key is not null")
        .join(parents, (F.col("part") == F.col("_part")) & (F.col("parent_key") == F.col("_key")))
        .withColumn("parent_conv_id", F.col("up")).select(*NODE, "ends"))
    shared = whole.join(_open_ends(found), "key", "left").select(
        *NODE, F.coalesce("ends", F.lit(_NONE)).alias("ends"))
    return inner.unionByName(outer).unionByName(shared).select(
        *NODE, F.lower(F.hex("ends")).alias("ends_sha256"))
