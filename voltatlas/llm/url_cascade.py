"""URL filters: rules by host and path, and exact host membership by a Bloom filter cascade.

A cascade answers whether a key of a known universe is listed. Level 1 encodes the listed keys;
level 2 the unlisted keys that pass level 1; level 3 the listed keys that pass level 2; and so on
until a level lets no key of the other kind pass. A key's answer is given by the first level that
rejects it. For the keys of the universe it is exact, so rows are judged without a join.

Levels are built from distributed sets that shrink by the false-positive rate. A level's bits are
put together as 4 KiB bitmaps and brought to the driver; together they take about 9 bits for each
listed key and 9 / 64 for each other one. Up to ``MAX_FILTER_BYTES`` they are broadcast. A list
that would need more is looked up by a join with the table of listed keys instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.shingles import mix
from voltatlas.llm.tables import row_struct, stored, with_row

HASHES = 6  # bits of a key in a level; at 9 bits a key, one key in 64 passes by mistake
BITS_PER_KEY = 9
BLOCK_BITS = 32_768  # of one bitmap of bitmap_construct_agg
MAX_FILTER_BYTES = 64 << 20
PART_KEYS = 1 << 17  # keys of a part of a longer cascade: at most about 150 KB of levels
UNIT_ROWS = 1 << 20  # rows that a copy of a part's cascade judges, about


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed values of the registered query.
RULES = (
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits host, subdomains and path; NULL if none.

    Of rules of one length, the first in the list.
    """
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.text))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)).otherwise(text)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """``HASHES`` bit positions of each key at a level, from two 64-bit hashes of the key."""
    a, b = h1.view(np.uint64), h2.view(np.uint64)
    out = np.empty((len(a), HASHES), dtype=np.int64)
    for i in range(HASHES):
        out[:, i] = (mix(a + mix(b + np.uint64(level * HASHES + i + 1))) % np.uint64(bits)).astype(np.int64)
    return out


@dataclass(frozen=True)
class Cascade:
    levels: tuple[np.ndarray, ...]  # packed bits, least significant first

    @property
    def size_bytes(self) -> int:
        return sum(len(x) for x in self.levels)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits = self.levels[level]
        at = positions(h1, h2, level, len(bits) * 8)
        return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool).all(axis=1)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key is listed; exact for the keys of the universe."""
        out = np.full(len(h1), len(self.levels) % 2 == 1)
        open_rows = np.arange(len(h1))
        for level in range(len(self.levels)):
            ok = self.passes(level, h1[open_rows], h2[open_rows])
            out[open_rows[~ok]] = level % 2 == 1
            open_rows = open_rows[ok]
        return out


def _key_hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit("a"), key), F.xxhash64(F.lit("b"), key)


def _level_bits(keys: DataFrame, level: int, count: int) -> np.ndarray:
    blocks = max(1, -(-count * BITS_PER_KEY // BLOCK_BITS))
    bits = blocks * BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(
                batch.column("h1").to_numpy(), batch.column("h2").to_numpy(), level, bits).reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // BLOCK_BITS), pa.array(at % BLOCK_BITS)], names=["block", "pos"])

    marks = keys.select("h1", "h2").mapInArrow(run, "block long, pos long")
    out = np.zeros((blocks, BLOCK_BITS // 8), dtype=np.uint8)
    for r in marks.groupBy("block").agg(F.bitmap_construct_agg("pos").alias("bits")).toLocalIterator():
        out[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.reshape(-1)


def _kept_by(keys: DataFrame, cascade: Cascade) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(cascade)
    last = len(cascade.levels) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = shared.value.passes(last, batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            yield batch.filter(pa.array(ok))

    return stored(keys.mapInArrow(run, "h1 long, h2 long"), "cascade-keys")


def build_cascade(universe: DataFrame, key: str, listed: str) -> Cascade | None:
    """A cascade over ``universe``: one row per distinct key, with the boolean ``listed``.

    None if the levels would take more than ``MAX_FILTER_BYTES``. An empty list gives a cascade
    whose one level rejects every key.
    """
    h1, h2 = _key_hashes(F.col(key))
    hashed = universe.select(h1.alias("h1"), h2.alias("h2"), F.col(listed).alias("listed"))
    inside = stored(hashed.filter("listed").select("h1", "h2"), "cascade-keys")
    outside = stored(hashed.filter("not listed").select("h1", "h2"), "cascade-keys")
    n_in, n_out = inside.count(), outside.count()
    if (n_in + n_out / 2 ** HASHES) * BITS_PER_KEY / 8 * 1.1 > MAX_FILTER_BYTES:
        return None
    cascade = Cascade(())
    encoded, other, count = inside, outside, n_in
    while True:
        level = len(cascade.levels)
        cascade = Cascade((*cascade.levels, _level_bits(encoded, level, count)))
        passed = _kept_by(other, cascade)
        count = passed.count()
        if not count:
            return cascade
        encoded, other = passed, encoded


def local_cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> Cascade:
    """The cascade over the given keys (distinct hashes), built in memory."""
    levels: tuple[np.ndarray, ...] = ()
    encoded, other = np.flatnonzero(listed), np.flatnonzero(~listed)
    while True:
        bits = np.zeros(max(8, -(-len(encoded) * BITS_PER_KEY // 8)), dtype=np.uint8)
        at = positions(h1[encoded], h2[encoded], len(levels), len(bits) * 8).reshape(-1)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        levels = (*levels, bits)
        passed = other[Cascade(levels).passes(len(levels) - 1, h1[other], h2[other])]
        if not len(passed):
            return Cascade(levels)
        encoded, other = passed, encoded


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))


def build_parts(universe: DataFrame, key: str, listed: str, parts: int) -> DataFrame:
    """``part long, levels array<binary>``: a cascade over the keys of each part of ``universe``.

    Keys are distinct, so a part holds about keys / ``parts`` of them, whatever the rows of a key.
    """
    h1, h2 = _key_hashes(F.col(key))
    hashed = universe.select(
        _part(F.col(key), parts).alias("part"), h1.alias("h1"), h2.alias("h2"), F.col(listed).alias("listed"))

    def run(keys: pa.Table) -> pa.Table:
        made = local_cascade(
            keys["h1"].to_numpy(), keys["h2"].to_numpy(), keys["listed"].to_numpy(zero_copy_only=False))
        return pa.table({
            "part": pa.array([keys["part"][0].as_py()], pa.int64()),
            "levels": pa.array([[x.tobytes() for x in made.levels]], pa.list_(pa.binary()))})

    return hashed.groupBy("part").applyInArrow(run, "part long, levels array<binary>")


def _judged_by_parts(rows: DataFrame, hosts: DataFrame, parts: int, pages: DataFrame, carry: Sequence[str]) -> DataFrame:
    """``row, host, path, rule, listed`` of rows whose hosts are in ``hosts`` (``host, listed, open_rows``)."""
    # One row for PART_KEYS hosts.
    units = stored(
        hosts.groupBy(_part(F.col("host"), parts).alias("part"))
        .agg(F.greatest(F.ceil(F.sum("open_rows") / F.lit(UNIT_ROWS)), F.lit(1)).cast("long").alias("units")),
        "cascade-units")
    cascades = stored(build_parts(hosts, "host", "listed", parts), "cascade-parts").join(units, "part").select(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)).alias("unit"), "levels")
    # A counter deals the rows of a part out evenly, however few hosts or urls they have.
    routed = rows.withColumns(
        {"part": _part(F.col("host"), parts), "at": F.monotonically_increasing_id()}).join(
        F.broadcast(units), "part").select(
        "part", F.pmod("at", "units").alias("unit"), "row", "host", "path", "rule")
    together = cascades.unionByName(routed, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, cascade = -1, Cascade(())
        for batch in batches:
            levels, of = batch.column("levels"), batch.column("part").to_numpy()
            heads = np.flatnonzero(levels.is_valid().to_numpy(zero_copy_only=False))
            cuts = [0, *heads, batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin < end and levels[begin].is_valid:
                    part = of[begin]
                    cascade = Cascade(tuple(np.frombuffer(x, np.uint8) for x in levels[begin].as_py()))
                    begin += 1
                if begin == end:
                    continue
                if (of[begin:end] != part).any():
                    raise RuntimeError("rows of a part without its cascade")
                some = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("row", "host", "path", "rule")),
                     pa.array(cascade.listed(some.column("h1").to_numpy(), some.column("h2").to_numpy()))],
                    names=["row", "host", "path", "rule", "listed"])

    h1, h2 = (F.coalesce(h, F.lit(0).cast("long")) for h in _key_hashes(F.col("host")))
    return (
        together.withColumns({"h1": h1, "h2": h2}).repartition("part", "unit")
        .sortWithinPartitions("part", "unit", F.col("levels").isNull())
        .mapInArrow(run, with_row(
            pages, carry, host=T.StringType(), path=T.StringType(), rule=T.StringType(), listed=T.BooleanType())))


def judge_urls(
    pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES, carry: Sequence[str] = ("page_id",),
) -> DataFrame:
    """One row per row of ``pages``: ``row`` (struct of carried columns), ``host, path, rule, verdict``.

    The longest fitting rule gives the verdict. An url without a rule gets ``block`` if its host is
    listed, else ``allow``; listed are the hosts of which a rule blocks some url of the table. The
    universe are all hosts of the table, found by one aggregate; a hot host is combined before the
    shuffle. Rows stay where they are unless the cascade is too large to broadcast; then those without
    a rule travel to the part of the cascade that has their host. NULL urls and urls without ``://`` have an empty host and path, which no rule fits
    and no list holds: they are allowed. Ties, repeated rows and long urls need no special case.
    """
    def judged(df: DataFrame, url: str) -> DataFrame:
        found = df.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
        rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
        return found.withColumns({"rule": rule, "verdict": verdict})

    named = pages.select(row_struct(pages, carry), pages[url_col].alias("url"))
    hosts = stored(
        judged(named.select("url"), "url").filter("host <> ''").groupBy("host").agg(
            F.max(F.coalesce(F.col("verdict") == "block", F.lit(False))).alias("listed"),
            F.count(F.when(F.col("verdict").isNull(), 1)).alias("open_rows")), "cascade-hosts")
    cascade = build_cascade(hosts, "host", "listed")
    rows = judged(named, "url")
    by_list = F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")
    if cascade is None:
        is_open = F.col("verdict").isNull() & (F.col("host") != "")
        parts = max(1, -(-hosts.count() // PART_KEYS))
        found = _judged_by_parts(rows.filter(is_open), hosts, parts, pages, carry)
        return rows.filter(~is_open).select(
            "row", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")).unionByName(
            found.select("row", "host", "path", "rule", by_list))
    shared = pages.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def is_listed(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(shared.value.listed(a.to_numpy(), b.to_numpy()))

    listed = (F.col("host") != "") & is_listed(*_key_hashes(F.col("host")))
    verdict = F.coalesce("verdict", F.when(listed, "block").otherwise("allow"))
    return rows.select("row", "host", "path", "rule", verdict.alias("verdict"))


def allowed(pages: DataFrame, url_col: str = "url", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``pages`` that are allowed, with their columns as they are."""
    kept = judge_urls(pages, url_col, rules, carry=pages.columns).filter("verdict = 'allow'")
    return kept.select(*[F.col("row")[c].alias(c) for c in pages.columns])
