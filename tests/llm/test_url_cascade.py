import numpy as np
import pytest
from pyspark.sql import functions as F

from voltatlas.llm import url_cascade as uc

URLS = [
    None, "", "no scheme", "http://", "https://A.Example.COM/en/1?x#y", "http://example.com", "http://example.com?x=/en/",
    "http://www.example.com/en/a", "http://deep.www.example.com/en/a", "http://xexample.com/en/", "http://a.net/es/x",
    "http://a.net/other", "http://b.net/other", "http://net/fr/", "http://a.b.net/fr/q#z", "http://a.b.net/", "ftp://c.org/es/",
    "http://c.org/a://b.net/es/", "//d.net/es/", "http://a.net/other", "http://" + "x" * 30_000 + ".net/fr/"]


def expected(urls):
    parts = []
    for u in urls:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        best = None
        for r in uc.RULES:
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path):
                best = r if best is None or len(r.text) > len(best.text) else best
        parts.append((host, path, best))
    blocked = {h for h, _, r in parts if r and r.verdict == "block"}
    return [(h, p, r.text if r else None, r.verdict if r else "block" if h in blocked else "allow") for h, p, r in parts]


@pytest.mark.parametrize(("limit", "keys", "rows"), [
    (uc.MAX_FILTER_BYTES, uc.PART_KEYS, uc.UNIT_ROWS), (0, uc.PART_KEYS, uc.UNIT_ROWS), (0, 3, 1)])
def test_every_url(spark, monkeypatch, limit, keys, rows):
    """By a broadcast cascade, and by one cut into parts to which the rows travel."""
    for name, value in (("MAX_FILTER_BYTES", limit), ("PART_KEYS", keys), ("UNIT_ROWS", rows)):
        monkeypatch.setattr(uc, name, value)
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(URLS)], "page_id long, url string, host int, rule string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in uc.judge_urls(pages).collect()}
    assert got == dict(enumerate(expected(URLS)))
    kept = uc.allowed(pages)
    assert kept.schema.names == pages.schema.names
    assert kept.count() == sum(v == "allow" for *_, v in expected(URLS))
    assert uc.judge_urls(pages.limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(40_000).select(
        F.concat(F.lit("host"), "id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(7)) == 0).alias("listed"))
    cascade = uc.build_cascade(universe, "k", "listed")
    h = universe.select(*[c.alias(n) for c, n in zip(uc._key_hashes(F.col("k")), ("a", "b"), strict=True)], "listed").toPandas()
    assert len(cascade.levels) > 1
    assert np.array_equal(cascade.listed(h["a"].to_numpy(), h["b"].to_numpy()), h["listed"].to_numpy())
    first = cascade.passes(0, h["a"].to_numpy(), h["b"].to_numpy())
    assert first[h["listed"]].all() and 0 < first[~h["listed"]].mean() < 0.05


def test_parts_are_exact_and_no_larger_than_their_keys(spark):
    universe = spark.range(40_000).select(
        F.concat(F.lit("host"), "id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("listed"))
    h1, h2 = uc._key_hashes(F.col("k"))
    keys = universe.select(uc._part(F.col("k"), 5).alias("part"), h1.alias("a"), h2.alias("b"), "listed").toPandas()
    parts = {r["part"]: r["levels"] for r in uc.build_parts(universe, "k", "listed", 5).collect()}
    assert set(parts) == set(range(5))
    for part, own in keys.groupby("part"):
        cascade = uc.Cascade(tuple(np.frombuffer(x, np.uint8) for x in parts[part]))
        assert len(cascade.levels) > 1
        assert np.array_equal(cascade.listed(own["a"].to_numpy(), own["b"].to_numpy()), own["listed"].to_numpy())
        assert cascade.size_bytes < 9 / 8 * (own["listed"].sum() + len(own) / 32) + 100


def test_a_hot_host_is_dealt_out(spark, monkeypatch):
    """Rows of one url go to several units of its part, each with the cascade."""
    monkeypatch.setattr(uc, "MAX_FILTER_BYTES", 0)
    monkeypatch.setattr(uc, "UNIT_ROWS", 50)
    urls = ["http://hot.net/x"] * 900 + ["http://hot.net/es/", "http://cold.net/x", None] * 3
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.row.page_id: r.verdict for r in uc.judge_urls(pages).collect()}
    assert got == {i: v for i, (*_, v) in enumerate(expected(urls))}
    assert sum(v == "block" for v in got.values()) == 903
