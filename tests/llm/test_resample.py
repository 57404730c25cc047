import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features(text):
    ws = words(text)
    return [" ".join(ws[i:i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def counts(texts, buckets=10_000):
    out = Counter()
    for t in texts:
        out.update(zlib.crc32(f.encode()) % buckets for f in features(t))
    return out


def plain(rows, target):
    s, t = counts(x for _, x in rows), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0))))
            for b in range(10_000)]
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % 10_000] for f in features(text))
        draw = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(words(text)), len(features(text)), weight, weight + draw))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = Counter()
    for k, r in enumerate(able[:5 * len(able) // 100]):
        rank[(*r, k + 1)] += 1
    drawn = Counter(able[:5 * len(able) // 100])
    for r, n in (Counter(out) - drawn).items():
        rank[(*r, None)] += n
    return rank


def found(docs, target):
    got = resample.resample(docs, target)
    return Counter(tuple(r) for r in got.select("row.doc_id", "n_words", "n_features", "weight", "score", "rank").collect())


def test_crc_of_sequences():
    rng = random.Random(3)
    lines = [" ".join("".join(rng.choice("abzé日09") for _ in range(rng.choice([1, 2, 7, 31, 32, 33, 90, 400])))
                      for _ in range(rng.randrange(6))) for _ in range(60)] + ["", "   ", "A-b_C", "\x00\x7fx\x80y"]
    crc, size, first = resample.words_of([x.encode() for x in lines])
    line, bucket = resample.inner_features(first, resample.n_gram_buckets(crc, size, 10_000))
    got = Counter(zip(line.tolist(), bucket.tolist()))
    assert got == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, x in enumerate(lines) for f in features(x))
    assert np.diff(first).tolist() == [len(words(x)) for x in lines]


def test_counts_with_crossing_features(spark):
    rng = random.Random(4)
    pool = ["one", "a b", "x y z", "p q r s", "k l m n o", "", " -- ", "repeated line of a few words", "é 日本"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(9))) for _ in range(300)] + [None, "", "\n\n"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for buckets in (10_000, 7):
        got = {r.bucket: r.n for r in resample.bucket_counts(docs, buckets=buckets).collect()}
        assert got == dict(counts(texts, buckets))


def test_awkward_rows(spark):
    target = ["the river and the stone", None, "cloud lamp on\nit"]
    rows = [(r[0], r[1]) for r in awkward_rows()]
    assert found(awkward(spark), spark.createDataFrame([(t,) for t in target], "text string")) == plain(rows, target)


def test_ranks_over_many_ranges_with_ties(spark):
    rng = random.Random(5)
    pool = [" ".join(rng.choice("stone river cloud lamp the of".split()) for _ in range(20)) for _ in range(3)]
    rows = [(i // 2, rng.choice(pool)) for i in range(1_500)] + [(None, pool[0])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(pool[1],)], "text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(docs, target) == plain(rows, [pool[1]])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_very_long_text(spark):
    text = "word " * 200_000 + "\n" + "x" * 300_000 + " " * 300_000 + "\nend"
    rows = [(1, text), (2, "a " * 30)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"),
                 spark.createDataFrame([("word",)], "text string")) == plain(rows, ["word"])


def test_empty_tables(spark):
    docs = empty(spark)
    target = docs.select(F.col("text"))
    assert not found(docs, target)
    rows = [(1, "a b c"), (2, "d")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), target) == plain(rows, [])
