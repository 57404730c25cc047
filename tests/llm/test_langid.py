import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward, awkward_rows, empty
from voltatlas.llm import langid
from voltatlas.llm.queries import QUERIES


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 40):
        codes = langid.codewords(n)
        assert codes.shape[0] == n and (np.abs(codes.sum(axis=0)) < n).all()
        distance = (codes.shape[1] - codes @ codes.T) / 2
        assert distance[~np.eye(n, dtype=bool)].min() >= (1 if n < 4 else 4)
    assert langid.codewords(4).shape == (4, 7)


def test_flipped_bits_are_corrected():
    """A margin of the wrong sign in one bit leaves the codeword nearest."""
    codes = langid.codewords(4)
    model = langid.Model(tuple("abcd"), codes, np.eye(langid.BUCKETS, 7), np.zeros(7), np.full(7, 1 / 7))
    x = np.zeros((4, langid.BUCKETS))
    x[:, :7] = codes
    x[np.arange(4), [0, 3, 5, 6]] *= -1
    assert model.losses(x).argmin(axis=1).tolist() == [0, 1, 2, 3]


def test_held_out_accuracy(spark, sf):
    path = f"{sf.rsplit('/', 1)[0]}/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language_id"](spark, path).join(docs, "doc_id").filter("held_out and lang is not null")
    hit, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and hit >= 0.97


def test_awkward_rows(spark):
    docs = awkward(spark)
    model = langid.train(docs, F.lit(True))
    assert set(model.languages) <= {"en", "fr", "de", "zz"}
    got = langid.predict(docs, model).collect()
    assert len(got) == len(awkward_rows())
    by = {r.row.doc_id: r for r in got}
    for i, t, *_ in awkward_rows():
        assert 0.0 <= by[i].score <= 1.0
        if t is None or not any(c.isalpha() for c in t):
            assert (by[i].lang_pred, by[i].score, by[i].ambiguous) == ("und", 0.0, True)
        elif i is not None:
            assert by[i].lang_pred in model.languages
    assert langid.predict(empty(spark), model).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "12", "de")], "doc_id long, text string, lang string")
    none = langid.train(docs, F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    one = langid.train(docs.withColumn("lang", F.lit("en")), F.lit(True))
    assert {r.row.doc_id: r.lang_pred for r in langid.predict(docs, one).collect()} == {1: "en", 2: "und", 3: "und"}


def test_a_text_in_parts_counts_like_the_whole():
    texts = ["Straße und Öl " * 40, "a", "", "the lamp", "é\u0130x\nQ9 z"]
    whole, n = langid.features(texts)
    for i, t in enumerate(texts):
        own, m = langid.features([t])
        assert np.allclose(own[0], whole[i]) and m[0] == n[i]


def _plain_vector(text):
    """Square roots of hashed n-gram counts of one text, character by character."""
    import unicodedata

    clean, last = [], " "
    for c in text.lower():
        c = c if unicodedata.category(c).startswith("L") else " "
        if c != " " or last != " ":
            clean.append(c)
        last = c
    x, m = np.zeros(langid.BUCKETS), 1 << 32
    codes = [32, *map(ord, clean), 32]
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b == 32:
            continue
        for h in (b * 0x9E3779B1, (a * 0x85EBCA77 + b) * 0xC2B2AE3D,
                  (((a * 0x27D4EB2F + b) % m * 0x165667B1 + c) % m) * 0x9E3779B1):
            x[h % m >> 20] += 1
    x = np.sqrt(x)
    return x / max(np.linalg.norm(x), 1e-12), codes


def test_fit_and_decoding_against_plain_ones(spark):
    """The chosen texts, the bits' ridge classifiers and the decoding, each by its definition."""
    import xxhash

    rows = [(r[0], r[1], r[2]) for r in awkward_rows()] * 2
    rows += [(1_000 + i, "shared words of one large group of copies", "fr") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, F.lit(True), max_rows=16)
    names = sorted({lang for _, t, lang in rows if lang and t and any(c.isalpha() for c in t)})
    assert list(model.languages) == names
    chosen = []
    for lang in names:
        texts = {t for _, t, v in rows if v == lang and t and any(c.isalpha() for c in t)}
        by_hash = sorted(texts, key=lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42)))
        chosen += [(t, lang) for t in by_hash[:16 // len(names)]]
    x = np.array([_plain_vector(t)[0] for t, _ in chosen]).astype(np.float32).astype(np.float64)
    at = np.array([names.index(v) for _, v in chosen])
    w = 1 / np.bincount(at)[at]
    w = w / w.mean()
    y = langid.codewords(len(names))[at]
    # The ridge with an intercept by its normal equations over the buckets.
    ones = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.eye(ones.shape[1]) * langid.RIDGE * len(x) / 100
    penalty[-1, -1] = 0
    solved = np.linalg.solve(ones.T @ (w[:, None] * ones) + penalty, ones.T @ (w[:, None] * y))
    margins = ones @ solved
    scale = 1 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)
    assert np.allclose(model.weights, solved[:-1] * scale, atol=1e-5) and np.allclose(model.bias, solved[-1] * scale, atol=1e-5)
    for r in langid.predict(docs, model).select("row.doc_id", "lang_pred", "score").distinct().collect():
        text = next((t for i, t, _ in rows if i == r.doc_id), None)
        if text is None or not any(c.isalpha() for c in text) or r.doc_id is None:
            continue
        m = np.clip(_plain_vector(text)[0] @ model.weights + model.bias, -1, 1)
        losses = [sum(t * (1 - a * b) / 2 for t, a, b in zip(model.trust, m, code)) for code in model.codes]
        assert abs(r.score - (1 - min(losses))) < 1e-6 and losses[names.index(r.lang_pred)] < min(losses) + 1e-9


def test_three_hundred_languages(spark):
    rng = np.random.default_rng(5)
    words = {f"l{i:03}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for i in range(300)}
    rows = [(k, " ".join(rng.choice(v, 30)), k) for k, v in words.items() for _ in range(4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string").repartition(4)
    model = langid.train(docs, F.lit(True))
    assert len(model.languages) == 300 and len({tuple(c) for c in model.codes}) == 300
    got = langid.predict(docs, model).collect()
    assert np.mean([r.row.doc_id == r.lang_pred for r in got]) > 0.9
