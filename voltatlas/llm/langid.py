"""Language identification with error-correcting output codes.

Each language has a codeword of bits. For every bit, a linear classifier over hashed character
n-grams (a ridge fit to -1 and +1 on normalised n-gram vectors) predicts that bit. A text gets the
language whose codeword has the smallest loss: the hinge loss of each bit's margin, weighted by
how well that bit is predicted on the training rows. A lead over the second language below
``AMBIGUOUS`` of the loss range is flagged.

The fit uses at most ``MAX_ROWS`` distinct labelled texts (one of each language if there are more
languages than that), shared evenly among the languages and chosen by a hash of the text. Their
n-gram vectors, a fixed number of counts, are computed by Spark from whole texts; the driver
solves a system of that many rows. Every text is then scored in whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.llm.tables import row_struct, stored, with_row

MAX_ROWS = 2_000  # labelled rows of a fit
BUCKETS = 4_096  # of hashed n-grams
RIDGE = 0.01
AMBIGUOUS = 0.1
UNKNOWN = "und"
_SLICE_CHARS, _SLICE_ROWS = 1 << 20, 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


def _grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (1 to 3 characters) of each text, and its number of letters.

    Letters are lower-cased, each run of other characters is one space.
    """
    lowered = [t.lower() for t in texts]
    code = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in lowered], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[code]
    keep = letter | np.concatenate(([True], letter[:-1])) if len(code) else letter
    code, row, letter = np.where(letter, code, 32)[keep].astype(np.uint32), row[keep], letter[keep]
    before = np.concatenate(([32], code[:-1])).astype(np.uint32) if len(code) else code
    before[np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))[: len(code)]] = 32
    after = np.concatenate((code[1:], [32])).astype(np.uint32)
    counts = np.zeros(len(texts) * BUCKETS)
    shift = np.uint32(32 - 12)
    for one in (
        code * np.uint32(0x9E3779B1),
        (before * np.uint32(0x85EBCA77) + code) * np.uint32(0xC2B2AE3D),
        ((before * np.uint32(0x27D4EB2F) + code) * np.uint32(0x165667B1) + after) * np.uint32(0x9E3779B1),
    ):
        at = row[letter] * BUCKETS + (one[letter] >> shift)
        counts += np.bincount(at, minlength=len(counts))
    return counts.reshape(len(texts), BUCKETS), np.bincount(row[letter], minlength=len(texts))


def features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the square roots of the n-gram counts, and the numbers of letters."""
    counts, letters = _grams(texts)
    rooted = np.sqrt(counts)
    return rooted / np.maximum(np.linalg.norm(rooted, axis=1, keepdims=True), 1e-12), letters


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Rows of -1 and +1, one for each language; no column is constant or a copy of another.

    Up to 5 languages have all their distinct splits as columns. Above that, of 200 random
    matrices with 15 columns for each doubling, the one with the largest least distance of rows.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 5:
        splits = [[1 if (s >> k) & 1 else -1 for k in range(languages)] for s in range(1, 2 ** (languages - 1))]
        return np.array(splits, dtype=float).T
    rng = np.random.default_rng(seed)
    best, best_distance = None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (languages, 15 * int(np.ceil(np.log2(languages)))))
        m = np.unique(m * m[0], axis=1)
        m = m[:, np.abs(m.sum(axis=0)) < languages]
        apart = (m.shape[1] - m @ m.T) / 2 + np.eye(languages) * m.shape[1]
        if apart.min() > best_distance:
            best, best_distance = m, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss, summing to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted hinge loss of each language's codeword, in [0, 1]."""
        margins = np.clip(x @ self.weights + self.bias, -1.0, 1.0)
        return sum(
            self.trust[b] * (1.0 - margins[:, [b]] * self.codes[None, :, b]) / 2.0
            for b in range(self.codes.shape[1]))

    def predict(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score in [0, 1] and ambiguity; ``und``, 0 and true without letters."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        x, letters = features([t or "" for t in texts])
        losses = self.losses(x)
        order = np.argsort(losses, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = losses[rows, order[:, 0]]
        second = losses[rows, order[:, 1]] if len(self.languages) > 1 else np.ones(len(texts))
        known = letters > 0
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(order[:, 0], known, strict=True)]
        score = np.where(known, np.clip(1.0 - best, 0.0, 1.0), 0.0)
        return names, score, ~known | (second - best < AMBIGUOUS)


def fit(x: np.ndarray, labels: Sequence[str]) -> Model:
    """Ridge classifiers of the bits, solved over the rows (there are fewer of them than needed
    for a system over the buckets); every language weighs the same."""
    languages = tuple(sorted(set(labels)))
    codes = codewords(len(languages))
    if len(languages) < 2:
        n = codes.shape[1]
        return Model(languages, codes, np.zeros((BUCKETS, n)), np.ones(n), np.full(n, 1.0 / n))
    at = np.array([languages.index(v) for v in labels])
    weight = 1.0 / np.bincount(at)[at]
    weight /= weight.mean()
    y = codes[at]
    mean, target = np.average(x, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    x = x - mean
    dual = np.linalg.solve(x @ x.T + np.diag(RIDGE * len(x) / 100.0 / weight), y - target)
    weights = x.T @ dual
    # Targets of the fit are shrunk by the ridge; margins are brought back to a spread of 1.
    bias = target - mean @ weights
    margins = x @ weights + target
    scale = 1.0 / np.maximum(np.median(np.abs(margins), axis=0), 1e-6)
    hit = np.average((np.sign(margins) == y), axis=0, weights=weight)
    trust = np.maximum(2.0 * hit - 1.0, 1e-3)
    return Model(languages, codes, weights * scale, bias * scale, trust / trust.sum())


def train(
    docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang",
    max_rows: int = MAX_ROWS,
) -> Model:
    """Fit on at most ``max_rows`` distinct texts that are ``usable`` and have a label and a letter.

    Each label has a codeword and gets an even share, one text at least: those whose hashes are
    lowest (the same in every run). Copies of a text count once. One pass finds the hashes, each
    task sending a share of each label at most; one pass computes the vectors of the chosen texts.
    """
    rows = docs.filter(
        usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("h"))
    hashes = stored(rows.select("lang", "h").distinct(), "lang-hashes")
    languages = hashes.agg(F.count_distinct("lang")).first()[0]
    if not languages:
        return Model((), np.ones((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1))
    share = max(1, max_rows // languages)
    chosen = stored(
        hashes.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("place") <= share).select("lang", "h"), "lang-chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # of chosen texts: a task sends each of them once
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True))
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            for i in range(0, len(new), 64):
                part = batch.take(pa.array(new[i:i + 64]))
                x, _ = features(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("h"),
                     pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["lang", "h", "x"])

    # As many rows as the fit takes: the bound of what is broadcast and of what comes to the driver.
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", "text").mapInArrow(
        run, "lang string, h long, x binary").groupBy("lang", "h").agg(F.first("x").alias("x"))
    sample = found.toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    x = np.empty((sample.num_rows, BUCKETS))
    for i, v in enumerate(sample.column("x")):
        x[i] = np.frombuffer(v.as_buffer(), dtype=np.float32)
    labels = sample.column("lang").to_pylist()
    del sample
    return fit(x, labels)


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t or "") > _SLICE_CHARS or i - start >= _SLICE_ROWS):
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def predict(
    docs: DataFrame, model: Model, text_col: str = "text", carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (carried columns), ``lang_pred, score, ambiguous``.

    Only the text is an input. NULL texts and texts without letters are ``und`` with score 0, and
    so is every text if nothing was learned. Texts of any length are scored in whole; equal texts
    get equal results; of languages with the same loss the first by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _runs(texts):
                names, score, ambiguous = shared.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.array(names, pa.string()),
                     pa.array(score), pa.array(ambiguous)],
                    names=["row", "lang_pred", "score", "ambiguous"])

    return docs.select(row_struct(docs, carry), docs[text_col].alias("text")).mapInArrow(
        run, with_row(docs, carry, lang_pred=T.StringType(), score=T.DoubleType(), ambiguous=T.BooleanType()))
