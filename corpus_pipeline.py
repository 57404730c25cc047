"""A training-corpus pipeline over ``documents``: stages, each written and read again."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltatlas.llm import exact_dedup, minhash, mixing, quality, sentencepieces
from voltatlas.llm.tables import documents, stored
from voltatlas.session import remove, written

_before: list[str] = []  # folders that the stage before has written for itself


def stage(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first deletes what the stage before it has left in the shared folder.

    That stage's result is on disk by then, as stages are written and read again. Folders that
    ``docs`` still reads (a result passed on unwritten) stay.
    """

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = [f for f in written() if f in _before]
        if known:
            read = docs.inputFiles()
            remove(spark, [f for f in known if not any(f"{f}/" in x for x in read)])
        mine = set(written())
        out = fn(spark, docs, sf_dir)
        _before[:] = [f for f in written() if f not in mine or f in known]
        return out

    return run


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs)


@stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each normalised text."""
    return exact_dedup.drop_exact_duplicates(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares 80 of 100 five-word shingles, or more."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


@stage
def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


@stage
def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    carry = ["doc_id", "lang", "source"]
    encoded = sentencepieces.encode(docs, carry=carry, decoded=False)
    return encoded.select(
        *[F.col("row")[c].alias(c) for c in carry],
        F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("mixing", mixing_to_targets),
    ("sentence_pieces", sentence_pieces),
]

ORACLE_SQL = None  # near duplicates and pieces cannot be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, step in STAGES[:-1]:
        docs = stored(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before:  # the stage's input: its successor is on disk
            remove(spark, [before])
        before = written()[-1]
        _before[:] = [f for f in _before if f != before]
    return STAGES[-1][1](spark, docs, sf_dir)
