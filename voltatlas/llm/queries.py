"""The operators of this package bound to the given tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltatlas.llm import (
    exact_dedup, langid, line_dedup, minhash, mixing, oracles, pii, prefix_trie, quality, resample, secret_scan,
    sentencepieces, token_counts, url_cascade,
)
from voltatlas.llm.tables import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(documents(spark, sf_dir), words=3, percent=85)
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op2_mixing", oracles.MIXING)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir))
    return counted.select(
        F.col("row.doc_id").alias("doc_id"), "section", F.col("start").alias("section_start"),
        F.col("end").alias("section_end"), "n_tokens", "n_crossing")


@query("op4_url_filters", oracles.URLS)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_cascade.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select(
        F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query("op5_quality_rules", oracles.QUALITY)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(documents(spark, sf_dir), carry=["doc_id"])
    return judged.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept")


def joined_spans(spans: str = "spans") -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256",
        joined_spans().alias("spans"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = langid.train(docs, ~held_out)
    return langid.predict(docs, model).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.pmod(F.crc32(F.col("row.doc_id").cast("string").cast("binary")), F.lit(5)) == 0).alias("held_out"),
        "lang_pred", "score", "ambiguous")


@query("op8_sentencepieces")
def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(documents(spark, sf_dir), decoded=False)
    return encoded.select(
        F.col("row.doc_id").alias("doc_id"), F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids", "round_trip")


@query("op9_exact_dedup", oracles.EXACT_DEDUP)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.find_personal_data(docs, pii.train(docs))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        joined_spans().alias("spans"))


@query("op11_line_dedup", oracles.LINES)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = line_dedup.kept_text(docs, line_dedup.line_bitmaps(docs))
    return kept.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_importance_resampling", oracles.RESAMPLE)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("row.doc_id", "n_features", "weight", "score", "rank")


@query("op13_prefix_trie", oracles.TRIE)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.trie_nodes(prefix_trie.rebuilt(prefix_trie.conversation_rows(turns)))
