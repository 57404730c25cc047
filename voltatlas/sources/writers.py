"""Sinks (S3, S5, S7, S8, S14-S16). All write with the executors; ``path`` is a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltatlas.functions.columns import finite


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.withColumns({
        n: finite(n).cast(t) for n, t in df.dtypes if t in ("double", "float")})


def write_lines(df: DataFrame, path: str, line: str = "url",
                partition: str | None = None) -> None:
    """S3: sorted unique lines, one folder for each partition value."""
    if partition is None:
        df.select(line).distinct().orderBy(line).write.mode("overwrite").text(path)
        return
    (
        df.select(partition, line).distinct()
        .repartitionByRange(F.col(partition), F.col(line))
        .sortWithinPartitions(partition, line)
        .write.mode("overwrite").partitionBy(partition).text(path)
    )


def write_page_store(pages: DataFrame, root: str, path: str = "path", content: str = "content") -> None:
    """Many pages to a file, each with its path; a crawl appends what it has fetched.

    One file a page would be as many files to create and to list. Paths that are still to be fetched
    are an anti-join with the store (X16).
    """
    pages.select(F.col(path).alias("path"), F.col(content).alias("content")).write.mode("append").json(root)


def write_json_arrays(df: DataFrame, path: str, keys: Sequence[str], rows_per_file: int = 100_000) -> None:
    """Files with one array of records each, of some ``rows_per_file`` rows.

    Rows are dealt to the files by a hash of their keys, so keys should name a row; a file's rows
    meet in one task, and no task holds more than one group at a time.
    """
    files = max(1, -(-df.count() // rows_per_file))
    group = F.pmod(F.xxhash64(*keys), F.lit(files)).alias("file")
    df.select(group, F.struct(*df.columns).alias("row")).groupBy("file").agg(
        F.to_json(F.collect_list("row")).alias("value")).write.partitionBy("file").text(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Header and a fixed column order."""
    nan_to_null(df).select(*columns).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue='""')


def write_json_records(df: DataFrame, path: str) -> None:
    """One object per line, missing values as explicit nulls."""
    nan_to_null(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def keyed_document(df: DataFrame, key: str, fields: dict[str, Column] | None = None) -> DataFrame:
    """One JSON object with a record for each key, keys in order.

    The document is one value: an export of a mart keyed by a dimension. ``write_json_by_key``
    writes any number of keys with all executors.
    """
    row = F.struct(*([c.alias(n) for n, c in fields.items()] if fields
                     else [c for c in df.columns if c != key]))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), row.alias("value"))))
    return df.where(F.col(key).isNotNull()).agg(
        F.to_json(F.map_from_entries(entries), {"ignoreNullFields": "false"}).alias("document"))


def write_json_by_key(df: DataFrame, path: str, key: str) -> None:
    """The same records as lines of key and value, for any number of keys."""
    others = [c for c in df.columns if c != key]
    nan_to_null(df).select(F.col(key).alias("key"), F.struct(*others).alias("value")).write.mode(
        "overwrite").option("ignoreNullFields", "false").json(path)


def write_model_bundle(model, path: str) -> None:
    """Fitted stages with their scaler and feature list."""
    model.write().overwrite().save(path)


def read_model_bundle(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def write_results_report(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table of the report."""
    for name, df in tables.items():
        write_json_records(df, f"{path}/{name}")


def write_split_by_category(df: DataFrame, path: str, categories: Sequence[str],
                            column: str = "dc_category") -> None:
    """The full table and its chosen categories, in one partitioned write each.

    The rows are computed once and kept for the second write.
    """
    kept = df.persist()
    try:
        kept.write.mode("overwrite").csv(f"{path}/all", header=True, escape='"', emptyValue='""')
        kept.where(F.col(column).isin(*categories)).write.mode("overwrite").partitionBy(column).csv(
            f"{path}/by_category", header=True, escape='"', emptyValue='""')
    finally:
        kept.unpersist()


def read_back(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, escape='"')
