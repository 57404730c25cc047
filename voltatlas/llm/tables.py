"""Intermediate tables in the cluster's shared folder, and reading the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas.session import shared_folder

# Between words: U+0020 and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table below ``spark.checkpoint.dir`` and read it back.

    The table cuts the lineage: later reads survive lost executors and repeat no work.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, compared without regard to case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_struct(docs: DataFrame, carry: Sequence[str]) -> Column:
    """The carried columns as the struct ``row``: inside it, no name can clash with another."""
    return F.struct(*[docs[c].alias(c) for c in carry] or [F.lit(1).alias("_")]).alias("row")


def with_row(docs: DataFrame, carry: Sequence[str], **columns: T.DataType) -> T.StructType:
    """Schema of ``row`` as in ``row_struct``, followed by the given columns."""
    fields = [docs.schema[c] for c in carry] or [T.StructField("_", T.IntegerType())]
    fields = [T.StructField(f.name, f.dataType) for f in fields]
    return T.StructType([
        T.StructField("row", T.StructType(fields)),
        *[T.StructField(name, kind) for name, kind in columns.items()]])
