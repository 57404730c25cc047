"""Sources (S1, S2, S4, S6, S9-S13)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltatlas import params as p
from voltatlas.functions.columns import blank_to_null, col, strip, text_to_number

FACILITY_SPEC = (
    "data_center_id string, data_center_name string, state string, city string, "
    "latitude double, longitude double, year_operational int, capacity_mw double, "
    "capacity_sqft double"
)
FACILITY_COLUMNS = [c.split()[0] for c in FACILITY_SPEC.split(", ")]
FACILITY_MAP = (
    "name string, state string, city string, year int, capacity_mw double, energy_mwh double, "
    "category string, has_energy_data boolean"
)
_API_RESPONSE = "struct<response: struct<data: array<struct<period: string, sales: string>>>>"


def path_columns(path: Column | str) -> dict[str, Column]:
    """State, city and facility from .../state/<state>/city/<city>/dc/<dc>/<file>.

    Folders of a partitioned write, as in .../state=<state>/city=<city>/..., read the same.
    """
    c = col(path)
    state, city, dc = r"/state[/=]([^/]+)/", r"city[/=]([^/]+)/", r"dc[/=]([^/]+)/"
    up_to_city = state.replace("(", "(?:")
    up_to_dc = up_to_city + city.replace("(", "(?:")
    return {
        "state": blank_to_null(F.regexp_extract(c, state, 1)),
        "city": blank_to_null(F.regexp_extract(c, up_to_city + city, 1)),
        "dc": blank_to_null(F.regexp_extract(c, up_to_dc + dc, 1)),
    }


def read_pages(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """One row for each stored page, with directory levels as columns."""
    pages = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return (
        pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
        .withColumns(path_columns("path"))
        .select("path", "state", "city", "dc", "content")
    )


def read_page_store(spark: SparkSession, root: str) -> DataFrame:
    """Pages packed into few files by ``writers.write_page_store``, in the columns of ``read_pages``."""
    pages = spark.read.json(root, schema="path string, content string")
    return pages.withColumns(path_columns("path")).select("path", "state", "city", "dc", "content")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that are not blank."""
    return spark.read.text(path).select(strip("value").alias("line")).where(F.col("line") != "")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str,
             multi_line: bool = False) -> DataFrame:
    """Header row, explicit schema; an empty cell or one of another type is missing.

    Quotes are doubled inside quoted cells. Files stay splittable unless cells hold line breaks.
    """
    return spark.read.csv(
        path, header=True, schema=schema, quote='"', escape='"', mode="PERMISSIVE",
        enforceSchema=True, multiLine=multi_line)


def read_json_records(spark: SparkSession, path: str | Sequence[str], schema: str,
                      one_array: bool = True) -> DataFrame:
    """Flat records, as one array per file or one record per line; folder names add no columns."""
    found = spark.read.json(path, schema=schema, multiLine=one_array)
    return found.select(*T.StructType.fromDDL(schema).names)


def flatten_api_response(df: DataFrame, body: str = "body", keep: Sequence[str] = ("state",),
                         factor: float = 1000.0) -> DataFrame:
    """Landed responses to (state, year, MWh); records without sales drop out.

    Sales come in million kWh, so the factor to MWh is 1000.
    """
    doc = F.from_json(F.col(body), F.lit(_API_RESPONSE))
    return (
        df.select(*keep, F.explode(doc["response"]["data"]).alias("r"))
        .select(*keep, F.col("r.period").try_cast("int").alias("year"),
                (text_to_number(F.col("r.sales")) * factor).alias("total_consumption_mwh"))
        .where(F.col("year").isNotNull() & F.col("total_consumption_mwh").isNotNull())
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def first_available(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, on any file system Spark can reach."""
    for path in paths:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(paths)} exists")


def rename_by_position(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """New names by position, negative ones from the end; the rest keep theirs."""
    n = len(df.columns)
    wanted = {(i + n if i < 0 else i): name for i, name in names.items() if -n <= i < n}
    return df.toDF(*[wanted.get(i, c) for i, c in enumerate(df.columns)])


def rename_all(df: DataFrame, names: Sequence[str] = tuple(p.SALES_COLUMNS)) -> DataFrame:
    """The full list of names; columns beyond it keep theirs."""
    return rename_by_position(df, dict(enumerate(names[: len(df.columns)])))


def drop_non_data_rows(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows whose year is a number."""
    return df.where(text_to_number(F.col(year).cast("string")).isNotNull())


def union_years(frames: dict[int, DataFrame | None], year: str = "year") -> DataFrame:
    """Yearly tables, each stamped with its year; absent years are skipped."""
    parts = [df.withColumn(year, F.lit(y)) for y, df in frames.items() if df is not None]
    if not parts:
        raise ValueError("no year has data")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
