"""Registry of queries and, where SQL can state them, their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a query. ``digits`` rounds columns in the same way on both sides.

    Sums of doubles differ in the last bits with the order of rows. Rounding half up with a
    little slack sends a value next to a tie the same way in both engines.
    """
    digits = digits or {}

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({
                c: F.floor(F.col(c) * float(10**n) + 0.501) / float(10**n)
                for c, n in digits.items()})

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = sql.strip()
            if digits:
                reps = ", ".join(
                    f'floor("{c}" * 1e{n} + 0.501::DOUBLE) / 1e{n} AS "{c}"'
                    for c, n in digits.items())
                text = f"SELECT * REPLACE ({reps}) FROM ({text}) AS rounded_rows"
            ORACLE[name] = text
        return fn

    return register
