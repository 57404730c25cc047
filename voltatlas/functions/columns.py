"""Column helpers: every function takes and returns a ``Column`` (JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What Python's str.strip() removes; Spark's trim() alone removes blanks only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def exploded(df: DataFrame, keep: Iterable[str], items: Column) -> DataFrame:
    """One row for each element of an array of structs, with the struct's fields as columns.

    The inner generator would have the array computed twice, once more in a filter on its
    size. The outer one computes it once; the row it adds for an empty array is dropped after.
    """
    numbered = F.transform(items, lambda x, i: F.struct(i.alias("position"), x.alias("item")))
    rows = df.select(*keep, F.explode_outer(numbered).alias("_e")).where(F.col("_e").isNotNull())
    return rows.select(*keep, "_e.position", "_e.item.*")


def blank_to_null(c: Column | str, blanks: Iterable[str] = ("",)) -> Column:
    c = col(c)
    return F.when(~c.isin(*blanks), c)


def finite(c: Column | str) -> Column:
    """NaN and infinities become NULL, the only missing value used downstream."""
    d = col(c).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def text_to_number(c: Column | str) -> Column:
    """Plain decimal or exponent notation only; Java would also accept suffixes as in '7d'."""
    s = strip(c)
    return finite(F.when(s.rlike(_NUMBER), s.try_cast("double")))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL for a zero or missing denominator."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """least()/greatest() skip NULLs, so missing values are kept missing explicitly."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def sum0(c: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def published(c: Column | str, digits: int) -> Column:
    """Half-even rounding as in the published files.

    Four digits below are rounded first, so a sum next to a tie does not depend on the order
    in which its parts were added.
    """
    return F.bround(F.round(col(c), digits + 4), digits)


def contains_any(text: Column | str, words: Iterable[str], whole_words: bool = False) -> Column:
    """True if the lower-cased text has any keyword; a missing text has none."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    out = F.lit(False)
    for w in words:
        if whole_words:
            out = out | t.rlike(r"(?<!\w)\Q" + w.strip() + r"\E(?!\w)")
        else:
            out = out | F.contains(t, F.lit(w))
    return out


def url_slug(url: Column | str) -> Column:
    """Last path segment, trailing slashes removed."""
    return F.element_at(F.split(F.rtrim(col(url), F.lit("/")), "/"), -1)


def not_null(*cols: Column | str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & col(c).isNotNull()
    return out


def dtype_of(df: DataFrame, name: str) -> str:
    return dict(df.dtypes)[name]


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, ddl: str, rows: Iterable[tuple]) -> DataFrame:
    """A literal table. It stays a local relation, so its size is known to the optimizer."""
    cols = [part.strip().split() for part in ddl.split(",")]
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    names = ", ".join(f"`{n}`" for n, _ in cols)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in cols])
