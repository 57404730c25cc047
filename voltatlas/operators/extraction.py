"""From crawled pages to facility listings and specs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltatlas import params as p
from voltatlas.functions.columns import blank_to_null, col, exploded, strip
from voltatlas.operators.cleaning import first_per_key

# (?d): only \n ends a line; (?iU): case and Unicode classes, as in the page patterns' origin.
_JSON_PATTERN = "(?d)" + p.EMBEDDED_JSON_PATTERN
_ANY_CASE = "(?iU)"

_LISTING_FIELDS = ["name", "companyname", "address", "postal", "city", "state", "country", "link",
                   "url"]
_LISTING_SCHEMA = (
    "struct<props: struct<pageProps: struct<mapdata: struct<dcs: array<struct<properties: struct<"
    + ", ".join(f"{f}: string" for f in _LISTING_FIELDS)
    + ">>>>>>>"
)


def valid_pages(df: DataFrame, content: str = "content", spec_pages: bool = False) -> DataFrame:
    """Pages that were not cut off by a rate limit (spec pages: nor by a check page)."""
    out = df.where(~F.contains(F.col(content), F.lit(p.RATE_LIMIT_MARKER)))
    if spec_pages:
        out = out.where(~F.contains(F.col(content), F.lit(p.CHECKPOINT_MARKER)))
    return out


def embedded_text(content: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(content), _JSON_PATTERN, 1))


def embedded_json(df: DataFrame, content: str = "content", out: str = "doc") -> DataFrame:
    """The page's data as a variant; pages without any, or with broken JSON, drop out."""
    # The generator keeps the optimizer from parsing once more in the filter.
    parsed = F.explode(F.array(F.try_parse_json(embedded_text(content))))
    return df.select("*", parsed.alias(out)).where(F.col(out).isNotNull())


def explode_listings(df: DataFrame, content: str = "content",
                     keep: Sequence[str] = ("path",)) -> DataFrame:
    """One row for each listed facility and its position; missing fields are ''.

    A page without data, or with broken JSON, has no rows.
    """
    dcs = F.from_json(embedded_text(content), F.lit(_LISTING_SCHEMA))[
        "props"]["pageProps"]["mapdata"]["dcs"]
    listed = F.transform(dcs, lambda dc: F.struct(*[
        F.coalesce(dc["properties"][f], F.lit("")).alias(f) for f in _LISTING_FIELDS]))
    return exploded(df, keep, listed).withColumnRenamed("companyname", "company")


def listing_urls(listings: DataFrame, base_url: str) -> DataFrame:
    """X4."""
    return listings.where((F.col("url") != "") & (F.col("name") != "")).withColumn(
        "specs_url", F.concat(F.lit(base_url), F.col("url"), F.lit("specs/")))


def detail_record(df: DataFrame, doc: str = "doc", keep: Sequence[str] = ()) -> DataFrame:
    """A spec page's facility as one flat row; pages without a facility drop out."""
    def get(path: str, kind: str = "string") -> Column:
        return F.try_variant_get(F.col(doc), "$.props.pageProps.dc." + path, kind)

    dc = F.try_variant_get(F.col(doc), "$.props.pageProps.dc", "string")
    fields = {
        "data_center_id": ("link", "string"),
        "data_center_name": ("name", "string"),
        "state": ("state", "string"),
        "city": ("city", "string"),
        "latitude": ("latitude", "double"),
        "longitude": ("longitude", "double"),
        "year_operational": ("meta_building.year_operational", "int"),
        "capacity_mw": ("meta_capacity.mw_builtout", "double"),
        "capacity_sqft": ("meta_capacity.whitespace_builtout", "double"),
    }
    return df.where(dc.isNotNull() & (dc != "{}")).select(
        *keep, *[get(path, kind).alias(name) for name, (path, kind) in fields.items()])


def _first_cell(content: Column, patterns: Sequence[str]) -> Column:
    """First pattern with a usable match; each pattern gives its first match only."""
    return F.coalesce(*[
        blank_to_null(strip(F.regexp_extract(content, _ANY_CASE + x, 1)), p.CELL_SENTINELS)
        for x in patterns])


def extract_capacity_and_year(df: DataFrame, content: str = "content") -> DataFrame:
    """``capacity`` and ``operational_date`` as text, NULL when not given.

    In order: a page that says no data was supplied has neither; blocked pages drop out; a
    page with readable data is taken at its word, also when it has no value; any other page
    is searched with the table patterns, then with the key patterns.
    """
    c = F.col(content)
    no_data = F.contains(c, F.lit(p.NO_DATA_MARKER))
    blocked = F.contains(c, F.lit(p.RATE_LIMIT_MARKER)) | F.contains(
        c, F.lit(p.CHECKPOINT_MARKER))
    rows = df.where(no_data | ~blocked).withColumn("_json", embedded_text(c)).withColumn(
        "_doc", F.try_parse_json("_json"))

    def given(path: str) -> Column:
        """The value as written; a numeric zero is no value, a text is left to the sentinels."""
        path = "$.props.pageProps.dc." + path
        text = F.get_json_object("_json", path)
        kind = F.schema_of_variant(F.try_variant_get("_doc", path, "variant"))
        zero = (kind != "STRING") & text.rlike(r"^-?0(\.0+)?$")
        return F.when(~F.coalesce(zero, F.lit(False)), blank_to_null(text, p.JSON_SENTINELS))

    power_key = blank_to_null(
        strip(F.regexp_extract(c, p.CAPACITY_KEY_PATTERN, 1)), p.POWER_KEY_SENTINELS)
    year_key = blank_to_null(F.regexp_extract(c, p.YEAR_KEY_PATTERN, 1))
    readable = F.col("_doc").isNotNull()
    return rows.withColumns({
        "capacity": F.when(no_data, F.lit(None))
        .when(readable, F.concat(given("meta_power.totalmw"), F.lit(" MW")))
        .otherwise(F.coalesce(_first_cell(c, p.CAPACITY_PATTERNS), power_key)),
        "operational_date": F.when(no_data, F.lit(None))
        .when(readable, given("meta_building.year_operational"))
        .otherwise(F.coalesce(_first_cell(c, p.YEAR_PATTERNS), year_key)),
    }).drop("_doc", "_json")


def extract_state_links(df: DataFrame, base_url: str, root: str = "/usa/",
                        content: str = "content") -> DataFrame:
    """Distinct absolute links below the country, without the country page."""
    links = F.regexp_extract_all(F.col(content), F.lit(f'href="({root}[^"]+)"'), F.lit(1))
    return (
        df.select(F.explode(links).alias("link"))
        .where(F.col("link") != root)
        .distinct()
        .select(F.concat(F.lit(base_url), F.col("link")).alias("url"))
    )


def extract_city_links(df: DataFrame, base_url: str, root: str = "/usa/",
                       content: str = "content", state: str = "state") -> DataFrame:
    """Distinct absolute links below the page's own state, without quote pages."""
    links = F.regexp_extract_all(F.col(content), F.lit(f'href="({root}[^"]+)"'), F.lit(1))
    prefix = F.concat(F.lit(root), F.col(state), F.lit("/"))
    parts = F.size(F.split(F.rtrim(F.col("link"), F.lit("/")), "/"))
    return (
        df.select(F.col(state), F.explode(links).alias("link"))
        .where(F.startswith("link", prefix) & (F.length("link") > F.length(prefix)))
        .where(~F.contains(F.col("link"), F.lit("/quote")) & (parts >= 4))
        .distinct()
        .select(state, F.concat(F.lit(base_url), F.col("link")).alias("url"))
    )


def pending_urls(urls: DataFrame, stored: DataFrame, url: str = "url",
                 content: str = "content") -> DataFrame:
    """The crawl frontier: URLs without a valid stored page."""
    done = valid_pages(stored, content, spec_pages=True).select(url)
    return urls.join(done, url, "left_anti")


def dedupe_listings(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The first row for each (name, address) in an explicit order."""
    return first_per_key(df, ["name", "address"], order)


def attach_specs(listings: DataFrame, specs: DataFrame, order: Sequence[Column | str],
                 link: str = "link", spec_link: str = "dc_link") -> DataFrame:
    """Specs by link; of several specs the last wins, none at all stays missing."""
    last = first_per_key(specs, [spec_link], order, last=True).select(
        F.col(spec_link).alias("_link"), "capacity", "operational_date")
    return listings.join(last, F.col(link) == F.col("_link"), "left").drop("_link")


def extraction_audit(df: DataFrame, pages: DataFrame, keys: Sequence[str] = ("name", "address"),
                     content: str = "content") -> DataFrame:
    """Totals over extracted rows, and the pages that were skipped as blocked.

    Distinct rows are counted over key groups, so no distinct set is held in one task.
    """
    groups = df.groupBy(*[F.struct(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("capacity").alias("c"),
        F.count("operational_date").alias("d"))
    blocked = F.contains(F.col(content), F.lit(p.RATE_LIMIT_MARKER)) | F.contains(
        F.col(content), F.lit(p.CHECKPOINT_MARKER))
    skipped = pages.agg(
        F.count_if(blocked & ~F.contains(F.col(content), F.lit(p.NO_DATA_MARKER)))).scalar()
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(F.lit(1)).alias("unique_rows"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("with_capacity"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("with_date"),
    ).withColumn("skipped", skipped)


def restore_missing_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The files mark missing specs with a text; used right before a sink."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(p.MISSING_TEXT)) for c in cols})
