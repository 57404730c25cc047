"""S1-S16, bound to the given tables.

Sink queries write the rows to a fresh path in the shared folder and return what a reader
finds there, so they cover the source of the same format as well.
"""

from pyspark.sql import functions as F

from voltatlas.operators import aggregates as agg
from voltatlas.operators import cleaning, joins, models, panel
from voltatlas.plans import marts
from voltatlas.queries import base
from voltatlas.queries.panel import _OPENINGS
from voltatlas.queries.base import sql, table
from voltatlas.queries.pages import SITE, city_pages, spec_pages
from voltatlas.queries.registry import query
from voltatlas.session import shared_folder
from voltatlas.sources import readers, writers


@query("s01_page_path_columns", """
    SELECT c_custkey AS page_key, lower(n_name) AS state, 'x' AS city,
        'dc-' || CAST(c_custkey AS VARCHAR) AS dc
    FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
    SELECT c_custkey, lower(n_name), lower(c_mktsegment), NULL
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def s01(spark, sf):
    paths = spec_pages(spark, sf).select("page_key", "path").unionByName(
        city_pages(spark, sf).select("page_key", "path"))
    return paths.withColumns(readers.path_columns("path")).drop("path")


@query("s01_page_files", """
    SELECT 'dc-' || CAST(c_custkey AS VARCHAR) AS data_center_id, c_name AS data_center_name,
        c_nationkey + 0.25::DOUBLE AS latitude,
        CAST(CASE WHEN c_custkey % 9 = 2 THEN c_custkey % 30 + 1990 END AS INTEGER)
            AS year_operational,
        CASE WHEN c_custkey % 9 = 2 THEN c_custkey % 50 + 1.5::DOUBLE END AS capacity_mw,
        CAST(CASE WHEN c_custkey % 9 = 2 THEN c_custkey END AS DOUBLE) AS capacity_sqft
    FROM customer WHERE c_custkey % 9 IN (2, 3, 8)""")
def s01_files(spark, sf):
    """Pages in a packed store, read back, flattened, written as CSV and read again."""
    pages, table_path = shared_folder(spark, "pages"), shared_folder(spark, "specs")
    writers.write_page_store(spec_pages(spark, sf), pages)
    writers.write_csv(marts.facility_specs(readers.read_page_store(spark, pages)), table_path,
                      readers.FACILITY_COLUMNS)
    return readers.read_csv(spark, table_path, readers.FACILITY_SPEC).select(
        "data_center_id", "data_center_name", "latitude", "year_operational", "capacity_mw",
        "capacity_sqft")


@query("s02_read_lines", """
    SELECT DISTINCT trim(line) AS line FROM (
        SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE trim(line) <> ''""")
def s02(spark, sf):
    path = shared_folder(spark, "lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return readers.read_lines(spark, path).distinct()


@query("s03_write_lines", f"""
    SELECT DISTINCT '{SITE}' || u AS line FROM (
        SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS u FROM pages)""")
def s03(spark, sf):
    path = shared_folder(spark, "links")
    links = table(spark, sf, "pages").select(
        F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("u"))
    writers.write_lines(links.select(F.concat(F.lit(SITE), "u").alias("url")), path)
    return readers.read_lines(spark, path)


@query("s03_write_lines_by_state", sql("facility") + """
    SELECT DISTINCT state, data_center_name AS line FROM facility""")
def s03_states(spark, sf):
    path = shared_folder(spark, "state-lines")
    writers.write_lines(base.facilities(spark, sf), path, "data_center_name", "state")
    return spark.read.text(path).select("state", F.col("value").alias("line"))




def _spec_rows(spark, sf):
    return base.facilities(spark, sf).select(
        F.col("data_center_id").cast("string").alias("data_center_id"), "data_center_name",
        "state", "city", "latitude", "longitude", "year_operational", "capacity_mw",
        F.lit(None).cast("double").alias("capacity_sqft"))


@query("s04_s05_csv_round_trip", sql("facility") + """
    SELECT CAST(data_center_id AS VARCHAR) AS data_center_id, data_center_name, state, city,
        latitude, longitude, year_operational, capacity_mw FROM facility""")
def s05(spark, sf):
    path = shared_folder(spark, "facility-csv")
    writers.write_csv(_spec_rows(spark, sf), path, [
        "data_center_id", "data_center_name", "state", "city", "latitude", "longitude",
        "year_operational", "capacity_mw", "capacity_sqft"])
    return readers.read_csv(spark, path, readers.FACILITY_SPEC).drop("capacity_sqft")


@query("s04_csv_quoted_text", """
    SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END AS source
    FROM documents""")
def s04_quoted(spark, sf):
    path = shared_folder(spark, "documents-csv")
    df = table(spark, sf, "documents").withColumn(
        "source", F.when(F.col("doc_id") % 5 != 0, F.col("source")))
    writers.write_csv(df, path, ["doc_id", "text", "source"])
    return readers.read_csv(spark, path, "doc_id bigint, text string, source string",
                            multi_line=True)


@query("s06_s08_json_records", sql("mapped") + """
    SELECT name, state, city, year_built AS year, capacity_mw, energy_mwh, category,
        has_energy_data FROM mapped""")
def s08(spark, sf):
    path = shared_folder(spark, "map-json")
    rows = base.mapped(spark, sf).select(
        "name", "state", "city", F.col("year_built").alias("year"),
        F.coalesce("capacity_mw", F.lit(float("nan"))).alias("capacity_mw"), "energy_mwh",
        "category", "has_energy_data")
    writers.write_json_records(rows, path)
    return readers.read_json_records(spark, path, readers.FACILITY_MAP, one_array=False)


@query("s06_json_array", sql("nation_dim") + """
    SELECT state, abbrev, population_millions FROM nation_dim""")
def s06_array(spark, sf):
    path = shared_folder(spark, "array-json")
    rows = base.nation_dim(spark, sf).select("state", "abbrev", "population_millions")
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).write.text(path)
    return readers.read_json_records(
        spark, path, "state string, abbrev string, population_millions double")


@query("s06_json_arrays", sql("facility") + """
    SELECT data_center_id, data_center_name, state, city, year_operational, capacity_mw FROM facility""")
def s06_arrays(spark, sf):
    """Every facility, in files with an array each."""
    path = shared_folder(spark, "arrays-json")
    rows = base.facilities(spark, sf).select(
        "data_center_id", "data_center_name", "state", "city", "year_operational", "capacity_mw")
    writers.write_json_arrays(rows, path, ["data_center_id"], rows_per_file=5_000)
    return readers.read_json_records(
        spark, path, "data_center_id long, data_center_name string, state string, city string, "
        "year_operational int, capacity_mw double")


@query("s07_keyed_document", sql("facility", "nation_dim") + """
    SELECT '{' || string_agg('"' || abbrev || '":{"name":"' || state || '","dc_count":'
        || CAST(n AS VARCHAR) || '}', ',' ORDER BY abbrev) || '}' AS document
    FROM (SELECT abbrev, state, count(*) AS n FROM facility JOIN nation_dim USING (state)
          GROUP BY 1, 2)""")
def s07(spark, sf):
    counts = base.facilities(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("dc_count"))
    mart = cleaning.state_abbrev(counts, out="abbrev", dim=base.nation_dim(spark, sf)).select(
        "abbrev", F.col("state").alias("name"), "dc_count")
    return writers.keyed_document(mart, "abbrev")


@query("s07_json_by_key", sql("facility") + """
    SELECT CAST(owner_id AS VARCHAR) AS key, count(*) AS dc_count FROM facility GROUP BY 1""")
def s07_lines(spark, sf):
    path = shared_folder(spark, "owners-json")
    counts = base.facilities(spark, sf).groupBy(
        F.col("owner_id").cast("string").alias("owner")).agg(
        F.count(F.lit(1)).alias("dc_count"))
    writers.write_json_by_key(counts, path, "owner")
    return spark.read.schema("key string, value struct<dc_count: bigint>").json(path).select(
        "key", "value.dc_count")


@query("s09_flatten_api_response", """
    SELECT CAST(o_orderkey AS VARCHAR) AS state, CAST(year(o_orderdate) AS INTEGER) AS year,
        CAST(o_orderkey AS DOUBLE) * 1000 AS total_consumption_mwh FROM orders
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2001, (o_orderkey + 0.5::DOUBLE) * 1000
    FROM orders WHERE o_orderkey % 3 = 0""")
def s09(spark, sf):
    k = F.col("o_orderkey").cast("string")
    first = F.concat(F.lit('{"response":{"data":[{"period":"'),
                     F.year("o_orderdate").cast("string"), F.lit('","sales":'), k, F.lit("},"))
    other = F.when(F.col("o_orderkey") % 3 == 0,
                   F.concat(F.lit('{"period":"2001","sales":"'), k, F.lit('.5"}'))
                   ).when(F.col("o_orderkey") % 3 == 1, F.lit('{"period":"2001","sales":null}')
                          ).otherwise(F.lit('{"period":"2001"}'))
    df = table(spark, sf, "orders").select(
        k.alias("state"), F.concat(first, other, F.lit("]}}")).alias("body"))
    return readers.flatten_api_response(df)


@query("s10_first_available", "SELECT s_suppkey, s_name FROM supplier")
def s10(spark, sf):
    path = readers.first_available(spark, [f"{sf}/absent.parquet", f"{sf}/supplier.parquet",
                                           f"{sf}/nation.parquet"])
    return spark.read.parquet(path).select("s_suppkey", "s_name")


@query("s11_rename_by_position", """
    SELECT o_orderkey AS first_column, o_custkey AS second_column, o_orderdate::DATE AS o_orderdate,
        o_orderpriority AS last_column FROM orders""")
def s11(spark, sf):
    df = readers.rename_by_position(
        table(spark, sf, "orders"), {0: "first_column", 1: "second_column", -1: "last_column"})
    return df.select("first_column", "second_column",
                     F.col("o_orderdate").cast("date").alias("o_orderdate"), "last_column")


@query("s12_drop_non_data_rows", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders
    WHERE o_orderstatus <> 'P'""")
def s12(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P",
        F.when(F.col("o_orderkey") % 2 == 0, "Data Year")).otherwise(
        F.year("o_orderdate").cast("string")).alias("year"))
    return readers.drop_non_data_rows(df)


@query("s13_union_years", """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year,
        CASE WHEN year(o_orderdate) < 1998 THEN o_totalprice END AS o_totalprice,
        CASE WHEN year(o_orderdate) >= 1998 THEN o_orderpriority END AS o_orderpriority
    FROM orders""")
def s13(spark, sf):
    # Yearly tables whose columns change in 1998; the last year has no table. Date ranges reach
    # the scans, so each reads the row groups of its year only.
    o = table(spark, sf, "orders")
    frames = {}
    for year in range(1995, 2002):
        other = "o_totalprice" if year < 1998 else "o_orderpriority"
        own = (F.col("o_orderdate") >= f"{year}-01-01") & (F.col("o_orderdate") < f"{year + 1}-01-01")
        frames[year] = o.where(own).select("o_orderkey", other)
    return readers.union_years({**frames, 2002: None})


@query("s14_model_bundle")
def s14(spark, sf):
    path = shared_folder(spark, "model")
    rows = panel.openings_by_year(base.categorized(spark, sf)).join(
        base.electricity(spark, sf), ["state", "year"])
    features = ["new_dc_count", "new_dc_capacity_mw"]
    model = models.fit(rows, features, "total_consumption_mwh", models.linear())
    writers.write_model_bundle(model, path)
    return models.score(writers.read_model_bundle(path), rows).select(
        "state", "year", "prediction")


@query("s14_one_feature_bundle", sql("categorized", "electricity", more=_OPENINGS + """,
    rows AS (SELECT * FROM openings JOIN electricity USING (state, year)),
    f AS (SELECT regr_intercept(total_consumption_mwh, new_dc_count) AS a,
        regr_slope(total_consumption_mwh, new_dc_count) AS b FROM rows)""") + """
    SELECT state, year, a + b * new_dc_count AS prediction FROM rows, f""", {"prediction": 1})
def s14_one(spark, sf):
    path = shared_folder(spark, "model")
    rows = panel.openings_by_year(base.categorized(spark, sf)).join(
        base.electricity(spark, sf), ["state", "year"])
    writers.write_model_bundle(
        models.fit(rows, ["new_dc_count"], "total_consumption_mwh", models.linear()), path)
    return models.score(writers.read_model_bundle(path), rows).select("state", "year", "prediction")


@query("s15_results_report", sql("categorized") + """
    SELECT dc_category, data_center_id, rank FROM (
        SELECT dc_category, data_center_id, CAST(row_number() OVER (PARTITION BY dc_category
            ORDER BY capacity_mw_est DESC, data_center_id) AS BIGINT) AS rank FROM categorized)
    WHERE rank <= 5""")
def s15(spark, sf):
    path = shared_folder(spark, "report")
    cat = base.categorized(spark, sf)
    writers.write_results_report({
        "summary": agg.category_summary(cat),
        "top": joins.top_k_within(cat.select("dc_category", "data_center_id", "capacity_mw_est"),
                                  "dc_category", "capacity_mw_est", 5, ["data_center_id"]),
    }, path)
    return spark.read.schema("dc_category string, data_center_id bigint, rank bigint").json(
        f"{path}/top")


@query("s16_split_by_category", sql("categorized") + """
    SELECT data_center_id, dc_category, capacity_mw_est, 'part' AS part FROM categorized
    WHERE dc_category IN ('big_ai', 'crypto') UNION ALL
    SELECT data_center_id, dc_category, capacity_mw_est, 'all' FROM categorized""")
def s16(spark, sf):
    path = shared_folder(spark, "split")
    rows = base.categorized(spark, sf).select("data_center_id", "capacity_mw_est", "dc_category")
    writers.write_split_by_category(rows, path, ["big_ai", "crypto"])
    ddl = "data_center_id bigint, capacity_mw_est double, dc_category string"
    whole = writers.read_back(spark, f"{path}/all", ddl).withColumn("part", F.lit("all"))
    part = writers.read_back(spark, f"{path}/by_category", ddl).withColumn("part", F.lit("part"))
    return whole.unionByName(part)


_SHEETS = """
    SELECT CAST(year AS INTEGER) AS year, CAST(utility_id AS VARCHAR) AS utility_id, state, ba_code,
        residential_sales_mwh, commercial_sales_mwh, industrial_sales_mwh, total_sales_mwh,
        total_customers FROM sales"""


@query("s13_sales_sheets", sql("sales") + _SHEETS, {
    c: 2 for c in ("residential_sales_mwh", "commercial_sales_mwh", "industrial_sales_mwh",
                   "total_sales_mwh", "total_customers")})
def s13_sheets(spark, sf):
    """Yearly sheets whose headers differ, one with a line that is no data.

    The sales are computed once and written by year; each sheet reads its own year's files.
    """
    sold = base.sales(spark, sf)
    path = shared_folder(spark, "sheets")
    sold.write.partitionBy("year").parquet(path)
    rows = spark.read.schema(sold.schema).parquet(path)
    known = {0: "year", 1: "utility_id", 6: "state", 8: "ba_code", 10: "residential_sales_mwh",
             13: "commercial_sales_mwh", 16: "industrial_sales_mwh", 22: "total_sales_mwh",
             23: "total_customers"}
    sheets: dict = {2002: None}
    for year in range(1995, 2002):
        cells = [F.col(known[i]).cast("string") if i in known else F.lit("-") for i in range(24)]
        sheet = rows.where(F.col("year") == year).select(
            *[c.alias(f"{year} column {i}") for i, c in enumerate(cells)])
        title = [F.lit("Data Year" if i == 0 else f"title {i}").alias(c) for i, c in enumerate(sheet.columns)]
        sheets[year] = sheet.unionByName(spark.range(1).select(*title)) if year == 1999 else sheet
    return marts.sales_sheets(sheets).select(
        F.col("year").cast("int").alias("year"), "utility_id", "state", "ba_code",
        "residential_sales_mwh", "commercial_sales_mwh", "industrial_sales_mwh", "total_sales_mwh",
        "total_customers")
