"""X1-X19, bound to the pages table and to pages that Spark derives from customers.

The given pages carry no embedded data, tables or cards. Pages of those shapes are rendered
from customer rows, one for each customer, and the oracle states what must come out of them
from the customer rows alone.
"""

from pyspark.sql import functions as F

from voltatlas.functions.columns import url_slug
from voltatlas.operators import extraction, page_elements
from voltatlas.queries.base import table
from voltatlas.queries.registry import query

SITE = "https://directory.example"
_OPEN = '<html><body><script id="__NEXT_DATA__" type="application/json">'
_CLOSE = "</script></body></html>"


def _customers(spark, sf):
    return table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))


def city_pages(spark, sf):
    """A page per customer with two listings; the second is shared by a whole nation."""
    k = F.col("c_custkey")
    ks, ns = k.cast("string"), F.col("c_nationkey").cast("string")

    def props(**fields):
        return F.struct(F.struct(*[c.alias(n) for n, c in fields.items()]).alias("properties"))

    own = props(
        name=F.col("c_name"), companyname=F.col("c_mktsegment"),
        address=F.concat(F.lit("addr "), ns), city=F.lower("c_mktsegment"),
        state=F.col("n_name"), country=F.lit("USA"), link=F.concat(F.lit("dc-"), ks),
        url=F.concat(F.lit("/usa/"), ns, F.lit("/"), ks, F.lit("/")))
    shared = props(
        name=F.concat(F.lit("Shared "), ns), companyname=F.lit("Common"),
        address=F.lit("main"), city=F.lower("c_mktsegment"), state=F.col("n_name"),
        country=F.lit("USA"), link=F.concat(F.lit("shared-"), ns), url=F.lit(""))
    doc = F.to_json(F.struct(F.struct(F.struct(F.struct(
        F.array(own, shared).alias("dcs")).alias("mapdata")).alias("pageProps")).alias("props")))
    page = F.concat(F.lit(_OPEN), doc, F.lit(_CLOSE))
    m = k % 10
    content = (
        F.when(m == 0, F.concat(page, F.lit("<p>Page View Limit Reached</p>")))
        .when(m == 1, F.concat(F.lit("<html>"), doc, F.lit("</html>")))
        .when(m == 2, F.concat(F.lit(_OPEN), F.substring(doc, 1, 40), F.lit(_CLOSE)))
        .otherwise(page)
    )
    return _customers(spark, sf).select(
        k.alias("page_key"),
        F.concat(F.lit("/html/state/"), F.lower("n_name"), F.lit("/city/"),
                 F.lower("c_mktsegment"), F.lit("/"), F.lpad(ks, 12, "0"), F.lit(".txt"))
        .alias("path"),
        content.alias("content"))


def spec_pages(spark, sf):
    """A spec page per customer, in nine shapes."""
    k = F.col("c_custkey")
    ks = k.cast("string")
    mw = F.concat((k % 50 + 1).cast("string"), F.lit(".5"))
    year = (k % 30 + 1990).cast("string")

    def data(inner):
        return F.concat(F.lit(_OPEN + '{"props":{"pageProps":{"dc":{"link":"dc-'), ks,
                        F.lit('","name":"'), F.col("c_name"), F.lit('","latitude":'),
                        F.col("c_nationkey").cast("string"), F.lit(".25,"), inner,
                        F.lit("}}}}" + _CLOSE))

    L = F.lit
    shapes = [
        L("<p>No data supplied by operator. Page View Limit Reached</p>"),
        L("<title>Vercel Security Checkpoint</title>"),
        data(F.concat(L('"meta_power":{"totalmw":'), mw,
                      L('},"meta_building":{"year_operational":"'), year,
                      L('"},"meta_capacity":{"mw_builtout":'), mw,
                      L(',"whitespace_builtout":"'), ks, L('"}'))),
        data(L('"meta_power":{"totalmw":0},"meta_building":{"year_operational":"-"}')),
        F.concat(L("<table><tr><td>Fully Built-Out Power</td><td class='v'> "), mw,
                 L(" MW </td></tr><tr><TD>year operational</TD><td>"), year,
                 L("</td></tr></table>")),
        F.concat(L("| Fully Built-Out Power | total | "), mw,
                 L(" MW | Year Operational | first | "), year, L(" |")),
        F.concat(L(_OPEN + '{"props":' + _CLOSE + ' {"power": " '), mw,
                 L(' MW ", "yearOperational": '), year, L("}")),
        F.concat(L('"Fully Built-Out Power" : "N/A", "power":"7 MW" Year Operational: '), year),
        data(F.concat(L('"meta_power":{"totalmw":"'), mw, L('"},"meta_building":null'))),
    ]
    content = None
    for i, s in enumerate(shapes):
        hit = k % 9 == i
        content = F.when(hit, s) if content is None else content.when(hit, s)
    return _customers(spark, sf).select(
        k.alias("page_key"), F.concat(L("dc-"), ks).alias("dc"),
        F.concat(L("/html/state/"), F.lower("n_name"), L("/city/x/dc/dc-"), ks, L("/specs.txt"))
        .alias("path"),
        F.col("c_acctbal").alias("balance"), content.alias("content"))


@query("x01_valid_pages", """
    SELECT c_custkey AS page_key FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 9 > 1""")
def x01(spark, sf):
    city = extraction.valid_pages(city_pages(spark, sf)).select("page_key")
    spec = extraction.valid_pages(spec_pages(spark, sf), spec_pages=True).select("page_key")
    return city.join(spec, "page_key")


@query("x02_embedded_json", """
    SELECT c_custkey AS page_key, 'dc-' || CAST(c_custkey AS VARCHAR) AS link FROM customer
    WHERE c_custkey % 10 NOT IN (1, 2)""")
def x02(spark, sf):
    return extraction.embedded_json(city_pages(spark, sf)).select(
        "page_key", F.try_variant_get(
            "doc", "$.props.pageProps.mapdata.dcs[0].properties.link", "string").alias("link"))


_LISTED = """listed AS (
    SELECT c_custkey AS page_key, CAST(0 AS INTEGER) AS position, c_name AS name,
        c_mktsegment AS company, 'addr ' || CAST(c_nationkey AS VARCHAR) AS address, '' AS postal,
        lower(c_mktsegment) AS city, n_name AS state, 'USA' AS country,
        'dc-' || CAST(c_custkey AS VARCHAR) AS link,
        '/usa/' || CAST(c_nationkey AS VARCHAR) || '/' || CAST(c_custkey AS VARCHAR) || '/' AS url,
        lower(n_name) || '/' || lower(c_mktsegment) || '/' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')
            AS path
    FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
    SELECT c_custkey, 1, 'Shared ' || CAST(c_nationkey AS VARCHAR), 'Common', 'main', '',
        lower(c_mktsegment), n_name, 'USA', 'shared-' || CAST(c_nationkey AS VARCHAR), '',
        lower(n_name) || '/' || lower(c_mktsegment) || '/' || lpad(CAST(c_custkey AS VARCHAR), 12, '0')
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
  valid AS (SELECT * FROM listed WHERE page_key % 10 > 2),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, address
      ORDER BY path, position) AS r FROM valid) WHERE r = 1)"""
_FIELDS = "position, name, company, address, postal, city, state, country, link, url"


def listings(spark, sf):
    return extraction.explode_listings(
        extraction.valid_pages(city_pages(spark, sf)), keep=("page_key", "path"))


@query("x03_explode_listings", f"WITH {_LISTED} SELECT page_key, {_FIELDS} FROM valid")
def x03(spark, sf):
    return listings(spark, sf).drop("path")


@query("x04_listing_urls", f"""WITH {_LISTED} SELECT page_key, name,
    '{SITE}' || url || 'specs/' AS specs_url FROM valid WHERE url <> '' AND name <> ''""")
def x04(spark, sf):
    return extraction.listing_urls(listings(spark, sf), SITE).select(
        "page_key", "name", "specs_url")


@query("x05_detail_record", """
    SELECT c_custkey AS page_key, 'dc-' || CAST(c_custkey AS VARCHAR) AS data_center_id,
        c_name AS data_center_name, c_nationkey + 0.25::DOUBLE AS latitude,
        CAST(CASE WHEN c_custkey % 9 = 2 THEN c_custkey % 30 + 1990 END AS INTEGER)
            AS year_operational,
        CASE WHEN c_custkey % 9 = 2 THEN c_custkey % 50 + 1.5::DOUBLE END AS capacity_mw,
        CAST(CASE WHEN c_custkey % 9 = 2 THEN c_custkey END AS DOUBLE) AS capacity_sqft
    FROM customer WHERE c_custkey % 9 IN (2, 3, 8)""")
def x05(spark, sf):
    docs = extraction.embedded_json(extraction.valid_pages(spec_pages(spark, sf)))
    return extraction.detail_record(docs, keep=["page_key"]).select(
        "page_key", "data_center_id", "data_center_name", "latitude", "year_operational",
        "capacity_mw", "capacity_sqft")


_SPECS = """specs AS (
    SELECT c_custkey AS page_key, 'dc-' || CAST(c_custkey AS VARCHAR) AS dc,
        CASE WHEN c_custkey % 9 IN (2, 4, 5, 6, 8)
               THEN CAST(c_custkey % 50 + 1 AS VARCHAR) || '.5 MW'
             WHEN c_custkey % 9 = 7 THEN '7 MW' END AS capacity,
        CASE WHEN c_custkey % 9 IN (2, 4, 5, 6, 7) THEN CAST(c_custkey % 30 + 1990 AS VARCHAR) END
            AS operational_date
    FROM customer WHERE c_custkey % 9 <> 1)"""


@query("x06_extract_capacity_and_year", f"""WITH {_SPECS}
    SELECT page_key, capacity, operational_date FROM specs""")
def x06(spark, sf):
    return extraction.extract_capacity_and_year(spec_pages(spark, sf)).select(
        "page_key", "capacity", "operational_date")


# The bound pages have links such as /The; the site's country root is '/', a state a letter.
@query("x07_extract_state_links", f"""
    SELECT DISTINCT '{SITE}' || u AS url FROM (
        SELECT unnest(regexp_extract_all(html, 'href="(/[^"]+)"', 1)) AS u FROM pages)
    WHERE u <> '/'""")
def x07(spark, sf):
    return extraction.extract_state_links(table(spark, sf, "pages"), SITE, "/", "html")


def _state_pages(spark, sf):
    """State pages rendered from customers: city links, a repeat, a quote and a foreign link."""
    k = F.col("c_custkey").cast("string")
    s = F.lower("n_name")

    def link(*parts):
        return F.concat(F.lit('<a href="'), *parts, F.lit('">x</a>'))

    seg = F.lower("c_mktsegment")
    return _customers(spark, sf).select(
        s.alias("state"),
        F.concat(
            link(F.lit("/usa/"), s, F.lit("/"), seg, F.lit("/")),
            link(F.lit("/usa/"), s, F.lit("/"), k, F.lit("/")),
            link(F.lit("/usa/"), s, F.lit("/"), k, F.lit("/")),
            link(F.lit("/usa/"), s, F.lit("/quote/")),
            link(F.lit("/usa/"), s, F.lit("/")),
            link(F.lit("/usa/elsewhere/"), k, F.lit("/"))).alias("content"))


@query("x08_extract_city_links", f"""
    SELECT DISTINCT state, '{SITE}/usa/' || state || '/' || x || '/' AS url FROM (
        SELECT lower(n_name) AS state, lower(c_mktsegment) AS x
        FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL
        SELECT lower(n_name), CAST(c_custkey AS VARCHAR)
        FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def x08(spark, sf):
    return extraction.extract_city_links(_state_pages(spark, sf), SITE)


@query("x09_url_slug", """
    SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS slug FROM pages""")
def x09(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_slug("url").alias("slug"))


# What DuckDB needs to restate the page text of the given pages.
_CLEAN = r"""regexp_replace(html,
    '(?is)<script[^>]*>.*?</script\s*>|<style[^>]*>.*?</style\s*>|<!--.*?-->|<!doctype[^>]*>', '{0}',
    'g')"""


def _decoded(x: str) -> str:
    return (f"replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', "
            "'\"'), '&amp;', '&')")


@query("x10_page_links", f"""
    SELECT page_id, CAST(i - 1 AS INTEGER) AS position,
        {_decoded("trim(regexp_replace(a, '<[^>]*>', '', 'g'))")} AS text,
        {_decoded("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS url
    FROM (SELECT page_id, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT page_id, regexp_extract_all({_CLEAN.format("")}, '(?is)<a\\s[^>]*>.*?</a>') AS l
        FROM pages))""")
def x10(spark, sf):
    return page_elements.page_links(table(spark, sf, "pages"))


@query("x11_page_title_and_text", f"""
    SELECT page_id, {_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        {_decoded('''trim(regexp_replace(regexp_replace(regexp_replace(''' +
                  _CLEAN.format('@@') + ''', '(?s)</?[a-zA-Z][^>]*>', '@@', 'g'),
                  '\\s*@@[\\s@]*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))''')} AS body
    FROM pages""")
def x11(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", page_elements.page_title("html").alias("title"),
        page_elements.page_text("html").alias("body"))


def _table_pages(spark, sf):
    """Tables and cards rendered from parts."""
    k = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit("<table><tr><th>Name</th><th>Brand</th></tr><tr><td> "), F.col("p_name"),
        F.lit(" </td><td><a href='/b/"), k, F.lit("'><b>"), F.col("p_brand"),
        F.lit("</b></a></td></tr><tr><td> </td></tr></table><div class='big card'><h3>"),
        F.col("p_name"), F.lit("</h3><p>Size <i>"), F.col("p_size").cast("string"),
        F.lit("</i></p></div><div class=\"card\"><a href=\"/c/"), k,
        F.lit("\">R&amp;D</a><script>var x;</script> end</div><div class='cards'>no</div>"),
    ).alias("html"))


@query("x12_page_table_rows", """
    SELECT p_partkey, CAST(0 AS INTEGER) AS position, 'Name|Brand' AS cells, '' AS links FROM part
    UNION ALL SELECT p_partkey, 1, trim(p_name) || '|' || p_brand,
        p_brand || '>/b/' || CAST(p_partkey AS VARCHAR) FROM part""")
def x12(spark, sf):
    rows = page_elements.page_table_rows(_table_pages(spark, sf), key="p_partkey")
    return rows.select(
        "p_partkey", "position", F.array_join("cells", "|").alias("cells"),
        F.array_join(F.transform("links", lambda x: F.concat(x["text"], F.lit(">"), x["url"])), ",")
        .alias("links"))


@query("x13_page_list_items", f"""
    SELECT page_id, CAST(i - 1 AS INTEGER) AS position, list_item, url FROM (
        SELECT page_id, i, {_decoded("trim(regexp_replace(li, '<[^>]*>', '', 'g'))")} AS list_item,
            {_decoded("regexp_extract(li, 'href=\"([^\"]*)\"', 1)")} AS url
        FROM (SELECT page_id, unnest(l) AS li, unnest(range(1, len(l) + 1)) AS i FROM (
            SELECT page_id, regexp_extract_all({_CLEAN.format("")}, '(?is)<li[^>]*>.*?</li>') AS l
            FROM pages)))
    WHERE length(list_item) > 5 AND contains(url, '/e')""")
def x13(spark, sf):
    return page_elements.page_list_items(table(spark, sf, "pages"), path="/e")


def _awkward_pages(spark, sf):
    """Nested and unclosed items, quoted '>', other attributes, open links, rendered from parts."""
    k = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit("<ul><li>Outer "), F.col("p_brand"), F.lit("<ul><li>Inner <a href='/e/"), k,
        F.lit("'>one</a></li></ul>tail</li><li>Last item "), F.col("p_name"),
        F.lit("</ul><a data-href='/x'>none</a><a title=\"a > b\" href='/q/"), k,
        F.lit("'>&nbsp;Good </a><a href='/open'>never "), F.col("p_brand")).alias("html"))


@query("x13_nested_list_items", """
    SELECT p_partkey, CAST(0 AS INTEGER) AS position,
        'Outer ' || p_brand || 'Inneronetail' AS list_item, '/e/' || p_partkey AS url FROM part
    UNION ALL SELECT p_partkey, 1, 'Innerone', '/e/' || p_partkey FROM part
    UNION ALL SELECT p_partkey, 2, 'Last item ' || trim(p_name), NULL FROM part""")
def x13_nested(spark, sf):
    return page_elements.page_list_items(_awkward_pages(spark, sf), key="p_partkey")


@query("x10_awkward_links", """
    SELECT p_partkey, CAST(0 AS INTEGER) AS position, 'one' AS text, '/e/' || p_partkey AS url FROM part
    UNION ALL SELECT p_partkey, 1, 'Good', '/q/' || p_partkey FROM part
    UNION ALL SELECT p_partkey, 2, 'never ' || p_brand, '/open' FROM part""")
def x10_awkward(spark, sf):
    return page_elements.page_links(_awkward_pages(spark, sf), key="p_partkey")


@query("x14_page_cards", """
    SELECT p_partkey, CAST(0 AS INTEGER) AS position, p_name AS name, NULL AS url,
        p_name || ' | Size | ' || CAST(p_size AS VARCHAR) AS details FROM part UNION ALL
    SELECT p_partkey, 1, 'R&D', '/c/' || CAST(p_partkey AS VARCHAR), 'R&D | end' FROM part""")
def x14(spark, sf):
    return page_elements.page_cards(_table_pages(spark, sf), key="p_partkey")


@query("x15_section_links", f"""
    SELECT page_id, CAST(i - 1 AS INTEGER) AS position, t AS name, '{SITE}' || u AS url FROM (
        SELECT page_id, i, {_decoded("trim(regexp_replace(a, '<[^>]*>', '', 'g'))")} AS t,
            {_decoded("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS u
        FROM (SELECT page_id, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM (
            SELECT page_id, regexp_extract_all({_CLEAN.format("")}, '(?is)<a\\s[^>]*>.*?</a>') AS l
            FROM pages)))
    WHERE contains(u, '/e') AND length(t) > 2 AND u <> '/e'""")
def x15(spark, sf):
    return page_elements.section_links(table(spark, sf, "pages"), "/e", SITE)


@query("x16_pending_urls", """
    SELECT DISTINCT 'dc-' || CAST(c_custkey AS VARCHAR) AS url FROM customer
    WHERE c_acctbal < 0 OR c_custkey % 9 = 1 OR c_custkey % 9 = 0""")
def x16(spark, sf):
    # Pages of customers in debt are not stored yet; two of the page shapes are cut off.
    stored = spec_pages(spark, sf).where(F.col("balance") >= 0).select(
        F.col("dc").alias("url"), "content")
    urls = table(spark, sf, "customer").select(
        F.concat(F.lit("dc-"), F.col("c_custkey").cast("string")).alias("url"))
    return extraction.pending_urls(urls, stored)


@query("x17_dedupe_listings", f"WITH {_LISTED} SELECT page_key, {_FIELDS} FROM uniq")
def x17(spark, sf):
    return extraction.dedupe_listings(listings(spark, sf), ["path", "position"]).drop("path")


@query("x17_dedupe_documents", """
    SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id)
        AS r FROM documents) WHERE r = 1""")
def x17_documents(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id", "lang", F.col("text").alias("name"), F.col("lang").alias("address"))
    return extraction.dedupe_listings(df, ["doc_id"]).select("doc_id", "lang")


_MANY_SPECS = """many AS (SELECT dc, capacity, operational_date, page_key AS seq FROM specs
    UNION ALL SELECT 'shared-' || CAST(page_key % 25 AS VARCHAR), capacity, operational_date,
        page_key FROM specs),
  final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dc ORDER BY seq DESC) AS r
      FROM many) WHERE r = 1)"""


def _many_specs(spark, sf):
    specs = extraction.extract_capacity_and_year(spec_pages(spark, sf)).select(
        F.col("dc").alias("dc_link"), "capacity", "operational_date", F.col("page_key").alias("seq"))
    return specs.unionByName(specs.withColumn(
        "dc_link", F.concat(F.lit("shared-"), (F.col("seq") % 25).cast("string"))))


@query("x18_attach_specs", f"""WITH {_LISTED}, {_SPECS}, {_MANY_SPECS}
    SELECT page_key, position, link, capacity, operational_date
    FROM valid LEFT JOIN final ON dc = link""")
def x18(spark, sf):
    return extraction.attach_specs(listings(spark, sf), _many_specs(spark, sf), ["seq"]).select(
        "page_key", "position", "link", "capacity", "operational_date")


@query("x19_extraction_audit", f"""WITH {_LISTED}, {_SPECS}, {_MANY_SPECS},
    j AS (SELECT name, address, capacity, operational_date FROM valid LEFT JOIN final ON dc = link)
    SELECT count(*) AS total, count(DISTINCT name || '|' || address) AS unique_rows,
        count(capacity) AS with_capacity, count(operational_date) AS with_date,
        (SELECT count(*) FROM customer WHERE c_custkey % 9 = 1) AS skipped FROM j""")
def x19(spark, sf):
    rows = extraction.attach_specs(listings(spark, sf), _many_specs(spark, sf), ["seq"])
    return extraction.extraction_audit(rows, spec_pages(spark, sf))


