"""Pages in the shapes a crawl stores, written by hand."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voltatlas.operators import extraction, page_elements
from voltatlas.plans import marts
from voltatlas.sources import readers


def page(data):
    text = data if isinstance(data, str) else json.dumps(data)
    return f'<html>\n<script id="__NEXT_DATA__" type="application/json">{text}</script></html>'


def spec(**dc):
    return page({"props": {"pageProps": {"dc": dc}}})


def frame(spark, contents):
    return spark.createDataFrame(list(enumerate(contents)), "path int, content string")


@pytest.mark.parametrize("content,capacity,date", [
    ("<p>No data supplied by X</p>", None, None),
    (spec(meta_power={"totalmw": 0}, meta_building={"year_operational": "2011"}), None, "2011"),
    (spec(meta_power={"totalmw": 6.8}) + "<td>Year Operational</td><td>2011</td>", "6.8 MW", None),
    ("<td>Fully Built-Out Power</td><td>6.8 MW</td><td>Year Operational</td><td>2011</td>",
     "6.8 MW", "2011"),
    (spec(meta_power={"totalmw": 73.0}, meta_building={"year_operational": 2011}), "73.0 MW",
     "2011"),
    (spec(meta_power={"totalmw": "0"}, meta_building={"year_operational": 0}), None, None),
    (spec(meta_power={"totalmw": "0.0"}, meta_building=None), "0.0 MW", None),
    (spec(meta_power={"totalmw": 0.0}, meta_building={"year_operational": "-"}), None, None),
    (spec(meta_power=None, meta_building={"year_operational": "N/A"}), None, None),
    (spec(meta_power={"totalmw": 120}), "120 MW", None),
    ('FULLY BUILT-OUT POWER</td>\n<td class="x">  9 MW </td>', "9 MW", None),
    ('<b>Fully Built-Out Power</b><i>4 MW</i>', "4 MW", None),
    ('<td>Fully Built-Out Power</td><td>-</td> "power": "8 MW"', "8 MW", None),
    ('"power":"null"', None, None),
    ('Year Operational: 1999', None, "1999"),
    ('"yearOperational":"2003"', None, "2003"),
    ('"Year Operational" : "2004"', None, "2004"),
    (page('{"props": ') + '"power" : "5 MW"', "5 MW", None),
    ("nothing here", None, None),
])
def test_capacity_and_year(spark, content, capacity, date):
    out = extraction.extract_capacity_and_year(frame(spark, [content])).collect()
    assert [(r.capacity, r.operational_date) for r in out] == [(capacity, date)]


def test_blocked_pages_drop_out(spark):
    df = frame(spark, ["Vercel Security Checkpoint", "x Page View Limit Reached x",
                       "No data supplied by A Page View Limit Reached", "fine"])
    assert extraction.extract_capacity_and_year(df).count() == 2
    assert extraction.valid_pages(df).count() == 2
    assert extraction.valid_pages(df, spec_pages=True).count() == 1


def test_embedded_json(spark):
    df = frame(spark, ["no tag", page('{"a": '), page({"a": 1}), page('{"a":\n1}')])
    assert [r.path for r in extraction.embedded_json(df).select("path").collect()] == [2]


def test_listings(spark):
    dcs = [{"type": "Feature", "properties": {"name": "A", "address": None, "url": "/usa/x/a/",
                                              "companyname": "C", "id": 1}},
           {"properties": {"name": "", "url": "/u/"}}, {"geometry": {}}]
    city = page({"props": {"pageProps": {"mapdata": {"dcs": dcs}}}})
    state = page({"props": {"pageProps": {"mapdata": {"geos": []}}}})
    out = extraction.explode_listings(frame(spark, [city, state, page("{"), "none"]))
    got = [(r.path, r.position, r.name, r.company, r.address, r.url)
           for r in out.orderBy("position").collect()]
    assert got == [(0, 0, "A", "C", "", "/usa/x/a/"), (0, 1, "", "", "", "/u/"),
                   (0, 2, "", "", "", "")]
    urls = extraction.listing_urls(out, "https://s").collect()
    assert [r.specs_url for r in urls] == ["https://s/usa/x/a/specs/"]


def test_detail_record(spark):
    full = spec(link="a", name="A", state="Iowa", city="X", latitude="41.5", longitude=-93,
                meta_building={"year_operational": "2011"},
                meta_capacity={"mw_builtout": "12.5", "whitespace_builtout": 1000})
    df = extraction.embedded_json(frame(spark, [
        full, spec(link="b", meta_building=None), page({"props": {"pageProps": {"dc": {}}}}),
        page({"props": {}}), spec(link="c", meta_capacity={"mw_builtout": "n/a"})]))
    out = extraction.detail_record(df, keep=["path"]).orderBy("path").collect()
    assert [r.path for r in out] == [0, 1, 4]
    a = out[0]
    assert (a.data_center_id, a.latitude, a.longitude, a.year_operational, a.capacity_mw,
            a.capacity_sqft) == ("a", 41.5, -93.0, 2011, 12.5, 1000.0)
    assert out[1].year_operational is None and out[2].capacity_mw is None


def test_city_links(spark):
    links = ["/usa/x/a/", "/usa/x/a/", "/usa/x/quote/", "/usa/x/", "/usa/y/b/"]
    html = "".join(f'<a href="{u}">t</a>' for u in links)
    df = spark.createDataFrame([("x", html)], "state string, content string")
    out = extraction.extract_city_links(df, "https://s").collect()
    assert [(r.state, r.url) for r in out] == [("x", "https://s/usa/x/a/")]
    state = extraction.extract_state_links(df.selectExpr("content || '<a href=\"/usa/\">' content"),
                                           "https://s")
    assert sorted(r.url for r in state.collect()) == [
        "https://s/usa/x/", "https://s/usa/x/a/", "https://s/usa/x/quote/", "https://s/usa/y/b/"]


def test_pending(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    stored = spark.createDataFrame([("a", "ok"), ("b", "Page View Limit Reached")],
                                   "url string, content string")
    assert sorted(r.url for r in extraction.pending_urls(urls, stored).collect()) == ["b", "c"]


def test_dedupe_listings(spark):
    df = spark.createDataFrame([(2, "n", "a"), (1, "n", "a"), (3, "n", "b")],
                               "pos int, name string, address string")
    out = extraction.dedupe_listings(df, ["pos"]).orderBy("pos").collect()
    assert [r.pos for r in out] == [1, 3]


def test_stored_pages_to_listing(spark, tmp_path):
    def store(rel, text):
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text, encoding="utf-8")

    dc = {"name": "A", "address": "1 St", "city": "Ames", "state": "Iowa", "link": "a-1",
          "url": "/usa/iowa/ames/a-1/"}
    city = page({"props": {"pageProps": {"mapdata": {"dcs": [{"properties": dc}] * 2}}}})
    store("state/iowa/city/ames/ames.txt", city + "\nsecond line")
    store("state/iowa/city/cut/cut.txt", city + "Page View Limit Reached")
    store("state/iowa/city/ames/dc/a-1/specs.txt",
          spec(meta_power={"totalmw": 6.8}, meta_building={"year_operational": "2011"}))
    pages = readers.read_pages(spark, str(tmp_path))
    got = {(r.state, r.city, r.dc) for r in pages.collect()}
    assert got == {("iowa", "ames", None), ("iowa", "cut", None), ("iowa", "ames", "a-1")}
    out = marts.facility_listing(pages.where("dc IS NULL"), pages.where("dc IS NOT NULL"))
    assert [tuple(r) for r in out.collect()] == [
        ("A", "", "1 St", "", "Ames", "Iowa", "", "6.8 MW", "2011")]


HTML = """<!DOCTYPE html><html><head><title> T &amp; U </title><style>p {a: b}</style></head><body>
<script>var x = "<a href='/no'>no</a>";</script><!-- <a href="/no2">no</a> -->
<p>One <b>two</b>
 three &lt;tag&gt; &copy; &#8364; &#x41; &nope; &amp;lt;</p>
<a class="k" href="/a?x=1&amp;y=2"> <i>A</i> b </a><a name="x">none</a><A HREF='/c'></A><a href=/d>D</a>
<ul><li>short</li><li><a href="/usa/texas/x/">A longer item</a></li></ul></body></html>"""


def test_title_text_links(spark):
    df = spark.createDataFrame([(1, HTML), (2, "<p>no title</p>"), (3, None)],
                               "page_id int, html string")
    got = {r.page_id: (r.t, r.b) for r in df.select(
        "page_id", page_elements.page_title("html").alias("t"),
        page_elements.page_text("html").alias("b")).collect()}
    assert got[1][0] == " T & U "
    assert got[1][1].split("\n") == [
        "T & U", "One", "two", "three <tag> © € A &nope; &lt;", "A", "b", "none", "D", "short",
        "A longer item"]
    assert got[2] == (None, "no title") and got[3] == (None, None)
    links = [(r.text, r.url) for r in page_elements.page_links(df).orderBy("position").collect()]
    assert links == [("Ab", "/a?x=1&y=2"), ("", "/c"), ("D", "/d"),
                     ("A longer item", "/usa/texas/x/")]
    items = page_elements.page_list_items(df).collect()
    assert [(r.list_item, r.url) for r in items] == [("A longer item", "/usa/texas/x/")]
    assert page_elements.page_list_items(df, longer_than=3, path="/usa/texas/").count() == 1
    sect = page_elements.section_links(df, "/usa/texas/", "https://s").collect()
    assert [(r.name, r.url) for r in sect] == [("A longer item", "https://s/usa/texas/x/")]


def test_tables_and_cards(spark):
    html = """<table><tr><th> A </th><th>B</th></tr><tr><td></td><td> </td></tr>
    <tr><td>x <b>y</b></td><td><a href="/l">L</a><a href="/m">M</a></td></tr></table>
    <tr><td>outside</td></tr>
    <div class="card wide"><h3>Name</h3><p>More</p><style>no</style></div>
    <div class="cardx">no</div><div class="card"><a href="/u">Go</a></div><div class=card></div>"""
    df = spark.createDataFrame([("k", html), ("n", None)], "page_id string, html string")
    rows = [(r.position, r.cells, [tuple(x) for x in r.links])
            for r in page_elements.page_table_rows(df).orderBy("position").collect()]
    assert rows == [(0, ["A", "B"], []), (1, ["xy", "L"+"M"], [("L", "/l")])]
    cards = [(r["name"], r.url, r.details)
             for r in page_elements.page_cards(df).orderBy("position").collect()]
    assert cards == [("Name", None, "Name | More"), ("Go", "/u", "Go"), (None, None, "")]


def html_frame(spark, *pages):
    return spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")


def test_list_items_nested_and_unclosed(spark):
    df = html_frame(
        spark, "<ul><li>Outer <a href='/o'>x</a><ul><li>Inner one</li><li>Inner two<a href=/i>y</a></ul>tail</li></ul>",
        "<ul><li>Alpha item<li>Beta item</ul>", None, "")
    got = [(r.page_id, r.position, r.list_item, r.url) for r in page_elements.page_list_items(df).collect()]
    assert got == [
        (0, 0, "OuterxInner oneInner twoytail", "/o"), (0, 1, "Inner one", None), (0, 2, "Inner twoy", "/i"),
        (1, 0, "Alpha itemBeta item", None), (1, 1, "Beta item", None)]
    one = page_elements.page_list_items(df, path="/i").collect()
    assert [r.list_item for r in one] == ["Inner twoy"]


def test_links_with_awkward_tags(spark):
    df = html_frame(
        spark, '<a data-href="/x">Text only</a><a title="a > b" href="/g">Good</a><a href>bare</a>'
        "<a href='/s'> R&amp;D&nbsp;</a><A HREF=/u>U</A><a href='/late'>never closed", "<a href=''></a>")
    got = [(r.page_id, r.text, r.url) for r in page_elements.page_links(df).collect()]
    assert got == [(0, "Good", "/g"), (0, "bare", ""), (0, "R&D", "/s"), (0, "U", "/u"), (0, "never closed", "/late")]


def test_page_text_decodes_before_stripping(spark):
    df = html_frame(
        spark, "<p>a</p><p>&nbsp;</p><p>b&nbsp;</p><p>c</p>", '<p title="x > y">t</p><i data-q=\'"\'>&#0000000065;&lt;b&gt;</i>',
        "no tags &amp; &unknown; &#x1F389;", "")
    got = [r.t for r in df.select(page_elements.page_text("html").alias("t")).collect()]
    assert got == ["a\nb\nc", "t\nA<b>", "no tags & &unknown; 🎉", ""]


def test_rows_and_cards_with_nesting(spark):
    df = html_frame(
        spark, "<tr><td>no table</td></tr><table><tr><td>A<td><a href=/1>one</a><a href=/2>two</a></tr><tr><th> </th></tr></table>"
        "<div class='x card'><a href='/c'>Name</a><h3>later</h3><div class=card>in</div></div>")
    rows = page_elements.page_table_rows(df).collect()
    assert [(r.position, r.cells, [(x.text, x.url) for x in r.links]) for r in rows] == [
        (0, ["Aonetwo", "onetwo"], [("one", "/1"), ("one", "/1")])]
    cards = page_elements.page_cards(df).collect()
    assert [(c.name, c.url, c.details) for c in cards] == [("Name", "/c", "Name | later | in"), (None, None, "in")]


def test_long_tables_take_linear_time():
    import time

    def seconds(n):
        html = "<table>" + "".join(f"<tr><td>{i}</td><td><a href='/{i}'>x</a></td></tr>" for i in range(n)) + "</table>"
        start = time.process_time()
        assert len(list(page_elements._rows_of(html))) == n
        return time.process_time() - start

    seconds(100)
    assert seconds(1_600) < 0.5
    assert seconds(16_000) < 5


def test_pages_of_one_scan_task_are_read_in_many(spark):
    """A small file is one task; equal pages, repeated and missing keys must not meet in one either."""
    html = "<table><tr><td><a href='/x'>X</a></td></tr></table><div class='card'><h3>H</h3></div><ul><li>An item</li></ul>"
    rows = [(k, html) for k in [None] * 30 + [1] * 30 + list(range(2, 42))] + [(50, None)]
    df = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    for read in (page_elements.page_links, page_elements.page_list_items, page_elements.page_table_rows,
                 page_elements.page_cards):
        found = read(df).select("page_id", F.spark_partition_id().alias("task")).collect()
        assert Counter(r.page_id for r in found) == Counter(k for k, h in rows if h)
        tasks = Counter(r.task for r in found)
        assert len(tasks) > 1 and max(tasks.values()) < 50
