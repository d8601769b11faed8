from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from noticelake.functions.web import resolved
from noticelake.operators import flow, html, structure

BASES = ["https://h.example/a/b/c.htm?x=1#y", "https://h.example", "http://h.example/", "https://h.example/a/"]
HREFS = ["d.htm", "/d/e.htm", "../d.htm", "../../../d.htm", "./d/./e/../f.htm", "//other.example/x", "https://other.example/y?z", "mailto:a@b", "?q=1", "#top", "", "d/?q=/../x", "..", ".", "2014/index.htm", "a/b/.."]


def test_addresses(spark):
    rows = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "base string, href string")
    found = rows.select("base", "href", resolved(F.col("base"), F.col("href")).alias("url")).collect()
    assert [r for r in found if r.url != urljoin(r.base, r.href)] == []


def test_links(spark):
    page = '<a href="x">one <b> two</b></a><a>no</a><a href="">empty</a><p><a href="y"></p><script>z</script><a href="w">in</a> &amp; out</a>'
    nodes = html.nodes(spark.createDataFrame([(1, "u", page), (2, "u", None)], "page_id bigint, url string, html string"))
    assert [(r.href, r.text) for r in structure.links(nodes).orderBy("pos").collect()] == [("x", "onetwo"), ("", "empty"), ("y", ""), ("w", "in")]


@pytest.fixture(scope="module")
def site():
    index = '<a href="2014/index.htm">2014</a><a href="../d1/2013/index.htm">y</a><a href="2012/index.htm">2012</a><a href="/20/other.htm">2014</a>'
    rows = "<table><caption>Circulars {y}</caption><tr><td>BPRD Circular No. {n} of {y}</td><td>May 1, {y}</td><td><a href='/bprd/{y}/C0{n}.htm'>KYC rules for all banks and dealers {n}</a></td></tr><tr><td>9</td><td>May 2, {y}</td><td><a href='/bprd/{y}/C09.htm'>AML rules 9</a></td></tr></table>"
    notice = "<table width='95%'><tr><td>No. {n} May 3, {y}</td></tr><tr><td><blockquote><p>{text}</p></blockquote><a href='/f/a.pdf'>Annex</a></td></tr></table>" + "filler " * 200
    host = "https://host.example"
    return [
        (f"{host}/d1/index.htm", index), (f"{host}/d1/2014/index.htm", rows.format(y=2014, n=1)), (f"{host}/d1/2013/index.htm", rows.format(y=2013, n=2)),
        (f"{host}/bprd/2014/C01.htm", notice.format(n=1, y=2014, text="See BPRD Circular No. 02 of 2013, and BPRD Circular No. 7 of 2011.")),
        (f"{host}/bprd/2013/C02.htm", notice.format(n=2, y=2013, text="See BPRD Circular No. 01 of 2014, which stands before.")),
    ]


def test_whole_flow(spark, site):
    pages = spark.createDataFrame(site, "url string, html string")
    tops = spark.createDataFrame([("d1", "https://host.example/d1/index.htm"), ("d2", "https://host.example/gone.htm")], "dept string, url string")
    years = sorted((r.dept, r.year, r.url) for r in flow.year_pages(tops, pages).collect())
    assert years == [("d1", y, f"https://host.example/d1/{y}/index.htm") for y in ("2012", "2013", "2014")]
    assert [r.year for r in flow.year_pages(tops, pages, 1).collect()] == ["2014"]
    whole, cited = flow.collected(tops, pages)
    found = {(r.year, r.pos): r for r in whole.collect()}
    assert sorted(found) == [(2013, 0), (2013, 1), (2014, 0), (2014, 1)]
    assert found[2014, 0].id_text == "BPRD Circular No. 1 of 2014" and found[2014, 0].date_text == "May 3, 2014" and found[2014, 0].found
    assert not found[2014, 1].found and found[2014, 1].date_text == "May 2, 2014" and found[2014, 1].content is None
    rows = {(r.notice, r.ord): r for r in cited.collect()}
    first = {k[1]: r for k, r in rows.items() if k[0] == found[2014, 0].notice}
    # the cited notice cites this one, which cites it again: its way ends there
    assert [(r.type, r.title, r.error, r["size"], r.errors) for _, r in sorted(first.items())] == [
        ("circular", "BPRD Circular No. 02 of 2013", None, 3, 2), ("circular", "BPRD Circular No. 7 of 2011", "No working URL found", 0, 0), ("pdf", "Annex", None, None, None),
    ]
    assert first[2].url == "https://host.example/f/a.pdf" and first[0].url.endswith("/bprd/2013/C02.htm")


def test_no_departments(spark, site):
    pages = spark.createDataFrame(site, "url string, html string")
    whole, cited = flow.collected(spark.createDataFrame([], "dept string, url string"), pages)
    assert whole.collect() == [] == cited.collect()
