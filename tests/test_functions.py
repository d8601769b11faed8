import pytest
from pyspark.sql import functions as F

from noticelake.functions import citation, grid, text
from noticelake.operators import attachments, references


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("title, expected", [
    ("BPRD Circular Letter No. 3 of 2019; see BSD Circular No. 7 of 2005", ("BSD", "circular", "07", "2005", "2005")),
    ("AC&MFD Circular No. 01 of 2014 dated January 29, 2015", ("AC&MFD", "circular", "01", "2015", "January 29, 2015")),
    ("BPRD Circular Letter 19 of 2021", ("BPRD", "circular_letter", "19", "2021", "2021")),
    ("nothing", None), (None, None), ("", None),
])
def test_parse(spark, title, expected):
    got = value(spark, citation.parsed(F.lit(title).cast("string")))
    assert (tuple(got[:5]) if got else None) == expected


@pytest.mark.parametrize("title, key", [("BSD Circular No. 007 of January 3, 2006", "bsd circular 7 2006"), (None, ""), ("Other  Text ", "other  text"), ("BPRD’s Circular Letter 000", "bprd’s circular letter 0")])
def test_canonical(spark, title, key):
    assert value(spark, citation.canonical(F.lit(title).cast("string"))) == key


@pytest.mark.parametrize("dept, year, code", [("BSD", "2006", "bsd"), ("BSD", "2007", "bsrvd"), ("BPRD", "2006", "bpd"), ("bprd", None, "bprd"), ("MFD", "2010", None), ("BSD", "x", "bsrvd"), ("ACFID", "1990", "acd"), (None, "2000", None)])
def test_codes(spark, dept, year, code):
    assert value(spark, citation.department_code(F.lit(dept).cast("string"), F.lit(year).cast("string"))) == code


@pytest.mark.parametrize("args, names", [(("acd", "01", "2014", "circular"), ["C01", "C1", "c01", "c1"]), (("acd", "12", "2014", "circular_letter"), ["CL12", "cl12"]), (("acd", "1", None, "circular"), []), (("acd", "00", "2014", "circular"), ["C00", "C0", "c00", "c0"])])
def test_candidates(spark, args, names):
    got = value(spark, citation.candidate_urls(*[F.lit(a).cast("string") for a in args]))
    assert got == [f"https://host.example/acd/2014/{n}.htm" for n in names]


def rows(lines):
    return F.array(*[F.array(*[F.lit(c).cast("string") for c in line]) for line in lines])


def test_grids(spark):
    got = value(spark, grid.structured(rows([["Name", "Amount", "Amount"], ["a", "1", "2"]])))
    assert got.rows == [{"Name": "a", "Amount": "2"}] and got.column_count == 3 and got.headers == ["Name", "Amount", "Amount"]
    six = [["a", "x" if k == 0 else ""] for k in range(6)]
    assert value(spark, grid.cleaned(rows(six))) == [["a"]] * 6 and value(spark, grid.cleaned(rows(six[:5])))[0] == ["a", "x"]
    toc = value(spark, grid.structured(rows([["Section", "Page"], ["Chapter 1", "1"], ["Part A", "4"]])))
    assert toc.headers == ["Section", "Page"] and toc.rows[0] == {"item": "Section", "page": "Page"} and toc.row_count == 3
    assert value(spark, grid.looks_like_header(F.array(F.lit("Paid"), F.lit("Sum")))) and not value(spark, grid.looks_like_header(F.array(F.lit("10"), F.lit("20.5"))))
    assert not value(spark, grid.is_valid(rows([["a", "b"]]))) and not value(spark, grid.is_valid(rows([["a"], ["b"]]))) and value(spark, grid.is_valid(rows([["a", "b"], [None, " "]])))
    assert value(spark, grid.structured(rows([[None, ""], ["", " "]]))) is None


def test_gate(spark):
    pages = spark.createDataFrame([(1, 1, " " + "x" * 50, 1), (2, 1, "x" * 49, 1), (2, 2, None, 0), (3, 1, "x" * 60 + " ", 0), (3, 2, "  " + "y" * 41, 0), (4, 1, None, 0)], "doc_id bigint, page_number int, text string, images int")
    got = {r.doc_id: r for r in attachments.gate(pages).collect()}
    assert got[1].notification == attachments.LIMITED and not got[1].has_text
    assert got[2].notification == attachments.IMAGE_ONLY and got[3].text_length == 104 and got[3].notification is None and got[4].text_length == 0


def test_numbers_and_text(spark):
    assert [value(spark, text.roman(F.lit(n))) for n in (1, 4, 9, 1994)] == ["I", "IV", "IX", "MCMXCIV"]
    assert value(spark, text.first_number(F.lit("Letter No. 5, circular no. 7 of 2001"))) == "5"
    assert value(spark, text.first_date(F.lit("abc\n11,  2010"))) == "abc 11, 2010" and value(spark, text.first_date(F.lit("4 février 2010"))) == "4 février 2010"
    assert value(spark, text.clean_text(F.lit(" &nbsp; a  b &nbsp;"))) == "a b" and value(spark, text.has_keyword(F.lit("StreamLining"))) is False


def test_paths_and_reach(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    paths = references.expand(edges).collect()
    for r in paths:
        nodes = r.path.split(">")
        assert (len(set(nodes[:-1])) == len(nodes) - 1) and ((nodes[-1] in nodes[:-1]) == (r.error is not None))
    assert {(r.root, r.node) for r in references.reachable(edges).collect()} == {(r.root, r.node) for r in paths if r.root != r.node}


def test_reach_of_a_long_chain(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 58
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)], "src bigint, dst bigint").coalesce(1)
    found = {(r.root, r.node) for r in references.reachable(edges).collect()}
    assert found == {(a, b) for a in range(n) for b in range(a + 1, n + 1)}
    with pytest.raises(ValueError):
        references.reachable(edges, max_rounds=3)


def test_null_titles_are_errors_not_lost(spark):
    titles = spark.createDataFrame([(1, None), (2, "BPRD Circular No. 5 of 2012"), (3, "nothing"), (4, None)], "k bigint, title string")
    known = spark.createDataFrame([("https://host.example/bprd/2012/C05.htm",)], "url string")
    found = {r.k: (r.url, r.error) for r in references.resolve(titles, known).collect()}
    assert found == {1: (None, references.ERRORS["parse"]), 2: ("https://host.example/bprd/2012/C05.htm", None), 3: (None, references.ERRORS["parse"]), 4: (None, references.ERRORS["parse"])}


def test_paths_cut_at_the_depth_are_marked(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "src bigint, dst bigint")
    found = references.expand(edges, spark.createDataFrame([(0,), (3,)], "root bigint"), max_depth=3).collect()
    assert sorted((r.root, r.path, r.error) for r in found if r.depth == 3) == [(0, "0>1>2>3", references.TOO_DEEP), (3, "3>4>5>6", None)]


def test_expansion_follows_pages_until_nothing_is_new(spark):
    url = "https://host.example/bprd/2012/C{:02d}.htm"
    cite = "Refer to BPRD Circular No. {} of 2012."
    pages = spark.createDataFrame([(url.format(k), cite.format(k + 1) + " " + cite.format(k)) for k in range(1, 4)] + [(url.format(4), cite.format(1) + " and XYZ Circular 9 of 2012")], "url string, text string")
    titles = spark.createDataFrame([("BPRD Circular No. 1 of 2012",), (None,), ("BPRD Circular No. 1 of 2012",)], "title string")
    met, edges = references.citation_graph(titles, pages)
    named = "BPRD Circular No. {} of 2012".format
    assert sorted((r.src, r.dst) for r in edges.collect()) == sorted([*((named(k), named(k + 1)) for k in range(1, 4)), (named(4), named(1)), (named(4), "XYZ Circular 9 of 2012")])
    errors = {r.title: r.error for r in met.collect()}
    assert errors == {**{named(k): None for k in range(1, 5)}, None: references.ERRORS["parse"], "XYZ Circular 9 of 2012": references.ERRORS["department"] + "XYZ"}
    paths = references.expand(edges, titles.filter("title is not null").distinct().withColumnRenamed("title", "root")).collect()
    assert {r.error for r in paths if r.depth == 4} == {references.CYCLE, None} and max(r.depth for r in paths) == 4
    assert [x.collect() for x in references.citation_graph(titles.limit(0), pages)] == [[], []]


def test_department_of_url(spark):
    rows = spark.createDataFrame([("https://host.example/ACD/index.htm",), ("https://host.example/",), ("other",), (None,)], "url string")
    assert [r[0] for r in rows.select(citation.department_of_url(F.col("url"))).collect()] == ["acd", None, None, None]


def test_numbers_and_dates_by_priority(spark):
    """The patterns tried one after the other, as they are written, on texts that mix them."""
    import random
    import re

    from noticelake.functions import text

    rng = random.Random(8)
    parts = ["Circular", "no.", "Letter No. 4", "no.5", "7 of 2011", "May 3, 2014", "XMay 13,  2004", ", 2004", "3 May 2012", "1/2/2003", "2003-04-05", " ", "\t", "  ", "é", "12345", "of"]
    made = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    first = lambda patterns, s, flags=0: next((m[1] for p in patterns if (m := re.search(p, s, flags))), None)
    rows = spark.createDataFrame([(s,) for s in made], "s string").select("s", text.first_number(F.col("s")).alias("number"), text.first_date(F.col("s")).alias("date")).collect()
    for r in rows:
        cleaned = re.sub(r"\s+", " ", r.s).strip()
        assert (r.number, r.date) == (first(text.NUMBER_PATTERNS, r.s, re.I), first(text.DATE_PATTERNS, cleaned) if len(cleaned) >= 3 else None)
