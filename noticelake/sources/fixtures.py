"""Input views derived from the driver's tables: notices, listings and grids as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_ref_titles": r"""
select o_orderkey as k,
  (case o_custkey % 8 when 0 then 'BPRD' when 1 then 'BSD' when 2 then 'BPD' when 3 then 'AC&MFD'
     when 4 then 'MFD' when 5 then 'acd' when 6 then 'BPRD''s' else 'ACFID' end)
  || (case when o_orderkey % 3 = 0 then ' Circular Letter ' else ' circular ' end)
  || (case when o_orderkey % 2 = 0 then 'No. ' else '' end)
  || (case when o_orderkey % 11 = 0 then cast(100 + o_orderkey % 40 as string)
           when o_orderkey % 4 = 0 then '0' || cast(o_orderkey % 10 as string) else cast(o_orderkey % 40 as string) end)
  || (case when o_orderkey % 5 = 0 then '' else ' of ' || cast(1998 + o_orderkey % 20 as string) end)
  || (case when o_orderkey % 7 = 0 then ' dated January 29, ' || cast(2000 + o_orderkey % 15 as string) else '' end) as title
from orders
""",
    "fx_listing_rows": r"""
select o_custkey % 200 as page_id, 2000 + (o_custkey % 200) % 20 as yr, o_orderkey as row_idx,
  case o_orderkey % 23 when 0 then 'section' when 1 then 'section' when 2 then 'colhead' when 3 then 'short' else 'data' end as shape,
  case o_orderkey % 23 when 0 then 'Circulars 2014' when 1 then 'Circular Letters 2014'
       when 2 then (case when o_orderkey % 2 = 0 then 'Circular No. Date Description' else 'Notification No. Date Description' end)
       when 3 then (case when o_orderkey % 2 = 0 then 'BPRD Circular No. 01' else 'BPRD Circular Letter No. 1' end)
       else (case when o_orderkey % 4 = 0 then cast(o_orderkey % 30 as string)
                  when o_orderkey % 9 = 0 then 'n/a'
                  else 'BPRD Circular No. ' || cast(o_orderkey % 30 as string) || ' of 2014' end) end as cell0,
  case when o_orderkey % 23 < 3 then '' when o_orderkey % 23 = 3 then 'Jan 2, 2014' when o_orderkey % 13 = 0 then ' - ' else ' January  ' || cast(1 + o_orderkey % 28 as string) || ',  2014 ' end as cell1,
  case when o_orderkey % 23 < 3 then '' when o_orderkey % 23 = 3 then 'AML guide'
       else (case o_orderkey % 6 when 0 then 'Revision of KYC rules for branches and agents number ' when 1 then 'StreamLining of forms and templates for branches ' when 2 then 'Customer Onboarding requirements for digital accounts '
             when 3 then 'Regulatory framework for remittance circular letter ' when 4 then 'Holiday notice for all scheduled banks and dealers ' else 'aml/cft controls in correspondent banking ' end) || cast(o_orderkey % 17 as string) end as cell2,
  case when o_orderkey % 23 < 3 then '' else 'https://host.example/bprd/2014/' ||
       (case o_orderkey % 8 when 0 then 'CL' when 1 then 'cl' when 2 then 'C' when 3 then 'c' when 4 then 'Help/C' when 5 then 'doc' when 6 then 'FE' else 'C' end)
       || cast(o_orderkey % 12 as string) || '.htm' end as href
from orders
""",
    "fx_ref_docs": r"""
select o_orderkey as doc_id,
  'BPRD Circular ' || (case when o_orderkey % 5 = 0 then 'Letter ' else '' end) || 'No. ' || cast(o_orderkey % 12 as string) || (case when o_orderkey % 4 = 0 then '' else ' of 2012' end) as own_id,
  'Amendment to BPRD Circular No. ' || cast(8 + o_orderkey % 9 as string) || ' of 2010' as doc_title,
  'Please refer to BPRD Circular No. ' || cast(o_orderkey % 9 as string) || ' of 2012, bprd circular 1 and BSD Circular Letter No. 0'
  || cast(o_orderkey % 7 as string) || ' of 2005. Attention is invited to BPRD Circular No. ' || cast(o_orderkey % 9 as string)
  || ' of 2012 and AC&MFD’s Circular ' || cast(o_orderkey % 5 as string) || ' dated January 29, 2014.' as text
from orders
""",
    "fx_edges": r"""
select o_orderkey as src, o_orderkey - o_orderkey % 10 + (o_orderkey * 7 + 3) % 10 as dst from orders
union select o_orderkey, o_orderkey - o_orderkey % 10 + (o_orderkey + 4) % 10 from orders where o_orderkey % 9 = 0
union select o_orderkey, o_orderkey + 10 from orders where o_orderkey % 10 = 0 and o_orderkey % 300 < 200
""",
    "fx_grid_cells": r"""
select l_orderkey as grid_id, l_linenumber as r,
  case when l_linenumber = 1 and l_orderkey % 3 = 0 then 'Item Name' when l_orderkey % 5 = 0 then 'Part ' || cast(l_linenumber as string) when l_partkey % 4 = 0 then null else ' ' || l_returnflag || ' ' end as c1,
  case when l_linenumber = 1 and l_orderkey % 3 = 0 then 'Amount' when l_partkey % 3 = 0 then '' else cast(l_suppkey as string) end as c2,
  case when l_linenumber = 1 and l_orderkey % 6 = 0 then 'Amount' when l_orderkey % 7 = 0 then null else cast(l_linenumber * 10 as string) end as c3,
  case when l_partkey % 29 = 0 then 'x' else null end as c4
from lineitem
""",
    "fx_dates": r"""
select o_orderkey as k, case o_orderkey % 7 when 0 then 'Karachi,  August 11, ' || cast(year(o_orderdate) as string) when 1 then '11 August ' || cast(year(o_orderdate) as string)
  when 2 then 'on 11/08/' || cast(year(o_orderdate) as string) when 3 then cast(year(o_orderdate) as string) || '-08-11 Circular No. 7' when 4 then 'ab' when 5 then null else 'Letter no. ' || cast(o_orderkey % 50 as string) || ' of 2011' end as s
from orders
""",
}

# Notices by order, each with its address and a text that cites others: within its ten (cycles among those that exist), from some tens to the next,
# an unknown department here and there, and notices that do not exist.
_YEAR = "cast(2003 + ({n}) % 12 as string)"
_TITLE = "'BPRD Circular No. ' || cast({n} as string) || ' of ' || " + _YEAR


def _citing() -> str:
    title, year = (lambda n: _TITLE.format(n=n)), (lambda n: _YEAR.format(n=n))
    key = "o_orderkey"
    number = f"case when {key} < 10 then '0' else '' end || cast({key} as string)"
    return f"""
select {key} as n, {title(key)} as title,
  'https://host.example/' || case when 2003 + {key} % 12 <= 2006 then 'bpd' else 'bprd' end || '/' || {year(key)} || '/C' || {number} || '.htm' as url,
  'Refer to ' || {title(f"{key} - {key} % 10 + ({key} * 7 + 3) % 10")} || '. ' || case when {key} % 9 = 0 then 'Also ' || {title(f"{key} - {key} % 10 + ({key} + 4) % 10")} || '. ' else '' end
  || case when {key} % 11 = 0 then 'See XYZ Circular 3 of 2010. ' else '' end || case when {key} % 10 in (0, 5, 7) and {key} % 300 < 200 then 'And ' || {title(f"{key} + 27")} || '.' else '' end as text
from orders
"""


VIEWS["fx_citing"] = _citing()

# Articles in the places where notices have theirs, with paragraphs made to lists, tables, quotes and numbered points; as ends are missing or stand
# where nothing is open, pages of all shapes come out.
_ARTICLES = ("""'<div class="content"><blockquote>'""", """'<table width="95%"><tr><td>'""", """'<div align="justify">'""", """'<div id="content">'""", "'<div>'", "'<blockquote>'")
_ENDS = ("'</blockquote></div>'", "'</td></tr></table>'", "'</div>'", "'</div>'", "'</div>'", "'</blockquote>'")
_MARKUP = (
    ("<h1>", "<p>1. "), ("</h1>", "</p><ul><li>of this page</li></ul>"), ("<p>E", '<ol type="I"><li>E'), ("<p>D", "<ul><li>D"), ("<p>A", '<ol type="a"><ul><li>A'), ("<p>T", "<table><tr><th>T"), ("<p>I", "<tr><td>I"),
    ("<p>L", "<blockquote><p>L"), ("<p>O", "<p>a) O"), ("<p>S", "<table><tr><td>S"), ("<p>R", "<blockquote><ul><li>R"), ("<p>N", "<p>iv. N"), ("n.</p>", "n.</li></ul>"), ("e.</p>", "e.</li></ol>"), ("t.</p>", "t.</td></tr></table>"),
    ("r.</p>", "r.</blockquote>"), ("h.</p>", "h.</p></blockquote>"), (" de ", "</li><li>de "), (" the ", "</td><td>the "), (" und ", "</td></tr><tr><td>und "), (" la ", "</li><ul><li>la "), (" of ", "</ul><li></li><li>of "), (" que ", "</td></tr><tr><th>que"), (" in ", "</td><td>"),
)


def _articles() -> str:
    case = lambda texts: "case page_id % 6 " + " ".join(f"when {k} then {t}" for k, t in enumerate(texts)) + " end"
    html = f"replace(replace(html, '<article>', {case(_ARTICLES)}), '</article>', {case(_ENDS)})"
    for old, new in _MARKUP:
        html = f"replace({html}, '{old}', '{new}')"
    return f"\nselect page_id, url, {html} as html\nfrom pages\n"


VIEWS["fx_articles"] = _articles()

#: The table that each view reads.
READS = {name: next(t for t in ("lineitem", "orders", "pages") if f"from {t}" in sql) for name, sql in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the Parquet tables in sf_dir."""
    table = READS[name]
    return spark.sql(VIEWS[name].replace(f"from {table}", "from {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def oracle(query: str, *names: str) -> str:
    """The query as DuckDB SQL with the named views put before its own common table expressions."""
    views = ", ".join(f"{name} as ({VIEWS[name].strip()})" for name in names)
    query = query.strip()
    for start in ("with recursive ", "with "):
        if query.startswith(start):
            return f"{start}{views}, {query[len(start):]}"
    return f"with {views} {query}"
