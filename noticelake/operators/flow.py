"""From departments to notices with their content and expanded citations: the operators in a row over one table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.citation import canonical
from noticelake.functions.web import resolved
from noticelake.operators import html, listing, notices, structure
from noticelake.operators.expansion import citation_tree
from noticelake.sources.files import CitationCache
from noticelake.sources.scratch import dealt, written


def year_pages(departments: DataFrame, site: DataFrame, max_years: int | None = None) -> DataFrame:
    """dept, year, url of the year pages that the departments' pages (dept, url) link to, the newest max_years; a department whose page is not in site (url, html) has none."""
    pages = departments.select("dept", "url").join(site.select("url", "html"), "url").withColumn("page_id", F.xxhash64("url"))
    pages = written(pages, "department-pages")
    nodes = written(html.nodes(pages.dropDuplicates(["page_id"])), "department-nodes")
    found = structure.links(nodes).join(pages.select("page_id", "dept", F.col("url").alias("base")), "page_id")
    links = listing.year_links(found.select(F.struct("dept", "base").alias("dept"), "pos", "href", "text"), max_years)
    return links.select("dept.dept", "year", resolved(F.col("dept.base"), F.col("href")).alias("url"))


def collected(departments: DataFrame, site: DataFrame, max_years: int | None = None, cache: CitationCache | None = None) -> tuple[DataFrame, DataFrame]:
    """Notices and their citations, expanded.

    departments: dept and url; site: url and html of all pages there are, one row for each address.  Notices have dept, year, kind, pos, id_text, title, date_text, url, found, content
    (JSON) and references; citations have notice (its dept, year, kind, pos), ord, type, title, url of references, and of the cited notice's expansion entry, error, size, errors and
    height (citation_tree's entry).  A year page or notice that is not in site is passed over: the first has no notices, the second keeps what the listing says.
    """
    years = written(year_pages(departments, site, max_years).withColumn("page_id", F.xxhash64("dept", "url")), "year-pages")
    listed = listing.notices(html.listing_rows(years.join(site.select("url", "html"), "url").select("page_id", "url", "html")))
    named = listed.join(years.select("page_id", "dept", F.col("year").cast("int").alias("year")), "page_id").drop("page_id")
    named = written(named.withColumn("notice", F.to_json(F.struct("dept", "year", "kind", "pos"))), "listed")
    # each page is parsed once, for notices and for citations alike
    parts = written(html.notice_parts(dealt(site.select(F.lit(0).cast("bigint").alias("page_id"), "url", "html"), "url")), "site-parts")
    whole = written(notices.assemble(named, parts), "assembled")
    cited = written(whole.select("notice", F.posexplode("references").alias("ord", "r")).select("notice", "ord", "r.type", "r.title", "r.url"), "cited")
    titles = cited.filter("type != 'pdf'").select("title").distinct()
    entries, _ = citation_tree(titles, parts.select("url", "text"), cache=cache)
    known = entries.select(F.col("entry").alias("key"), F.col("url").alias("found_at"), F.col("entry"), "error", "size", "errors", "height")
    keyed = cited.withColumn("key", F.when(F.col("type") != "pdf", canonical(F.col("title"))))
    expanded = keyed.join(known, "key", "left").select("notice", "ord", "type", "title", F.coalesce("url", "found_at").alias("url"), "entry", "error", "size", "errors", "height")
    return whole, expanded
