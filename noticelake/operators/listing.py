"""Listing pages: rows of a page's table to notices, in the order of its tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.functions.text import any_of, clean_date, collapse, found, has_keyword, strip

# Tests and words that classify rows and links (fixed values).
LETTERS_YEAR = r"circular\s+letters?\s+\d{4}"
CIRCULARS_YEAR = r"circulars?\s+\d{4}"
LETTERS = r"\bcircular\s+letters?\b"
CIRCULARS = r"\bcirculars?\b"
COLUMN_HEADS = r"circular.*date.*description|noti.*date.*description"
BLOCKED = ("library", "help", "index.asp", "sitemap", "contact", "feedback", "about", "careers", "events", "javascript:")
LETTER_URL, CIRCULAR_URL = r"/CL\d+\.htm", r"/C\d+\.htm"
FLAGS = "(?iU)"
UNNUMBERED = 999


def section_head(text: Column) -> Column:
    """The section that a row's text opens, by four tests in order; null if it opens none."""
    no_letter, short = ~F.lower(text).contains("letter"), F.length(strip(text)) < 50
    test = lambda p: any_of(text, (p,), FLAGS)
    return (
        F.when(test(LETTERS_YEAR), "circular_letters").when(test(CIRCULARS_YEAR) & no_letter, "circulars")
        .when(test(LETTERS) & short, "circular_letters").when(test(CIRCULARS) & no_letter & short, "circulars")
    )


def sections(rows: DataFrame) -> DataFrame:
    """rows (page_id, row_idx, row_text) with head (the section a row opens) and section (the one it stands in).

    One shuffle by page; the state is the last head so far, a running frame.
    """
    so_far = Window.partitionBy("page_id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("head", section_head(F.col("row_text"))).withColumn("section", F.last("head", ignorenulls=True).over(so_far))


def kind_by_url(url: Column, section: Column, title: Column) -> Column:
    """Circular or letter by address, then by section, then by title."""
    return (
        F.when(any_of(url, (LETTER_URL,), FLAGS), "circular_letter").when(any_of(url, (CIRCULAR_URL,), FLAGS), "circular")
        .when(section == "circular_letters", "circular_letter").when(section == "circulars", "circular")
        .when(F.lower(title).contains("circular letter"), "circular_letter").otherwise("circular")
    )


def notices(rows: DataFrame) -> DataFrame:
    """Notices of listing rows (page_id, row_idx, row_text, cells, links: array of (href, title), the address resolved).

    One row per notice: page_id, kind, pos (from 0), id_text, title, date_text, url.  Section heads, column heads, rows of under
    10 characters, three cells or no .htm link are passed over; of links, those without text, blocked ones and those without a keyword.
    An address stays once per page and kind, the first time; the order is that of the number after "No." in the ID, unnumbered ones as
    999, then of the page.  Every window is over one page; what is filtered is filtered before the second.
    """
    inside = sections(rows).filter("head is null").filter(~any_of(F.col("row_text"), (COLUMN_HEADS,), FLAGS))
    inside = inside.filter((F.length(strip(F.col("row_text"))) >= 10) & (F.size("cells") >= 3))
    id_text = collapse(F.element_at("cells", 1))
    links = inside.select(
        "page_id", "row_idx", "section", F.when((F.length(id_text) < 50) & id_text.rlike(r"(?U)\d"), id_text).alias("id_text"),
        clean_date(F.element_at("cells", 2)).alias("date_text"),
        F.posexplode(F.filter("links", lambda x: x["href"].endswith(".htm"))).alias("link_idx", "link"),
    )
    title, url = collapse(strip(F.col("link.title"))), F.col("link.href")
    wanted = links.withColumns({"title": title, "url": url}).filter((F.length("url") > 0) & (F.length("title") > 0))
    wanted = wanted.filter(~any_of(F.lower("url"), tuple(w.replace(".", r"\.") for w in BLOCKED)) & has_keyword(F.col("title")))
    wanted = wanted.withColumn("kind", kind_by_url(F.col("url"), F.col("section"), F.col("title")))
    first = Window.partitionBy("page_id", "kind", "url").orderBy("row_idx", "link_idx")
    kept = wanted.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    number = F.coalesce(found(F.col("id_text"), r"(?U)No\.\s*(\d+)").try_cast("int"), F.lit(UNNUMBERED))
    place = Window.partitionBy("page_id", "kind").orderBy("number", "row_idx", "link_idx")
    return kept.withColumn("number", number).select("page_id", "kind", (F.row_number().over(place) - 1).alias("pos"), "id_text", "title", "date_text", "url")


def year_links(links: DataFrame, max_years: int | None = None) -> DataFrame:
    """Year pages of a department from its page's links (dept, pos, href, text): dept, year, href; newest first, max_years at most.

    An address counts if it has 20 and index.htm; the year is the first 20xx in address and text put together, and of one year the first link stays.
    """
    year = found(F.concat(F.col("href"), F.coalesce("text", F.lit(""))), r"(20\d{2})", 1)
    hits = links.filter(F.col("href").contains("20") & F.col("href").contains("index.htm")).withColumn("year", year).filter("year is not null")
    firsts = hits.groupBy("dept", "year").agg(F.min_by("href", "pos").alias("href"))
    if max_years is not None:
        firsts = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("dept").orderBy(F.desc("year")))).filter(F.col("nth") <= max_years)
    return firsts.select("dept", "year", "href").orderBy("dept", F.desc("year"))


def filled_id(dept: Column, kind: Column, id_text: Column, number: Column, year: Column) -> Column:
    """The ID, made from the number found in the document where the listing has none or only digits."""
    made = F.concat(F.upper(dept), F.when(kind == "circular_letter", " Circular Letter No. ").otherwise(" Circular No. "), F.lpad(number, F.greatest(F.length(number), F.lit(2)), F.lit("0")), F.lit(" of "), year)
    bare = id_text.isNull() | (id_text == "") | id_text.rlike(r"^\d+$")
    return F.when(number.isNotNull() & bare, made).otherwise(id_text)
