"""Whole notices: what a listing says of one, put together with its page, its citations and its attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.functions.text import first_date, first_number, once
from noticelake.operators.listing import filled_id
from noticelake.operators.references import detect
from noticelake.sources.scratch import dealt, written


def assemble(notices: DataFrame, parts: DataFrame) -> DataFrame:
    """notices (notice: an id of its own, dept, year, kind, id_text, title, date_text, url and others) with what their pages have.

    parts: html.notice_parts(), one row for each address.  The number in a page's header makes the ID where the listing has none or only
    digits, the date there replaces the listing's.  Added are found (whether the page is known), content (blocks, JSON) and
    references: an array of (type, title, url), citations first, in their order, then the PDF files that the page links to.
    A notice without its page keeps what the listing says; content is null and references are empty.

    Pages are parsed once.  The notices meet their pages by address, and their citations by the notice's id, by which detect() has
    dealt them already.
    """
    parts = written(parts, "parts")
    whole = once(notices.join(parts.withColumn("found", F.lit(True)), "url", "left"), number=first_number(F.col("header")), date=first_date(F.col("header")))
    whole = whole.withColumns({
        "id_text": filled_id(F.col("dept"), F.col("kind"), F.col("id_text"), F.col("number"), F.col("year").cast("string")),
        "date_text": F.coalesce("date", "date_text"), "found": F.coalesce("found", F.lit(False)),
    })
    cited = detect(dealt(whole.select(F.col("notice").alias("doc_id"), F.col("id_text").alias("own_id"), F.col("title").alias("doc_title"), "text"), "doc_id"))
    reference = F.struct("type", "title", F.lit(None).cast("string").alias("url"))
    listed = cited.groupBy(F.col("doc_id").alias("notice")).agg(F.array_sort(F.collect_list(F.struct("ord", reference.alias("of")))).alias("cited"))
    files = F.transform(F.coalesce("pdfs", F.array()), lambda x: F.struct(F.lit("pdf").alias("type"), x["title"].alias("title"), x["url"].alias("url")))
    kind = "array<struct<type:string,title:string,url:string>>"
    joined = whole.join(listed, "notice", "left")
    references = F.concat(F.coalesce(F.transform("cited", lambda x: x["of"]), F.array()).cast(kind), files.cast(kind))
    own = [c for c in notices.columns if c not in ("id_text", "date_text")]
    return joined.select(*own, "id_text", "date_text", "found", F.col("blocks").alias("content"), references.alias("references"))


def with_attachments(references: DataFrame, attachments: DataFrame) -> DataFrame:
    """references (with url) and, of those that are attachments (url, pages, text_extractable, notification), what is known of the file."""
    known = attachments.select("url", "pages", "text_extractable", "notification")
    return references.join(known, "url", "left")
