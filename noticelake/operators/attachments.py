"""Attachments whose pages are extracted already: text cleaning, the gate on extractable text, and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.functions import grid
from noticelake.functions.text import strip

IMAGE_ONLY = "PDF contains primarily image content with minimal extractable text"
LIMITED = "PDF has limited extractable text content"
DESPITE = ("PDF contains ", " images but text was successfully extracted")
NOT_FETCHED = "Failed to download PDF"


def page_text(text: Column) -> Column:
    """Lines trimmed, empty ones dropped; null if none is left."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def gate(pages: DataFrame) -> DataFrame:
    """Per document of pages (doc_id, page_number, text, images): pages, image_count, text_length, has_text, text_extractable, notification.

    The length is that of all pages' text put together and trimmed once: from the first page with text to the last, so it is
    the sum of the pages' lengths less the white space before and after, and no document's text is gathered.
    """
    text = F.coalesce("text", F.lit(""))
    start = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    end = F.length(text) - F.length(F.regexp_replace(text, r"(?U)\s+$", ""))
    some = F.length(strip(text)) > 0
    parts = pages.select("doc_id", "page_number", "images", F.length(text).alias("n"), start.alias("lead"), end.alias("trail"), some.alias("some"))
    at = F.when(F.col("some"), F.col("page_number"))
    ends = parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("images"), F.lit(0)).alias("image_count"),
        F.array_agg(F.struct("page_number", "n", "lead", "trail", "some")).alias("sizes"), F.min(at).alias("first"), F.max(at).alias("last"),
    )
    between = F.filter("sizes", lambda x: (x["page_number"] >= F.col("first")) & (x["page_number"] <= F.col("last")))
    length = F.aggregate(between, F.lit(0).cast("bigint"), lambda a, x: a + x["n"] - F.when(x["page_number"] == F.col("first"), x["lead"]).otherwise(0) - F.when(x["page_number"] == F.col("last"), x["trail"]).otherwise(0))
    length = F.coalesce(length, F.lit(0).cast("bigint"))
    out = ends.select("doc_id", "pages", "image_count", length.alias("text_length"))
    out = out.withColumns({"has_text": F.col("text_length") > 50, "text_extractable": F.col("text_length") > 100})
    return out.withColumn("notification", F.when(~F.col("text_extractable"), F.when((F.col("image_count") > 0) & (F.col("text_length") < 50), IMAGE_ONLY).otherwise(LIMITED)))


def outcomes(files: DataFrame, pages: DataFrame) -> DataFrame:
    """What comes of each file: url, status (error, notification or content), error, notification, pages, image_count, text_length.

    files: url and fetched (whether there are bytes), one row for each address; pages: url, page_number, text, images, as fetch.pdf_pages has them
    (rows without a page number, of files that cannot be read, count as no pages).  A file that was not fetched is an error.  One
    without enough text, which holds of unreadable ones, is a notification alone; of others there is content, with a notification if there are images, too.
    """
    known = gate(pages.filter("page_number is not null").select(F.col("url").alias("doc_id"), "page_number", "text", "images")).withColumnRenamed("doc_id", "known")
    joined = files.select("url", F.coalesce("fetched", F.lit(False)).alias("fetched")).join(known, F.col("url") == F.col("known"), "left")
    enough = F.coalesce("text_extractable", F.lit(False))
    status = F.when(~F.col("fetched"), "error").when(~enough, "notification").otherwise("content")
    seen = F.when(F.col("image_count") > 0, F.concat(F.lit(DESPITE[0]), F.col("image_count").cast("string"), F.lit(DESPITE[1])))
    notification = F.when(F.col("fetched"), F.when(enough, seen).otherwise(F.coalesce("notification", F.lit(LIMITED))))
    number = lambda c: F.when(F.col("fetched"), F.coalesce(c, F.lit(0)).cast("bigint")).alias(c)
    return joined.select("url", status.alias("status"), F.when(~F.col("fetched"), NOT_FETCHED).alias("error"), notification.alias("notification"), *map(number, ("pages", "image_count", "text_length")))


def grids(cells: DataFrame) -> DataFrame:
    """grid_id and rows (array of arrays) of cell rows (grid_id, r, cells): one shuffle by grid."""
    return cells.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("found")).select("grid_id", F.transform("found", lambda x: x["cells"]).alias("rows"))


def tables(found: DataFrame) -> DataFrame:
    """Valid tables of grids (doc_id, page_number, table_number, rows) in structured form; numbers of rejected ones stay free."""
    made = found.filter(grid.is_valid(F.col("rows"))).withColumn("t", grid.structured(F.col("rows"))).filter("t is not null")
    name = F.concat(F.lit("page_"), F.col("page_number").cast("string"), F.lit("_table_"), F.col("table_number").cast("string"))
    return made.select("doc_id", "page_number", "table_number", name.alias("table_id"), "t.*")


def page_content(pages: DataFrame, structured: DataFrame) -> DataFrame:
    """Content of pages in order: doc_id, page_number, ord, type (text or table), text, table_id.

    Of pages (doc_id, page_number, text) the cleaned text comes first, if there is any; then the page's tables(), by their number.
    """
    texts = pages.select("doc_id", "page_number", F.lit(0).alias("ord"), F.lit("text").alias("type"), page_text(F.col("text")).alias("text"), F.lit(None).cast("string").alias("table_id")).filter("text is not null")
    grids_ = structured.select("doc_id", "page_number", F.col("table_number").cast("int").alias("ord"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), "table_id")
    return texts.unionByName(grids_)
