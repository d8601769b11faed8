"""Tables found in attachments, as arrays of rows of cells: validity, cleaning, header and contents tests, structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticelake.functions.text import let, strip

# Thresholds and words of the tests (fixed values).
VALID_FILL, COLUMN_FILL, TOC_SHARE, NUMERIC_SHARE = 0.3, 0.2, 0.3, 0.7
TOC_WORDS = ("CONTENTS", "PART", "CHAPTER", "SECTION", "REGULATION", "ANNEXURE", "APPENDIX", "PAGE NO", "PAGE")
TOC_MARKS = ("REGULATION–", "REGULATION-", "PART A", "PART B", "PART C")
HEADER_WORDS = (
    "NAME", "TYPE", "DATE", "NUMBER", "ID", "DESCRIPTION", "AMOUNT", "STATUS", "CATEGORY", "TITLE", "CODE", "VALUE",
    "TOTAL", "COUNT", "PAGE", "ITEM", "DETAILS", "CONTENTS", "REGULATION", "PART", "SECTION", "CHAPTER", "ANNEXURE",
)


def filled(cell: Column) -> Column:
    return F.length(strip(F.coalesce(cell, F.lit("")))) > 0


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def is_valid(rows: Column) -> Column:
    """Two rows, two columns in the first, and 30 % of all cells filled."""
    cells = F.flatten(rows)
    share = F.size(F.filter(cells, filled)) / F.size(cells)
    return F.coalesce((F.size(rows) >= 2) & (F.size(F.element_at(rows, 1)) >= 2) & (share >= VALID_FILL), F.lit(False))


def cleaned(rows: Column) -> Column:
    """Nulls as empty cells, cells trimmed; columns (of the first row) filled in 20 % of the rows; rows with a filled cell."""
    def kept_columns(text: Column) -> Column:
        width, height = F.size(F.element_at(text, 1)), F.size(text)
        wide = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(wide, lambda k: F.size(F.filter(text, lambda r: F.coalesce(F.get(r, k - 1), F.lit("")) != "")) / height >= COLUMN_FILL)
        pruned = let(kept, lambda ks: F.transform(text, lambda r: F.transform(ks, lambda k: F.coalesce(F.get(r, k - 1), F.lit("")))))
        return F.filter(pruned, lambda r: F.exists(r, lambda c: c != ""))

    text = F.transform(rows, lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    return F.when(F.size(rows) > 0, let(text, kept_columns)).otherwise(rows)


def looks_like_header(row: Column) -> Column:
    """Header words count 1, title case or capitals a half; 1 is enough unless over 70 % of the filled cells are numbers."""
    def test(cells: Column) -> Column:
        score = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.when(any_word(F.upper(c), HEADER_WORDS), 1.0).otherwise(0.0) + F.when(is_title(c) | is_capitals(c), 0.5).otherwise(0.0))
        numeric = F.size(F.filter(cells, lambda c: F.regexp_replace(c, r"[.\-]", "").rlike(r"^\d+$")))
        return (F.size(cells) > 0) & (numeric / F.size(cells) <= NUMERIC_SHARE) & (score >= 1)

    return F.coalesce(let(F.transform(F.filter(row, filled), strip), test), F.lit(False))


def is_title(cell: Column) -> Column:
    """Every run of letters begins with a capital and goes on in small letters."""
    return cell.rlike("[A-Z]") & ~cell.rlike("[A-Za-z][A-Z]") & ~cell.rlike("(^|[^A-Za-z])[a-z]")


def is_capitals(cell: Column) -> Column:
    return cell.rlike("[A-Z]") & ~cell.rlike("[a-z]")


def is_contents(rows: Column) -> Column:
    """Whether 30 % of the filled cells, each counted up to twice, have words of a table of contents; three rows at least."""
    def test(cells: Column) -> Column:
        points = F.aggregate(cells, F.lit(0), lambda a, c: a + any_word(c, TOC_WORDS).cast("int") + any_word(c, TOC_MARKS).cast("int"))
        return (F.size(cells) > 0) & (points / F.size(cells) >= TOC_SHARE)

    cells = F.transform(F.filter(F.flatten(rows), filled), lambda c: F.upper(strip(c)))
    return F.coalesce((F.size(rows) >= 3) & let(cells, test), F.lit(False))


def contents_names(width: Column) -> Column:
    names = lambda *xs: F.array(*[F.lit(x) for x in xs])
    more = F.transform(F.sequence(F.lit(1), F.greatest(width - 4, F.lit(1))), lambda i: F.concat(F.lit("detail_"), i.cast("string")))
    return (
        F.when(width <= 0, F.array().cast("array<string>")).when(width == 1, names("item")).when(width == 2, names("item", "page"))
        .when(width == 3, names("section", "title", "page")).when(width == 4, names("section", "subsection", "title", "page"))
        .otherwise(F.concat(names("section", "subsection", "title"), more, names("page")))
    )


def structured(rows: Column) -> Column:
    """headers (null without), rows as maps, row_count and column_count of a grid; null if nothing is left of it.

    Of columns with one name the last one counts.  A table of contents has its own column names, and its first row is a row.
    """
    def of(clean: Column) -> Column:
        first = F.element_at(clean, 1)
        tests = F.struct(((F.size(clean) > 1) & looks_like_header(first)).alias("header"), is_contents(clean).alias("contents"))
        return F.when(F.size(first) > 0, let(tests, lambda t: build(clean, first, t["header"], t["contents"])))

    def build(clean: Column, first: Column, header: Column, contents: Column) -> Column:
        width = F.size(first)
        generic = F.transform(first, lambda _, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
        named = F.transform(first, lambda h, i: F.when(h != "", h).otherwise(F.concat(F.lit("column_"), (i + 1).cast("string"))))
        names = F.when(contents, contents_names(width)).when(header, named).otherwise(generic)
        data = F.when(contents | ~header, clean).otherwise(F.slice(clean, F.lit(2), F.greatest(F.size(clean) - 1, F.lit(0))))

        def maps(names: Column) -> Column:
            # of equal names the last: positions after which the name does not come again
            last = F.filter(F.sequence(F.lit(1), width), lambda k: ~F.array_contains(F.slice(names, k + 1, width), F.element_at(names, k)))
            row_map = lambda at: F.transform(data, lambda row: F.map_from_arrays(F.transform(at, lambda k: F.element_at(names, k)), F.transform(at, lambda k: F.get(row, k - 1))))
            return F.filter(let(last, row_map), lambda m: F.exists(F.map_values(m), lambda v: v != ""))

        return let(let(names, maps), lambda found: F.struct(F.when(header, first).alias("headers"), found.alias("rows"), F.size(found).alias("row_count"), width.alias("column_count")))

    return let(cleaned(rows), lambda clean: F.when(F.size(clean) > 0, of(clean)))
