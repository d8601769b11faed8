"""Text functions over notices, as Catalyst expressions: keywords, numbers, dates, numbering and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words, patterns and tables that results depend on (fixed values).
KEYWORDS = ("KYC", "CDD", "AML", "CFT", "CPF", "Customer Onboarding Framework", "Framework", "Customer Onboarding")
NUMBER_PATTERNS = (r"(?:circular|letter)\s+no\.\s*(\d+)", r"no\.\s*(\d+)", r"(\d+)\s+of\s+\d{4}")
DATE_PATTERNS = (r"(\w+\s+\d{1,2},\s+\d{4})", r"(\d{1,2}\s+\w+\s+\d{4})", r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{4}-\d{2}-\d{2})")
#: The first word whole and from its start: no match begins elsewhere in it, so none is tried.
QUICK_DATES = (DATE_PATTERNS[0].replace(r"(\w+", r"(?<!\w)(\w++", 1), *DATE_PATTERNS[1:])
UNWANTED_PATTERNS = (r"^(Home|Back|Print|Download|Search)$", r"^(Department|Circular|Notification)s?\s*$", r"^\s*\|\s*$", r"^\s*[-_=]+\s*$")
NUMBERED_PATTERNS = (r"^\s*\d+[\.\)]\s+", r"^\s*[A-Z][\.\)]\s+", r"^\s*[a-z][\.\)]\s+", r"^\s*[IVX]+[\.\)]\s+", r"^\s*[ivx]+[\.\)]\s+")
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))

UNICODE = "(?U)"


def let(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each computed once per row however often it is used: a generator of one row, which the
    optimizer neither copies into filters above it nor folds into other projections."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, UNICODE + r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, UNICODE + r"\s{2,}|[^\S ]", " ")  # a single blank stays as it is


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the pattern's first match; null where it or the match is missing."""
    return let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def any_of(text: Column, patterns: tuple[str, ...], flags: str = UNICODE) -> Column:
    return F.coalesce(text.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def has_keyword(text: Column) -> Column:
    """Whether one of the keywords stands in the text as words; false for null."""
    return any_of(text, (r"\b(?:" + "|".join(KEYWORDS) + r")\b",), "(?iU)")


def first_number(text: Column) -> Column:
    """The number of a notice by the first pattern, in order of priority, that matches anywhere."""
    named, plain, year = [found(text, "(?iU)" + p) for p in NUMBER_PATTERNS]
    # what the first pattern finds has a match of the second in it
    return let(plain, lambda x: F.when(x.isNotNull(), F.coalesce(named, x)).otherwise(year))


def clean_date(text: Column) -> Column:
    """White space collapsed and trimmed; null if under three characters."""
    cleaned = strip(collapse(text))
    return F.when(F.length(cleaned) >= 3, cleaned)


def first_date(text: Column) -> Column:
    """The date, as text, by the first pattern that matches the cleaned text."""
    def first(cleaned):
        named, *others = [found(cleaned, UNICODE + p) for p in QUICK_DATES]
        return F.coalesce(F.when(cleaned.rlike(UNICODE + r",\s+\d{4}"), named), *others)

    return let(clean_date(text), first)


def clean_text(text: Column) -> Column:
    """White space collapsed, literal &nbsp; taken off the ends; empty for null."""
    text = strip(collapse(F.coalesce(text, F.lit(""))))
    text = F.regexp_replace(text, UNICODE + r"^\s*&nbsp;\s*", "")
    return F.regexp_replace(text, UNICODE + r"\s*&nbsp;\s*$", "")


def is_unwanted(text: Column) -> Column:
    """Under three characters, or nothing but a navigation word, a section word, a bar or a rule."""
    text = strip(F.coalesce(text, F.lit("")))
    return (F.length(text) < 3) | any_of(text, UNWANTED_PATTERNS, "(?iU)")


def is_numbered_point(text: Column) -> Column:
    return any_of(text, NUMBERED_PATTERNS)


def without_number(text: Column) -> Column:
    return F.regexp_replace(text, UNICODE + r"^\d+\.\s*", "")


def renumbered(items: Column) -> Column:
    """Items of an array numbered 1., 2., ... anew if there is more than one."""
    return F.when(F.size(items) > 1, F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), without_number(x)))).otherwise(items)


def roman(number: Column) -> Column:
    """Roman numeral of a whole number, by a fold over the values."""
    values = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    start = F.struct(number.cast("int").alias("left"), F.lit("").alias("out"))
    step = lambda a, x: F.struct((a["left"] % x["v"]).cast("int").alias("left"), F.concat(a["out"], F.repeat(x["s"], F.floor(a["left"] / x["v"]).cast("int"))).alias("out"))
    return F.aggregate(values, start, step, lambda a: a["out"])


def list_label(number: Column, style: Column) -> Column:
    """A list item's number in its list's style: 1, A, a, I or i; decimal for any other and for null."""
    label = (
        F.when(style == "A", F.char(number + 64))
        .when(style == "a", F.char(number + 96))
        .when(style == "I", roman(number))
        .when(style == "i", F.lower(roman(number)))
        .otherwise(number.cast("string"))
    )
    return F.concat(label, F.lit("."))
