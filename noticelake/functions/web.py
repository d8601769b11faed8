"""Addresses: links resolved against the page that they stand on, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def without_dots(path: Column) -> Column:
    """An absolute path with . and .. taken out; a path that ends in either is a folder."""
    parts = F.split(path, "/")
    step = lambda kept, x: F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(x == ".", kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolved(base: Column, href: Column) -> Column:
    """The address that href means on the page base: absolute ones as they are, else by host, folder or page of the base."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    page = F.regexp_extract(base, r"^[^?#]*", 0)
    path = F.regexp_replace(page, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    own, rest = F.regexp_extract(href, r"^[^?#]*", 0), F.regexp_extract(href, r"[?#].*$", 0)
    there = F.concat(origin, without_dots(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))), rest)
    return (
        F.when(href.rlike(SCHEME), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(href == "", base)
        .when(F.startswith(href, F.lit("?")), F.concat(page, href)).when(F.startswith(href, F.lit("#")), F.concat(F.regexp_extract(base, "^[^#]*", 0), href)).otherwise(there)
    )
