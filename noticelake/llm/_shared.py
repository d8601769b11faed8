"""What the operators of this package share: text rules, CRC splits, rows of batches, the removal of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticelake.sources.scratch import shared_dir, written  # noqa: F401  for the package's modules

#: White space as the contracts define it: space, and U+0009 to U+000D.
WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session: the one setting that a cluster sizes to its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column's value as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rows_of(batches: Iterator, columns: list[str], most: int = 512) -> Iterator[tuple]:
    """Lists of the named columns' values, most rows at a time, so that long texts aren't turned to Python objects all at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            part = batch.slice(at, most)
            yield tuple(part.column(c).to_pylist() for c in columns)


def without_rows(docs: DataFrame, keys: list[Column], gone: DataFrame, several: DataFrame, broadcast_rows: int) -> DataFrame:
    """docs without the rows whose keys (null-safe) are a row of gone, and with one row of those whose keys are a row of several.

    Columns and all other rows are as they were, whatever the columns are called.  gone and several have as many columns as keys.
    Small ones are broadcast, so texts do not move; larger ones meet the rows in a shuffle.
    """
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], *[key.alias(f"k{k}") for k, key in enumerate(keys)])

    def joined(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
        right = right.toDF(*[f"r{k}" for k in range(len(keys))])
        right = F.broadcast(right) if right.count() <= broadcast_rows else right
        on = F.lit(True)
        for k in range(len(keys)):
            on = on & F.col(f"k{k}").eqNullSafe(F.col(f"r{k}"))
        return left.join(right, on, kind)

    left = joined(rows, gone, "left_anti")
    if not several.isEmpty():
        one = joined(left, several, "left_semi").dropDuplicates([f"k{k}" for k in range(len(keys))])
        left = joined(left, several, "left_anti").unionByName(one)
    return left.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])


#: What this Python worker keeps between partitions: one thing at most, by its key.
_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What make() gives, made once per Python worker; it stays until a partition needs something else (``lean``)."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Give free memory back to the system: Arrow's, and that of malloc where it is glibc's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let_go(key: Hashable) -> None:
    """Drop what the worker keeps under any other key."""
    if _kept and key not in _kept:
        _kept.clear()
        release()


def lean(run: Callable[[Iterator], Iterator], key: Hashable = None) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, whose worker holds no more than it needs: what the stage before kept under another key goes
    first, and free memory goes last, as the worker lives on and shares its executor's memory with the stages after it."""

    def whole(batches: Iterator) -> Iterator:
        let_go(key)
        yield from run(batches)
        release()

    return whole
