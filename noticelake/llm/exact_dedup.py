"""Exact deduplication by counting quotient filters and byte verification.

A fingerprint's high bits (the quotient) address a slot, its low bits (the remainder) are stored there; runs of equal
quotient are kept sorted by remainder, with two bits of metadata and, for repeated fingerprints, a count.  So a filter
holds its fingerprints sorted and without loss, and two filters merge like sorted lists: equal quotient and remainder
add their counts.  Each partition builds a filter, cut into slices by the first bits of the quotient; slices of one
number meet in one task and are merged.  Only fingerprints whose merged count is above one can belong to copies: their
rows, and no others, go to byte verification, which groups them by the normalised bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticelake.llm._shared import WHITE, lean, partitions, without_rows, written

#: Repeated fingerprints (8 bytes each) up to which the rows to verify are found by a broadcast; beyond, by a shuffled join.
BROADCAST_FINGERPRINTS = 2_000_000


@dataclass
class CountingQuotientFilter:
    """Fingerprints of 64 bits with counts.  occupied and run_ends are bit sets over quotients and slots; remainders holds
    a run for each occupied quotient, in order; repeats and counts list the slots whose count is above one."""

    remainder_bits: int
    first_quotient: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    repeats: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, quotient_bits: int | None = None) -> "CountingQuotientFilter":
        """Of uint64 fingerprints, in any order, repeats allowed."""
        fingerprints, counts = add_up(fingerprints, np.ones(len(fingerprints), np.int64) if counts is None else counts)
        if quotient_bits is None:
            # quotients about as many as fingerprints over the range that these fingerprints cover
            spread = int(fingerprints[-1] - fingerprints[0]) if len(fingerprints) else 0
            quotient_bits = max(1, min(48, 64 - spread.bit_length() + max(1, len(fingerprints)).bit_length()))
        shift = np.uint64(64 - quotient_bits)
        quotients = fingerprints >> shift
        remainders = fingerprints & np.uint64((1 << int(shift)) - 1)
        first = int(quotients[0]) if len(quotients) else 0
        occupied = np.zeros(int(quotients[-1]) - first + 1 if len(quotients) else 0, bool)
        occupied[(quotients - np.uint64(first)).astype(np.int64)] = True
        run_ends = np.ones(len(quotients), bool)
        run_ends[:-1] = quotients[1:] != quotients[:-1]
        repeats = np.flatnonzero(counts > 1)
        return cls(int(shift), first, occupied, run_ends, remainders, repeats, counts[repeats])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in order, and their counts."""
        run = np.concatenate([[0], np.cumsum(self.run_ends)[:-1]]).astype(np.int64)[: len(self.remainders)]
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run] + np.uint64(self.first_quotient)
        counts = np.ones(len(self.remainders), np.int64)
        counts[self.repeats] = self.counts
        return (quotients << np.uint64(self.remainder_bits)) | self.remainders, counts

    def to_bytes(self) -> bytes:
        width = (self.remainder_bits + 7) // 8
        head = np.array([self.remainder_bits, self.first_quotient, len(self.occupied), len(self.run_ends), len(self.repeats)], np.int64)
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        return b"".join(x.tobytes() for x in (head, np.packbits(self.occupied), np.packbits(self.run_ends), np.ascontiguousarray(packed), self.repeats.astype(np.int64), self.counts.astype(np.int64)))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "CountingQuotientFilter":
        bits, first, spread, slots, repeats = np.frombuffer(raw, np.int64, 5).tolist()
        width, at = (bits + 7) // 8, 40
        occupied = np.unpackbits(np.frombuffer(raw, np.uint8, (spread + 7) // 8, at), count=spread).astype(bool)
        at += (spread + 7) // 8
        run_ends = np.unpackbits(np.frombuffer(raw, np.uint8, (slots + 7) // 8, at), count=slots).astype(bool)
        at += (slots + 7) // 8
        remainders = np.zeros((slots, 8), np.uint8)
        remainders[:, :width] = np.frombuffer(raw, np.uint8, slots * width, at).reshape(slots, width)
        at += slots * width
        ends = [np.frombuffer(raw, np.int64, repeats, at + k * repeats * 8) for k in (0, 1)]
        return cls(bits, first, occupied, run_ends, remainders.view("<u8").reshape(-1), *ends)

    def merge(self, other: "CountingQuotientFilter") -> "CountingQuotientFilter":
        pairs = [self.items(), other.items()]
        return self.build(*(np.concatenate(x) for x in zip(*pairs)))


def add_up(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and the sums of their counts."""
    if not len(fingerprints):
        return fingerprints.astype(np.uint64), counts.astype(np.int64)
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
    return fingerprints[starts], np.add.reduceat(counts, starts)


def normalised(column: str) -> Column:
    """White-space runs become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), WHITE, " ")


def repeated_fingerprints(rows: DataFrame, slices: int) -> DataFrame:
    """Fingerprints (column fp of rows, bigint; column copies: how often) whose count over all rows is above one."""
    slice_bits = max(1, (slices - 1).bit_length())
    schema = "slice int, filter binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            new = add_up(batch.column("fp").to_numpy().view(np.uint64), batch.column("copies").to_numpy())
            while held and len(held[-1][0]) <= 2 * len(new[0]):  # sizes stay geometric
                new = add_up(*(np.concatenate(x) for x in zip(held.pop(), new)))
            held.append(new)
        if not held:
            return
        fps, counts = add_up(*(np.concatenate(x) for x in zip(*held)))
        cut = (fps >> np.uint64(64 - slice_bits)).astype(np.int64)
        edges = np.searchsorted(cut, np.arange((1 << slice_bits) + 1))
        for k in range(1 << slice_bits):
            a, b = edges[k], edges[k + 1]
            if a < b:
                part = CountingQuotientFilter.build(fps[a:b], counts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.to_bytes()], pa.binary())], ["slice", "filter"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, list[CountingQuotientFilter]] = {}
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("filter").to_pylist()):
                arrived, stack = CountingQuotientFilter.from_bytes(raw), merged.setdefault(k, [])
                while stack and len(stack[-1].remainders) <= 2 * len(arrived.remainders):  # sizes stay geometric
                    arrived = stack.pop().merge(arrived)
                stack.append(arrived)
        for stack in merged.values():
            whole = stack.pop()
            while stack:
                whole = stack.pop().merge(whole)
            fps, counts = whole.items()
            again = counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(fps[again].view(np.int64)), pa.array(counts[again])], ["fp", "copies"])

    built = rows.select("fp", "copies").mapInArrow(lean(build), schema)
    return built.repartitionById(1 << slice_bits, F.col("slice")).mapInArrow(lean(merge), "fp bigint, copies bigint")


def find_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fingerprint=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space runs become one space; a null text counts as empty.  Of equal
    texts the row of the smallest id stays.  A row that repeats both id and text is a copy like any other: of such rows
    exactly one is kept.  The same id with different texts stays once for each text.  A null id sorts after all others.  Other columns are not
    read, so their names cannot clash.  No rows: no rows.

    The text is read once for its fingerprint and digest, and of texts only those with a repeated fingerprint move in a
    shuffle, pre-aggregated per task; a hot group therefore reaches verification as one row per task.
    ``fingerprint`` is a function of the normalised text that returns a bigint.
    """
    spark = docs.sparkSession
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")).withColumn("norm", normalised("text"))
    base = source.select("doc_id", fingerprint(F.col("norm")).alias("fp"), F.sha2(F.col("norm"), 256).alias("text_sha256"))
    base = written(base.groupBy("doc_id", "fp", "text_sha256").agg(F.count(F.lit(1)).alias("copies")), "exact-base")
    repeated = written(repeated_fingerprints(base, partitions(spark)), "exact-repeated")

    few = repeated.count() <= BROADCAST_FINGERPRINTS
    wanted = F.broadcast(repeated.select("fp")) if few else repeated.select("fp")
    routed = source.withColumn("fp", fingerprint(F.col("norm"))).join(wanted, "fp", "left_semi")
    groups = routed.groupBy("fp", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.filter("group_size > 1").select("fp", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-groups")
    if not groups.groupBy("text_sha256").count().filter("count > 1").isEmpty():
        raise ValueError("two texts with different bytes have one SHA-256")

    row = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    found = base.join(groups, ["fp", "text_sha256"], "left").select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), "text_sha256", row.alias("nth"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows that find_copies() does not keep; columns, whatever they are called, and all other rows are as they were.

    Only rows of groups are touched: their (id, digest) pairs decide, and of rows equal in both one stays.  Null and empty texts
    are one group; a null id is an id like any other, after all others; the same id with different texts stays once for each.  No rows: no rows.
    """
    copies = find_copies(docs, id_column, text_column)
    groups = written(copies.filter("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "exact-decisions")
    keys = [F.col(id_column), F.sha2(normalised(text_column), 256)]
    return without_rows(docs, keys, groups.filter("not kept").select("doc_id", "text_sha256"), groups.filter("kept and rows > 1").select("doc_id", "text_sha256"), BROADCAST_FINGERPRINTS // 4)
