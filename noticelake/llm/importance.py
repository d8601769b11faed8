"""Importance resampling towards a target distribution, on hashed word n-grams.

Texts become rows of a sparse document-by-bucket count matrix, kept as Parquet in CSR blocks: a block has a bounded number
of entries, and its documents, row pointers, bucket indices and counts.  Column sums of the matrix give the corpus's distribution over
buckets, those of the target's matrix the target's; the product of the matrix with the log ratios of both (gains) gives each document's
weight.  Gumbel noise from the document's id turns the highest scores into a draw without replacement.

Texts move nowhere: they are read once, and afterwards only the matrix is.  What the driver sees is one number per bucket and one per distinct score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticelake.llm._shared import rows_of, written

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 2
#: Documents and matrix entries after which a block is closed; bytes of a text that are cut into words at once.
BLOCK_DOCS, BLOCK_ENTRIES, PIECE = 512, 1 << 14, 1 << 20
#: Bytes of a Parquet row group of blocks: a reader decodes a row group's arrays at once, so memory is bounded by it and not by the file.
ROW_GROUP = 4 << 20

# In UTF-8 every byte of a character outside ASCII is over 127, so words can be cut from bytes.
WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a lower-cased text, a piece of it at a time; a word is never cut."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE)
        end = gap.start() if gap else len(data)
        yield WORD_BYTES.findall(data, at, end)
        at = end


def features(text: str | None, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, the buckets that the text's runs of 1 to longest words fall in (ascending), and how many fall in each."""
    words, total = 0, None
    last: list[bytes] = []  # the words before this piece that a run may start with
    found: list[np.ndarray] = []
    for piece in pieces((text or "").encode().lower()):
        words += len(piece)
        run = last + piece
        sums = [0] * len(run)
        for n in range(1, longest + 1):  # crc32 of a run goes on from that of the run without its last word
            tail = [b" " + w for w in run[n - 1 :]] if n > 1 else run
            sums = list(map(zlib.crc32, tail, sums))
            # runs that lie in the words before this piece have been counted
            new = sums[max(0, len(last) - n + 1) :]
            found.append(np.array(new, np.int64) % buckets)
        last = run[max(0, len(run) - longest + 1) :] if longest > 1 else []
        if sum(map(len, found)) > PIECE:
            counted = np.bincount(np.concatenate(found), minlength=buckets)
            total, found = counted if total is None else total + counted, []
    if total is not None:
        total = total + np.bincount(np.concatenate([*found, np.zeros(0, np.int64)]), minlength=buckets)
        at = np.flatnonzero(total)
        return words, at, total[at]
    return words, *np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)


def count_matrix(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """CSR blocks of docs: ids and words (of each document), indptr (one longer), indices and data (of each entry).

    A document is a row: repeated rows and null ids are documents of their own, a null or empty text is an empty row of the matrix.
    A text of any length takes one row with an entry per bucket at most; a block is closed by the text that fills it, so it has fewer than
    BLOCK_ENTRIES entries and those of one text.
    """
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = to_arrow_type(source.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, sizes, indices, data, entries = [], [], [0], [], [], 0

        def block() -> pa.RecordBatch:
            columns = [(ids, kind), (words, pa.int64()), (np.cumsum(sizes), pa.int64()), (np.concatenate(indices), pa.int32()), (np.concatenate(data), pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([c], pa.list_(t)) for c, t in columns], ["ids", "words", "indptr", "indices", "data"])

        for some, texts in rows_of(batches, ["id", "text"], most=64):
            for one, value in zip(some, texts):
                n, at, counts = features(value, buckets, longest)
                ids.append(one), words.append(n), sizes.append(len(at)), indices.append(at), data.append(counts)
                entries += len(at)
                if len(ids) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                    yield block()
                    ids, words, sizes, indices, data, entries = [], [], [0], [], [], 0
        if ids:
            yield block()

    id_type = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"ids array<{id_type}>, words array<bigint>, indptr array<bigint>, indices array<int>, data array<int>")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and total of each column that has entries; a partition sends one row per column at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at, counts = (batch.column(c)[k].values.to_numpy() for c in ("indices", "data"))
                np.add.at(total, at, counts.astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "total"])

    return matrix.select("indices", "data").mapInArrow(run, "bucket int, total bigint").groupBy("bucket").agg(F.sum("total").alias("total"))


def dense(sums: DataFrame, buckets: int) -> list[int]:
    """Column sums as a list; one number per bucket, so bounded."""
    out = [0] * buckets
    for row in sums.collect():
        out[row.bucket] = row.total
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Thousandths of the log ratio of target and corpus in each bucket, one added to every count; floors go down."""
    n, s, t = len(corpus), float(sum(corpus)), float(sum(target))
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target)], np.int64)


def weights(matrix: DataFrame, gain: np.ndarray, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_features and weight of each document: the floored mean gain of its features, by products of blocks and gains."""
    id_type = matrix.schema["ids"].dataType.elementType
    kind = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                indptr, at, counts = (batch.column(c)[k].values.to_numpy().astype(np.int64) for c in ("indptr", "indices", "data"))
                sums = [np.concatenate([[0], np.cumsum(x)])[indptr] for x in (counts, counts * gain[at])]
                n, total = np.diff(sums[0]), np.diff(sums[1])
                ids, words = batch.column("ids")[k].values.cast(kind), batch.column("words")[k].values
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(total // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    found = matrix.mapInArrow(run, f"id {id_type.simpleString()}, n_words bigint, n_features bigint, weight bigint")
    return found.withColumnRenamed("id", key)


def gumbel(key: str, seed: int) -> Column:
    """Thousandths of Gumbel noise from the id, floored; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, text: str = "text", key: str = "doc_id", target_text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every row of docs: its likeness to target's texts, and its place in the draw.

    Of the N rows with at least least_words words the percent * N // 100 highest scores are drawn and ranked from 1, ties by smaller key; others have no rank.
    A null text has no words, features of 0 weigh 0; rows of equal key and score share their places in any order.  With an empty target every
    document is weighed against equal buckets; without docs there are no rows.  Columns beside key and text are not looked at.
    """
    spark = docs.sparkSession
    matrix = written(count_matrix(docs, text, key, buckets, longest), "count-matrix", **{"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 8})
    wanted = count_matrix(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("text")), "text", "id", buckets, longest)
    gain = gains(dense(column_sums(matrix, buckets), buckets), dense(column_sums(wanted, buckets), buckets))
    scored = weights(matrix, gain, "id").withColumn("score", F.col("weight") + gumbel("id", seed))
    scored = written(scored.withColumn("open", F.col("n_words") >= least_words), "scores")
    # Scores are whole thousandths, so their counts are few however many documents there are; they say where each score's places begin.
    places = scored.filter("open").groupBy("score").agg(F.count("*").alias("n"))
    places = written(places.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")), "places")
    drawn = (places.agg(F.sum("n")).first()[0] or 0) * percent // 100
    within = places.filter(F.col("before") < drawn)
    lowest = within.agg(F.min("score")).first()[0]
    high = F.col("open") & (F.col("score") >= F.lit(lowest).cast("bigint"))
    high = F.coalesce(high, F.lit(False))
    order = Window.partitionBy("score").orderBy("id")
    ranked = scored.filter(high).join(within.select("score", "before"), "score").withColumn("rank", F.col("before") + F.row_number().over(order))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ["id", "n_words", "n_features", "weight", "score"]
    rest = scored.filter(~high).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, "rank").union(rest).withColumnRenamed("id", key)
