"""Corpus pipeline: documents that toxicity rejects go, then exact copies, then near copies; what is left is mixed to
target weights and encoded.  Each stage works on all rows that its predecessor kept.

All stages take null and empty texts (no tokens, never toxic, copies of each other), null ids (an id like any other), repeated
ids and rows, texts of any length, further columns of any name (they are passed on) and empty tables (which stay empty).
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from noticelake.llm import bpe, exact_dedup, mixing, simhash, toxicity
from noticelake.llm._shared import crc_mod, written

#: No source is repeated more than this often against the least repeated one.
MOST_REPEATS = 1.5
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Rows that go to Python together (Spark's own setting: 10,000).  Documents are wide: a task held its batch several times over, outside of the heap.
BATCH_ROWS = 2_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """stage, in a session that hands at most BATCH_ROWS rows to Python at a time; the session keeps that, as stages end when their result is read."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        most = "spark.sql.execution.arrow.maxRecordsPerBatch"
        set_to = int(spark.conf.get(most))
        if not 0 < set_to <= BATCH_ROWS:
            spark.conf.set(most, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold, by a model of the labels outside the held-out third; repeated rows share their fate."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod("doc_id", 3) != 1)  # the rest stays held out
    return toxicity.reject(docs, toxicity.train(docs, labels))


@in_small_batches
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike up to white space the row of the smallest id; of rows equal in id and text one."""
    return exact_dedup.drop_copies(docs)


@in_small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the shingles of five words, exactly counted) the row of the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to MOST_REPEATS times; a null source is one of its own."""
    return mixing.mix(docs, most_repeats=MOST_REPEATS)


@in_small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, one row per row; a null text has no tokens."""
    return bpe.encode(docs, Path(RANKS).read_bytes(), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("temperature mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: SQL expresses neither the classifier, the fingerprints nor the merges; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
