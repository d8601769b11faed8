import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noticelake.llm.exact_dedup import CountingQuotientFilter, drop_copies, find_copies

SCHEMA = "doc_id bigint, text string, fp string, norm string"
ROWS = [
    (5, "a  b", "x", None), (3, "a\tb", "x", None), (3, "a\tb", "x", None), (9, None, None, "n"), (8, "", None, "n"), (7, "unique", "y", None),
    (4, "A b", "y", None), (11, " ", "z", None), (12, "\n\n", "z", None), (3, "other text, same id", "q", None), (20, "long " * 20000, "q", None), (19, "long  " * 20000, "q", None),
]


def brute(rows):
    groups = {}
    for k, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(k)
    return sorted((k, min(groups[n]), len(groups[n])) for k, text, *_ in rows for n in [re.sub(r"[\x20\x09-\x0D]+", " ", text or "")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 40)), st.lists(st.integers(0, 40)))
def test_filters_merge_without_loss(a, b):
    x, y = (CountingQuotientFilter.build(np.array(v, np.uint64)) for v in (a, b))
    merged = CountingQuotientFilter.from_bytes(x.merge(CountingQuotientFilter.from_bytes(y.to_bytes())).to_bytes())
    fps, counts = merged.items()
    expected = {v: (a + b).count(v) for v in a + b}
    assert fps.tolist() == sorted(expected) and counts.tolist() == [expected[v] for v in sorted(expected)]


def test_copies_against_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    weak = lambda norm: (F.xxhash64(norm) % 2)  # noqa: E731  collisions must be told apart by their bytes
    for fingerprint in (F.xxhash64, weak):
        found = find_copies(docs, fingerprint=fingerprint).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in found) == brute(ROWS)
        assert sorted(r.doc_id for r in found if r.kept) == [3, 3, 4, 7, 8, 11, 19]


def test_drop_copies_keeps_columns_and_one_row(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 3, 4, 7, 8, 11, 19]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert find_copies(docs).collect() == [] and drop_copies(docs).collect() == []


def test_names_of_columns_do_not_matter(spark):
    rows = [(1, "a b", 1, 2, 3), (2, "a  b", 4, 5, 6), (2, "a b", 4, 5, 6), (3, "c", 7, 8, 9), (3, "c", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __id int, __text_sha256 int, k0 int")
    left = drop_copies(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [rows[0], rows[3]]
