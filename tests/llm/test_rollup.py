from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from noticelake.llm import rollup
from noticelake.llm.rollup import CommitConflict, RollupStore, counts

SCHEMA = "doc_id bigint, op string, source string, lang string, tokenizer string, tokens bigint"
CHANGE = st.tuples(st.sampled_from([1, 2, 3, None]), st.sampled_from(["insert", "revise", "delete"]), st.sampled_from(["a", None]), st.sampled_from(["en", "de"]), st.sampled_from(["v1", "v2"]), st.one_of(st.none(), st.integers(0, 9)))


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in store.totals().collect()}


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batches=st.lists(st.lists(CHANGE, max_size=4, unique_by=lambda c: c[0]), min_size=1, max_size=3))
def test_against_replay(spark, tmp_path_factory, batches):
    store, present = RollupStore(spark, str(tmp_path_factory.mktemp("rollup") / "s")), {}
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        assert store.apply(f"b{n}", df) and not store.apply(f"b{n}", df)
        for k, op, *rest in batch:
            present.pop(k, None)
            if op != "delete":
                present[k] = (*rest[:3], rest[3] or 0)
    docs, tokens = Counter(v[:3] for v in present.values()), Counter()
    for v in present.values():
        tokens[v[:3]] += v[3]
    assert totals(store) == {k: (n, tokens[k]) for k, n in docs.items()}


def test_last_change_of_a_batch_and_counts(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    assert store.totals().collect() == [] and store.apply("none", spark.createDataFrame([], SCHEMA)) and store.totals().collect() == []
    rows = [(1, "insert", "a", "en", "v1", 5, 0), (1, "revise", "a", "en", "v1", 7, 1), (2, "insert", "a", "en", "v1", 1, 0), (2, "delete", None, None, None, None, 2)]
    store.apply("x", spark.createDataFrame(rows, SCHEMA + ", seq int"))
    assert totals(store) == {("a", "en", "v1"): (1, 7)}
    docs = spark.createDataFrame([(1, "ab c1-2", "s", "en"), (2, None, None, None)], "doc_id bigint, text string, source string, lang string")
    assert sorted(r.tokens for r in counts(docs, "words-1").collect()) == [0, 2] and sorted(r.tokens for r in counts(docs, "words-2").collect()) == [0, 5]


def test_repeated_rows_and_ids(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    rows = [("x", "insert", "a", "en", "v1", 2), ("x", "insert", "a", "en", "v1", 2), ("x", "insert", "a", "de", "v1", 5), ("y", "insert", "a", "en", "v1", 1), (None, "insert", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA.replace("bigint", "string", 1)).repartition(3)
    store.apply("b1", df)
    assert totals(store) == {("a", "en", "v1"): (3, 5), ("a", "de", "v1"): (1, 5), (None, None, None): (1, 0)}
    store.apply("b2", spark.createDataFrame([("x", "revise", "a", "en", "v2", 9), ("zz", "delete", None, None, None, None)], df.schema))
    assert totals(store) == {("a", "en", "v1"): (1, 1), ("a", "en", "v2"): (1, 9), (None, None, None): (1, 0)}
    store.apply("b3", spark.createDataFrame([("x", "delete", None, None, None, None), (None, "delete", None, None, None, None)], df.schema))
    assert totals(store) == {("a", "en", "v1"): (1, 1)} and [r.doc_id for r in store.present().collect()] == ["y"]


def test_of_two_writers_one_fails(spark, tmp_path):
    path = str(tmp_path / "s")
    change = lambda k: spark.createDataFrame([(k, "insert", "a", "en", "v1", k)], SCHEMA)
    fast, slow = RollupStore(spark, path), RollupStore(spark, path)
    own_commit = slow._commit

    def late(record):
        fast.apply("x", change(1))
        own_commit(record)

    slow._commit = late
    with pytest.raises(CommitConflict):
        slow.apply("y", change(2))
    assert totals(slow) == {("a", "en", "v1"): (1, 1)}
    slow._commit = own_commit
    fast.buckets += 3  # a store keeps the buckets that it began with
    assert slow.apply("y", change(2)) and not fast.apply("y", change(2)) and totals(fast) == {("a", "en", "v1"): (2, 3)}


def test_merging_folders_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollup, "COMPACT_AFTER", 3)
    store = RollupStore(spark, str(tmp_path / "s"), buckets=4)
    for n in range(7):
        assert store.apply(f"b{n}", spark.createDataFrame([(n % 3, "insert", "a", "en", "v1", n), (n + 10, "insert", "b", None, "v1", 1)], SCHEMA))
    assert totals(store) == {("a", "en", "v1"): (3, 15), ("b", None, "v1"): (7, 7)} and not store.apply("b0", spark.createDataFrame([], SCHEMA))
    assert len(store.state()["deltas"]) < 4 and len(list((tmp_path / "s" / "log").iterdir())) < 9


def test_a_batch_writes_what_follows_the_batch(spark, tmp_path):
    store = RollupStore(spark, str(tmp_path / "s"))
    store.apply("large", spark.range(20000).selectExpr("id as doc_id", "'insert' as op", "'a' as source", "'en' as lang", "'v1' as tokenizer", "id as tokens"))
    store.apply("small", spark.createDataFrame([(5, "revise", "a", "en", "v1", 0)], SCHEMA))
    large, small = (sum(f.stat().st_size for f in (tmp_path / "s" / "log" / f"part={x}").rglob("*.parquet")) for x in store.state()["log"])
    assert small < large / 50 and totals(store) == {("a", "en", "v1"): (20000, sum(range(20000)) - 5)}
