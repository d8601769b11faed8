import math
from collections import Counter, defaultdict

import pytest

from noticelake.llm.mixing import exponent, mix, mix_plan, tokens_of


def rows():
    out = []
    for source, n in (("big", 700), ("mid", 120), ("small", 30), (None, 15), ("", 3)):
        out += [(len(out) + k, "w " * (1 + (k * 7) % 13), source, k) for k in range(n)]
    return [*out, (5000, None, "big", 0), (5000, None, "big", 0), (None, "x", "mid", 0)]


SCHEMA = "doc_id bigint, text string, source string, block int"


def shares(totals, a):
    raw = {k: (v / sum(totals.values())) ** a for k, v in totals.items()}
    return {k: v / sum(raw.values()) for k, v in raw.items()}


def entropy(weights):
    return -sum(w * math.log(w) for w in weights.values())


def test_exponent_against_bisection(spark):
    totals = Counter()
    for _, text, source, _ in rows():
        totals[source] += len((text or "").split()) + 1
    df = spark.createDataFrame([(v,) for v in totals.values()], "total bigint")
    for goal in (0.5, 0.8, 0.95, 1.0):
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if entropy(shares(totals, middle)) >= goal * math.log(len(totals)) else (low, middle)
        found = exponent(df, goal, 1e9)
        assert found == pytest.approx(1.0 if entropy(shares(totals, 1.0)) >= goal * math.log(len(totals)) else low, abs=1e-6)
    a = exponent(df, 1.0, 3.0)
    w = shares(totals, a)
    repeats = [w[k] / totals[k] for k in totals]
    assert max(repeats) / min(repeats) == pytest.approx(3.0)


def test_mixture_meets_its_weights(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    found = mix_plan(docs, entropy=0.9, most_repeats=4.0).collect()
    totals, used, weight, seen = Counter(), Counter(), {}, defaultdict(Counter)
    for _, text, source, _ in rows():
        totals[source] += len((text or "").split()) + 1
    for r in found:
        used[r.source] += r.n_tokens
        weight[r.source] = r.weight
        seen[r.doc_id][r.epoch] += 1
    assert sum(weight.values()) == pytest.approx(1)
    budget = max(totals[s] / weight[s] for s in totals)
    for s in totals:  # short of the budget by less than one document
        assert 0 <= round(weight[s] * budget) - used[s] < 28
    assert {k for k, *_ in rows()} == set(seen)
    assert all(sorted(e) == list(range(len(e))) for e in seen.values()) and seen[5000] == {e: 2 for e in seen[5000]}
    capped = mix_plan(docs, entropy=0.9, budget=300.0).collect()
    assert 0 < sum(r.n_tokens for r in capped) <= 300
    assert [(r.doc_id, r.epoch, r.turn, r.place) for r in sorted(found, key=str)] == [(r.doc_id, r.epoch, r.turn, r.place) for r in sorted(mix_plan(docs.repartition(5), entropy=0.9, most_repeats=4.0).collect(), key=str)]


def test_mix_repeats_rows_whole(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    expected = Counter(r.doc_id for r in mix_plan(docs, entropy=0.9, most_repeats=2.0).collect())
    found = mix(docs, entropy=0.9, most_repeats=2.0)
    assert found.columns == docs.columns
    got = found.collect()
    assert Counter(r.doc_id for r in got) == expected and {tuple(r) for r in got} == set(rows())
    for empty in (mix_plan(docs.limit(0)), mix(docs.limit(0))):
        assert empty.collect() == []


def test_tokens(spark):
    df = spark.createDataFrame([("a b\tc",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(tokens_of("t").alias("n")).collect()] == [4, 1, 1]
