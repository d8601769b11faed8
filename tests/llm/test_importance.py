import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noticelake.llm import importance
from noticelake.llm.importance import features, resample

SCHEMA = "doc_id bigint, text string, rank string, id string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text, longest=2):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@settings(deadline=None, max_examples=60)
@given(st.text(st.sampled_from("aB9 éİ.-\nß中"), max_size=60), st.integers(1, 4), st.integers(1, 9))
def test_features(text, longest, piece):
    importance.PIECE, kept = piece, importance.PIECE  # texts of many pieces
    try:
        n, at, counts = features(text, longest=longest)
    finally:
        importance.PIECE = kept
    words, expected = plain(text, longest)
    assert n == len(words) and dict(zip(at.tolist(), counts.tolist())) == dict(Counter(expected))


def brute(rows, target):
    docs = [(k, *plain(t)) for k, t in rows]
    s, t = Counter(x for *_, f in docs for x in f), Counter(x for text in target for x in plain(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sum(s.values()) + 10_000.0) / ((s[b] + 1.0) * (sum(t.values()) + 10_000.0))))
    out = []
    for k, words, found in docs:
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    drawn = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], x[0] if x[0] is not None else -1))
    return out, drawn[: 25 * len(drawn) // 100]


def test_draw(spark):
    rng = np.random.default_rng(5)
    some = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(some, rng.integers(0, 60)))) for k in range(400)] + [(1000 + k, "Law of the land " * 8) for k in range(200)]  # a third alike
    rows += [(5000, None), (5001, ""), (5002, "x " * 60_000), (3, rows[3][1]), (None, "null id " * 15)]
    target = ["law of the land and sea", "w3 w4", None, ""]
    docs = spark.createDataFrame([(k, t, "r", "i") for k, t in rows], SCHEMA).repartition(5)
    found = resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    expected, drawn = brute(rows, target)
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score) for r in found) == sorted((x[0] or -1, *x[1:4]) for x in expected)
    assert [(r.doc_id, r.score) for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == [(x[0], x[3]) for x in drawn]
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, len(drawn) + 1)) and len(drawn) > 90


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    few = spark.createDataFrame([(1, "one two", "r", "i")], SCHEMA)
    assert resample(none, few).collect() == [] == resample(none, none).collect()
    assert [(r.n_features, r["rank"]) for r in resample(few, none).collect()] == [(3, None)]


def test_blocks_are_bounded(spark):
    """Many texts of many features: no block, and no row group of the written matrix, grows with the partition."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, " ".join(map(str, rng.integers(0, 10**9, 1000))), "r", "i") for k in range(300)], SCHEMA).coalesce(1)
    sizes = [np.diff(r.indptr) for r in importance.count_matrix(docs).select("indptr").collect()]
    assert sum(map(len, sizes)) == 300 and all(s.sum() - s[-1] < importance.BLOCK_ENTRIES for s in sizes)
