import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticelake.llm._shared import crc_mod
from noticelake.llm.lm_score import Hash, scores, stream_of, words_of

ORDER = 3


def ppm(training, order):
    table = defaultdict(Counter)
    for stream in training:
        padded = b"\0" * order + stream
        for i in range(order, len(padded)):
            for k in range(order + 1):
                table[padded[i - k : i]][padded[i]] += 1

    def chance(context, byte):
        out, seen = 1.0, set()
        for k in range(order, -1, -1):
            c = table.get(context[order - k :])
            if c is None:
                continue
            left = {b: n for b, n in c.items() if b not in seen}
            if not left:
                continue
            width = sum(left.values()) + len(left)
            if byte in left:
                return out * left[byte] / width
            out *= len(left) / width
            seen |= set(left)
        return out / (256 - len(seen))

    return chance


def expected(rows, order):
    train = [(k, t) for k, t in rows if zlib.crc32(str(k).encode()) % 7 != 2]
    chance = ppm([stream_of(words_of(t)) for _, t in train], order)
    c = Counter(w for _, t in train for w in [*words_of(t), "end"])
    n, v = sum(c.values()), len(c)
    out = []
    for k, t in rows:
        tokens = [*words_of(t), "end"]
        padded = b"\0" * order + stream_of(words_of(t))
        score = sum(math.log10(chance(padded[i - order : i], padded[i])) for i in range(order, len(padded)))
        out.append((k, zlib.crc32(str(k).encode()) % 7 == 2, len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), score))
    return sorted(out)


@pytest.mark.parametrize("entries", [4_000_000, 60])
def test_against_brute_force(spark, entries):
    rng = random.Random(5)
    words = ["the", "then", "Zöe", "cat", "cats", "sat", "a", "été", "on"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(40)] + [(41, None), (42, "qqq\0 日本\t\tx"), (3, "the cat"), (3, "the cat")]
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id bigint, text string, score int").repartition(3)
    found = sorted(tuple(r) for r in scores(docs, crc_mod("doc_id", 7) != 2, order=ORDER, block_entries=entries).collect())
    for a, b in zip(found, expected(rows, ORDER), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_chances_add_up():
    chance = ppm([b"the cat sat \n", b"the hat \n"], ORDER)
    for context in (b"the", b"zzz", b" ca", b"\0\0\0"):
        assert sum(chance(context, b) for b in range(256)) == pytest.approx(1)


def test_without_training_or_rows(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in scores(docs, F.lit(None).cast("boolean")).collect()}
    assert found[1].score == pytest.approx(-4 * math.log10(256)) and found[1].n_known == 0 and found[2].n_tokens == 1 and found[2].held_out
    assert scores(docs.limit(0), F.lit(True)).collect() == []


def test_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    h = Hash(keys, np.arange(len(keys)).astype(float))
    got, hit = h.get(np.concatenate([keys, keys + np.uint64(1)]))
    assert hit[: len(keys)].all() and (got[: len(keys)] == np.arange(len(keys))).all() and not hit[len(keys) :].any()
