import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from noticelake.llm import fingerprint as fp


def plain_features(raw: bytes) -> list[bytes]:
    """Selected windows by the definition, one at a time."""
    w = fp.WINDOW
    raw = b"\0" * (w - 1) + raw + b"\0" * (w - 1)
    ranks = []
    for i in range(len(raw) - w + 1):
        total = sum(round(c * math.log2(c) * (1 << 12)) for c in Counter(raw[i : i + w]).values())
        most = round(w * math.log2(w) * (1 << 12))
        entropy = (most - total) * 1000 // most
        ranks.append(1023 if entropy <= 0 else 1000 - abs(entropy - fp.COMMON))
    popular = Counter()
    for i in range(len(ranks) - w + 1):
        popular[min(range(i, i + w), key=lambda k: (ranks[k], k))] += 1
    return [raw[i : i + w] for i in sorted(popular) if popular[i] >= fp.POPULAR and ranks[i] < 1023]


def texts():
    rng = random.Random(2)
    words = ["the", "house", "ünder", "a", "river", "42", "runs,", "日本"]
    return ["", "a", "short one", *[" ".join(rng.choice(words) for _ in range(n)) for n in (3, 20, 200, 900)]]


def test_features_against_definition():
    raw = [x.encode() for x in texts()]
    found, owner = fp.features_of(raw)
    for k, x in enumerate(raw):
        windows = plain_features(x)
        own = found[owner == k]
        assert len(own) == len(windows)
        seen = {}
        assert all(seen.setdefault(w, h) == h for w, h in zip(windows, own.tolist()))
        assert len(set(seen.values())) == len(set(windows))


def test_likeness():
    rng = random.Random(3)
    a = " ".join(f"w{rng.randrange(3000)}" for _ in range(6000))
    b = " ".join(f"v{rng.randrange(3000)}" for _ in range(4000))
    da, db, de, empty = fp.digests([a, b, fp.edited(a, b), ""])
    assert len(da.filters) > 3 and fp.likeness(da, da) == 1 and fp.likeness(da, fp.digests([a])[0]) == 1
    assert fp.likeness(da, db) < 0.15 < 0.5 < fp.likeness(da, de) < 0.9 and fp.likeness(da, de) == pytest.approx(fp.likeness(de, da))
    assert fp.likeness(empty, empty) == 1 and fp.likeness(empty, da) == 0
    again = fp.Digest.parse(da.text())
    assert again.text() == da.text() and fp.likeness(again, de) == pytest.approx(fp.likeness(da, de), abs=1e-6)


def test_next_rows(spark):
    rng = random.Random(4)
    rows = [(k, None if k % 9 == 0 else " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 40))), "x") for k in range(0, 300, 3)]
    rows += [(30, "zz repeated id", "y"), (30, "zz repeated id", "y"), (None, "null id", "y"), (301, "long " * 20000, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string").repartition(5)
    found = fp.compare_with_next(docs, least_partitions=7).collect()
    line = sorted(((k, t or "") for k, t, _ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    expected = [(k, len(t), hashlib.sha256(fp.edited(t, line[(i + 1) % len(line)][1]).encode()).hexdigest()) for i, (k, t) in enumerate(line)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=order) == sorted(expected, key=order)
    one = fp.compare_with_next(docs.filter("doc_id = 301")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fp.compare_with_next(docs.limit(0)).collect() == []
    plain = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in found if r.doc_id != 30)


def test_ranges(spark):
    bounds = [5, 10, 15, 20, 40]
    rows = [(k,) for k in range(50)] + [(None,)]
    found = {r.k: r.n for r in spark.createDataFrame(rows, "k bigint").select("k", fp.range_of("k", bounds).alias("n")).collect()}
    assert all(found[k] == sum(b >= k for b in bounds) for k in range(50)) and found[None] == 5


def test_blocks_of_filters_change_nothing(monkeypatch):
    rng = random.Random(6)
    a, b = (" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (9000, 5000))
    da, db = fp.digests([a, b])
    whole = fp.likeness(da, db)
    monkeypatch.setattr(fp, "PAIR_BLOCK", 5)
    assert fp.likeness(da, db) == pytest.approx(whole, abs=1e-12) == fp.likeness(db, da)


def test_ids_must_be_whole_numbers(spark):
    with pytest.raises(TypeError):
        fp.compare_with_next(spark.createDataFrame([("a", "x")], "doc_id string, text string"))
