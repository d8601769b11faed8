import zlib
from collections import defaultdict

import numpy as np

from noticelake.llm.sharding import pack, shard

SCHEMA = "doc_id bigint, text string, shard string"


def test_pack_balances_all_dimensions():
    rng = np.random.default_rng(2)
    demands = np.column_stack([rng.lognormal(8, 1, 4000), rng.lognormal(6, 1, 4000), rng.integers(1, 5, 4000)])
    chosen = pack(demands, 8)
    loads = np.array([demands[chosen == k].sum(0) for k in range(8)]) / demands.sum(0) * 8
    assert np.abs(loads - 1).max() < 0.03
    assert len(pack(np.zeros((0, 3)), 4)) == 0


def test_rows(spark):
    rows = [(k, f"text {k} " + "word " * (k % 50), "x") for k in range(3000)]
    rows += [(10_000 + k, "the same text", "x") for k in range(1500)]  # a third of all rows
    rows += [(20_000 + k, f"pair {k // 2}", "x") for k in range(200)] + [(30_001, None, "x"), (30_001, None, "x"), (None, "", "x"), (30_002, "long " * 40000, "x")]
    found = shard(spark.createDataFrame(rows, SCHEMA).repartition(4), 8).collect()
    assert len(found) == len(rows)
    text = defaultdict(list)
    for k, t, _ in rows:
        text[k].append(t)
    slots, homes, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in found:
        t = text[r.doc_id][0]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        slots[r.shard].append(r.slot)
        homes[t].add(r.shard)
        sizes[r.shard] += r.size
    assert set(slots) <= set(range(8)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(v) == 1 for k, v in homes.items() if k != "the same text") and len(homes["the same text"]) > 1
    rest = sorted(v for v in sizes.values())[:-1]  # one text is larger than a shard's share
    assert max(rest) / min(rest) < 1.2
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []


def plain_pack(demands, shards):
    """The greedy placement by its words, one shard at a time."""
    total = [max(sum(d[c] for d in demands), 1e-300) for c in range(3)]
    shares = [[d[c] / total[c] * shards for c in range(3)] for d in demands]
    loads, chosen = [[0.0] * 3 for _ in range(shards)], [0] * len(demands)
    for k in sorted(range(len(demands)), key=lambda k: (-sum(x * x for x in shares[k]), k)):
        own, options = shares[k], []
        for s in range(shards):
            left = [1 - loads[s][c] for c in range(3)]
            fits = all(left[c] - own[c] >= -own[c] * 0.5 for c in range(3))
            score = sum(left[c] * own[c] for c in range(3)) if fits else min(left[c] - own[c] for c in range(3))
            options.append((not fits, -round(score, 12), -round(sum(left), 9), s))
        best = min(options)[-1]
        loads[best] = [loads[best][c] + own[c] for c in range(3)]
        chosen[k] = best
    return chosen


def test_pack_against_the_plain_placement():
    rng = np.random.default_rng(5)
    for n, shards in ((0, 3), (1, 4), (40, 4), (200, 7), (90, 16)):
        demands = np.column_stack([rng.integers(1, 400, n), rng.integers(1, 60, n), rng.integers(1, 4, n)]).astype(float)
        demands[n // 2 :] = demands[: n - n // 2]  # ties
        assert pack(demands, shards).tolist() == plain_pack(demands.tolist(), shards)


def test_equal_groups_and_shards(spark):
    rows = [(k % 10, f"t{k % 40}", "s") for k in range(400)]
    found = shard(spark.createDataFrame(rows, SCHEMA), 4).collect()
    assert len(found) == 400 and sorted(r.slot for r in found if r.shard == 0) == list(range(sum(r.shard == 0 for r in found)))
    assert sorted({r.shard for r in found}) == [0, 1, 2, 3]
