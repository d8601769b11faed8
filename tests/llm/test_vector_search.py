import math

import numpy as np
import pytest

from noticelake.llm import vector_search
from noticelake.llm.vector_search import Space, Tree, pages_of, top_k

SCHEMA = "vec_id bigint, embedding array<float>, v string, rank int"


def brute(rows, queries, k, scale=256):
    points = []
    for key, x in rows:
        if x is not None and key is not None and all(c is not None and math.isfinite(c) for c in x):
            points.append((key, tuple(math.floor(scale * float(np.float32(c))) for c in x)))
    points = sorted(set(points))
    out = []
    for key, q in points:
        if key in queries:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), other) for other, x in points if other != key)[:k]
            out += [(key, n, other, -score) for n, (score, other) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("size, width", [(1, 3), (40, 2), (700, 2), (900, 6)])
def test_tree_against_all(size, width, monkeypatch):
    monkeypatch.setattr(vector_search, "PAGE", 16)
    rng = np.random.default_rng(size)
    vectors = np.unique(rng.integers(-40, 40, (size, width)), axis=0)
    space = Space(int((vectors**2).sum(1).max()), width)
    pages = pages_of(space.points(vectors))
    routers, radii = np.array([p["router"] for p in pages]), np.array([p["radius"] for p in pages])
    for p in pages:
        p["entries"], p["distances"] = np.array(p["entries"], int), np.array(p["distances"])
        if not p["leaf"]:
            p["routers"], p["radii"] = routers[p["entries"]], radii[p["entries"]]
    assert sorted(e for p in pages if p["leaf"] for e in p["entries"]) == list(range(len(vectors)))
    tree = Tree(space, vectors, [[k] for k in range(len(vectors))], pages)
    visited = 0
    for q in rng.integers(-40, 40, (30, width)):
        scores = vectors @ q
        best = sorted(((-int(s), k) for k, s in enumerate(scores)))[:4]
        tree.computed = 0
        assert tree.search(q, 4, None) == [(-s, k) for s, k in best]
        assert tree.search(q, 4, -best[-1][0]) == [(-s, k) for s, k in best]
        visited += tree.computed
    if size == 700:
        assert visited < 30 * len(vectors) * 0.7  # bounds spare computations


def test_rows(spark, monkeypatch):
    for name, value in (("CELL", 60), ("TREE", 50), ("BLOCK", 7), ("SAMPLE", 200), ("PAGE", 8), ("FANOUT", 4)):
        monkeypatch.setattr(vector_search, name, value)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(0, 0.2, 5).tolist()) for k in range(400)] + [(1000 + k, [0.5, -0.25, 0.125, 0.0, 0.75]) for k in range(250)]  # a hot vector
    rows += [(5000, None), (5050, [1.0, None, 0.0, 0.0, 0.0]), (5100, [float("nan")] * 5), (5150, [float("inf")] * 5), (5200, []), (5250, [0.5, 0.5]), (50, rows[50][1]), (None, [0.1] * 5), (5300, [0.0] * 5)]
    table = spark.createDataFrame([(k, x, "v", 1) for k, x in rows], SCHEMA).repartition(6)
    queries = {k for k, _ in rows if k is not None and k % 50 == 0}
    found = sorted(tuple(r) for r in top_k(table, table.filter("vec_id % 50 = 0"), 5).collect())
    padded = [(k, x if x is None else x + [0.0] * (5 - len(x))) for k, x in rows]
    assert found == brute(padded, queries, 5)


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0], "v", 1), (50, [2.0], "v", 1), (7, [-1.0], "v", 1)], SCHEMA)
    assert sorted(tuple(r) for r in top_k(few, few.filter("vec_id % 50 = 0")).collect()) == [(0, 1, 50, 131072), (0, 2, 7, -65536), (50, 1, 0, 131072), (50, 2, 7, -131072)]
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none, none).collect() == [] == top_k(few, none).collect()


def test_large_components(spark):
    rows = [(k, [float(2**20 + k), float(k)]) for k in range(60)]
    table = spark.createDataFrame([(k, x, "v", 1) for k, x in rows], SCHEMA)
    assert sorted(tuple(r) for r in top_k(table, table.filter("vec_id % 50 = 0"), 3).collect()) == brute(rows, {0, 50}, 3)
