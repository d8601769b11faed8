"""Exact top-k search by inner product with M-trees in pages.

A vector x becomes the point (x, sqrt(B - |x|^2)), B being the largest squared length there is, and a query q the point (q, 0).  Their squared distance is
|q|^2 + B - 2 q.x, so the nearest points are those of the highest inner products, and the distance is a metric: M-trees apply.

Equal vectors are one point with their smallest ids (as many as a query may ask for, and one more), so hot vectors stay small.
A bounded sample gives routing points of two levels; every point is then dealt to its nearest router (a cell), large cells
in parts by hash, and each part becomes an M-tree of pages with covering radii and distances to parents, kept as Parquet.
Each query first searches its nearest cell, best page first.  The k-th score found there bounds all further cells, subtrees and
entries: those whose stored distances rule them out by the triangle inequality are not computed.  Scores are compared as
whole numbers; the float bounds have slack, so nothing that ties is lost.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from noticelake.llm._shared import partitions, written

#: Points a cell should have, and those from which it is dealt to several trees.
CELL, TREE = 4_096, 16_384
#: Points that routers are drawn from, and cells at most.
SAMPLE, MOST_CELLS = 32_768, 4_096
#: Entries of a leaf page, and routers that a page is split by.  A page is one product of a matrix, so large ones cost little even where bounds rule out few.
PAGE, FANOUT = 1024, 8
#: Queries that search a tree in one task.
BLOCK = 4_096
#: Copies of a result that rows of one query vector are joined with, so that hot query vectors spread.
SALT = 16
#: Relative slack of distances.
SLACK = 1e-9
#: Beyond this squared length inner products are summed as integers, not as floats.
EXACT = 1 << 52


def scaled(rows: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """id and v, the floored components of scale * vector; vectors null or with null or non-finite components, and rows without id, are left out."""
    x = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double"))
    found = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), x.alias("x")).filter("id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return found.filter(finite).select("id", F.transform("x", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def distinct_points(rows: DataFrame, keep: int) -> DataFrame:
    """v and the keep smallest ids of each distinct vector, ascending; cut per task before rows meet, so a hot vector sends few."""
    least = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("place") <= keep)
    return least.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


class Space:
    """Squared bound and dimension of all points; shorter vectors count as filled up with zeros."""

    def __init__(self, bound: int, width: int):
        self.bound, self.width, self.whole = bound, width, bound < EXACT

    def matrix(self, column: pa.Array) -> np.ndarray:
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int) if len(column) else np.zeros(0, int)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(sizes), self.width), np.int64)
        out[np.arange(self.width)[None, :] < sizes[:, None]] = flat
        return out

    def points(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.bound - np.einsum("ij,ij->i", x, x), 0))])

    def distance(self, query_norm: float, score: int) -> float:
        return math.sqrt(max(query_norm + self.bound - 2.0 * score, 0.0))


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b."""
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


def slack(space: Space) -> float:
    # squared distances are off by parts of the bound, so distances near zero by the root of that
    return math.sqrt((space.bound + 1) * SLACK)


# ---- building


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of count points, each the farthest from those before; the first is the first."""
    chosen, far = [0], between(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, between(points, points[chosen[-1:]])[:, 0])
    return np.array(chosen)


def pages_of(points: np.ndarray) -> list[dict]:
    """The pages of points' M-tree: page, parent, leaf, router, radius, and its entries (points of a leaf, pages of an inner page) with their distances
    to the page's router.  Page 0 is the root."""
    pages: list[dict] = []
    stack = [(np.arange(len(points)), -1, 0)]
    while stack:
        at, parent, router = stack.pop()
        own = points[at]
        to_router = between(own, points[router : router + 1])[:, 0]
        page = {"page": len(pages), "parent": parent, "leaf": True, "router": int(router), "radius": float(to_router.max(initial=0)), "entries": at, "distances": to_router}
        pages.append(page)
        if len(at) <= PAGE:
            continue
        page |= {"leaf": False, "entries": [], "distances": []}
        heads = spread(own, min(FANOUT, 2 * math.ceil(len(at) / PAGE)))  # pages about half full
        nearest = between(own, own[heads]).argmin(1)
        nearest[heads] = np.arange(len(heads))  # a router is in its own page, however close others are
        stack.extend((at[nearest == k], page["page"], at[heads[k]]) for k in range(len(heads)))
    for page in pages[1:]:  # children enter their parents
        parent = pages[page["parent"]]
        parent["entries"].append(page["page"])
        parent["distances"].append(float(between(points[page["router"] : page["router"] + 1], points[parent["router"] : parent["router"] + 1])[0, 0]))
    return pages


class Tree:
    """An M-tree over rows of its pages, searched best page first."""

    def __init__(self, space: Space, vectors: np.ndarray, ids: list[list[int]], pages: list[dict]):
        self.space, self.ids, self.pages = space, ids, pages
        self.points = space.points(vectors)
        for page in pages:
            if page["leaf"]:
                page["own"] = vectors[page["entries"]].astype(float if space.whole else np.int64)
        self.eps = slack(space)
        self.computed = 0

    def search(self, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, id) of the k highest scores, ties to smaller ids; below least none are looked for."""
        q = np.append(query.astype(float), 0.0)
        norm = float(q @ q)
        best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
        reach = math.inf if least is None else self.space.distance(norm, least) + self.eps

        def distance(at: np.ndarray) -> np.ndarray:
            self.computed += len(at)
            gaps = self.points[at] - q
            return np.sqrt(np.einsum("ij,ij->i", gaps, gaps))

        root = self.pages[0]
        first = float(distance(np.array([root["router"]]))[0])
        heap = [(max(first - root["radius"], 0.0), 0, first)]  # lower bound, page, distance of its router
        while heap:
            low, number, to_router = heapq.heappop(heap)
            if low > reach:
                break
            page = self.pages[number]
            entries, stored = page["entries"], page["distances"]
            if page["leaf"]:
                near = np.abs(to_router - stored) <= reach
                count = int(near.sum())
                if not count:
                    continue
                self.computed += count
                own = page["own"] if 2 * count > len(near) else page["own"][near]  # most of a page is copied in more time than all is computed
                scores = (own @ q[:-1]).astype(np.int64) if self.space.whole else own @ query  # sums of floats within EXACT are whole
                close, scores = entries[near], scores[near] if 2 * count > len(near) else scores
                order = np.arange(len(close)) if len(best) < k else np.flatnonzero(scores >= best[0][0])
                for j in order[np.argsort(-scores[order], kind="stable")]:
                    score = int(scores[j])
                    if least is not None and score < least or len(best) == k and score < best[0][0]:
                        break
                    for one in self.ids[close[j]]:
                        if len(best) < k:
                            heapq.heappush(best, (score, -one))
                        elif (score, -one) > best[0]:
                            heapq.heapreplace(best, (score, -one))
                if len(best) == k:
                    reach = min(reach, self.space.distance(norm, best[0][0]) + self.eps)
            else:
                kept = np.flatnonzero(np.abs(to_router - stored) - page["radii"] <= reach)
                if len(kept):
                    away = distance(page["routers"][kept])
                    for j, d in zip(kept, away):
                        bound = max(float(d) - page["radii"][j], 0.0)
                        if bound <= reach:
                            heapq.heappush(heap, (bound, int(entries[j]), float(d)))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


# ---- routers


class Routers:
    """Two levels of routing points from a bounded sample: each cell's router belongs to the nearest of fewer upper ones."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.points = sample[:cells]
        upper = spread(self.points, max(1, math.isqrt(len(self.points))))
        self.upper = self.points[upper]
        home = between(self.points, self.upper).argmin(1)
        self.members = [np.flatnonzero(home == k) for k in range(len(upper))]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell that each point goes to, down both levels, and its distance to the cell's router."""
        top = between(points, self.upper).argmin(1)
        cell, away = np.zeros(len(points), int), np.zeros(len(points))
        for k in np.unique(top):
            at = np.flatnonzero(top == k)
            d = between(points[at], self.points[self.members[k]])
            cell[at], away[at] = self.members[k][d.argmin(1)], d.min(1)
        return cell, away


VECTORS = "v array<bigint>"
PAGES = "cell int, tree int, page int, parent int, leaf boolean, router int, radius double, entries array<int>, distances array<double>, vectors array<array<bigint>>, ids array<array<bigint>>"


class Index:
    """M-trees over all vectors of rows (id, v), for searches of at most `most` results.

    Equal rows count once.  An id with several vectors has all of them, each a candidate of its own.  Without rows searches find nothing.
    Vectors of different length are compared as if filled up with zeros.  Inner products have to fit in a long.
    """

    def __init__(self, rows: DataFrame, most: int):
        spark = rows.sparkSession
        self.most = most
        points = written(distinct_points(rows, most + 1), "points")
        squared = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
        count, bound, width = points.agg(F.count("*"), F.coalesce(F.max(squared), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        self.count, self.space = count, Space(bound, width)
        space = self.space
        if not count:
            self.cells, self.pages = [], spark.createDataFrame([], PAGES)
            return
        drawn = points.filter(F.pmod(F.xxhash64("v"), F.lit(count)) < SAMPLE) if count > SAMPLE else points
        table = drawn.select("v", F.xxhash64("v").alias("h")).toArrow().sort_by("h")  # SAMPLE rows about, whatever count is
        sample = space.points(space.matrix(table.column("v").combine_chunks()))
        routers = self.routers = Routers(sample, max(1, min(MOST_CELLS, math.ceil(count / CELL))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, away = routers.nearest(space.points(space.matrix(batch.column("v"))))
                    yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("ids"), pa.array(cell, pa.int32()), pa.array(away)], ["v", "ids", "cell", "away"])

        dealt = written(points.mapInArrow(deal, f"{VECTORS}, ids array<bigint>, cell int, away double"), "cells")
        sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        self.cells = [(r.cell, r.n, r.radius, math.ceil(r.n / TREE)) for r in sizes.collect()]  # MOST_CELLS rows at most
        parts = F.broadcast(sizes.select("cell", F.ceil(F.col("n") / TREE).alias("trees")))
        dealt = dealt.join(parts, "cell").withColumn("tree", F.pmod(F.xxhash64("v"), F.col("trees")).cast("int"))

        def build(table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            column = table.column("v").combine_chunks()
            vectors, ids = space.matrix(column), table.column("ids").to_pylist()
            rows = []
            for p in pages_of(space.points(vectors)):
                own = p["entries"] if p["leaf"] else []
                rows.append({
                    **{c: table.column(c)[0].as_py() for c in ("cell", "tree")}, **{c: p[c] for c in ("page", "parent", "leaf", "router", "radius")},
                    "entries": [int(x) for x in p["entries"]], "distances": [float(x) for x in p["distances"]], "vectors": [vectors[x].tolist() for x in own], "ids": [ids[x] for x in own],
                })
            return pa.Table.from_pylist(rows, page_schema)

        page_schema = to_arrow_schema(StructType.fromDDL(PAGES))
        self.pages = written(dealt.select("v", "ids", "cell", "tree").groupBy("cell", "tree").applyInArrow(build, PAGES), "tree-pages")

    def _reached(self, queries: DataFrame, home: bool) -> DataFrame:
        """Queries (v, least) with the trees they have to search: those of the nearest cell, or those of the cells within reach besides."""
        space, routers = self.space, self.routers
        cells = np.array([c for c, *_ in self.cells])
        radius, trees = np.array([r for _, _, r, _ in self.cells]), [t for *_, t in self.cells]
        centres, eps = routers.points[cells], slack(space)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                    vectors = space.matrix(batch.column("v"))
                    q = np.column_stack([vectors.astype(float), np.zeros(len(vectors))])
                    away = between(q, centres)
                    near = np.arange(len(cells))[None, :] == away.argmin(1)[:, None]
                    if not home:
                        norms = np.einsum("ij,ij->i", q, q)
                        reach = [math.inf if s is None else space.distance(n, s) + eps for n, s in zip(norms, batch.column("least").to_pylist())]
                        near = ~near & (np.maximum(away - radius, 0) <= np.array(reach)[:, None])
                    at, cell = np.nonzero(near)
                    number = [len(range(trees[c])) for c in cell]
                    rows = np.repeat(at, number)
                    tree = [t for n in number for t in range(n)]
                    yield pa.RecordBatch.from_arrays([batch.column("v").take(pa.array(rows)), batch.column("least").take(pa.array(rows)), pa.array(np.repeat(cells[cell], number), pa.int32()), pa.array(tree, pa.int32())], ["v", "least", "cell", "tree"])

        return queries.mapInArrow(run, f"{VECTORS}, least bigint, cell int, tree int")

    def _searched(self, wanted: DataFrame) -> DataFrame:
        """v, score and id of the best in each tree that a query (v, least, cell, tree) searches; trees with many queries take them in blocks."""
        space, most = self.space, self.most + 1
        wanted = written(wanted, "searches")
        blocks = wanted.groupBy("cell", "tree").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        pages = self.pages.join(blocks, ["cell", "tree"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        wanted = wanted.join(blocks, ["cell", "tree"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).drop("blocks")
        schema = pa.schema([("v", pa.list_(pa.int64())), ("score", pa.int64()), ("id", pa.int64())])

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            left = left.sort_by("page").combine_chunks()
            entries, leaves = left.column("entries").to_pylist(), left.column("leaf").to_pylist()
            count = 1 + max((max(e) for e, leaf in zip(entries, leaves) if leaf), default=-1)
            vectors, ids = np.zeros((count, space.width), np.int64), [[]] * count
            for k, leaf in enumerate(leaves):
                if leaf:
                    column = left.column("vectors").chunk(0)[k].values
                    vectors[entries[k]] = space.matrix(column)
                    for e, some in zip(entries[k], left.column("ids")[k].as_py()):
                        ids[e] = some
            routers, radii = left.column("router").to_numpy(), left.column("radius").to_numpy()
            pages = [{"leaf": leaf, "entries": np.array(e, int), "distances": np.array(d), "router": r, "radius": w} for leaf, e, d, r, w in zip(leaves, entries, left.column("distances").to_pylist(), routers, radii)]
            for p in pages:
                if not p["leaf"]:
                    p["routers"], p["radii"] = routers[p["entries"]], radii[p["entries"]]
            tree = Tree(space, vectors, ids, pages)
            right = right.combine_chunks()
            queries = space.matrix(right.column("v").chunk(0))
            found = [tree.search(q, most, least) for q, least in zip(queries, right.column("least").to_pylist())]
            at = pa.array([k for k, some in enumerate(found) for _ in some], pa.int64())
            flat = [x for some in found for x in some]
            return pa.Table.from_arrays([right.column("v").chunk(0).take(at), pa.array([s for s, _ in flat], pa.int64()), pa.array([i for _, i in flat], pa.int64())], schema=schema)

        by = ["cell", "tree", "block"]
        return pages.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(search, "v array<bigint>, score bigint, id bigint")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id and score of each query's (id, v) k best rows with other ids, ties to smaller ids; all there are, if fewer."""
        if k > self.most:
            raise ValueError(f"the index keeps ids for {self.most} results")
        spark = queries.sparkSession
        if not self.count:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
        rows = queries.distinct()
        asked = rows.select("v").distinct().withColumn("least", F.lit(None).cast("bigint"))
        asked = written(asked.repartition(partitions(spark)), "asked")
        order = Window.partitionBy("v").orderBy(F.desc("score"), "id")
        best = lambda found: found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
        near = written(best(self._searched(self._reached(asked, True))), "near")
        # with k + 1 scores (one may be the query's own row) the last is the least that matters
        least = near.filter(F.col("place") == k + 1).select(F.col("v").alias("w"), F.col("score").alias("floor"))
        bounded = asked.join(least, F.col("v") == F.col("w"), "left").select("v", F.col("floor").alias("least"))
        far = self._searched(self._reached(bounded, False))
        found = best(near.select("v", "score", "id").union(far)).groupBy("v").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "id"))).alias("found"))
        spun = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        asking = rows.select(F.col("id").alias("query_id"), "v", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int").alias("salt"))
        own = asking.join(spun, ["v", "salt"]).select("query_id", F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k).alias("found"))
        flat = own.select("query_id", F.posexplode("found").alias("at", "x"))
        return flat.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.low")).alias("score"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: of each row of queries the k rows of highest inner product with another key, exactly."""
    return Index(scaled(rows, key, vector, scale), k).search(scaled(queries, key, vector, scale), k)
