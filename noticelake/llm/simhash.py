"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is embedded as the bit counts of its sixteen 4-bit segments.  A differing bit changes one count
by one, so the Manhattan distance of two embeddings is a lower bound of the Hamming distance: fingerprints within
``BITS`` bits lie within that Manhattan distance.  The counts of the four 16-bit segments, sums of the fine counts, form
a coarse grid, over which the range join is dealt out: each distinct fingerprint goes to its own cell as host and to the
cells at coarse offsets of length 1 and 2 (one of each opposite pair) as visitor: 21 rows, whatever the data.  In a task,
hosts are sorted by fine cell and visitors look up the fine offsets that their coarse offset leaves room for.  What is
found is verified by the exact Hamming distance.

Links leave a task as a spanning forest of what it verified, so a dense group gives a row per fingerprint and not per
pair, and components are completed by alternating large-star and small-star rounds.

One fingerprint of a whole text tells near copies only while few bits differ.  Near copies by similarity (``near_copies``) are therefore
found in two steps.  Texts of one component of fingerprints meet one of them, and what the exact Jaccard similarity of their shingles confirms is
linked.  Then every pair of texts that is not joined by then meets if it shares a shingle of both prefixes: the rarest shingles of a text, by one order for
all, as many as a text of the least similarity cannot lack altogether.  So no pair at or above the similarity is lost, whatever its bits.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticelake.llm._shared import WHITE, lean, partitions, release, rows_of, without_rows, written
from noticelake.sources.scratch import Rounds

SHINGLE = 3
SEED = 42
#: Largest Hamming distance of a link.
BITS = 2
FINE, COARSE = 16, 4
PER = FINE // COARSE
#: Near copies by similarity: words of a shingle, least Jaccard similarity.
WORDS = 5
SIMILARITY = 0.8
#: One text in so many is counted for the order of shingles, and so many of the most frequent ones come last.  Any order is exact; a good one leaves few pairs.
COUNTED, FREQUENT = 8, 200_000
#: Pairs in shared cells up to which all meet at once; beyond, the first 1, 8, 64, ... of each cell go before while
#: that halves the pairs left, so that what they join needs to meet no more.
CELL_PAIRS = 1_000_000
#: Texts of a block within which pairs are verified, about; the pairs of a block are about as many.
BLOCK_TEXTS = 1_000
#: Slack of products of similarities and sizes, so that rounding never rules a pair out.
SLACK = 1e-9
BROADCAST_ROWS = 500_000
#: Fingerprints of a coarse cell from which it is split.
CELL_HOSTS = 1_000_000
#: Candidate pairs that a task verifies at a time, and links that it holds before they become a forest.
PAIR_BLOCK = 500_000
HELD_LINKS = 4_000_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority fingerprint of the text's word shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = list(itertools.accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends]
    found = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])], "<u8")
    ones = np.zeros(64, np.int64)
    raw = found.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (bigint, the fingerprint's bits) of every row."""
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, ["doc_id", "text"]):
            fps = np.array([simhash(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "fp": fps}, schema=pa.schema([("doc_id", batch_type), ("fp", pa.int64())]))

    batch_type = to_arrow_type(source.schema["doc_id"].dataType)
    return source.mapInArrow(lean(run), f"doc_id {kind}, fp bigint")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the sixteen 4-bit segments, one per nibble."""
    x = fps - ((fps >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))


def coarse_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the four 16-bit segments, one column each."""
    return np.bitwise_count(fps.astype("<u8").view(np.uint16).reshape(-1, COARSE)).astype(np.int64)


def offsets(dimensions: int, length: int) -> list[tuple[int, ...]]:
    """Integer vectors of Manhattan length up to ``length``."""
    near = [v for v in itertools.product(range(-length, length + 1), repeat=dimensions) if sum(map(abs, v)) <= length] if dimensions <= 4 else None
    if near is not None:
        return near
    found = {(0,) * dimensions}
    for _ in range(length):
        found |= {v[:k] + (v[k] + d,) + v[k + 1 :] for v in found for k in range(dimensions) for d in (-1, 1)}
    return sorted(v for v in found if sum(map(abs, v)) <= length)


def coarse_offsets(bits: int) -> list[tuple[int, ...]]:
    """Of opposite coarse offsets up to a length the one whose first nonzero is positive."""
    return [v for v in offsets(COARSE, bits) if next((x for x in v if x), 1) > 0]


COARSE_OFFSETS = coarse_offsets(BITS)


def fine_steps(bits: int = BITS) -> list[np.ndarray]:
    """For each coarse offset, what to subtract from a visitor's packed fine counts to reach hosts it may link to."""
    coarse = coarse_offsets(bits)
    steps: list[list[int]] = [[] for _ in coarse]
    place = {v: k for k, v in enumerate(coarse)}
    for v in offsets(FINE, bits):
        k = place.get(tuple(sum(v[PER * c : PER * (c + 1)]) for c in range(COARSE)))
        if k is not None and (any(coarse[k]) or next((x for x in v if x), 1) > 0):
            steps[k].append(sum(x << (4 * i) for i, x in enumerate(v)) % (1 << 64))
    return [np.array(x, np.uint64) for x in steps]


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of a component of the links (a, b) to its least member."""
    nodes, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    left, right = codes[: len(a)], codes[len(a) :]
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[label])
        while (jump := new[new]).tolist() != new.tolist():
            new = jump
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (u, v) between the distinct fingerprints in column fp that join all that lie within so many bits.

    Every pair within them is verified in some task; returned are forests with the same components.  A coarse cell with more
    than CELL_HOSTS fingerprints is split by a hash of their fine counts, and a visitor goes to the parts that its offsets lead to.
    """
    spark = distinct.sparkSession
    n, coarse = partitions(spark, 2), coarse_offsets(bits)

    base, steps_of = 17 ** np.arange(COARSE), fine_steps(bits)
    still = next(k for k, v in enumerate(coarse) if not any(v))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, many = np.unique(coarse_counts(batch.column("fp").to_numpy().view(np.uint64)) @ base, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(many)], ["cell", "many"])

    weights = distinct.select("fp").mapInArrow(lean(weigh), "cell int, many bigint").groupBy("cell").agg(F.sum("many").alias("many"))
    heavy = sorted((r.cell, -(-r.many // CELL_HOSTS)) for r in weights.filter(F.col("many") > CELL_HOSTS).collect())  # 17**4 cells at most
    heavy_cells, heavy_parts = np.array([c for c, _ in heavy], np.int64), np.array([m for _, m in heavy], np.uint64)

    def part(fine: np.ndarray, parts: np.ndarray) -> np.ndarray:
        mixed = fine * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) % parts).astype(np.int32)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            counts = coarse_counts(fps)
            for k, v in enumerate(coarse):
                cell = counts - np.array(v)
                inside = ((cell >= 0) & (cell <= 16)).all(1)
                cell, own = cell[inside] @ base, fps[inside]
                row, to = np.arange(len(own)), np.zeros(len(own), np.int32)
                at = np.minimum(np.searchsorted(heavy_cells, cell), max(0, len(heavy_cells) - 1))
                split = np.flatnonzero(heavy_cells[at] == cell) if len(heavy_cells) else row[:0]
                if len(split):
                    parts, fine = heavy_parts[at[split]], segment_counts(own[split])
                    if k == still:  # hosts, which visit their own cell as well
                        goals = [part(fine, parts), *(part(fine - s, parts) for s in steps_of[k])]
                    else:
                        goals = [part(fine - s, parts) for s in steps_of[k]]
                    pairs = np.unique(np.concatenate([split.astype(np.int64) << 32 | g for g in goals]))
                    single = np.ones(len(own), bool)
                    single[split] = False
                    row, to = np.concatenate([row[single], pairs >> 32]), np.concatenate([to[single], (pairs & 0xFFFFFFFF).astype(np.int32)])
                yield pa.RecordBatch.from_arrays([pa.array(cell[row], pa.int32()), pa.array(to), pa.array(np.full(len(row), k, np.int8)), pa.array(own[row].view(np.int64))], ["cell", "part", "step", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(batch.column(c).to_numpy() for c in ("cell", "step", "fp")) for batch in batches]
        if not held:
            return
        cells, step, fps = (np.concatenate(x) for x in zip(*held))
        fps = fps.view(np.uint64)
        hosts = np.unique(fps[step == still])
        order = np.argsort(segment_counts(hosts), kind="stable")
        hosts = hosts[order]
        fine = segment_counts(hosts)  # a fine cell lies in one coarse cell, so the coarse one needs no test
        for k, steps in enumerate(steps_of):
            visitors = fps[step == k]
            own = segment_counts(visitors)
            held_a, held_b, size = [], [], 0
            for s in steps:
                goal = own - s
                low = np.searchsorted(fine, goal, "left")
                many = np.searchsorted(fine, goal, "right") - low
                some = np.flatnonzero(many)
                for part in np.array_split(some, max(1, int(many[some].sum()) // PAIR_BLOCK + 1)):
                    m = many[part]
                    pick = np.repeat(low[part] - np.concatenate([[0], np.cumsum(m)[:-1]]).astype(np.int64), m) + np.arange(m.sum())
                    x, y = np.repeat(visitors[part], m), hosts[pick]
                    near = (np.bitwise_count(x ^ y) <= bits) & (x != y)
                    held_a.append(x[near]), held_b.append(y[near])
                    size += int(near.sum())
                    if size > HELD_LINKS:
                        a, b = spanning_forest(np.concatenate(held_a), np.concatenate(held_b))
                        held_a, held_b, size = [a], [b], 0
            if size:
                a, b = spanning_forest(np.concatenate(held_a), np.concatenate(held_b))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    dealt = distinct.select("fp").mapInArrow(lean(spread), "cell int, part int, step byte, fp bigint").repartition(n, "cell", "part")
    return dealt.select("cell", "step", "fp").mapInArrow(lean(join), "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node it is connected to) of every node of the edges (u, v); large-star and small-star in turn.

    Each round writes its links to the shared folder; their number never grows beyond the first.  A hub's links are
    spread by a join that AQE can split, and minima are pre-aggregated before the shuffle.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        # neighbours of a node: all (large star), or the smaller ones (small star)
        both = links.union(links.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()

    links = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = mark(links)
    while now[0]:
        links = written(star(star(links, True), False), "links")
        last, now = now, mark(links)
        if now == last:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, fp (bigint) and component_id, the smallest doc_id that links of BITS bits reach.

    A null or empty text, or one without words, has the fingerprint zero and links like any other.  Repeated rows each
    keep their row.  Null ids reach others but are never a component's id unless all its ids are null.  Other columns are
    not read.  No rows: no rows.

    Fingerprints are made once and written; from then on only distinct ones move.  One fingerprint holding many rows is
    one row of the join, and returns to its rows by a join whose large side AQE may split.
    """
    base = written(fingerprints(docs, id_column, text_column, shingle), "simhash-base")
    distinct = written(base.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(links(distinct))
    roots = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(roots.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return base.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingles(norm: str, words: int = WORDS) -> np.ndarray:
    """Hashes of a normalised text's distinct word shingles, ascending; of a shorter text the whole, of an empty one none."""
    import xxhash

    raw = norm.encode("utf-8", "surrogatepass")
    ends = [*(m.start() for m in re.finditer(b" ", raw)), len(raw)]
    if not raw or len(ends) <= words:
        return np.array([xxhash.xxh64_intdigest(raw, SEED)] if raw else [], np.uint64)
    starts = [0, *(e + 1 for e in ends)]
    return np.unique(np.array([xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64))


def majority(found: np.ndarray) -> int:
    """The majority fingerprint of the hashes, as a signed number."""
    ones, raw = np.zeros(64, np.int64), found.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 4096):
        ones += np.unpackbits(raw[at : at + 4096], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<i8")[0])


def prefix(found: np.ndarray, similarity: float, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first hashes by (count, hash), as many as leave less than a similar text must have in common; often is ascending, what it lacks counts 0."""
    many = len(found) - math.ceil(similarity * len(found) - SLACK) + 1
    if not len(found) or not len(often):
        return found[: many if len(found) else 0]
    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
    return found[np.argsort(np.where(often[at] == found, counts[at], 0), kind="stable")[:many]]


def words_only(column: str) -> Column:
    """The text's words, A-Z lower-cased, joined by blanks; null is empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(column), F.lit("")), upper, upper.lower()), WHITE, " "))


def dealt(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes by block, so that pairs with nodes in common meet in few blocks and each text moves to few.

    Pairs go by the least node that either side is paired with or is, which all pairs of a crowd have in common.  What shares one and has over
    BLOCK_TEXTS pairs or nodes is cut into a square of hashes of both sides; less goes to one of as many blocks as the pairs fill.
    """
    sides = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    least = written(sides.groupBy("node").agg(F.least("node", F.min("other")).alias("least")), "near-least")
    own = lambda name: least.select(F.col("node").alias(name), F.col("least").alias(f"least_{name}"))
    keyed = written(pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", F.least("least_a", "least_b").alias("key")), "near-keyed")
    sides = keyed.select("key", F.explode(F.array("a", "b")).alias("node")).groupBy("key", "node").agg(F.count(F.lit(1)).alias("many"))
    sizes = sides.groupBy("key").agg((F.sum("many") / 2).alias("pairs"), F.count(F.lit(1)).alias("nodes")).filter(F.greatest("pairs", "nodes") > BLOCK_TEXTS)
    cuts = sizes.select("key", F.ceil(F.greatest(F.sqrt(F.col("pairs") / BLOCK_TEXTS), F.col("nodes") / BLOCK_TEXTS)).alias("cuts"))
    light = F.pmod(F.xxhash64("key"), F.lit(keyed.count() // BLOCK_TEXTS + 1))
    cut = [F.pmod(F.xxhash64(c, F.lit("cut")), F.col("cuts")) for c in ("a", "b")]
    block = F.when(F.col("cuts").isNull(), light).otherwise(F.xxhash64("key", *cut))
    return keyed.join(cuts, "key", "left").select("a", "b", block.alias("block"))


def similar(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame], words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles have at least that Jaccard similarity, counted exactly.

    texts gives one row (node, norm) for each of the nodes asked for.  Texts move, not their shingles, which take several times as much room, and
    go once to each block that has a pair of theirs.
    """
    pairs = written(dealt(pairs), "near-dealt")
    ends = written(pairs.select("block", F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ends")

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = {node: shingles(norm, words) for nodes, norms in rows_of(right.to_batches(), ["node", "norm"], most=128) for node, norm in zip(nodes, norms)}
        near = []
        for a, b in zip(left.column("a").to_pylist(), left.column("b").to_pylist()):
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            near.append(shared >= similarity * (len(sets[a]) + len(sets[b]) - shared))
        del sets
        release()
        return left.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    moved = texts(ends.select("node").distinct()).join(ends, "node").select("block", "node", "norm")
    return pairs.groupBy("block").cogroup(moved.groupBy("block")).applyInArrow(count, "a binary, b binary")


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the FREQUENT shingles that most of one in COUNTED distinct texts (column norm) have, and by how many; two at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (norms,) in rows_of(batches, ["norm"], most=128):
            found, many = np.unique(np.concatenate([shingles(x, words) for x in norms]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(many)], ["hash", "many"])

    counted = texts.filter(F.pmod(F.xxhash64("norm"), F.lit(COUNTED)) == 0).select("norm").mapInArrow(lean(run), "hash bigint, many bigint")
    rows = counted.groupBy("hash").agg(F.sum("many").alias("many")).filter("many > 1").orderBy(F.desc("many"), "hash").limit(FREQUENT).collect()
    often = np.array([r.hash for r in rows], np.int64).view(np.uint64)
    order = np.argsort(often)
    return often[order], np.array([r.many for r in rows], np.int64)[order]


def meeting(active: DataFrame, many: int | None, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that share a cell, of sizes that allow the similarity; their sizes, and in shared how many cells.

    Of each cell the first ``many`` nodes meet all others; None: all meet all.
    """
    first = active
    if many:
        first = active.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("place", "node"))).filter(F.col("nth") <= many)
    first = first.select("cell", *[F.col(c).alias(f"first_{c}") for c in ("node", "place", "size", "root")])
    after = F.struct("first_place", "first_node") < F.struct("place", "node")
    near = F.least("size", "first_size") >= F.lit(similarity) * F.greatest("size", "first_size") - F.lit(SLACK)
    pairs = active.join(first, "cell").filter(after & near & (F.col("root") != F.col("first_root")))
    low = F.col("first_node") < F.col("node")
    pairs = pairs.select(
        F.least("first_node", "node").alias("a"), F.greatest("first_node", "node").alias("b"),
        F.when(low, F.col("first_size")).otherwise(F.col("size")).alias("size_a"), F.when(low, F.col("size")).otherwise(F.col("first_size")).alias("size_b"),
    )
    return pairs.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("shared"))


def enough_shared(similarity: float) -> Column:
    """Whether sets of size_a and size_b whose prefixes have ``shared`` hashes in common may have that similarity.

    Hashes in common beyond them come after the end of one of the prefixes, so they are no more than that set has there.
    """
    rest = lambda size: F.ceil(F.lit(similarity) * F.col(size) - F.lit(SLACK)) - F.lit(1)
    least = F.lit(similarity / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) - F.lit(SLACK)
    return F.col("shared") + F.greatest(rest("size_a"), rest("size_b")) >= least


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of docs: doc_id, node (a digest of the words) and root, one node of each group of near copies.

    Texts with the same words are one node, so those without words are.  Nodes of at least that Jaccard similarity of shingles of so many words are
    linked, and a group is what links reach: exactly, no link between groups is lost.  Repeated rows each keep their row; ids, null or
    not, are not looked at; other columns are not read.  No rows: no rows.

    Components of near fingerprints are joined first, each by pairs of its first node.  Then all pairs that share a cell, a hash of both prefixes, meet unless
    they have a root in common; by sizes and the number of cells shared most are ruled out, others are verified once.  The more nodes
    without a common root share rare shingles, the more pairs there are: up to all of them, as each may be a link.  Cells hold digests
    and sizes; each round reads the texts of its own pairs again, and shingles of a text are made in the blocks where it is compared.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), words_only(text_column).alias("norm"))
    often = spark.sparkContext.broadcast(frequent_shingles(source, words))  # FREQUENT rows at most
    source = source.withColumn("node", F.unhex(F.md5("norm")))
    kind = source.schema["doc_id"].dataType
    base_schema = pa.schema([("doc_id", to_arrow_type(kind)), ("node", pa.binary()), ("size", pa.int32()), ("fp", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nodes, norms in rows_of(batches, ["doc_id", "node", "norm"], most=128):
            found = [shingles(x, words) for x in norms]
            prefixes = [prefix(x, similarity, *often.value).view(np.int64) for x in found]
            columns = (ids, nodes, [len(x) for x in found], [majority(x) for x in found], prefixes)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, base_schema)], schema=base_schema)

    def texts(nodes: DataFrame) -> DataFrame:
        """node and words of the nodes; a row of each is looked up by its id first, so that few texts are read as words again."""
        rows = base.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        rows = written(rows, "near-wanted")
        rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
        raw = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
        found = raw.join(rows.select("doc_id"), F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").select(words_only("text").alias("norm"))
        return found.withColumn("node", F.unhex(F.md5("norm"))).join(rows.select("node"), "node", "left_semi").select("node", "norm").dropDuplicates(["node"])

    base = written(source.mapInArrow(lean(sample), f"doc_id {kind.simpleString()}, node binary, size int, fp bigint, prefix array<bigint>"), "near-base")
    nodes = base.filter("size > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "fp", "prefix")])
    nodes = written(nodes.withColumn("place", F.xxhash64("node")), "near-nodes")
    together = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    columns = ["cell", "node", "size", "place", F.col("node").alias("root")]

    cells = nodes.select("node", "size", "place", F.explode("prefix").alias("cell")).withColumn("nodes", together)
    active = written(cells.filter("nodes > 1").select(*columns), "near-active")
    joined = components(links(nodes.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    joined = F.broadcast(joined) if joined.count() <= BROADCAST_ROWS else joined
    alike = nodes.join(joined, "fp", "left").select("node", "size", "place", F.coalesce("root", "fp").alias("cell")).withColumn("nodes", together)
    alike = written(alike.filter("nodes > 1").select(*columns), "near-alike")

    tried, linked = Rounds(spark, "near-tried"), Rounds(spark, "near-linked")

    def verify(pairs: DataFrame) -> DataFrame | None:
        """Links the pairs that are similar; node and root of all that is linked by now, None if nothing is."""
        new = pairs.select("a", "b")
        new = new.join(tried.all(), ["a", "b"], "left_anti") if tried.count else new
        linked.add(similar(tried.add(new), texts, words, similarity))
        edges = linked.all().select(F.col("a").alias("u"), F.col("b").alias("v"))
        return None if edges.isEmpty() else components(edges)

    def apart(groups: DataFrame | None) -> DataFrame:
        """The cells' nodes by their present roots, without cells of one root."""
        rooted = active.drop("root").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node")) if groups is not None else active
        several = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("cell")
        return written(rooted.join(several, "cell", "left_semi").select("cell", "node", "size", "place", "root"), "near-active")

    groups = verify(meeting(alike, 1, similarity))
    active, many, last = apart(groups), 1, math.inf
    while many:
        pairs = active.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0
        if not pairs:
            break
        many = many if pairs > CELL_PAIRS and pairs < last / 2 else None  # a round that joins little is the last but one
        groups = verify(meeting(active, many, similarity).filter(enough_shared(similarity)))
        if many:
            active, many, last = apart(groups), 8 * many, pairs
    if groups is None:
        return base.select("doc_id", "node", F.col("node").alias("root"))
    return base.select("doc_id", "node").join(groups, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near_copies(), that of the smallest id; columns, whatever they are called, as they were.

    Of rows equal in id and words one stays; the same id with texts that are no near copies stays once for each; a null id
    comes after all others; null and empty texts are one group.  No rows: no rows.  Only ids and digests move: the rows that go are
    looked up in the texts, broadcast while they are few and shuffled otherwise.
    """
    found = near_copies(docs, id_column, text_column, words, similarity)
    rows = written(found.groupBy("doc_id", "node", "root").agg(F.count(F.lit(1)).alias("rows")), "near-rows")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    kept = rows.groupBy("root").agg(F.min(order).alias("kept")).select("root", F.col("kept.doc_id").alias("kept_id"), F.col("kept.node").alias("kept_node"))
    decided = rows.join(kept, "root").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("node") == F.col("kept_node")))
    decided = written(decided.filter("not kept or rows > 1").select("doc_id", "node", "kept"), "near-decided")
    keys = [F.col(id_column), F.unhex(F.md5(words_only(text_column)))]
    return without_rows(docs, keys, decided.filter("not kept").select("doc_id", "node"), decided.filter("kept").select("doc_id", "node"), BROADCAST_ROWS)


def hexadecimal(column: str):
    """A bigint's bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
