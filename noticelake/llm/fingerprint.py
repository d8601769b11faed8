"""Document fingerprints from statistically improbable features.

Every window of ``WINDOW`` bytes of a text has a Shannon entropy, kept up as the window slides.  Windows are ranked by
how far their entropy is from that of ordinary prose: the farther, the rarer, the lower the rank.  A window is a
feature if it has the lowest rank, leftmost first, of at least ``POPULAR`` of the ``WINDOW`` neighbourhoods that
contain it.  Features are hashed into Bloom filters of ``FILTER_BITS`` bits, five bits each, and a filter that has
``FILTER_FEATURES`` of them is followed by the next: a chain.  Two chains are compared filter by filter, by the bits in
common over what chance would give, divided by the most there could be.

Texts stand between zero bytes, so that their beginnings and ends are windows too and short texts have features.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from noticelake.llm._shared import partitions

WINDOW = 32
POPULAR = 6
#: Entropy (0 to 1000) that windows of prose have most often, by which rarity is measured.
COMMON = 790
FILTER_BITS = 2048
FILTER_FEATURES = 160
HASHES = 5
#: Pairs of filters that are compared at a time.
PAIR_BLOCK = 1 << 18
#: Bytes of text whose windows are looked at together.
CHUNK_BYTES = 1 << 18

U = np.uint64
_SCALE = 1 << 12
_C_LOG_C = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 2)], np.int32)


def ranks_of(raw: np.ndarray) -> np.ndarray:
    """Rank of the window that starts at each byte: 0 the rarest."""
    n = len(raw) - WINDOW + 1
    ahead = np.zeros(len(raw), np.uint8)  # how often the byte comes again in the rest of its window
    behind = np.zeros(len(raw), np.uint8)
    for lag in range(1, WINDOW):
        same = raw[lag:] == raw[:-lag]
        ahead[:-lag] += same
        behind[lag:] += same
    first = np.bincount(raw[:WINDOW], minlength=256)
    leaves = ahead[: n - 1].astype(np.int64) + 1  # count of the byte that leaves, in the window it leaves
    enters = behind[WINDOW : WINDOW + n - 1].astype(np.int64)
    change = _C_LOG_C[leaves - 1] - _C_LOG_C[leaves] + _C_LOG_C[enters + 1] - _C_LOG_C[enters]
    total = np.concatenate([[int(_C_LOG_C[first].sum())], change]).cumsum()
    most = int(_C_LOG_C[WINDOW])
    entropy = (most - total) * 1000 // most
    rarity = np.abs(entropy - COMMON)
    return np.where(entropy <= 0, 1023, 1000 - rarity).astype(np.uint32)


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of several texts: features as hashes of 64 bits, in order, and the index of the text each is from."""
    pad = b"\0" * (WINDOW - 1)
    sizes = np.array([len(x) + 2 * (WINDOW - 1) for x in texts])
    raw = np.frombuffer(b"".join([y for x in texts for y in (pad, x, pad)]), np.uint8)
    owner = np.repeat(np.arange(len(texts)), sizes)
    n = len(raw) - WINDOW + 1
    rank = ranks_of(raw)
    # a window belongs to a text if it lies within it; a neighbourhood is WINDOW windows of one text in a row
    inside = owner[:n] == owner[WINDOW - 1 :]
    key = (np.where(inside, rank, 1023).astype(U) << U(32)) | np.arange(n, dtype=U)
    step, low = 1, key
    while step < WINDOW:
        hop = min(step, WINDOW - step)
        low = np.minimum(low[:-hop], low[hop:])
        step += hop
    whole = owner[: len(low)] == owner[np.minimum(np.arange(len(low)) + 2 * WINDOW - 2, len(raw) - 1)]
    winners = (low[whole] & U(0xFFFFFFFF)).astype(np.int64)
    popular = np.bincount(winners, minlength=n)
    at = np.flatnonzero((popular >= POPULAR) & (rank < 1023) & inside)
    if not len(at):
        return np.zeros(0, U), np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[at]
    lanes = np.ascontiguousarray(windows).view("<u8")
    h = np.full(len(at), 0x243F6A8885A308D3, U)
    for k in range(lanes.shape[1]):
        h = (h ^ lanes[:, k]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(29)
    return h, owner[at]


class Digest:
    """A chain of Bloom filters: filters as an array of 64-bit words, and the number of features of each."""

    def __init__(self, features: np.ndarray):
        fresh, first = np.unique(features, return_index=True)
        features = features[np.sort(first)]  # a feature that comes again changes nothing
        count = max(1, -(-len(features) // FILTER_FEATURES)) if len(features) else 0
        bits = np.zeros((count, FILTER_BITS), np.uint8)
        row = np.arange(len(features)) // FILTER_FEATURES
        for k in range(HASHES):
            bits[row, ((features >> U(11 * k)) & U(FILTER_BITS - 1)).astype(np.int64)] = 1
        self.filters = np.packbits(bits, axis=1)
        self.words = self.filters.view("<u8")
        self.set_bits = bits.sum(1, dtype=np.int64)
        self.counts = np.bincount(row, minlength=count)

    def text(self) -> str:
        """Number of filters, features of the last, and the filters in base 64."""
        return f"{len(self.filters)}:{int(self.counts[-1]) if len(self.counts) else 0}:" + base64.b64encode(self.filters.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> "Digest":
        count, last, rest = text.split(":", 2)
        new = cls(np.zeros(0, U))
        new.filters = np.frombuffer(base64.b64decode(rest), np.uint8).reshape(int(count), FILTER_BITS // 8)
        new.words = new.filters.view("<u8") if int(count) else new.words
        new.set_bits = np.bitwise_count(new.words).sum(1).astype(np.int64)
        new.counts = np.array([FILTER_FEATURES] * (int(count) - 1) + [int(last)] * (int(count) > 0))
        return new


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1, the same both ways; 1 for equal digests.  Two empty digests are equal, an empty and another have nothing in common.

    Each filter of a chain takes its best match in the other, weighted by its features; the result is the mean of both
    directions weighted by all features, so what only one text has counts against it.
    """
    if not len(a.filters) or not len(b.filters):
        return float(len(a.filters) == len(b.filters))
    if a.filters.shape == b.filters.shape and (a.filters == b.filters).all():
        return 1.0
    step = max(1, PAIR_BLOCK // len(b.words))  # filters of a that meet all of b's at a time
    ahead, back = 0.0, np.zeros(len(b.counts))
    for at in range(0, len(a.words), step):
        words, set_bits, counts = a.words[at : at + step], a.set_bits[at : at + step, None], a.counts[at : at + step, None]
        common = np.stack([np.bitwise_count(row & b.words).sum(1) for row in words]).astype(float)
        chance = set_bits * b.set_bits[None, :] / FILTER_BITS
        most = np.minimum(set_bits, b.set_bits[None, :]).astype(float)
        match = np.clip((common - chance) / np.maximum(most - chance, 1.0), 0.0, 1.0)
        # a small filter within a large one covers no more of it than it has
        ahead += (match * np.minimum(1.0, b.counts[None, :] / counts)).max(1) @ counts[:, 0]
        back = np.maximum(back, (match * np.minimum(1.0, counts / b.counts[None, :])).max(0))
    return float(min(1.0, (ahead + back @ b.counts) / (a.counts.sum() + b.counts.sum())))


def digests(texts: list[str]) -> list[Digest]:
    raw = [x.encode("utf-8", "surrogatepass") for x in texts]
    out: list[Digest] = []
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK_BYTES):
            size += len(raw[end])
            end += 1
        found, owner = features_of(raw[at:end])
        edges = np.searchsorted(owner, np.arange(end - at + 1))
        out += [Digest(found[a:b]) for a, b in zip(edges[:-1], edges[1:])]
        at = end
    return out


def edited(text: str, other: str) -> str:
    """The last third of the text (rounded down, in code points) replaced by as much of the other's beginning, or all of it."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row; a null text counts as empty, and an empty text has no filter.  No shuffle."""
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = to_arrow_type(source.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(kind), pa.array([d.text() for d in digests(part.column("text").to_pylist())], pa.string())], ["doc_id", "fingerprint"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def range_of(column: str, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or above the column's value: 0 for the largest; null is below all.

    Found in two steps over the square root of the bounds each, so many ranges stay cheap."""
    if not bounds:
        return F.lit(0)
    wide = math.isqrt(len(bounds)) + 1
    chunks = [bounds[k : k + wide] for k in range(0, len(bounds), wide)]
    listed = lambda xs: f"array({','.join(f'{x}L' for x in xs)})"
    whole = f"size(filter({listed(c[-1] for c in chunks)}, x -> x < {column}))"
    within = f"size(filter(element_at(array({','.join(listed(c) for c in chunks)}, cast(array() as array<bigint>)), {whole} + 1), x -> x < {column}))"
    return F.expr(f"{len(bounds)} - if({column} is null, 0, least({len(bounds)}, {whole} * {wide} + {within}))").cast("int")


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_partitions: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller id (after the smallest: the largest); rows of one id follow each other by text.
    Ids are whole numbers; others are a TypeError.  A null text counts as empty; a null id comes last, before the largest again.  One row alone is its own next.  Other columns are not read.  No rows:
    no rows.

    Rows are cut into ranges by quantiles of the id, one task each, with one row more per range: the first of the range
    after it, which its last row needs.  Texts move once.  The driver keeps a bound and an id per range, no more.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    if not isinstance(source.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"{id_column} must be a whole number, not {source.schema['doc_id'].dataType.simpleString()}")
    n = max(least_partitions, 2 * partitions(spark))
    ids = source.select("doc_id").filter("doc_id is not null")
    bounds = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n).alias("b")).first()["b"] if n > 1 else None
    bounds = sorted(set(bounds or []))
    dealt = source.withColumn("own", range_of("doc_id", bounds))
    firsts = {r.own: r.top for r in dealt.groupBy("own").agg(F.max("doc_id").alias("top")).collect()}
    if not firsts:
        return spark.createDataFrame([], T.StructType([source.schema["doc_id"], *_FIELDS]))
    # the first row of each range goes also to the range before it, and that of the first range to the last
    order = sorted(firsts)
    heads = spark.createDataFrame([(k, firsts[k], order[i - 1]) for i, k in enumerate(order)], T.StructType([T.StructField("head_own", T.IntegerType()), T.StructField("top", source.schema["doc_id"].dataType), T.StructField("before", T.IntegerType())]))
    dealt = dealt.join(F.broadcast(heads), (F.col("own") == F.col("head_own")) & F.col("doc_id").eqNullSafe(F.col("top")), "left")
    homes = F.filter(F.array(F.struct(F.col("own").alias("range"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("range"), F.lit(True).alias("guest"))), lambda x: x["range"].isNotNull())
    spread = dealt.select("doc_id", "text", F.explode(homes).alias("home")).select("doc_id", "text", "home.range", "home.guest")
    kind, id_field = to_arrow_type(source.schema["doc_id"].dataType), source.schema["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, its text and digest

        def row(k, text, digest, other_text, other_digest, changed, changed_digest):
            return (k, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest.text(), changed_digest.text(), likeness(digest, changed_digest), likeness(digest, other_digest))

        at_range, over = None, False  # over: the range's guest has been met
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ranges = part.column("range").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
                for a, b in itertools.pairwise(edges):
                    if ranges[a] != at_range:
                        at_range, over, last = ranges[a], False, None
                    if over:
                        continue
                    keys, texts, guests = (part.slice(a, b - a).column(c).to_pylist() for c in ("doc_id", "text", "guest"))
                    if True in guests:  # the first guest, in order, is the next of the range's last row
                        stop = guests.index(True) + 1
                        keys, texts, over = keys[:stop], texts[:stop], True
                    found = digests(texts)
                    line = ([last] if last else []) + list(zip(keys, texts, found))
                    last = line[-1]
                    changed = [edited(x[1], y[1]) for x, y in itertools.pairwise(line)]
                    out = [row(*x, y[1], y[2], c, d) for x, y, c, d in zip(line, line[1:], changed, digests(changed))]
                    if out:
                        columns = list(zip(*out))
                        yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, t) for c, t in zip(columns[1:], _ARROW)]], [id_field.name, *[f.name for f in _FIELDS]])

    # a task may get several ranges; each is sorted by id downwards, then its guest rows
    sorted_rows = spread.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return sorted_rows.select("range", "doc_id", "text", "guest").mapInArrow(run, T.StructType([id_field, *_FIELDS]))


_FIELDS = [T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
_ARROW = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
