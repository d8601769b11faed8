"""Language-model scores by prediction by partial matching over bytes.

A text is its lower-cased words with a space after each and a line feed at the end, so that it ends as a token sequence
does.  Training counts, over all training texts, every byte in its contexts of 0 to ``ORDER`` bytes: the byte-context
trie, kept as sorted arrays.  Each partition sorts its grams of the highest order, adds up equal ones and deals them by a
hash of the gram; partial counts meet by hash and are added, so nothing is dropped and no task sees the whole.

Scoring walks from the longest context down.  A context that has the byte codes it with its count; one that has not codes an
escape (method C: as many chances as distinct bytes) and the next shorter context follows, from whose counts the bytes of the longer one
are excluded, since they could not have followed.  Below order 0 the bytes not yet seen are equally likely.  For a trained trie every one of
these terms depends on (context, next longer context) alone, so they are laid down once per context and looked up for all positions of a
batch of texts together.

The trie and the vocabulary grow with the corpus, so they are cut into blocks of bounded size: contexts by their last two bytes, words
by hash.  Each block is broadcast in turn and scores all texts as far as it knows; its part is written before the next block is
fetched, so driver and workers hold one block however many there are, and the parts add up.  A corpus whose trie fits one block needs one
pass; a larger one takes a pass over the texts for each block.  Words are looked up by hashes of 64 bits: n_known is exact up to their collisions.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticelake.llm._shared import partitions, rows_of, written

ORDER = 5
#: Contexts with symbols, and words, that a block may have: what a worker keeps is about 60 bytes for each.
BLOCK_ENTRIES = 4_000_000
#: Bytes of text that are counted or scored together.
CHUNK_BYTES = 1 << 19

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
U = np.uint64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_keys(words: Iterable[bytes]) -> np.ndarray:
    """Words as hashes of 64 bits, by which counts are looked up: 8 bytes instead of a Python object for each."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), U)


def stream_of(words: list[bytes]) -> bytes:
    return b" ".join([*words, b"\n"]) if words else b"\n"


def grams(streams: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the streams the order bytes before it and itself, packed with the oldest byte highest; and how many
    bytes of its own stream precede it (order at most).  Bytes before a stream's start are 0."""
    pad = b"\0" * order
    raw = np.frombuffer(pad + pad.join(streams) if streams else pad, np.uint8)
    packed = np.zeros(max(0, len(raw) - order), U)
    for k in range(order + 1):
        packed |= raw[k : len(raw) - order + k].astype(U) << U(8 * (order - k))
    sizes = np.array([len(x) for x in streams], np.int64)
    keep = np.ones(len(packed), bool)
    starts = np.cumsum(sizes + order) - sizes - order
    for s in range(order):  # positions of the padding itself
        gone = (starts + sizes)[:-1] + s
        keep[gone] = False
    at = np.arange(len(packed)) - np.repeat(starts, np.concatenate([sizes[:-1] + order, sizes[-1:]])) if len(sizes) else np.zeros(0, np.int64)
    return packed[keep], np.minimum(at, order)[keep]


def add_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not len(keys):
        return keys.astype(U), np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def mixed(keys: np.ndarray) -> np.ndarray:
    x = (keys ^ (keys >> U(31))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(29))


def count(training: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Grams of the highest order and words of the column text, each with its count over all rows: (gram, n) and (word, n), words as word_keys().

    Counts travel as arrays, one for each partition and slice; slices are added up in tasks of their own.
    """
    slices = 2 * partitions(training.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()
        streams: list[bytes] = []
        size = 0

        def add() -> None:
            nonlocal size
            held.append(add_up(grams(streams, order)[0]))
            streams.clear()
            size = 0
            while len(held) > 1 and len(held[-2][0]) <= 2 * len(held[-1][0]):
                (a, m), (b, n) = held.pop(), held.pop()
                held.append(add_up(np.concatenate([a, b]), np.concatenate([m, n])))

        def out() -> Iterator[pa.RecordBatch]:
            if streams:
                add()
            if not held and not words:
                return
            keys, n = add_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if held else (np.zeros(0, U), np.zeros(0, np.int64))
            home = mixed(keys) % U(slices)
            listed: dict[int, list[bytes]] = {}
            for w in words:
                listed.setdefault(zlib.crc32(w) % slices, []).append(w)
            for k in range(slices):
                own, ws = home == U(k), listed.get(k, [])
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((k, pa.int32()), (keys[own].tobytes(), pa.binary()), (n[own].tobytes(), pa.binary()), (b" ".join(ws), pa.binary()), (np.array([words[w] for w in ws], np.int64).tobytes(), pa.binary()))], ["slice", "grams", "n", "words", "m"])
            held.clear(), words.clear()

        for (texts,) in rows_of(batches, ["text"]):
            for text in texts:
                found = words_of(text)
                words.update(found)
                streams.append(stream_of(found))
                size += len(streams[-1])
                if size >= CHUNK_BYTES:
                    add()
            if sum(len(k) for k, _ in held) > 2_000_000 or len(words) > 300_000:
                yield from out()
        yield from out()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        words: Counter = Counter()
        for batch in batches:
            for k, raw, n, ws, m in zip(*(batch.column(c).to_pylist() for c in ("slice", "grams", "n", "words", "m"))):
                stack, new = held.setdefault(k, []), (np.frombuffer(raw, U), np.frombuffer(n, np.int64))
                while stack and len(stack[-1][0]) <= 2 * len(new[0]):
                    a, c = stack.pop()
                    new = add_up(np.concatenate([a, new[0]]), np.concatenate([c, new[1]]))
                stack.append(new)
                for w, c in zip(ws.split(), np.frombuffer(m, np.int64).tolist()):
                    words[w] += c
        for stack in held.values():
            keys, n = add_up(np.concatenate([a for a, _ in stack]), np.concatenate([c for _, c in stack]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.nulls(len(keys), pa.int64()), pa.array(n)], ["gram", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(word_keys(words).view(np.int64)), pa.array(list(words.values()), pa.int64())], ["gram", "word", "n"])

    dealt = training.select("text").mapInArrow(split, "slice int, grams binary, n binary, words binary, m binary").repartitionById(slices, F.col("slice"))
    table = written(dealt.mapInArrow(join, "gram bigint, word bigint, n bigint"), "lm-counts")
    return table.filter("gram is not null").select("gram", "n"), table.filter("word is not null").select("word", "n")


class Trie:
    """Terms of every context of a block: for a gram of order k (context and byte) its log10 probability where the longest
    known context is that one, and where the byte is reached by an escape from the longer context it belongs to.

    grams, counts: distinct grams of the highest order with their counts, every gram of each context that is in the block.
    """

    def __init__(self, grams_: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order = order
        levels = [None] * (order + 1)
        keys, n = add_up(grams_, counts)
        for k in range(order, -1, -1):
            levels[k] = (keys, n)
            if k:
                keys, n = add_up(keys & U((1 << (8 * k)) - 1), n)
        self.levels, self.tables = levels, []
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(order + 1):
                keys, n = levels[k]
                context, start = np.unique(keys >> U(8), return_index=True)
                total, kinds = (np.add.reduceat(n, start), np.diff(np.append(start, len(keys)))) if len(keys) else (n, n)
                # what remains of this context once the bytes of the longer context are excluded, by longer context
                if k < order:
                    longer, _ = levels[k + 1]
                    place = np.searchsorted(keys, longer & U((1 << (8 * (k + 1))) - 1))
                    upper, begin = np.unique(longer >> U(8), return_index=True)
                    gone = np.add.reduceat(n[place], begin) if len(longer) else n[:0]
                    gone_kinds = np.diff(np.append(begin, len(longer)))
                    home = np.searchsorted(context, upper & U((1 << (8 * k)) - 1))
                    rest, rest_kinds = total[home] - gone, kinds[home] - gone_kinds
                else:
                    upper, rest, rest_kinds = np.zeros(0, U), n[:0], n[:0]
                width = (total + kinds).astype(float)
                free, free_kinds = (rest + rest_kinds).astype(float), rest_kinds.astype(float)
                self.tables.append({
                    "context": context, "log_width": np.log10(width), "escape": np.log10(kinds / width), "kinds": kinds,
                    "upper": upper, "log_free": np.where(free > 0, np.log10(np.maximum(free, 1)), 0.0),
                    "free_escape": np.where(free_kinds > 0, np.log10(np.maximum(free_kinds, 1) / np.maximum(free, 1)), 0.0),
                    "log_n": np.log10(n),
                })
        self.top = Hash(levels[order][0], self.tables[order]["log_n"] - self.tables[order]["log_width"][np.searchsorted(self.tables[order]["context"], levels[order][0] >> U(8))])

    def score(self, packed: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram after the bytes before it."""
        out, hit = self.top.get(packed)
        left = np.flatnonzero(~hit)
        if len(left):
            distinct, back = np.unique(packed[left], return_inverse=True)
            out[left] = self._walk(distinct)[back]
        return out

    def _walk(self, packed: np.ndarray) -> np.ndarray:
        out = np.zeros(len(packed))
        active = np.arange(len(packed))
        upper = np.full(len(packed), -1, np.int64)  # the longer context's place among the level's upper ones, if it is known
        seen = np.zeros(len(packed), np.int64)  # distinct bytes of the longest context passed so far
        for k in range(self.order, -1, -1):
            if not len(active):
                break
            t, (keys, _) = self.tables[k], self.levels[k]
            gram = packed[active] & U((1 << (8 * (k + 1))) - 1)
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(t["context"], gram >> U(8)), len(t["context"]) - 1)
            known = t["context"][at] == gram >> U(8)
            place = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            has = keys[place] == gram
            from_above = upper[active] >= 0
            own = np.maximum(upper[active], 0)
            above = from_above & known
            free = np.where(above, t["log_free"][own] if len(t["upper"]) else 0.0, t["log_width"][at])
            escape = np.where(above, t["free_escape"][own] if len(t["upper"]) else 0.0, t["escape"][at])
            out[active] += np.where(has, t["log_n"][place] - free, np.where(known, escape, 0.0))
            seen[active] = np.where(known, t["kinds"][at], seen[active])
            # for the next level down: where this context stands among those that exclude
            if k:
                below = self.tables[k - 1]["upper"]
                spot = np.minimum(np.searchsorted(below, gram >> U(8)), max(0, len(below) - 1))
                upper[active] = np.where(known & (below[spot] == gram >> U(8)), spot, -1) if len(below) else -1
            active = active[~has]
        out[active] -= np.log10(np.maximum(1, 256 - seen[active]))
        return out


class Hash:
    """Open addressing from uint64 keys to floats, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, ~U(0), U), np.zeros(size)
        waiting, slot, self.longest = np.arange(len(keys)), self._slot(keys), 0
        while len(waiting):
            self.longest += 1
            free = self.keys[slot] == ~U(0)
            self.keys[slot[free]] = keys[waiting[free]]
            mine = self.keys[slot] == keys[waiting]
            self.values[slot[mine]] = values[waiting[mine]]
            waiting, slot = waiting[~mine], (slot[~mine] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is known."""
        slot = self._slot(keys)
        found = self.keys[slot]
        hit = found == keys
        out = np.where(hit, self.values[slot], 0.0)
        waiting = np.flatnonzero(~hit & (found != ~U(0)))
        slot = slot[waiting]
        for _ in range(self.longest):
            if not len(waiting):
                break
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            mine = found == keys[waiting]
            out[waiting[mine]] = self.values[slot[mine]]
            hit[waiting[mine]] = True
            more = ~mine & (found != ~U(0))
            waiting, slot = waiting[more], slot[more]
        return out, hit


#: The block that a worker has at hand, by the name that its pass gave it.
_built: dict[str, tuple[Trie, Hash]] = {}


def squeezed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Keys as the steps between them in ascending order, and their counts, compressed: a worker keeps a broadcast as long as it lives."""
    order = np.argsort(keys)
    compress = zstandard.ZstdCompressor(3).compress
    return compress(np.diff(keys[order], prepend=U(0)).tobytes()), compress(counts[order].astype(np.int64).tobytes())


def expanded(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    return np.cumsum(np.frombuffer(expand(keys), U)), np.frombuffer(expand(counts), np.int64)


def block_of(packed: np.ndarray, blocks: int) -> np.ndarray:
    """A position's block: a hash of the last two bytes of its context, which all its contexts from order 2 share."""
    return (mixed((packed >> U(8)) & U(0xFFFF)) % U(blocks)).astype(np.int64)


def scores(docs: DataFrame, train_on: Column, order: int = ORDER, block_entries: int = BLOCK_ENTRIES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    score is the log10 probability of the text under the byte model, base_score under the add-one unigram model of the training words, both
    with an end.  A null text counts as empty: one token, the end.  train_on is a condition over docs' columns; null counts as false.  Without training
    rows every byte has probability 1/256.  Repeated rows each keep their row, and count as often as they stand in
    training.  Other columns are not read.  No rows: no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.coalesce(train_on, F.lit(False)).alias("train"))
    gram_counts, word_counts = count(source.filter("train"), order)
    n_docs = source.filter("train").count()
    facts = word_counts.agg(F.count(F.lit(1)).alias("kinds"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    entries = gram_counts.count()
    total = facts["n"] + n_docs
    kinds = facts["kinds"] + (1 if n_docs else 0)  # the end is a token like the words
    log_total = math.log10(total + kinds + 1)
    end_value, end_known = math.log10(n_docs + 1), int(n_docs > 0)
    blocks = max(1, math.ceil(max(entries, facts["kinds"]) / block_entries))
    kind = to_arrow_type(source.schema["doc_id"].dataType)
    id_type = source.schema["doc_id"].dataType.simpleString()
    low_orders = None
    if blocks > 1:
        # contexts of order 0 and 1 belong to no block alone: each block has all grams of order 2 (2**24 at most) folded to order 1
        low = gram_counts.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
        low_orders = (low["gram"].to_numpy(np.int64).view(U), low["n"].to_numpy(np.int64))
    from functools import reduce

    parts = []
    for b in range(blocks):
        own_grams, own_words = gram_counts, word_counts
        if blocks > 1:
            own_grams = own_grams.mapInArrow(_block_filter(b, blocks), "gram bigint, n bigint")
            own_words = own_words.filter(F.pmod("word", F.lit(blocks)) == b)
        table, words = own_grams.toArrow(), own_words.toArrow()  # a block: block_entries rows or about that
        content = spark.sparkContext.broadcast((*squeezed(table["gram"].to_numpy().view(U), table["n"].to_numpy()), *squeezed(words["word"].to_numpy().view(U), words["n"].to_numpy()), low_orders))
        del table, words
        part = source.select("doc_id", "text", "train").mapInArrow(_block_scorer(content, b, blocks, order, kind, end_value, end_known), f"doc_id {id_type}, train boolean, row string, n_tokens bigint, n_known bigint, known double, score double")
        if blocks > 1:
            part = written(part, "lm-part")
            content.destroy()  # the next block takes its place
        parts.append(part)
    if blocks == 1:
        whole = parts[0]
    else:
        # rows are the same in every pass: id and digest tell them apart, and repeated rows have equal sums
        union = reduce(DataFrame.unionByName, [p.withColumn("block", F.lit(b)) for b, p in enumerate(parts)])
        summed = union.groupBy("doc_id", "row", "train").agg(F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("known").alias("known"), F.sum("score").alias("score"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"))
        average = [(F.col(c) / F.col("times")).alias(c) for c in ("known", "score")]
        whole = summed.select("doc_id", "train", "row", "n_tokens", (F.col("n_known") / F.col("times")).cast("bigint").alias("n_known"), *average, F.explode(F.sequence(F.lit(1), "times")))
    return whole.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), (F.col("known") - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), "score")


def _block_filter(block: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(block_of(batch.column("gram").to_numpy().view(U), blocks) == block))

    return run


def _block_scorer(content, block: int, blocks: int, order: int, kind: pa.DataType, end_value: float, end_known: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            *packed_block, low = content.value
            keys, n = expanded(*packed_block[:2])
            words, m = expanded(*packed_block[2:])
            if low is not None:
                keys, n = lend(keys, n, low, order)
            _built[key] = (Trie(keys, n, order), Hash(words, np.log10(m + 1.0)))
            del keys, n, words, m  # the tables hold what is needed of them
        trie, vocabulary = _built[key]
        for ids, trains, texts in rows_of(batches, ["doc_id", "train", "text"]):
            at = 0
            while at < len(texts):
                streams, sizes, tokens, known, values, digests = [], [], [], [], [], []
                size = 0
                first = at
                while at < len(texts) and size < CHUNK_BYTES:
                    found = words_of(texts[at])
                    value, hit = vocabulary.get(word_keys(found))
                    tokens.append(len(found) + 1)
                    known.append(int(hit.sum()) + (end_known if block == 0 else 0))
                    values.append(float(value.sum()) + (end_value if block == 0 else 0.0))
                    streams.append(stream_of(found))
                    sizes.append(len(streams[-1]))
                    digests.append(f"{zlib.crc32(streams[-1]):08x}{zlib.adler32(streams[-1]):08x}{sizes[-1]:x}" if blocks > 1 else "")
                    size += sizes[-1]
                    at += 1
                packed, _ = grams(streams, order)
                if blocks == 1:
                    each = trie.score(packed)
                else:
                    own = block_of(packed, blocks) == block
                    each = np.zeros(len(packed))
                    each[own] = trie.score(packed[own])
                starts = np.cumsum([0, *sizes[:-1]])
                total = np.add.reduceat(each, starts)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first:at], kind), pa.array(trains[first:at], pa.bool_()), pa.array(digests), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(values, pa.float64()), pa.array(total, pa.float64())], ["doc_id", "train", "row", "n_tokens", "n_known", "known", "score"])

    return run


def lend(keys: np.ndarray, n: np.ndarray, low: tuple[np.ndarray, np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's grams and, under a context that no text has, what other blocks add to the counts of orders 0 and 1."""
    own, m = add_up(keys & U(0xFFFF), n)
    all_keys, all_n = add_up(*low)
    rest = all_n.copy()
    rest[np.searchsorted(all_keys, own)] -= m
    some = rest > 0
    alien = np.uint64(int.from_bytes(b"\xff" * (order - 1), "big") << 16)  # bytes FF never stand in UTF-8
    return np.concatenate([keys, all_keys[some] | alien]), np.concatenate([n, rest[some]])
