"""Temperature mixing of sources, realised as budgeted block permutations.

A source's share p of all tokens becomes the weight p**a / sum(p**a).  Entropy grows as the exponent a falls from 1 to
0, and so does the repetition of the smallest source against the largest; a is found by bisection: the largest exponent that
reaches the target entropy, but never one that repeats a source more often than the limit.  Each round of the bisection
evaluates a grid of exponents in one aggregate over the source totals, so nothing grows with the number of sources.

A weight becomes a budget of tokens, and a budget whole epochs and a remainder.  A source's documents fall into blocks by a
hash; each epoch visits the blocks in an order of its own, and the remainder takes whole blocks of the last epoch's order, then
documents of one block, while the budget lasts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm._shared import WORD, written

#: Rows a block should have about; the number of blocks follows the number of rows.
BLOCK_ROWS = 20_000
LEAST_BLOCKS = 64
#: Rows of the block and extra-document tables up to which they are broadcast.
BROADCAST_ROWS = 500_000
SECTIONS = 16


def tokens_of(text_column: str) -> Column:
    """Words of the text, and one for its end."""
    return (F.regexp_count(F.coalesce(F.col(text_column), F.lit("")), F.lit(WORD)) + 1).cast("bigint")


def source_key(column: str) -> Column:
    """Sources as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def exponent(totals: DataFrame, entropy: float, most_repeats: float) -> float:
    """The exponent for source totals (column total, above zero): entropy is a share of the largest one possible, ln(sources)."""
    facts = totals.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("all"), F.min("total").alias("low"), F.max("total").alias("high")).first()
    if facts.n < 2 or facts.low == facts.high:
        return 1.0
    limit = max(0.0, 1 - math.log(most_repeats) / math.log(facts.high / facts.low)) if most_repeats >= 1 else 0.0
    p = F.col("total") / F.lit(float(facts["all"]))
    low, high = 0.0, 1.0  # the entropy is reached at low, and not above high
    goal = entropy * math.log(facts.n)
    while high - low > 1e-9:
        grid = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS + 1)]
        sums = totals.agg(*[c for a in grid for c in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]).first()
        reached = [math.log(z) - a * s / z >= goal for a, z, s in zip(grid, sums[::2], sums[1::2])]
        k = reached.index(False) if False in reached else SECTIONS
        if k == SECTIONS:
            low = high
            break
        low, high = (grid[k - 1] if k else low), grid[k]
    return max(low, limit)


def plan(docs: DataFrame, entropy: float, most_repeats: float, budget: float | None, seed: int, id_column: str, text_column: str, source_column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' keys (written), each block's whole epochs and weight, and the documents of cut blocks that get one more."""
    keys = docs.select(F.col(id_column).alias("doc_id"), source_key(source_column).alias("source_key"), tokens_of(text_column).alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(id_column).cast("string")).alias("place"))
    keys = written(keys, "mix-keys")
    rows = keys.count()
    blocks_each = max(LEAST_BLOCKS, math.ceil(rows / BLOCK_ROWS))
    keys = keys.withColumn("block", F.pmod("place", F.lit(blocks_each)).cast("int"))
    blocks = written(keys.groupBy("source_key", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    totals = written(blocks.groupBy("source_key").agg(F.sum("tokens").alias("total")), "mix-totals")
    facts = totals.agg(F.sum("total").alias("all")).first()
    if not facts["all"]:
        none = totals.select("source_key", F.lit(0).alias("block"), F.lit(0.0).alias("weight"), F.lit(0).alias("epochs"))
        return keys, none, keys.select("source_key", "doc_id")
    a = exponent(totals, entropy, most_repeats)
    scaled = totals.withColumn("raw", F.pow(F.col("total") / F.lit(float(facts["all"])), F.lit(a)))
    z = scaled.agg(F.sum("raw")).first()[0]
    weights = scaled.withColumn("weight", F.col("raw") / F.lit(z))
    if budget is None:  # just enough that every document is used once at least
        budget = weights.agg(F.max(F.col("total") / F.col("weight"))).first()[0]
    weights = weights.withColumn("budget", F.round(F.col("weight") * F.lit(float(budget))).cast("bigint"))
    weights = weights.select("source_key", "weight", F.floor(F.col("budget") / F.col("total")).cast("int").alias("whole"), (F.col("budget") % F.col("total")).alias("rest"))

    order = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed), F.lit("last"), F.col("block")), "block")
    cut = blocks.join(F.broadcast(weights) if totals.count() <= BROADCAST_ROWS else weights, "source_key").withColumn("upto", F.sum("tokens").over(order))
    room = F.col("rest") - (F.col("upto") - F.col("tokens"))
    cut = written(cut.select("source_key", "block", "weight", (F.col("whole") + (room >= F.col("tokens")).cast("int")).alias("epochs"), F.when((room > 0) & (room < F.col("tokens")), room).alias("room")), "mix-epochs")

    # one block at most of a source is cut within: its documents in hashed order, repeated rows together
    partial = cut.filter("room is not null").select("source_key", "block", "room")
    partial = F.broadcast(partial) if totals.count() <= BROADCAST_ROWS else partial
    sums = keys.join(partial, ["source_key", "block"]).groupBy("source_key", "block", "place", "doc_id", "room").agg(F.sum("n_tokens").alias("n_tokens"))
    within = Window.partitionBy("source_key", "block").orderBy("place", "doc_id")
    extra = sums.withColumn("upto", F.sum("n_tokens").over(within)).filter("upto <= room").select("source_key", "doc_id")
    return keys, cut.select("source_key", "block", "weight", "epochs"), written(extra, "mix-extra")


def mixed(docs: DataFrame, rows: DataFrame, blocks: DataFrame, extra: DataFrame) -> DataFrame:
    """rows (with source_key, block, doc_id) with their weight, one row per epoch; blocks and extra are broadcast while small."""
    blocks = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    more = extra.select(F.col("source_key").alias("__source"), F.col("doc_id").alias("__id"), F.lit(1).alias("__more"))
    more = F.broadcast(more) if extra.count() <= BROADCAST_ROWS else more
    found = rows.join(blocks, ["source_key", "block"]).join(more, (F.col("source_key") == F.col("__source")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    times = F.col("epochs") + F.coalesce("__more", F.lit(0))
    return found.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), times - 1))).drop("__source", "__id", "__more", "epochs")


def mix_plan(docs: DataFrame, entropy: float = 0.95, most_repeats: float = 4.0, budget: float | None = None, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixture's rows: doc_id, source, n_tokens, weight (of the source), epoch, block, turn and place.

    Sorted by epoch, turn (the hashed place of the block in that epoch's permutation) and place, they are the order to
    read.  Without a budget (in tokens) the mixture is the smallest that uses every document once at least, so none is
    dropped; with one, sources may be cut short.  n_tokens counts words and one end, so an empty or null text has one.
    A null source is a source of its own.  Repeated rows are used alike.  Other columns are not read.  No rows: no rows.

    The text is read once; from then on keys of some 40 bytes move.  A source's rows are spread over blocks, whose
    number follows that of the rows, so a hot source is many groups.
    """
    keys, blocks, extra = plan(docs, entropy, most_repeats, budget, seed, id_column, text_column, source_column)
    found = mixed(docs, keys, blocks, extra)
    source = F.when(F.col("source_key") != "", F.substr("source_key", F.lit(2)))
    return found.select("doc_id", source.alias("source"), "n_tokens", "weight", "epoch", "block", F.xxhash64(F.lit(seed), F.col("epoch"), F.col("block")).alias("turn"), "place")


def mix(docs: DataFrame, entropy: float = 0.95, most_repeats: float = 4.0, budget: float | None = None, seed: int = 42, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """docs as mix_plan() has them: each row as many times as it has epochs, columns as they were.

    Texts do not move: a row's block follows from its own columns, and joins the small table of blocks.
    """
    keys, blocks, extra = plan(docs, entropy, most_repeats, budget, seed, id_column, text_column, source_column)
    many = max(LEAST_BLOCKS, math.ceil(keys.count() / BLOCK_ROWS))
    own = {name: f"__mix_{k}" for k, name in enumerate(docs.columns)}
    place = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"))
    rows = docs.withColumns({"__key": source_key(source_column), "__block": F.pmod(place, F.lit(many)).cast("int"), "__doc": F.col(id_column)})
    rows = rows.select(*[F.col(f"`{k}`").alias(v) for k, v in own.items()], F.col("__key").alias("source_key"), F.col("__block").alias("block"), F.col("__doc").alias("doc_id"))
    found = mixed(docs, rows, blocks, extra)
    return found.select(*[F.col(v).alias(k) for k, v in own.items()])
