"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group, and a group's demand is the vector of its bytes, tokens and rows.  Groups of more than
``HEAVY`` of a shard in any of the three are packed one by one (there are few of them by that very share), those of more
than ``WHOLE`` in pieces of equal size; the many light ones are first gathered, by a hash of the group, into cells of nearly equal size.
Heavy groups and cells are then placed, the longest first, each in the shard where the dot product of its demand and the
shard's residual capacity is highest, both in shares of the total, among shards with room for it.  What the driver packs
is bounded by the number of cells and the share, not by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm._shared import WORD, written

#: Cells for each shard, and the share of a shard that makes a group heavy.
CELLS = 512
HEAVY = 1 / 256
#: Share of a shard up to which a group stays whole.
WHOLE = 0.9
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(demands: np.ndarray, shards: int) -> np.ndarray:
    """Each row's shard.  demands: rows of bytes, tokens and rows.

    Placed by the length of the demand, longest first.  A shard has room while no dimension passes its capacity (the mean,
    with the demand's own size as slack); if none has, the one whose largest load stays smallest takes it.  Ties go to the smaller
    total load, then to the lower shard.
    """
    total = np.maximum(demands.sum(0), 1e-300)
    share = demands / total * shards
    room = np.ones((shards, demands.shape[1]))
    chosen = np.zeros(len(demands), int)
    for k in sorted(range(len(demands)), key=lambda k: (-float(share[k] @ share[k]), k)):
        left = room - share[k]
        fits = (left >= -share[k] * 0.5).all(1)
        if fits.any():
            dot = np.where(fits, room @ share[k], -np.inf)
            best = int(np.lexsort((np.arange(shards), -room.sum(1), -np.round(dot, 12)))[0])
        else:
            best = int(np.lexsort((np.arange(shards), -room.sum(1), -np.round(left.min(1), 12)))[0])
        room[best] -= share[k]
        chosen[k] = best
    return chosen


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size (UTF-8 bytes of the text, null counting none, plus 1), tokens (words, plus 1), text_crc32
    (0 for null), shard (0 to shards - 1) and slot (from 0 without gaps in each shard).

    Rows with equal texts share a shard unless their group is heavier than a piece of a shard may be: then its rows are dealt to as many
    pieces as it needs, by a hash of the id, so that a text that a third of all rows have fills no shard alone.  A null text is a group apart from the empty one.  Repeated rows are placed like others and get slots of their
    own.  Other columns are not read.  No rows: no rows.

    Texts are read once and don't move; rows of some 60 bytes do, by cell.  Slots come from per-cell counts: a cell's offset
    within its shard is a running sum over the packed cells, and a row's number within its cell a window over that cell alone.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("bigint").alias("tokens"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("group"),
    )
    rows = written(rows, "shard-rows")
    totals = rows.agg(*[F.sum(c).alias(c) for c in ("size", "tokens")], F.count(F.lit(1)).alias("rows")).first()
    if not totals["rows"]:
        return rows.select("doc_id", "size", "tokens", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    full = {"bytes": totals["size"] / shards, "tokens": totals["tokens"] / shards, "rows": totals["rows"] / shards}
    weight = F.greatest(*[F.col(c) / F.lit(float(full[c])) for c in DIMENSIONS])
    # at most 3 * shards / HEAVY groups can be over the share, and those over WHOLE a few pieces and parts more: all bounded
    heavy = groups.withColumn("weight", weight).filter(F.col("weight") > HEAVY)
    pieces = F.when(F.col("weight") <= WHOLE, F.lit(1)).otherwise(F.ceil(F.col("weight") / F.lit(0.5))).cast("int")
    heavy = written(heavy.select("group", pieces.alias("pieces"), F.ceil(F.col("weight") * F.lit(64)).cast("int").alias("parts")), "shard-heavy")
    # A light row's unit is a cell, a heavy row's its group or piece; rows are numbered within parts of a unit, so that no
    # window holds a hot group.
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 40))
    cell = F.pmod(F.xxhash64("group"), F.lit(CELLS * shards)).cast("string")
    unit = F.when(F.col("pieces").isNull(), cell).when(F.col("pieces") == 1, F.col("group")).otherwise(F.concat_ws("/", "group", (place % F.col("pieces")).cast("string")))
    part = F.coalesce((F.floor(place / F.col("pieces")) % F.col("parts")).cast("int"), F.lit(0))
    placed = rows.join(F.broadcast(heavy), "group", "left").withColumns({"unit": unit, "part": part}).drop("pieces", "parts", "group")
    placed = written(placed, "shard-units")
    parts = placed.groupBy("unit", "part").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).toPandas().sort_values(["unit", "part"], ignore_index=True)
    units = parts.groupby("unit", as_index=False)[list(DIMENSIONS)].sum()
    units["shard"] = pack(units[list(DIMENSIONS)].to_numpy(float), shards)
    parts = parts.merge(units[["unit", "shard"]], on="unit")
    parts["offset"] = parts.groupby("shard")["rows"].cumsum() - parts["rows"]
    table = docs.sparkSession.createDataFrame(parts[["unit", "part", "shard", "offset"]].astype({"part": "int32", "shard": "int32", "offset": "int64"}), "unit string, part int, shard int, offset bigint")
    nth = F.row_number().over(Window.partitionBy("unit", "part").orderBy("doc_id", "text_crc32", "size"))
    found = placed.withColumn("nth", nth).join(F.broadcast(table), ["unit", "part"])
    return found.select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("bigint").alias("slot"))
