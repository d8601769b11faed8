"""Conversation structure repair: the cheapest edits that turn a conversation's rows into an optional system row and pairs of user and assistant.

The search is Dijkstra's on the implicit lattice of (rows read, grammar state): keeping, re-roling and deleting a row
lead to the next row, inserting one stays at it.  Its priority is (cost, audit), the audit being the edits' initials, and it stops at the
first accepting node at the end that it pops.  Of two paths of equal cost to a node neither audit can begin with the other (what
follows would be insertions alone, which cost), so the order of audits survives what is appended and the search is exact for ties, too.

Rows are dealt by ranges of (conversation, turn) and read as sorted streams, in segments of at most SEGMENT rows.  A conversation that lies in one
segment is repaired there.  One that goes over segments or tasks, however long, has each segment searched from every state
that may enter it, and the segments' best ways are then put together by the same search, over segments in place of rows.  So no task holds
more than a segment's texts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from noticelake.llm._shared import partitions, written

#: Rows and bytes of text after which a segment ends.
SEGMENT, SEGMENT_BYTES = 512, 8 << 20
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
#: What an undeleted truncated row costs besides.
TRUNCATED = 5
# States: at the start, after the system row, after a user's, after an assistant's row.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
LEGAL = ("su", "ua", "au")
BLANK, DUPLICATE, CUT = 1, 2, 3
WHITE = " \t\n\v\f\r"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text of rows after faults planted by crc32(`conv:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes its
    stops, 3 repeats it, 4 makes it a user's.  A null id, turn, role or text counts as one space (the turn itself stays null)."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    found = rows.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind"))
    found = found.filter("kind != 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text_now = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return found.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"))


def fault(text: str, seen: bool) -> int:
    """A row's first fault, 0 if it has none."""
    bare = text.rstrip(WHITE)
    return BLANK if not bare else DUPLICATE if seen else CUT if bare[-1] not in ".!?" else 0


def cheapest(rows: list[tuple[str, int]], entry: int = 0, goals: tuple[int, ...] = ACCEPTING, every: bool = False) -> list[tuple[int, int, str]]:
    """(state, cost, audit) of the cheapest way from state entry over all rows (initial, fault) to one of goals; of the ways to each if every."""
    heap, done, found = [(0, "", 0, entry)], set(), []
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in goals:
            found.append((state, cost, audit))
            if not every or len(found) == len(goals):
                break
        step = NEXT[state]
        wanted = WANTED[state][0]
        heapq.heappush(heap, (cost + COSTS["I"], audit + "I", at, step[wanted]))
        if at < len(rows):
            initial, kind = rows[at]
            heapq.heappush(heap, (cost + COSTS["D"], audit + "D", at + 1, state))
            if kind not in (BLANK, DUPLICATE):
                more = TRUNCATED if kind == CUT else 0
                heapq.heappush(heap, (cost + COSTS["R"] + more, audit + "R", at + 1, step[wanted]))
                if initial in step:
                    heapq.heappush(heap, (cost + COSTS["K"] + more, audit + "K", at + 1, step[initial]))
    return found


def chained(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost and audits, by segment, of the cheapest way through segments whose ways are (entry, exit, cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, at, state, parts = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(segments):
            if state in ACCEPTING:
                lengths = []
                while parts:
                    parts, n = parts
                    lengths.append(n)
                cuts = [0]
                for n in reversed(lengths):
                    cuts.append(cuts[-1] + n)
                return cost, [audit[a:b] for a, b in zip(cuts, cuts[1:])]
            continue
        for entry, out, more, edits in segments[at]:
            if entry == state:
                heapq.heappush(heap, (cost + more, audit + edits, at + 1, out, (parts, len(edits))))
    raise ValueError("no way through the segments")


def edited(roles: list[str], texts: list[str], audit: str, entry: int = 0) -> tuple[list[tuple[str, str]], int]:
    """Role and text of the rows after the audit's edits, and the state that they end in."""
    out, at, state = [], 0, entry
    for edit in audit:
        if edit == "I":
            out.append((WANTED[state], ""))
        elif edit == "R":
            out.append((WANTED[state], texts[at]))
        elif edit == "K":
            out.append((roles[at], texts[at]))
        at += edit != "I"
        if edit != "D":
            state = NEXT[state][out[-1][0][:1]]
    return out, state


def as_text(rows: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in rows)


STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, first_turn bigint, last_turn bigint, low bigint, high bigint, turns bigint"


def _stats(rows: list[tuple], faults: list[int]) -> dict:
    """Counts of a segment, and what those of its neighbours need to be added to them."""
    initials = [r[2][:1] for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    return {
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        "first": initials[0], "last": initials[-1], "first_turn": rows[0][1], "last_turn": rows[-1][1], "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)),
    }


def segments(rows: DataFrame, texts: bool = True) -> DataFrame:
    """Segments of conversations: conv, part and seg (their order), whole (the segment is all of its conversation), counts, roles and texts (of whole
    conversations if texts), and ways (entry, exit, cost, audit): of a whole conversation the cheapest alone, else the cheapest between any two
    states; digest of a whole one."""
    keep = texts
    digest = F.sha2("text", 256)
    rows = rows.withColumns({"at": F.struct(F.col("turn").isNotNull().alias("known"), "turn"), "digest": digest})
    first = rows.groupBy(F.col("conv").alias("conv_f"), F.col("role").alias("role_f"), F.col("digest").alias("digest_f")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    same = F.col("conv").eqNullSafe(F.col("conv_f")) & (F.col("role") == F.col("role_f")) & (F.col("digest") == F.col("digest_f"))
    # rows that no other equals meet nothing; of equal ones all but those of the first turn are repeats
    known = rows.join(first.filter("n > 1"), same, "left").select("conv", "turn", "role", "text", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"))
    by: list[Column] = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    dealt = known.repartitionByRange(partitions(rows.sparkSession), *by, F.substring("text", 1, 32).asc()).sortWithinPartitions(*by, F.col("text").asc())
    id_type = rows.schema["conv"].dataType.simpleString()
    ddl = f"conv {id_type}, part int, seg int, whole boolean, {STATS}, roles array<string>, texts array<string>, ways array<struct<entry:int,exit:int,cost:bigint,audit:string>>, digest string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        now: list[tuple] = []  # the segment that grows, its faults and bytes
        faults: list[int] = []
        size = count = 0
        opened = True  # the conversation may have begun before this segment
        before = None
        out: list[dict] = []

        def close(ends: bool) -> None:
            nonlocal now, faults, size, count, opened
            whole = ends and not opened
            codes = [(r[2][:1], f) for r, f in zip(now, faults)]
            roles, texts = [r[2] for r in now], [r[3] for r in now]
            if whole:
                ways = [(0, *cheapest(codes)[0])]
                made = hashlib.sha256(as_text(edited(roles, texts, ways[0][3])[0]).encode()).hexdigest()
            else:
                ways, made = [(entry, *way) for entry in NEXT for way in cheapest(codes, entry, tuple(s for s in NEXT if s != 0 or entry == 0), True) if way], None
            names = ("entry", "exit", "cost", "audit")
            out.append({"size": len(now), "conv": now[0][0], "part": part, "seg": count, "whole": whole, **_stats(now, faults), "roles": roles if keep or not whole else None, "texts": texts if keep or not whole else None, "ways": [dict(zip(names, w)) for w in ways], "digest": made})
            now, faults, size, count, opened = [], [], 0, count + 1, not ends

        for batch in batches:
            for piece in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                for row in zip(*(c.to_pylist() for c in piece.columns)):
                    if now and row[0] != now[-1][0]:
                        close(True)
                    elif len(now) >= SEGMENT or size > SEGMENT_BYTES:
                        close(False)
                    faults.append(fault(row[3], row[4] or before == row[:4]))
                    now.append(row)
                    before = row[:4]
                    size += len(row[3])
                if sum(x["size"] for x in out) > 2 * SEGMENT:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if now:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, ddl)


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _joined(rows: list[dict]) -> dict:
    """One row for a conversation of several segments (without texts): its counts, cost, audit, and the audits by segment."""
    rows = sorted(rows, key=lambda r: (r["part"], r["seg"]))
    counts = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    turns = sum(r["turns"] for r in rows)
    for a, b in zip(rows, rows[1:]):
        counts["illegal"] += a["last"] + b["first"] not in LEGAL
        turns -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    low, high = ([r[k] for r in rows if r[k] is not None] for k in ("low", "high"))
    cost, audits = chained([[(w["entry"], w["exit"], w["cost"], w["audit"]) for w in r["ways"]] for r in rows])
    state, entries = 0, []
    for r, audit in zip(rows, audits):
        entries.append(state)
        state = next(w["exit"] for w in r["ways"] if w["entry"] == state and w["audit"] == audit)
    edits = [{"part": r["part"], "seg": r["seg"], "entry": e, "edits": a} for r, e, a in zip(rows, entries, audits)]
    return {"conv": rows[0]["conv"], "gaps": max(high) - min(low) + 1 - turns if low else 0, **counts, "cost": cost, "audit": "".join(audits), "pieces": edits}


def _digests(pieces: DataFrame) -> DataFrame:
    """conv and digest of conversations in pieces (conv, part, seg, entry, edits, roles, texts): hashed as a sorted stream, piece by piece."""
    id_type = pieces.schema["conv"].dataType.simpleString()
    schema = to_arrow_schema(StructType.fromDDL(f"conv {id_type}, digest string"))
    dealt = pieces.select("conv", "part", "seg", "entry", "edits", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "part", "seg")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, sha, out = None, False, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if sha is None or row["conv"] != now:
                    if sha is not None:
                        out.append({"conv": now, "digest": sha.hexdigest()})
                    now, begun, sha = row["conv"], False, hashlib.sha256()
                rows, _ = edited(row["roles"], row["texts"], row["edits"], row["entry"])
                if rows:
                    sha.update((("\n" if begun else "") + as_text(rows)).encode())
                    begun = True
        if sha is not None:
            out.append({"conv": now, "digest": sha.hexdigest()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, f"conv {id_type}, digest string")


class Repair:
    """The repair of rows (conv, turn, role, text): results for each conversation, and the repaired rows.

    A conversation's rows are taken by turn, nulls first, those of a turn by role and text.  Null roles and texts count as one space.  Blank and
    repeated rows are always deleted.  A role counts by its first character, and one that begins with neither s, u nor a can't be kept.
    Ids may be null (a conversation like any other).  Texts and conversations may be of any length; without rows there are no results.
    Without texts only results() can be had, and what is written is smaller by the texts.
    """

    def __init__(self, rows: DataFrame, texts: bool = True):
        self.texts = texts
        filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
        self.segments = written(segments(rows.select("conv", F.col("turn").cast("bigint").alias("turn"), *filled), texts), "segments")
        id_type = rows.schema["conv"].dataType.simpleString()
        parted = self.segments.filter("not whole").drop("whole", "roles", "texts", "digest")
        ddl = f"conv {id_type}, {RESULT}, pieces array<struct<part:int,seg:int,entry:int,edits:string>>"
        schema = to_arrow_schema(StructType.fromDDL(ddl))
        made = parted.groupBy("conv").applyInArrow(lambda found: pa.Table.from_pylist([_joined(found.to_pylist())], schema), ddl)
        self.parted = written(made, "parted-conversations")

    def pieces(self) -> DataFrame:
        """Segments of conversations in several, each with its share of the edits and the state it begins in."""
        of = self.parted.select(F.explode("pieces").alias("p")).select(F.col("p.part").alias("p"), F.col("p.seg").alias("s"), "p.entry", "p.edits")
        found = self.segments.filter("not whole").select("conv", "part", "seg", "roles", "texts")
        return found.join(of, (F.col("part") == F.col("p")) & (F.col("seg") == F.col("s"))).drop("p", "s")

    def results(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
        way = F.element_at("ways", 1)
        counts = [F.col(c) for c in ("blank", "duplicate", "truncated", "illegal")]
        gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
        one = self.segments.filter("whole").select("conv", gaps, *counts, way["cost"].alias("cost"), way["audit"].alias("audit"), F.col("digest").alias("repaired_sha256"))
        digests = _digests(self.pieces()).withColumnRenamed("conv", "conv_d")
        parted = self.parted.join(digests, F.col("conv").eqNullSafe(F.col("conv_d")))
        return one.union(parted.select("conv", "gaps", *counts, "cost", "audit", F.col("digest").alias("repaired_sha256")))

    def rows(self) -> DataFrame:
        """conv, part, seg, ord, role and text of the repaired rows, ordered within a conversation by part, seg and ord."""
        if not self.texts:
            raise ValueError("the texts of whole conversations were not kept")
        ready = self.segments.filter("whole").select("conv", "part", "seg", "roles", "texts", F.lit(0).alias("entry"), F.element_at("ways", 1)["audit"].alias("edits"))
        found = ready.unionByName(self.pieces())
        id_type = found.schema["conv"].dataType.simpleString()
        ddl = f"conv {id_type}, part int, seg int, ord int, role string, text string"
        schema = to_arrow_schema(StructType.fromDDL(ddl))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    r = batch.slice(k, 1).to_pylist()[0]
                    made = [{"conv": r["conv"], "part": r["part"], "seg": r["seg"], "ord": i, "role": a, "text": b} for i, (a, b) in enumerate(edited(r["roles"], r["texts"], r["edits"], r["entry"])[0])]
                    yield pa.RecordBatch.from_pylist(made, schema)

        return found.mapInArrow(run, ddl)
