"""Byte-level BPE by DuckDB recursive queries, one database per Python worker.

Each partition's texts are split by the tokenizer's pattern; the distinct pieces, cut into bytes, become token-position
rows (piece, position, id).  A recursive query joins neighbouring rows to the merge table and contracts, in every piece
at once, the leftmost pair of minimum rank, until no piece has a pair left.  Decoding joins the final ids to the
vocabulary and concatenates their bytes by an ordered aggregate.  Pieces repeat very often, so a bounded cache of pieces
that are already encoded and decoded goes before the query; it changes no result.

Pieces over ``LONG_PIECE`` bytes would need as many rounds of the recursion as they have bytes, each over all of them.
They get the same contraction, leftmost pair of minimum rank first, from a heap over a linked list.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from noticelake.llm._shared import kept, lean

#: Pieces of more bytes are contracted by contract().
LONG_PIECE = 256
#: Known pieces kept by a worker (about 60 bytes each), pieces per recursive query, and characters looked at together.
KNOWN_PIECES = 400_000
QUERY_PIECES = 5_000
GROUP_CHARS = 2_000_000
GROUP_ROWS = 2_000

#: Unicode white space, for DuckDB's regular expressions, whose own class has ASCII only (fixed values).
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: A row has its own id, and its next row's position and id; key orders pairs by rank, then position.  A round takes each
#: piece's least key, writes the merged id to its left row, drops its right row and looks up the two pairs that changed.
ENCODE_SQL = """
with recursive state(piece, step, pos, id, next_pos, next_id, key) as (
    select b.piece, 0, b.pos, b.id, b.next_pos, b.next_id, (m.id::bigint << 32) | (b.pos << 16) | b.next_pos
    from (select piece, pos, id, lead(pos) over around as next_pos, lead(id) over around as next_id
          from bytes_in window around as (partition by piece order by pos)) b
    left join merges m on m.l = b.id and m.r = b.next_id
  union all
    select n.piece, n.step, n.pos, n.id, n.next_pos, n.next_id,
           case when n.changed then (m.id::bigint << 32) | (n.pos << 16) | n.next_pos else n.key end
    from (select s.piece, s.step + 1 as step, s.pos, s.key,
                 case when s.pos = b.pos then b.made else s.id end as id,
                 case when s.pos = b.pos then gone.next_pos else s.next_pos end as next_pos,
                 case when s.pos = b.pos then gone.next_id when s.next_pos = b.pos then b.made else s.next_id end as next_id,
                 coalesce(s.pos = b.pos or s.next_pos = b.pos, false) as changed
          from state s
          join (select piece, (min(key) >> 16) & 65535 as pos, min(key) & 65535 as next_pos, (min(key) >> 32)::integer as made
                from state where key is not null group by piece) b on b.piece = s.piece
          join state gone on gone.piece = b.piece and gone.pos = b.next_pos
          where s.pos <> b.next_pos) n
    left join merges m on n.changed and m.l = n.id and m.r = n.next_id)
select s.piece, string_agg(cast(s.id as varchar), ',' order by s.pos) as ids, count(*)::integer as n,
       unhex(string_agg(v.hex, '' order by s.pos)) as decoded
from state s join (select piece, max(step) as step from state group by piece) last on last.piece = s.piece and last.step = s.step
join vocabulary v on v.id = s.id
group by s.piece order by s.piece
"""


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x.strip())}


def coder_key(lines: bytes, pattern: str) -> tuple[str, str, str]:
    return "coder", hashlib.md5(lines).hexdigest(), pattern


class Coder:
    """Encodes and decodes pieces; one per Python worker and vocabulary."""

    @classmethod
    def get(cls, lines: bytes, pattern: str) -> "Coder":
        return kept(coder_key(lines, pattern), lambda: cls(lines, pattern))

    def __init__(self, lines: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = ranks = read_ranks(lines)
        self.split_one = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.one = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.one:
            raise ValueError("a byte-level vocabulary has all 256 bytes")
        # RE2 has no lookahead.  Where no two white-space characters stand side by side it makes no difference; the
        # other texts are split by the pattern as it is.
        self.plain = pattern.replace(r"\s+(?!\S)|", "").replace(r"[^\s", f"[^{SPACE}").replace(r"\s+", f"[{SPACE}]+")
        self.has_plain = "(?" not in self.plain and r"\s" not in self.plain and r"\S" not in self.plain
        self.forget()
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                l, r = ranks.get(token[:cut]), ranks.get(token[cut:])
                if l is not None and r is not None:
                    left.append(l), right.append(r), made.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "id": pa.array(made, pa.int32())})
        vocabulary = pa.table({"id": pa.array(list(self.token), pa.int32()), "hex": [x.hex() for x in self.token.values()]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("arriving", table)
            self.db.execute(f"create table {name} as select * from arriving")
            self.db.unregister("arriving")

    def forget(self) -> None:
        """Known pieces: their text, ids joined by commas, number of ids, and bytes decoded from the ids."""
        self.pieces, self.ids, self.n, self.decoded = pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.binary())

    def split(self, texts: pa.Array) -> pa.ListArray:
        """Each text's pieces, in order."""
        if not self.has_plain:
            return pa.array([self.split_one(x) for x in texts.to_pylist()], pa.list_(pa.string()))
        self.db.register("texts_in", pa.table({"text": texts}))
        found = self.db.sql(f"select regexp_extract_all(text, $${self.plain}$$) as pieces, regexp_matches(text, '[{SPACE}][{SPACE}]') as odd from texts_in").to_arrow_table()
        self.db.unregister("texts_in")
        pieces, odd = found["pieces"].combine_chunks(), np.flatnonzero(found["odd"].to_numpy())
        if len(odd):
            parts, at = [], 0
            for k in odd.tolist():
                parts += [pieces.slice(at, k - at), pa.array([self.split_one(texts[k].as_py())], pieces.type)]
                at = k + 1
            pieces = pa.concat_arrays([*parts, pieces.slice(at)])
        return pieces

    def _query(self, pieces: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        raw = [x.encode() for x in pieces]
        sizes = np.fromiter(map(len, raw), np.int32, len(raw))
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        rows = pa.table({
            "piece": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
            "pos": (np.arange(len(starts)) - starts).astype(np.int32),
            "id": np.array(self.one, np.int32)[np.frombuffer(b"".join(raw), np.uint8)],
        })
        self.db.register("bytes_in", rows)
        coded = self.db.sql(ENCODE_SQL).to_arrow_table()
        self.db.unregister("bytes_in")
        if len(coded) != len(pieces):
            raise RuntimeError("a piece is missing from the recursive query's result")
        return tuple(coded[x].combine_chunks() for x in ("ids", "n", "decoded"))

    def _learn(self, new: pa.Array) -> None:
        long = pc.greater(pc.binary_length(new), LONG_PIECE)
        short = new.filter(pc.invert(long))
        found = [(self.pieces, self.ids, self.n, self.decoded)]
        for at in range(0, len(short), QUERY_PIECES):
            part = short.slice(at, QUERY_PIECES)
            found.append((part, *self._query(part.to_pylist())))
        for x in new.filter(long).to_pylist():
            ids = contract(x.encode(), self.ranks)
            found.append((pa.array([x]), pa.array([",".join(map(str, ids))]), pa.array([len(ids)], pa.int32()), pa.array([b"".join(self.token[i] for i in ids)], pa.binary())))
        self.pieces, self.ids, self.n, self.decoded = map(pa.concat_arrays, zip(*found))

    def code(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Of each text (none null): ids joined by commas, their number, the bytes they decode to."""
        lists = self.split(texts)
        flat = lists.flatten().dictionary_encode()
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        if len(self.pieces) > KNOWN_PIECES:
            self.forget()
        at = pc.index_in(flat.dictionary, value_set=self.pieces)
        if at.null_count:
            new = flat.dictionary.filter(pc.is_null(at))
            self._learn(new)
            at = pc.index_in(flat.dictionary, value_set=self.pieces)
        codes = at.take(flat.indices)
        ends = np.concatenate([[0], np.cumsum(self.n.take(codes).to_numpy(), dtype=np.int64)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.ids.take(codes)), ",")
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.decoded.take(codes)), b"")
        return joined, ends[offsets[1:]] - ends[offsets[:-1]], decoded


def contract(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the leftmost pair of minimum rank until none is left; a heap of pairs over a linked list."""
    part: list[bytes | None] = [bytes([b]) for b in piece]
    after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(part) and (rank := ranks.get(part[i] + part[after[i]])) is not None:
            heapq.heappush(heap, (rank, i, len(part[i]) + len(part[after[i]])))

    for i in range(len(part)):
        offer(i)
    while heap:
        rank, i, size = heapq.heappop(heap)
        if part[i] is None or (j := after[i]) >= len(part) or len(part[i]) + len(part[j]) != size or ranks.get(part[i] + part[j]) != rank:
            continue
        part[i], part[j] = part[i] + part[j], None
        after[i] = after[j]
        if after[i] < len(part):
            before[after[i]] = i
        offer(i), offer(before[i])
    return [ranks[x] for x in part if x is not None]


def encode(docs: DataFrame, ranks_file: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text", with_values: bool = False) -> DataFrame:
    """Encode and decode every text; one row per row of docs: id, n_tokens, ids_sha256, decoded_sha256.

    With ``with_values`` also ids (their decimal numbers joined by commas) and decoded (bytes).  A null text counts as
    empty: no tokens, and the digests of nothing.  Repeated rows and ids each give a row; other columns are ignored, so
    their names cannot clash.  No shuffle: each partition stands alone, and memory is bounded by the cache, one group of
    texts (``GROUP_CHARS``) and the longest text.
    """
    spark = docs.sparkSession
    lines = spark.sparkContext.broadcast(ranks_file)  # a vocabulary file: its size is that of a tokenizer, not of the data
    source = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_values:
        fields += [T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.get(lines.value, pattern)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            group = np.maximum(np.cumsum(sizes) // GROUP_CHARS, np.arange(len(sizes)) // GROUP_ROWS)
            edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist()
            for at, to in itertools.pairwise(edges):
                part = batch.slice(at, to - at)
                ids, n, decoded = coder.code(pc.fill_null(part.column("text"), ""))
                hashes = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string()) for column in (ids, decoded)]
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), *hashes, *[ids, decoded] * with_values]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return source.mapInArrow(lean(run, coder_key(ranks_file, pattern)), T.StructType(fields))
