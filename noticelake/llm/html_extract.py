"""Main text of web pages: block structure, and a suffix array over each host's token streams.

A tolerant tokenizer turns a page into blocks of text, each with what its open elements say of it: within the article,
within something that is none of it (menus, forms, adverts, comments), or neither.  The pages of a host, in groups of
bounded bytes, are concatenated into one stream of word numbers, whose suffix array (prefix doubling, sorted to the
length of a long run) brings equal runs side by side.  The groups' counts of runs are added up for the host, by hashes
of the runs.  A longer repeated substring is a chain of such runs, each on as many pages at least, so the runs of that
length say all that maximal ones would of which words are covered.  Runs that stand on several distinct pages of the host
are boilerplate, and blocks that they cover are removed; unique runs stay.  Where the page marks its article, only runs on
many pages count against a block of it, and never against most of an article: articles may quote and copy each other.
"""

from __future__ import annotations

import html
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noticelake.llm._shared import rows_of, written

#: Bytes of a host's pages, about, that one suffix array takes (results do not depend on it); words of a long run; pages that
#: make a run boilerplate: outside of a marked article at least, and within one the larger of that and a share of the host.
GROUP_BYTES = 8 << 20
RUN = 8
LEAST_PAGES = 3
SHARE = 0.3
#: Share of a block's words that must be covered for it to go, and of an article's words that may go.
COVERED = 0.8
MOST_OF_ARTICLE = 0.5
BROADCAST_HOSTS = 200_000
#: Pages that are parsed together, and how hard what moves is compressed.
SLICE = 1024
LEVEL = 6

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*+)((?:[^<>\"']++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
QUOTE_OR_END = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
# What elements are, by HTML's own definitions (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
OUTSIDE = frozenset("head nav footer aside form script style noscript template button select textarea iframe object svg canvas menu dialog title fieldset".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id and role that mark what is no part of an article (fixed values).
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments commentlist disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login register share sharing social related recommended recommendations trending popular widget search searchbox toolbar pagination pager "
    "copyright legal disclaimer complementary contentinfo skip".split()
)
SIDE_PAIRS = ("side bar", "site header", "page header", "top bar", "call to action")


class Markup:
    """The markup of a page from left to right: (start, end, slash, name, attributes), the name empty for comments and declarations.

    A < that nothing closes is text.  Every character is passed a bounded number of times: of an attempt that failed the
    quotes it went through are kept, and an attempt that comes to one of them fails as well.
    """

    def __init__(self, page: str):
        self.page, self.last_end = page, page.rfind(">")
        self.dead: set[int] = set()
        self.event_from = self.event_at = -1

    def next_event(self, at: int) -> int:
        if not self.event_from <= at <= self.event_at:
            found = QUOTE_OR_END.search(self.page, at)
            self.event_from, self.event_at = at, found.start() if found else len(self.page)
        return self.event_at

    def end_of_tag(self, at: int) -> int:
        """Place of the > that closes a tag whose name ends at at, quoted ones passed over; -1 if there is none."""
        page, passed = self.page, []
        event = self.next_event(at)
        while event < len(page) and page[event] != ">":
            if event in self.dead:
                break
            passed.append(event)
            close = page.find(page[event], event + 1)
            if close < 0:
                break
            found = QUOTE_OR_END.search(page, close + 1)
            event = found.start() if found else len(page)
        if event < len(page) and page[event] == ">":
            return event
        self.dead.update(passed)
        return -1

    def find(self, at: int) -> tuple[int, int, str, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if plain := PLAIN_TAG.match(page, at):
                return at, plain.end(), plain[1], plain[2].lower(), plain[3]
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if page.startswith(opening, at):
                    end = page.find(closing, at + len(opening))
                    return at, len(page) if end < 0 else end + len(closing), "", "", ""
            if at > self.last_end:  # no tag closes from here on
                unclosed = [k for k in (page.find("<!--", at), page.find("<![CDATA[", at)) if k >= 0]
                if not unclosed:
                    return None
                at = min(unclosed)
                continue
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.find(">", at) + 1, "", "", ""
            named = TAG_NAME.match(page, at)
            if named and (end := self.end_of_tag(named.end())) >= 0:
                return at, end + 1, named[1], named[2].lower(), page[named.end() : end]
            at += 1
        return None


def blocks_of(page: str | None) -> list[tuple[str, int]]:
    """Text blocks in page order and their kind: 2 within the article, 1 neither, 0 no part of an article.

    White space within a block is one space; character references are decoded; blocks without text are left out.
    Time is in proportion to the page's length, whatever is left open in it.
    """
    out: list[tuple[str, int]] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, outside, main: of it or what it stands in
    open_names: Counter = Counter()
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, outside, main = open_tags[-1] if open_tags else ("", False, False)
                out.append((text, 0 if outside else 2 if main else 1))

    page, at = page or "", 0
    markup = Markup(page)
    while at < len(page):
        found = markup.find(at)
        if found is None:
            parts.append(page[at:])
            break
        start, end, slash, name, attributes = found
        if start > at:
            parts.append(page[at:start])
        at = end
        if not name:
            continue
        if name in ("br", "wbr"):
            parts.append(" " if name == "br" else "")
            continue
        if name not in INLINE:
            end_block()
        if slash:
            if open_names[name]:
                k = len(open_tags) - 1
                while open_tags[k][0] != name:
                    k -= 1
                if any(x[0] not in INLINE for x in open_tags[k:]):
                    end_block()
                open_names.subtract(x[0] for x in open_tags[k:])
                del open_tags[k:]
            continue
        if name in VOID or attributes.endswith("/") and name not in RAW:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
            at = len(page) if close is None else close.start()
            continue
        outer = open_tags[-1] if open_tags else ("", False, False)
        marks = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        words = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(marks.get(k, "") for k in ("class", "id", "role"))).lower())
        main = outer[2] or name in MAIN or "main" in (marks.get("role", ""), marks.get("id", "")) or marks.get("itemprop", "") == "articleBody"
        outside = outer[1] or name in OUTSIDE or name == "header" and not main or "hidden" in attributes.split() or not ASIDE_WORDS.isdisjoint(words) or any(x in " ".join(words) for x in SIDE_PAIRS)
        open_tags.append((name, outside, main) if name not in ("body", "html") else (name, False, False))
        open_names[name] += 1
    end_block()
    return out


def ranked_runs(stream: np.ndarray, owner: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the places where a run starts, the number of each place's run, and of each run its distinct owners.

    stream: word numbers from 0; owner: the page of each word, in ascending order.  The suffix array is made by prefix
    doubling up to the run's length; suffixes that agree so far stand side by side, and each such range is one run.
    """
    n = len(stream)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank, length = stream.astype(np.int64), 1
    while length < run:
        step = min(length, run - length)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead + 1, return_inverse=True)
        length += step
    last = np.searchsorted(owner, owner, "right")  # a run must end on its page
    starts = np.flatnonzero(np.arange(n) + run <= last)
    array = starts[np.argsort(rank[starts], kind="stable")]  # places of one run stay in page order
    first = np.ones(len(array), bool)
    first[1:] = rank[array][1:] != rank[array][:-1]
    fresh = first.copy()
    fresh[1:] |= owner[array][1:] != owner[array][:-1]
    label = np.cumsum(first) - 1
    return array, label, np.bincount(label, weights=fresh).astype(np.int64)


def covered(n: int, array: np.ndarray, label: np.ndarray, pages: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each of n places the largest number of pages of a run that covers it."""
    begun = np.zeros(n, np.int64)
    begun[array] = pages[label]
    cover = begun.copy()
    for k in range(1, min(run, n)):
        np.maximum(cover[k:], begun[:-k], out=cover[k:])
    return cover


def repeated_runs(stream: np.ndarray, owner: np.ndarray, run: int = RUN) -> np.ndarray:
    """For each position of the stream the number of distinct owners whose streams have a run that covers it."""
    return covered(len(stream), *ranked_runs(stream, owner, run), run)


class Streams:
    """The word streams of a group's distinct pages, one after the other, and their runs."""

    def __init__(self, pages: list[list[tuple[str, int]]]):
        self.numbers: dict[str, int] = {}
        self.spans: list[list[tuple[int, int]] | None] = []
        self.distinct: dict[tuple, int] = {}
        words, sizes = array("q"), []
        for blocks in pages:
            key = tuple(blocks)
            if key in self.distinct:  # a copy of a page is no other page
                self.spans.append(None)
                sizes.append(0)
                continue
            self.distinct[key] = len(self.spans)
            own, start = [], len(words)
            for text, _ in blocks:
                found = text.lower().split()
                own.append((len(words), len(words) + len(found)))
                words.extend(self.numbers.setdefault(w, len(self.numbers)) for w in found)
            self.spans.append(own)
            sizes.append(len(words) - start)
        self.stream = np.frombuffer(words, np.int64) if words else np.zeros(0, np.int64)
        self.array, self.label, self.pages = ranked_runs(self.stream, np.repeat(np.arange(len(sizes)), sizes))

    def hashes(self, bits: int) -> np.ndarray:
        """A hash of each run's words, the same in every group."""
        import xxhash

        words = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.numbers], np.uint64)
        at = self.array[np.flatnonzero(np.diff(self.label, prepend=-1))]
        out = np.zeros(len(at), np.uint64)
        for k in range(RUN):
            out = (out ^ words[self.stream[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out >> np.uint64(64 - bits)


def main_texts(pages: list[list[tuple[str, int]]], host: tuple[int, int, np.ndarray, np.ndarray] | None = None) -> list[list[str]]:
    """Of each page of a group the blocks of its main text.

    host, where the group is not the whole host: the host's distinct pages, the bits of a hash, and the hashes (ascending) and
    pages of the runs whose pages on the host are more than those of the group.
    """
    group = Streams(pages)
    size_of_host, counts = len(group.distinct), group.pages
    if host is not None:
        size_of_host, bits, known, totals = host
        if len(known):
            own_hashes = group.hashes(bits)
            at = np.minimum(np.searchsorted(known, own_hashes), len(known) - 1)
            counts = np.where(known[at] == own_hashes, totals[at], counts)
    cover = covered(len(group.stream), group.array, group.label, counts) if size_of_host >= LEAST_PAGES else np.zeros(len(group.stream), np.int64)
    strict = max(LEAST_PAGES, math.ceil(SHARE * size_of_host))
    kept: list[list[str]] = []
    for blocks, own in zip(pages, group.spans):
        if own is None:
            kept.append(kept[group.distinct[tuple(blocks)]])
            continue
        marked = any(kind == 2 for _, kind in blocks)
        wanted = [k for k, (_, kind) in enumerate(blocks) if kind == (2 if marked else 1)]
        least = strict if marked else LEAST_PAGES
        gone = {k for k in wanted if (cover[own[k][0] : own[k][1]] >= least).sum() >= COVERED * max(1, own[k][1] - own[k][0])}
        size = lambda ks: sum(own[k][1] - own[k][0] for k in ks)
        if marked and size(gone) > MOST_OF_ARTICLE * size(wanted):
            gone = set()
        kept.append([blocks[k][0] for k in wanted if k not in gone])
    return kept


def packed(blocks: list[tuple[str, int]]) -> str:
    """Blocks as lines that start with their kind; a block's text has no line feed."""
    return "\n".join(f"{kind}{text}" for text, kind in blocks)


def unpacked(content: str) -> list[tuple[str, int]]:
    return [(x[1:], int(x[0])) for x in content.split("\n")] if content else []


def bundle(contents: list[str]) -> bytes:
    """Contents of several pages, compressed together."""
    raw = [x.encode("utf-8", "surrogatepass") for x in contents]
    return zstandard.ZstdCompressor(LEVEL).compress(b"".join([np.array([len(raw), *map(len, raw)], "<u4").tobytes(), *raw]))


def unbundled(compressed: bytes) -> list[str]:
    raw = zstandard.ZstdDecompressor().decompress(compressed)
    many = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 * (many + 1) + np.cumsum([0, *np.frombuffer(raw, "<u4", many, 4)])
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def parsed(pages: DataFrame) -> DataFrame:
    """The pages of a slice that go to one group in one row: host, groups, bits, part, content (a bundle of what is distinct) and pages
    (page_id, url and the place of their content in the bundle).  Contents that are alike go to one group."""
    import xxhash

    kind = pages.schema["page_id"].dataType
    page_type = pa.list_(pa.struct([("page_id", to_arrow_type(kind)), ("url", pa.string()), ("at", pa.int32())]))
    schema = pa.schema([("host", pa.string()), ("groups", pa.int32()), ("bits", pa.int32()), ("part", pa.int32()), ("content", pa.binary()), ("pages", page_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, hosts, groups, bits, htmls in rows_of(batches, ["page_id", "url", "host", "groups", "bits", "html"], SLICE):
            dealt: dict[tuple, tuple[dict[str, int], list[dict]]] = {}
            for page_id, url, host, many, size, page in zip(ids, urls, hosts, groups, bits, htmls):
                content = packed(blocks_of(page))
                part = xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass")) % many if many > 1 else 0
                contents, rows = dealt.setdefault((host, many, size, part), ({}, []))
                rows.append({"page_id": page_id, "url": url, "at": contents.setdefault(content, len(contents))})
            rows = [(*home, bundle(list(contents)), own) for home, (contents, own) in dealt.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows), schema)], schema=schema)

    return pages.mapInArrow(run, f"host string, groups int, bits int, part int, content binary, pages array<struct<page_id: {kind.simpleString()}, url: string, at: int>>")


def steps(hashes: np.ndarray) -> bytes:
    """Ascending hashes as their steps, byte by byte, which compress."""
    gaps = np.diff(hashes, prepend=np.uint64(0)).astype(">u8")
    return zstandard.ZstdCompressor(LEVEL).compress(gaps.view(np.uint8).reshape(-1, 8).T.tobytes())


def from_steps(compressed: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(compressed)
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64))


def numbers(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(LEVEL).compress(values.astype("<u4").tobytes())


def from_numbers(compressed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(compressed), "<u4")


def distinct_contents(group: pa.Table) -> tuple[dict[str, int], list[list[int]]]:
    """The distinct contents of a group's bundles, and of the contents of each bundle the place among them."""
    contents: dict[str, int] = {}
    return contents, [[contents.setdefault(x, len(contents)) for x in unbundled(raw.as_py())] for raw in group.column("content")]


def host_runs(dealt: DataFrame) -> DataFrame:
    """For each group (host, part) of dealt its runs that stand on LEAST_PAGES pages of the host or more, and on pages of
    other groups: hashes, and their pages on the host.

    A group counts its own runs and deals their hashes into as many buckets as the host has groups; a bucket adds up
    what all groups of the host say of its runs, and tells each group of those it has.  Groups hold no page in common.
    One bucket more, without hashes, adds up the distinct pages.  A group that is its whole host has nothing to ask.
    """
    def table(host: str, rows: list[tuple], **kinds: pa.DataType) -> pa.Table:
        return pa.table({"host": pa.array([host] * len(rows), pa.string()), **{name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())}})

    def count(group: pa.Table) -> pa.Table:
        host, groups, bits, part = (group.column(x)[0].as_py() for x in ("host", "groups", "bits", "part"))
        rows = []
        if groups > 1 and host:
            streams = Streams([unpacked(x) for x in distinct_contents(group)[0]])
            hashes, inverse = np.unique(streams.hashes(bits), return_inverse=True)
            counts = np.bincount(inverse, weights=streams.pages, minlength=len(hashes)).astype(np.int64)
            bucket = (hashes % np.uint64(groups)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(groups + 1))
            rows = [(part, b, steps(hashes[order[x:y]]), numbers(counts[order[x:y]])) for b, (x, y) in enumerate(zip(bounds, bounds[1:])) if x < y]
            rows.append((part, groups, None, numbers(np.array([len(streams.distinct)]))))
        return table(host, rows, part=pa.int32(), bucket=pa.int32(), hashes=pa.binary(), counts=pa.binary())

    def add(group: pa.Table) -> pa.Table:
        parts, counts = group.column("part").to_pylist(), [from_numbers(x) for x in group.column("counts").to_pylist()]
        if group.column("hashes")[0].as_py() is None:
            rows = [(part, None, numbers(np.array([np.concatenate(counts).sum()]))) for part in parts]
        else:
            hashes = [from_steps(x) for x in group.column("hashes").to_pylist()]
            _, place = np.unique(np.concatenate(hashes), return_inverse=True)
            totals = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)[place]
            rows = []
            for part, own, here, total in zip(parts, hashes, counts, np.split(totals, np.cumsum([len(x) for x in hashes])[:-1])):
                many = (total >= LEAST_PAGES) & (total > here)
                if many.any():
                    rows.append((part, steps(own[many]), numbers(total[many])))
        return table(group.column("host")[0].as_py(), rows, part=pa.int32(), hashes=pa.binary(), totals=pa.binary())

    counted = dealt.groupBy("host", "part").applyInArrow(count, "host string, part int, bucket int, hashes binary, counts binary")
    return counted.groupBy("host", "bucket").applyInArrow(add, "host string, part int, hashes binary, totals binary")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks joined by a line feed, empty if none) and n_chars.

    A null page counts as empty; a page whose url is null or names no host shares runs with no other.  Repeated rows each
    keep theirs.  Pages that mark an article (article or main elements, or their roles) give its blocks; others what is left
    beside menus, forms and the like once runs shared by pages of the host are gone.  Other columns are not read.  No rows: no rows.

    Pages are parsed once and move once, compressed, to groups of their host.  A host is dealt to as many groups of
    GROUP_BYTES as its pages need by a hash of the blocks, so a host of a third of all pages is many groups, and a task
    holds one group at a time; the pages of a run are counted over all groups of its host (host_runs), so that what goes
    does not depend on the groups.  Runs meet there by hashes with twelve bits more than the host's bytes need.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html")).withColumn("host", host)
    large = source.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size")).filter(F.col("size") > GROUP_BYTES)
    bits = F.least(F.lit(64), F.ceil(F.log2("size")) + F.lit(12))
    large = written(large.select("host", F.ceil(F.col("size") / F.lit(GROUP_BYTES)).cast("int").alias("groups"), bits.cast("int").alias("bits")), "large-hosts")
    large = F.broadcast(large) if large.count() <= BROADCAST_HOSTS else large
    dealt = parsed(source.join(large, "host", "left").withColumns({"groups": F.coalesce("groups", F.lit(1)), "bits": F.coalesce("bits", F.lit(64))}))

    def texts(group: pa.Table, runs: pa.Table) -> pa.Table:
        contents, places = distinct_contents(group)
        of_host = None if group.column("host")[0].as_py() else (1, 64, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if runs.num_rows:
            found = [(h and from_steps(h), from_numbers(t).astype(np.int64)) for h, t in zip(runs.column("hashes").to_pylist(), runs.column("totals").to_pylist())]
            known, pages = (np.concatenate([x[k] for x in found if x[0] is not None] or [np.zeros(0, kind)]) for k, kind in enumerate((np.uint64, np.int64)))
            order = np.argsort(known)
            of_host = next(int(t[0]) for h, t in found if h is None), group.column("bits")[0].as_py(), known[order], pages[order]
        kept = main_texts([unpacked(x) for x in contents], of_host)
        rows = group.column("pages").combine_chunks()
        each = rows.flatten()  # the pages of all bundles, put together by content
        first = np.cumsum([0, *map(len, places[:-1])])
        which = np.concatenate(places)[np.repeat(first, rows.value_lengths().to_numpy()) + each.field("at").to_numpy()]
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(contents) + 1))
        own = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each.take(pa.array(order)))
        return pa.table({"pages": own, "text": pa.array(["\n".join(x) for x in kept], pa.string())})

    kind = source.schema["page_id"].dataType.simpleString()
    found = dealt.groupBy("host", "part").cogroup(host_runs(dealt).groupBy("host", "part")).applyInArrow(texts, f"pages array<struct<page_id: {kind}, url: string, at: int>>, text string")
    rows = found.select(F.explode("pages").alias("page"), "text")
    return rows.select("page.page_id", "page.url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
