"""A Spark data source of web addresses: one partition for a share of a host's addresses, paced as the host allows, in batch and as a stream.

    spark.dataSource.register(PageSource)
    spark.read.format("web_pages").option("list", "/shared/addresses.txt").load()
    spark.readStream.format("web_pages").option("list", "/shared/addresses.txt").load()

The list is a text file with an address a line that driver and executors can read; a stream takes the lines that are new.  A host's addresses are never asked for
by more tasks at once than ``per_host``, and each of those waits ``delay`` seconds between two.  Tries follow fetch.fetch_one.
"""

from __future__ import annotations

import importlib
import time
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from noticelake.sources import fetch

SCHEMA = "url string, host string, content binary, tries int, error string"


@dataclass
class Share(InputPartition):
    """The lines of the list that one task fetches: from, to, and which of the host's addresses among them."""

    host: str
    start: int
    end: int
    share: int
    shares: int


def host_of(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


def lines_of(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str]]:
    """Numbers and addresses of the list's lines from start up to end; empty lines count, but are no addresses."""
    with open(path, encoding="utf-8") as lines:
        for number, line in enumerate(lines):
            if end is not None and number >= end:
                return
            if number >= start and line.strip():
                yield number, line.strip()


class Settings:
    def __init__(self, options: dict[str, str]):
        self.path = options["list"]
        self.per_host, self.delay = int(options.get("per_host", "1")), float(options.get("delay", "0"))
        module, _, name = options.get("get", "noticelake.sources.fetch:web_get").partition(":")
        self.get_from = (module, name)
        limits = fetch.PDF if options.get("kind", "page") == "pdf" else fetch.PAGE
        self.limits = {k: type(v)(options.get(k, v)) for k, v in limits.items()}
        self.mark = fetch.PDF_MARK if options.get("kind", "page") == "pdf" else b""

    def shares(self, start: int, end: int | None) -> list[Share]:
        """A partition for each share of a host's addresses; what the driver holds is one number for each host."""
        counts: dict[str, int] = defaultdict(int)
        last = start
        for number, url in lines_of(self.path, start, end):
            counts[host_of(url)] += 1
            last = number + 1
        end = last if end is None else end
        return [Share(host, start, end, k, min(self.per_host, n)) for host, n in sorted(counts.items()) for k in range(min(self.per_host, n))]

    def fetch(self, part: Share) -> Iterator[tuple]:
        get = getattr(importlib.import_module(self.get_from[0]), self.get_from[1])
        place = fetched = 0
        for _, url in lines_of(self.path, part.start, part.end):
            if host_of(url) != part.host:
                continue
            place += 1
            if place % part.shares != part.share:
                continue
            if fetched and self.delay:
                time.sleep(self.delay)
            fetched += 1
            address, content, tries, error = fetch.fetch_one(url, get, mark=self.mark, **self.limits)
            yield address, part.host, content, tries, error


class PageReader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Share]:
        return self.settings.shares(0, None)

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.settings.fetch(partition)


class PageStream(DataSourceStreamReader):
    """New lines of the list; offsets are line numbers, so a restarted stream asks for what it had not finished."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def initialOffset(self) -> dict:
        return {"line": 0}

    def latestOffset(self) -> dict:
        return {"line": max((number + 1 for number, _ in lines_of(self.settings.path)), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.settings.shares(start["line"], end["line"])

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.settings.fetch(partition)

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(Settings(self.options))

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(Settings(self.options))
