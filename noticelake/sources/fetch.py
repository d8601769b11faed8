"""Bytes of addresses, and pages of PDF files, by functions that the caller gives: connectors for a cluster with a network and libraries."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Get = Callable[[str, dict[str, str], float], tuple[int, bytes]]
#: What waiting for pages and for PDF files takes: tries, seconds between them, seconds until a try is given up (fixed values).
PAGE = {"attempts": 1, "pause": 0.0, "timeout": 10.0}
PDF = {"attempts": 25, "pause": 15.0, "timeout": 60.0}
#: The status of a proxy whose origin gave no proper answer: the one that passes by itself, and so is asked again.
PASSING = 520
HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "text/html,application/pdf,*/*", "Accept-Language": "en-US,en;q=0.9"}
PDF_MARK = b"%PDF"


def web_get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, bytes]:
    """Status and body of an address over HTTP."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as reply:
            return reply.status, reply.read()
    except HTTPError as error:
        return error.code, b""


def fetch_one(url: str | None, get: Get = web_get, attempts: int = 1, pause: float = 0.0, timeout: float = 10.0, headers: dict[str, str] = HEADERS, mark: bytes = b"", wait: Callable[[float], None] = time.sleep) -> tuple[str | None, bytes | None, int, str | None]:
    """url, content, tries and error of one address.

    An answer counts if its status is 2xx and its body starts with mark.  What passes by itself is tried again after a pause until the attempts are
    used up: status PASSING, lost connections, time that runs out, and other exceptions.  Any other status and other content are final at once.
    """
    error, tries = "no address", 0
    while url and tries < attempts:
        if tries:
            wait(pause)
        tries += 1
        try:
            status, body = get(url, headers, timeout)
        except Exception as failure:  # a connection may fail in any way
            error = f"{type(failure).__name__}: {failure}"
            continue
        if 200 <= status < 300:
            return (url, body, tries, None) if body.startswith(mark) else (url, None, tries, "other content")
        error = f"status {status}"
        if status != PASSING:
            break
    return url, None, tries, error


def fetched(urls: DataFrame, get: Get = web_get, attempts: int = 1, pause: float = 0.0, timeout: float = 10.0, headers: dict[str, str] = HEADERS, mark: bytes = b"", wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """url, content, tries and error of every row of urls (column url), by fetch_one: content is null where error is not, and an address that
    fails is no failed task.  A null url is an error.  Rows are fetched where they are: deal them out before, as the hosts allow, or use PageSource.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("url", pa.string()), ("content", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])
        for batch in batches:
            for url in batch.column("url").to_pylist():
                row = fetch_one(url, get, attempts, pause, timeout, headers, mark, wait)
                yield pa.RecordBatch.from_arrays([pa.array([x], field.type) for x, field in zip(row, schema)], schema=schema)

    return urls.select("url").mapInArrow(run, "url string, content binary, tries int, error string")


def pdf_pages(files: DataFrame, read: Callable[[bytes], list[tuple[str | None, int, list]]]) -> DataFrame:
    """url, page_number (from 1), text, images, tables and error of files (url, content): a row for each page.

    read gives of a file's bytes each page's text, number of images and tables (lists of rows of cells).  A file that it cannot read, and
    null content, is one row with an error and no page.
    """
    def rows(url: str | None, content: bytes | None) -> list[tuple]:
        try:
            if content is None:
                raise ValueError("no content")
            return [(url, k, text, images, tables, None) for k, (text, images, tables) in enumerate(read(content), 1)]
        except Exception as failure:  # so may a reader
            return [(url, None, None, None, None, f"{type(failure).__name__}: {failure}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = pa.list_(pa.list_(pa.list_(pa.string())))
        schema = pa.schema([("url", pa.string()), ("page_number", pa.int32()), ("text", pa.string()), ("images", pa.int32()), ("tables", grids), ("error", pa.string())])
        for batch in batches:
            for url, content in zip(batch.column("url").to_pylist(), batch.column("content").to_pylist()):
                if found := rows(url, content):
                    yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*found), schema)], schema=schema)

    return files.select("url", "content").mapInArrow(run, "url string, page_number int, text string, images int, tables array<array<array<string>>>, error string")
