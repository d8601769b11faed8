"""A Spark data sink of department documents: one ``<dept>_results<suffix>.json`` for each department, written as its rows stream by.

    write_departments(notices, "/shared/results", suffix="_structure_aware")

Rows come dealt by department and sorted, so a task holds one notice at a time, however large a department is.  Files are staged beside their
place under a name of the task's own; the commit of the job moves them, an abort removes them, and a task that is run again
stages anew.  The folder may be in any store that pyarrow.fs opens by its address, or a path that driver and executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from noticelake.operators.summary import newest_years

KINDS = {"circular": "circulars", "circular_letter": "circular_letters"}
SCHEMA = "dept string, dept_url string, year string, kind string, pos bigint, entry string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def shifted(value, depth: int) -> str:
    """JSON, two blanks a level, to stand at a depth."""
    return json.dumps(value, indent=2, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


class Document:
    """One department's document, written piece by piece: years in the order they come, each with its circulars, letters and counts, then the totals."""

    def __init__(self, out, dept: str, url: str | None, stamp: str):
        self.out, self.totals, self.year, self.years, self.kind = out, dict.fromkeys(KINDS.values(), 0), None, 0, None
        self.put(f'{{\n  "department": {shifted(dept, 1)},\n  "url": {shifted(url, 1)},\n  "processing_timestamp": {shifted(stamp, 1)},\n  "years": {{')

    def put(self, text: str) -> None:
        self.out.write(text.encode())

    def upto(self, kind: str | None) -> None:
        """Close the list that is open and open those up to kind's; none: all."""
        names = list(KINDS.values())
        at = -1 if self.kind is None else names.index(self.kind)
        goal = len(names) if kind is None else names.index(kind)
        while at < goal:
            if at >= 0:
                self.put("\n      ],\n" if self.count else "],\n")
            at += 1
            if at < len(names):
                self.put(f'      "{names[at]}": [')
                self.kind, self.count = names[at], 0

    def close_year(self) -> None:
        if self.year is not None:
            self.upto(None)
            self.put('      "summary": ' + shifted({f"total_{k}": n for k, n in self.counts.items()}, 3) + "\n    }")

    def add(self, year: str, kind: str, entry: str) -> None:
        if year != self.year:
            self.close_year()
            self.put(("," if self.years else "") + f"\n    {shifted(year, 2)}: {{\n")
            self.year, self.years, self.kind, self.counts = year, self.years + 1, None, dict.fromkeys(KINDS.values(), 0)
        name = KINDS[kind]
        if name != self.kind:
            self.upto(name)
        self.put(("," if self.count else "") + "\n        " + shifted(json.loads(entry), 4))
        self.count += 1
        self.counts[name] += 1
        self.totals[name] += 1

    def close(self) -> None:
        self.close_year()
        self.put("\n  }" if self.years else "}")
        self.put(f',\n  "total_years_processed": {self.years},\n  "summary": {shifted({f"total_{k}": n for k, n in self.totals.items()}, 1)}\n}}\n')
        self.out.close()


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class DepartmentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix, self.stamp = options["path"].rstrip("/"), options.get("suffix", "_structure_aware"), options.get("stamp", "")

    def write(self, rows: Iterator[Row]) -> Staged:
        store, folder = opened(self.folder)
        store.create_dir(folder, recursive=True)
        staged, document, dept = Staged(), None, None
        try:
            for row in rows:
                if document is None or row.dept != dept:
                    if document:
                        document.close()
                    dept = row.dept
                    name = f"{(dept or '').lower()}_results{self.suffix}.json"
                    staged.files.append((f"{folder}/.{name}-{uuid.uuid4().hex}", f"{folder}/{name}"))
                    document = Document(store.open_output_stream(staged.files[-1][0]), dept, row.dept_url, self.stamp)
                document.add(row.year, row.kind, row.entry)
            if document:
                document.close()
        except BaseException:
            self._remove(staged)
            raise
        return staged

    def _remove(self, staged: Staged) -> None:
        store, _ = opened(self.folder)
        for path, _ in staged.files:
            if store.get_file_info(path).type != fs.FileType.NotFound:
                store.delete_file(path)

    def commit(self, messages: list[Staged | None]) -> None:
        store, _ = opened(self.folder)
        for message in messages:
            for path, name in message.files if message else ():
                store.move(path, name)

    def abort(self, messages: list[Staged | None]) -> None:
        for message in messages:
            if message:
                self._remove(message)


class DepartmentSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "department_json"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DepartmentWriter:
        return DepartmentWriter(self.options)


def write_departments(notices: DataFrame, path: str, suffix: str = "_structure_aware", max_years: int | None = None, stamp: str = "", extra: tuple[str, ...] = ()) -> None:
    """Write notices (dept, year, kind, pos, title, id_text, date_text, url and, if there, dept_url and the columns extra) as department files.

    Years are in descending order, at most the max_years newest; notices as placed (pos).  Keys without a value are left out of a notice, extra columns
    that hold JSON text (content, references) stand as JSON.  Rows of unknown kind or without year are not written; without notices there are no files.
    """
    spark = notices.sparkSession
    spark.dataSource.register(DepartmentSink)
    if max_years is not None:
        notices = newest_years(notices, max_years)
    quoted = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f'"{name}": '), value))
    text = lambda c: F.substring(F.to_json(F.array(F.col(c).cast("string"))), F.lit(2), F.length(F.to_json(F.array(F.col(c).cast("string")))) - 2)
    named = {"title": "title", "ID": "id_text", "date": "date_text", "url": "url"}
    parts = [quoted(name, F.when(F.col(c).isNotNull(), text(c))) for name, c in named.items()] + [quoted(c, F.col(c)) for c in extra]
    entry = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", "), F.lit("}"))
    url = F.col("dept_url") if "dept_url" in notices.columns else F.lit(None).cast("string")
    rows = notices.filter(F.col("kind").isin(*KINDS) & F.col("year").isNotNull()).select("dept", url.alias("dept_url"), F.col("year").cast("string").alias("year"), "kind", F.col("pos").cast("bigint").alias("pos"), entry.alias("entry"))
    dealt = rows.repartition("dept").sortWithinPartitions("dept", F.desc(F.col("year").try_cast("int")), F.desc("year"), "kind", "pos", "entry")
    dealt.write.format("department_json").mode("append").option("path", path).option("suffix", suffix).option("stamp", stamp).save()
