import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from noticelake.sources import departments, fetch, files
from noticelake.sources.documents import DepartmentWriter, Staged, write_departments
from noticelake.sources.web import PageSource
from noticelake.streaming import pages


def test_cache(spark, tmp_path):
    cache = files.CitationCache(spark, str(tmp_path / "cache"))
    assert cache.load().collect() == [] and cache.parts() == []
    resolved = spark.createDataFrame([("BSD Circular No. 05 of 2003", "u1"), ("b", None), ("bsd circular 5 of 2003", "u1")], "title string, url string")
    cache.add(resolved, "one"), cache.add(resolved, "one")
    assert len(cache.parts()) == 1
    assert [(r.norm_key, r.title, r.url, r.citations) for r in cache.load().collect()] == [("bsd circular 5 2003", "BSD Circular No. 05 of 2003", "u1", [])]
    asked = spark.createDataFrame([("BSD circular 5 of 2003",), ("b",), ("BSD Circular Letter 5 of 2003",)], "title string")
    assert sorted(r.title for r in cache.missing(asked).collect()) == ["BSD Circular Letter 5 of 2003", "b"]
    # runs at once, one of which dies before it is complete
    runs = [spark.createDataFrame([(f"ABC Circular {k} of 2010", f"u{k}")], "title string, url string") for k in range(4)]
    with ThreadPoolExecutor() as pool:
        list(pool.map(cache.add, runs))
    (tmp_path / "cache" / "add-dead").mkdir()
    (tmp_path / "cache" / "add-dead" / "part-0.parquet").write_bytes(b"half a file")
    assert cache.load().count() == 5 and len(cache.parts()) == 5
    before = sorted(map(tuple, cache.load().collect()))
    cache.compact()
    assert len(cache.parts()) == 1 and sorted(map(tuple, cache.load().collect())) == before
    cache.add(spark.createDataFrame([("abc circular 1 of 2010", "later")], "title string, url string"))
    assert {r.norm_key: r.url for r in cache.load().collect()}["abc circular 1 2010"] == "later"


def test_sinks(spark, tmp_path):
    notices = spark.createDataFrame([("acd", 2014, "circular", 1, "t2", None, None, "u2"), ("acd", 2014, "circular", 0, "t1", "i", None, "u1"), ("acd", 2015, "circular_letter", 0, "t3", None, None, "u3")], "dept string, year int, kind string, pos int, title string, id_text string, date_text string, url string")
    rows = notices.withColumns({"dept": F.upper("dept"), "dept_url": F.lit("https://d"), "content": F.when(F.col("pos") == 0, F.lit('[{"type": "content", "text": "a\\n\\u00fc"}]'))})
    write_departments(rows.union(rows.withColumn("dept", F.lit("MFD")).filter("year = 2015")).repartition(3), str(tmp_path / "out"), files.run_suffix(True, False), stamp="now", extra=("content",))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".json") == ["acd_results_with_pdf_content.json", "mfd_results_with_pdf_content.json"]
    text = (tmp_path / "out" / "acd_results_with_pdf_content.json").read_text()
    expected = {
        "department": "ACD", "url": "https://d", "processing_timestamp": "now", "years": {
            "2015": {"circulars": [], "circular_letters": [{"title": "t3", "url": "u3", "content": [{"type": "content", "text": "a\nü"}]}], "summary": {"total_circulars": 0, "total_circular_letters": 1}},
            "2014": {"circulars": [{"title": "t1", "ID": "i", "url": "u1", "content": [{"type": "content", "text": "a\nü"}]}, {"title": "t2", "url": "u2"}], "circular_letters": [], "summary": {"total_circulars": 2, "total_circular_letters": 0}},
        }, "total_years_processed": 2, "summary": {"total_circulars": 2, "total_circular_letters": 1},
    }
    assert json.loads(text) == expected and text == json.dumps(expected, indent=2, ensure_ascii=False) + "\n"
    write_departments(rows, str(tmp_path / "newest"), max_years=1)
    assert list(json.loads((tmp_path / "newest" / "acd_results_structure_aware.json").read_text())["years"]) == ["2015"]
    write_departments(rows.limit(0), str(tmp_path / "none"))
    assert not list((tmp_path / "none").glob("*.json")) if (tmp_path / "none").exists() else True
    files.write_facts(notices, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).filter("year = 2014").count() == 2
    assert departments.departments(spark).count() == 6


def test_aborted_documents_leave_nothing(tmp_path):
    from pyspark.sql import Row

    writer = DepartmentWriter({"path": str(tmp_path)})
    row = Row(dept="A", dept_url=None, year="2014", kind="circular", pos=0, entry='{"title": "t"}')
    staged = writer.write(iter([row]))
    assert len(list(tmp_path.iterdir())) == 1 and not list(tmp_path.glob("a_*"))
    writer.abort([staged, None])
    assert not list(tmp_path.iterdir())
    with pytest.raises(ValueError):  # a task that fails takes its files away
        writer.write(iter([row, Row(dept="B", dept_url=None, year="2014", kind="circular", pos=0, entry="no json")]))
    assert not list(tmp_path.iterdir())
    first, again = writer.write(iter([row])), writer.write(iter([row]))  # run twice, committed once
    writer.commit([again, Staged()])
    assert [p.name for p in tmp_path.glob("a_*")] == ["a_results_structure_aware.json"] and first.files != again.files


def test_attachments(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1.4"), (tmp_path / "b.pdf").write_bytes(b"<html>"), (tmp_path / "c.txt").write_bytes(b"%PDF")
    assert [r.path.rsplit("/")[-1] for r in files.attachments(spark, str(tmp_path)).collect()] == ["a.PDF"]


def test_stream(spark, tmp_path):
    rows = [(1, "u", "<p>Some first paragraph of text</p>"), (2, "u", "<p>again</p>"), (3, "v", "<ol><li>x</li></ol>")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    pages.block_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert sorted(r.type for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["content", "list"]


def test_fetching(spark):
    def get(url, headers, timeout):
        get.seen = {**getattr(get, "seen", {}), url: getattr(get, "seen", {}).get(url, 0) + 1}
        if url == "down":
            raise ConnectionError("no route")
        if url == "late" and get.seen[url] < 3:
            return 520, b""
        return (404, b"") if url == "gone" else (200, b"%PDF-1.4 " + headers["User-Agent"].encode() if url != "page" else b"<html>")

    urls = spark.createDataFrame([("down",), ("late",), ("gone",), ("page",), ("ok",), (None,)], "url string").coalesce(1)
    found = {r.url: r for r in fetch.fetched(urls, get, attempts=4, pause=0, mark=fetch.PDF_MARK, wait=lambda s: None).collect()}
    assert found["late"].tries == 3 and found["late"].error is None and bytes(found["ok"].content).startswith(b"%PDF-1.4 Mozilla")
    assert {k: r.error for k, r in found.items() if r.error} == {"down": "ConnectionError: no route", "gone": "status 404", "page": "other content", None: "no address"}

    def read(content):
        return [(content.decode()[5:], 1, [[["a", "b"], ["c", None]]]), (None, 0, [])]

    files_ = spark.createDataFrame([("u", b"%PDF-x"), ("bad", b"\xff"), ("none", None)], "url string, content binary")
    pages = {(r.url, r.page_number): r for r in fetch.pdf_pages(files_, read).collect()}
    assert pages["u", 1].text == "x" and pages["u", 1].tables == [[["a", "b"], ["c", None]]] and pages["u", 2].text is None
    assert pages["bad", None].error.startswith("UnicodeDecodeError") and pages["none", None].error == "ValueError: no content"


def test_references_meet_their_attachments(spark):
    from noticelake.operators.notices import with_attachments

    refs = spark.createDataFrame([("n1", "u1"), ("n1", "u2"), ("n2", "u1")], "notice string, url string")
    known = spark.createDataFrame([("u1", 3, True, None)], "url string, pages int, text_extractable boolean, notification string")
    assert sorted((r.notice, r.url, r.pages) for r in with_attachments(refs, known).collect()) == [("n1", "u1", 3), ("n1", "u2", None), ("n2", "u1", 3)]


def test_retries(spark):
    """A dead link is asked for once, a passing status to the end."""
    asked = {}

    def get(url, headers, timeout):
        asked[url] = asked.get(url, 0) + 1
        if url == "slow":
            raise TimeoutError
        return (200, b"<html>") if url == "page" else (int(url), b"")

    outcomes = {u: fetch.fetch_one(u, get, **fetch.PDF, mark=fetch.PDF_MARK, wait=lambda s: None) for u in ("404", "403", "500", "520", "page", "slow")}
    assert asked == {"404": 1, "403": 1, "500": 1, "520": 25, "page": 1, "slow": 25}
    assert {u: (x[2], x[3]) for u, x in outcomes.items()} == {
        "404": (1, "status 404"), "403": (1, "status 403"), "500": (1, "status 500"), "520": (25, "status 520"), "page": (1, "other content"), "slow": (25, "TimeoutError: "),
    }


@pytest.fixture
def server():
    """Answers by path: /ok/x a page, /late/x status 520 twice, /404/x that status, /pdf/x a PDF file."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        asked: list[tuple[str, str]] = []

        def do_GET(self):
            kind = self.path.split("/")[1]
            self.asked.append((self.headers["Host"].split(":")[0], self.path))
            late = kind == "late" and sum(p == self.path for _, p in self.asked) < 3
            self.send_response(520 if late else int(kind) if kind.isdigit() else 200)
            self.end_headers()
            self.wfile.write(b"%PDF-1.4" if kind == "pdf" else b"<p>" + self.path.encode())

        def log_message(self, *args):
            pass

    served = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield served.server_address[1], Handler.asked
    served.shutdown()


def test_web_pages(spark, tmp_path, server):
    port, asked = server
    asked.clear()
    hosts = [f"http://127.0.0.1:{port}", f"http://localhost:{port}"]
    lines = [f"{hosts[k % 2]}/{kind}/{k}" for k, kind in enumerate(["ok", "ok", "late", "404", "ok", "ok", "pdf", "520"])]
    path = tmp_path / "list.txt"
    path.write_text("\n".join([*lines[:4], "", *lines[4:]]) + "\n")
    spark.dataSource.register(PageSource)
    read = lambda **options: spark.read.format("web_pages").options(list=str(path), **options).load()
    frame = read(attempts=4, pause=0, per_host=2)
    assert frame.rdd.getNumPartitions() == 4  # two shares of each host
    found = {r.url: r for r in frame.collect()}
    assert sorted(found) == sorted(lines) and len(asked) == 8 + 2 + 3
    assert {u: (r.tries, r.error) for u, r in found.items() if r.error or r.tries > 1} == {lines[2]: (3, None), lines[3]: (1, "status 404"), lines[7]: (4, "status 520")}
    assert {r.host for r in found.values()} == {"127.0.0.1", "localhost"} and bytes(found[lines[0]].content) == b"<p>/ok/0"
    # a pace of a tenth of a second between the four addresses of each host
    began = time.time()
    read(kind="pdf", attempts=1, delay=0.1).filter("error is null").collect()
    assert time.time() - began >= 0.3
    assert [r.url for r in read(kind="pdf", attempts=1).filter("error is null").collect()] == [lines[6]]


def test_web_page_stream(spark, tmp_path, server):
    port, asked = server
    asked.clear()
    spark.dataSource.register(PageSource)
    path = tmp_path / "list.txt"
    line = lambda k: f"http://localhost:{port}/ok/{k}\n"

    def run():
        stream = spark.readStream.format("web_pages").option("list", str(path)).load().select("url", "error")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)

    path.write_text("".join(map(line, range(3))))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    path.write_text("".join(map(line, range(5))))
    run()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [line(k).strip() for k in range(5)]
    assert len({p for _, p in asked}) == len(asked) == 5  # none is asked for twice


def test_department_codes_by_period(spark):
    from noticelake.functions import citation

    rows = spark.createDataFrame([(d, y) for d in ("BPRD", "bsd", "AC&MFD", "BPD", "none", None) for y in ("2006", "2007", "1999", None, "", "x")], "department string, year string")
    found = departments.with_code(rows, F.col("department"), F.col("year"), departments.codes(spark))
    both = found.withColumn("plain", citation.department_code(F.col("department"), F.col("year")))
    assert both.count() == 36 and both.filter(~F.col("code").eqNullSafe(F.col("plain"))).isEmpty()
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "CartesianProduct" not in found._jdf.queryExecution().toString()
