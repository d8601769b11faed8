import zlib

import pytest

from noticelake.operators import attachments
from noticelake.sources import fetch
from noticelake.sources.pdf import read_pages, value


def stream(info, data, pack=True):
    data = zlib.compress(data) if pack else data
    return b"<< %s /Length %d %s >>\nstream\n%s\nendstream" % (info, len(data), b"/Filter /FlateDecode" if pack else b"", data)


def file_of(objects, trailer=b"<< /Root 1 0 R >>"):
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, x) for k, x in objects.items())
    return b"%PDF-1.5\n" + body + b"trailer\n" + trailer + b"\nstartxref\n0\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00e9> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <00790079>] endbfrange"
PAGES = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 /Resources << /Font << /F1 8 0 R /F#32 9 0 R >> /XObject << /P 10 0 R /Q 11 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R 6 0 R] >>", 4: b"<< /Type /Pages /Kids [7 0 R 12 0 R 2 0 R] >>",
    5: stream(b"", rb"BT /F1 12 Tf 10 700 Td (Circular \(No. 1\)) Tj 0 -14 Td [(Ban) 20 (ks) -300 (shall\056)] TJ T* (caf\351) Tj"), 6: stream(b"", b"/F2 9 Tf 1 0 0 1 10 500 Tm <00010002001000110012> Tj <00200021> ' ET", pack=False),
    7: b"<< /Type /Page /Resources << /XObject << /P 10 0 R >> >> >>", 8: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 9: b"<< /Type /Font /ToUnicode 13 0 R >>",
    10: stream(b"/Type /XObject /Subtype /Image", b"12 0 obj (no object) endobj"), 11: stream(b"/Subtype /Form /Resources << /XObject << /A 10 0 R /B 14 0 R >> >>", b""),
    12: b"<< /Type /Page /Contents 15 0 R >>", 13: stream(b"", CMAP), 14: stream(b"/Subtype /Image", b"x", pack=False), 15: stream(b"/Filter [/ASCIIHexDecode]", b"42 54 20 28 68 69 29 20 54 6A 20 45 54>", pack=False),
}


def test_pages():
    expected = [("Circular (No. 1)\nBanks shall.\ncafé\nAéabc\nxyy", 2, []), ("", 1, []), ("hi", 2, [])]
    assert read_pages(file_of(PAGES)) == expected
    # objects in object streams, which later files keep all but streams in
    loose = {k: v for k, v in PAGES.items() if b"stream" in v}
    packed = [(k, v) for k, v in PAGES.items() if k not in loose]
    places, inner = b"", b""
    for k, v in packed:
        places += b"%d %d " % (k, len(inner))
        inner += v + b" "
    objects = {**loose, 20: stream(b"/Type /ObjStm /N %d /First %d" % (len(packed), len(places)), places + inner), 21: stream(b"/Type /XRef /Root 1 0 R", b"")}
    assert read_pages(file_of(objects, b"<< >>")) == expected


@pytest.mark.parametrize("data, error", [
    (b"<html>", "no PDF file"), (b"%PDF-1.4 nothing", "no catalogue"), (file_of({1: b"<< /Type /Catalog >>"}), "no pages"), (file_of(PAGES, b"<< /Encrypt 5 0 R >>"), "encrypted"),
    (file_of({**PAGES, 5: stream(b"/Filter /LZWDecode", b"x", pack=False)}), "filter LZWDecode"), (file_of({**PAGES, 5: b"<< /Filter /FlateDecode >> stream\nbroken\nendstream"}), "decompressing"),
])
def test_unreadable(data, error):
    with pytest.raises((ValueError, zlib.error), match=error):
        read_pages(data)


def test_values():
    assert value(b"<< /A [1 -2.5 (a\\\n(b)\\)) <4a4>] /B 3 0 R % note\n /C true /D null >>", 0)[0].keys() == {"A", "B", "C", "D"}
    assert value(b"[(a\\n\\101) <4a4>]", 0)[0] == [b"a\nA", b"J@"]
    deep = value(b"[" * 20_000 + b"]" * 20_000, 0)[0]
    assert isinstance(deep, list)
    with pytest.raises(ValueError):
        value(b"<< /A (b", 0)


def test_files_to_outcomes(spark):
    """Bytes to pages, and on to what is said of a file."""
    long = {**PAGES, 5: stream(b"", b"BT (" + b"Plain words of a notice. " * 8 + b") Tj ET")}
    files = spark.createDataFrame([("short", file_of(PAGES)), ("long", file_of(long)), ("bad", b"%PDF"), ("none", None)], "url string, content binary")
    pages = fetch.pdf_pages(files, read_pages).cache()
    assert {(r.url, r.page_number, r.images) for r in pages.filter("error is null").collect()} == {(u, k, n) for u in ("short", "long") for k, n in ((1, 2), (2, 1), (3, 2))}
    assert {r.url: r.error for r in pages.filter("error is not null").collect()} == {"bad": "ValueError: no catalogue", "none": "ValueError: no content"}
    said = {r.doc_id: r for r in attachments.gate(pages.filter("error is null").selectExpr("url as doc_id", "page_number", "text", "images")).collect()}
    assert said["long"].text_extractable and said["long"].notification is None and said["long"].image_count == 5
    assert not said["short"].text_extractable and said["short"].notification is not None
    fetched = files.selectExpr("url", "content is not null as fetched")
    found = {r.url: (r.status, r.error is None, r.pages) for r in attachments.outcomes(fetched, pages).collect()}
    assert found == {"short": ("notification", True, 3), "long": ("content", True, 3), "bad": ("notification", True, 0), "none": ("error", False, None)}
