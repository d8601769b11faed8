import numpy as np

from noticelake.llm.html_extract import blocks_of, extract, main_texts, repeated_runs

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy now</div>
<article><header><h1>Head&eacute;line</h1></header><p><b>One &amp;
 two<br>three <p>Four <a href="x>y">link</a>s</p><aside>aside</aside><form><p>form</p></form><div class="share-bar">Share</div>
<section id="comments"><article class="comment"><p>Reader says</p></article></section></article><footer>&copy; foot</footer></body></html>"""


def test_blocks():
    assert [x for x, kind in blocks_of(PAGE) if kind == 2] == ["Headéline", "One & two three", "Four links"]
    assert blocks_of(None) == [] and blocks_of("") == [] and blocks_of("<p") == [("<p", 1)]
    assert blocks_of("<script>x") == [] and blocks_of("plain  text") == [("plain text", 1)]


def test_runs_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        owner = np.sort(rng.integers(0, 5, 120))
        stream = rng.integers(0, 2, 120)
        run = 5
        expected = np.zeros(120, int)
        windows = {}
        for i in range(120 - run + 1):
            if owner[i] == owner[i + run - 1]:
                windows.setdefault(tuple(stream[i : i + run]), []).append(i)
        for places in windows.values():
            for i in places:
                expected[i : i + run] = np.maximum(expected[i : i + run], len({owner[j] for j in places}))
        assert (repeated_runs(stream, owner, run) == expected).all()
    assert len(repeated_runs(np.array([], int), np.array([], int))) == 0


def test_host_boilerplate_goes_and_unique_text_stays():
    plate = "Subscribe to our weekly letter and never miss any story again today"
    pages = [[(plate, 1), (f"own text of page number {k} " + " ".join(f"w{k}x{j}" for j in range(12)), 1)] for k in range(4)]
    assert [x for x in main_texts(pages)] == [[p[1][0]] for p in pages]
    article = [("shared passage " * 30, 2), ("x", 2)]
    assert main_texts([article] * 5) == [["shared passage " * 30, "x"]] * 5  # copies of one page
    marked = [[(plate, 2), (f"text {k} " + " ".join(f"w{k}x{j}" for j in range(30)), 2)] for k in range(4)]
    assert main_texts(marked) == [[p[1][0]] for p in marked]


def test_rows(spark):
    rows = [(1, "http://a.example/x", PAGE, "c"), (1, "http://a.example/x", PAGE, "c"), (2, None, None, "c"), (3, "nonsense", "", None), (None, "https://U@B.example:80/", "<main><p>" + "x " * 50000, None)]
    found = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert len(found) == 5 and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert texts[1] == "Headéline\nOne & two three\nFour links" and texts[2] == texts[3] == "" and texts[None] == ("x " * 50000).strip()
    assert extract(spark.createDataFrame(rows[:0], "page_id bigint, url string, html string")).collect() == []


def test_host_of_many_groups_as_one(spark, monkeypatch):
    """Runs are counted over all groups of a host: what goes does not depend on how many groups there are."""
    from noticelake.llm import html_extract

    own = lambda k, mark: " ".join(f"{mark}{k}x{j}" for j in range(15))
    plate, rare, quote = own(0, "plate"), own(0, "rare"), own(0, "quote")
    rows = []
    for k in range(120):
        parts = [own(k, "w")] + [plate] * (k % 10 == 0) + [rare] * (k in (5, 50, 95)) + [quote] * (k in (7, 77))
        rows.append((k, f"http://a.example/{k}", "".join(f"<p>{x}</p>" for x in parts)))
    rows += [(k, f"http://a.example/{k}", f"<article><p>{plate}</p><p>{own(k, 'w')} {own(k, 'v')}</p></article>") for k in range(120, 140)]
    rows += [(k, f"http://a.example/{k}", f"<p>{quote}</p><p>{own(7, 'copy')}</p><script>{k}</script>") for k in range(140, 150)]  # copies of one page
    docs = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    whole = {r.page_id: r.text for r in extract(docs).collect()}
    monkeypatch.setattr(html_extract, "GROUP_BYTES", 900)
    assert {r.page_id: r.text for r in extract(docs).collect()} == whole
    assert len(whole) == 150 and all(whole[k] == own(k, "w") for k in range(120) if k not in (7, 77))
    assert all(whole[k].startswith("plate") for k in range(120, 140))  # on 32 of 141 pages: under the share of the host
    assert whole[140] == own(7, "copy") and whole[149] == whole[140]


def test_time_follows_length_whatever_is_left_open():
    import time

    began = time.perf_counter()
    for page in ("<" * 10**6, "<a " * 350_000, '<a "' * 250_000, "<a '\"" * 200_000 + ">", "<a " + "b" * 10**6 + ">", "<div>" * 50_000 + "</i>" * 50_000, "<a <a" * 200_000 + '"', "<!--" * 250_000):
        blocks_of(page)
    assert time.perf_counter() - began < 20
    assert blocks_of('<p title="a>b">x</p><p title="y') == [("x", 1), ('<p title="y', 1)]


def test_pages_without_host_share_no_runs(spark):
    plate = " ".join(f"plate{j}" for j in range(20))
    rows = [(k, url, f"<p>{plate}</p><p>own {k}</p>") for k, url in enumerate([None] * 5 + ["no host"] * 5 + ["http://h.example/"] * 5)]
    texts = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(texts[k] == f"{plate}\nown {k}" for k in range(10)) and all(texts[k] == f"own {k}" for k in range(10, 15))
