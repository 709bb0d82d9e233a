import hashlib

import pytest

from riskflow.llm import html_extract, warc

SCHEMA = "page_id bigint, url string, html string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy   now</div>
<article><h1>A &amp; B</h1><p>First   line<br>goes on.<p>Second <b>bold</b>&nbsp;end.</p><div class="share">Share</div>
<p>Ti.</p><!-- <p>hidden</p> --></article><aside>Side</aside><form><input><label>Mail</label></form>
<section id="comments"><article><p>Nice!</p></article></section><footer>&copy; 2020</footer></body></html>"""


def test_article_without_its_surroundings():
    assert html_extract.extract_text(PAGE) == "A & B\n\nFirst line goes on.\n\nSecond bold end.\n\nTi."


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<nav>x", ""), ("<p>One<p>Two", "One\n\nTwo"), ("plain <b>text", "plain text"),
    ("<article><p>A</p><p>B &am", "A\n\nB &am"), ("<article><p>A</p></article><footer cla", "A"),
    ("<form><div><h1>T</h1><p>Wrapped page.</p></div></form>", "T\n\nWrapped page."),
    ("<body><div id='header'>Name</div><p>Story here.</p></body>", "Story here."),
    ("<article><p>1 &lt; 2 &#8364;</p><pre>a\n  b</pre></article>", "1 < 2 €\n\na b"),
    ("<nav><li>x</li><article><p>Left open menu</p></article>", "Left open menu"),
    ("<p>" + "x" * 50 + "</p>" + "<b>" * 5000 + "deep", "x" * 50 + "\n\ndeep"),
])
def test_cases(page, want):
    assert html_extract.extract_text(page) == want


def test_regions_without_a_marked_article():
    story = "<p>" + "A long sentence of the story goes here. " * 8 + "</p>"
    page = (f"<body><div><div><a href=1>Home</a></div></div></div><div><div><div>{story}<p>Short.</p>{story}</div></div>"
            "</div><div><div><div>Copyright 2020</div></div></div></body>")
    text = html_extract.extract_text(page)
    assert text.startswith("A long") and "Short." in text and "Copyright" not in text and "Home" not in text


@pytest.mark.parametrize("name", ["site has-sidebar", "menu-open", "page has-comments", "widget"])
def test_a_name_does_not_silence_the_story(name):
    story = "".join(f"<p>{f'Sentence {k} of the story goes on and on. ' * 4}</p>" for k in range(5))
    page = f'<body><div class="{name}"><h1>Title</h1>{story}<div class="menu"><p>Home of the menu</p></div></div></body>'
    got = html_extract.extract_text(page)
    assert got.startswith("Title") and got.count("of the story") == 20 and "menu" not in got


def test_a_small_marked_part_does_not_hide_the_story():
    story = "".join(f"<p>{f'Sentence {k} of the story goes on and on. ' * 4}</p>" for k in range(5))
    page = f"<body><main><p>A short teaser.</p></main><nav>Menu</nav><div><div>{story}</div></div></body>"
    got = html_extract.extract_text(page)
    assert "teaser" in got and got.count("of the story") == 20


def _frame(spark):
    big = "<p>" + "long page " * 60_000 + "</p>"
    rows = [(1, "http://a", PAGE), (2, "http://b", PAGE), (3, None, None), (4, "u", ""), (5, "u", "<p>tiny</p>"),
            (6, "u", "<p>tiny</p>"), (7, "http://long", big), (8, "é\r\nX: y", "<p>ü" + "y" * 120), (None, "n", PAGE),
            (9, "r", "z" * 100), (9, "r", "z" * 100), (10, "r", "z" * 100)]
    return rows, spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA + ", payload string, digest string")


def test_extract_pages(spark):
    rows, df = _frame(spark)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()), key=repr)
    want = [(i, u, html_extract.extract_text(h)) for i, u, h in rows]
    assert got == sorted(((*w, len(w[2])) for w in want), key=repr)
    assert html_extract.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archive_round_trip(spark):
    rows, df = _frame(spark)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                  for r in warc.roundtrip(df).collect()), key=repr)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if (x or "").encode() == data and j is not None]
        first = min(same, default=None)
        revisit = len(data) >= 100 and i != first
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                     first if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.roundtrip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_random_access_and_export(spark, tmp_path):
    import io

    import zstandard
    _, df = _frame(spark)
    bundles = warc.write_bundles(warc.archive_records(df.where("page_id is not null")), frame_bytes=4096,
                                 bundle_bytes=64 * 1024)
    data = {r.bundle: bytes(r.data) for r in bundles.collect()}
    index = warc.bundle_index(bundles).collect()
    assert len(index) == 11
    for r in index:
        record = warc.read_record(data[r.bundle], r.frame, r.offset, r.length)
        assert f"WARC-Record-ID: <{r.record_id}>".encode() in record
    payloads = {r.page_id: r.payload for r in warc.read_bundles(bundles).collect() if r.record_type == "response"}
    assert bytes(payloads["1"]).decode() == PAGE and "2" not in payloads
    files = warc.export_bundles(bundles, str(tmp_path)).collect()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(files[0].path, "rb").read()),
                                                       read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1") and len(list(warc.parse_records(whole))) >= 1
    with pytest.raises(ValueError):
        warc.frame_table(b"no bundle here, only some bytes")
