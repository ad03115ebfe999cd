"""Page operators: URL filters, WARC archives, main text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from descant.llm import html, registry, urls, warc

RULES = registry.URL_RULES


def url_by_brute_force(url):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("#")[0].split("?")[0]
    best = None
    for rule, verdict in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_urls_equal_brute_force(spark):
    cases = [None, "", "nothing", "http://", "http://a.COM/en/7", "https://example.com/en/71?x", "https://m.example.com/en/8#t", "http://com/en/", "http://xcom/en/1", "http://net/de/", "http://a.example.net/de/8x", "http://a.example.net/de/9", "ftp://Ä.Org/es/ü?://", "x://u@b.org:80/es/", "http://org?/es/", "a://b://c/en/", "http://a.com/x\x00b.org/es/1", "http://com/en/\x001", "http://m.com/en/\n://net/de/", "a b://c.com/en/ /x", "http://a.b.c.d.e.f.com/en/x/y", "http://.com/en/", "http://com./en/", "HTTP://EXAMPLE.COM/EN/7"]
    cases += ["http://hot.example.com/en/1"] * 50
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(cases)] + [(3, cases[3])], "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit("r"), "short": F.lit("s")})
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(RULES, "rule string, verdict string")).withColumn("rule", F.coalesce("rule", F.lit("-"))).collect())
    want = sorted((k, *(x if x is not None else "-" for x in url_by_brute_force(u))) for k, u in [*enumerate(cases), (3, cases[3])])
    assert got == want
    rules = spark.createDataFrame([*RULES, ("com/en/", "allow"), (None, "block")], "rule string, verdict string")
    assert urls.judge(pages, rules).where("rule = 'com/en/' and verdict <> 'block'").count() == 0
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record": F.lit(1), "digest": F.lit("d"), "text": F.lit("t")}).repartition(3)


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    bodies = ["", None, "short", "short", "WARC/1.1\r\n\r\n" * 30, "é€😀" * 9000, "x" * 16_384, "x" * 100, "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é€😀" * 9000, "\r\n\r\n" * 5000, "0\r\n\r\n" * 20]
    rows = [(100 - k, f"http://e.com/{k}\r\n", b) for k, b in enumerate(bodies)]
    got = {r.page: r for r in warc.round_trip(pages_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, b in sorted(rows):
        first.setdefault(b or "", i)
    for i, _, b in rows:
        data = (b or "").encode()
        r = got[str(i)]
        again = len(data) >= 100 and first[b] != i
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.problem) == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", str(first[b]) if again else None, None)


def test_warc_edges(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0
    twice = [(1, "u", "y" * 40_000)] * 2 + [(2, "u", "z" * 200)] * 2 + [(None, "u", "z" * 200)]
    got = sorted((r.page, r.record_type, r.payload_bytes) for r in warc.round_trip(pages_of(spark, twice)).collect())
    assert got == [("", "revisit", 200)] + [("1", "response", 40_000)] * 2 + [("2", "response", 200)] * 2
    same = [(1, "u", "a" * 40_000), (1, "u", "b" * 50_000), (None, "u", "c" * 60_000), (None, "u", "d" * 20_000), (None, "u", "d" * 20_000), (3, "u", "s")]
    got = sorted((r.page, r.record_type, r.payload_bytes, r.problem) for r in warc.round_trip(pages_of(spark, same)).collect())
    assert got == sorted((str(i or ""), "response", len(t), None) for i, _, t in same)
    text = spark.createDataFrame([("a:b>\n1", "u", "y" * 200), ("a:c", "u", "y" * 200)], "page_id string, url string, html string")
    got = sorted((r.page, r.record_type, r.refers_to) for r in warc.round_trip(text).collect())
    assert got == [("a:b>\n1", "response", None), ("a:c", "revisit", "a:b>\n1")]


def test_warc_reader_reports_broken_segments():
    parts = [{"segment": 1, "total_length": None, "block": b"HTTP/1.1 200 OK\r\n\r\nab"}, {"segment": 3, "total_length": 30, "block": b"cd"}]
    import pyarrow as pa

    row = {"page": "1", "uri": "u", "record_type": "response", "refers_to": None, "digest": None, "parts": parts}
    kind = pa.list_(pa.struct([("segment", pa.int32()), ("total_length", pa.int64()), ("block", pa.binary())]))
    batch = lambda r: pa.RecordBatch.from_pylist([r], pa.schema([("page", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("parts", kind)]))
    problem = lambda r: next(warc._decode(iter([batch(r)]))).to_pylist()[0]["problem"]
    assert problem(row) == "a segment is missing"
    parts[1]["segment"] = 2
    assert problem(row) == "wrong total length"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"x" * 10_000, 7)) == b"x" * 10_000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<div class="ad">Buy</div><article class="post"><header><h1>Head &amp; line</h1></header><p>One  &lt;b&gt; <b>two<br>three<p>Four&nbsp;five</p><aside>no</aside><form>no<input>no</form><section id="comments"><article>no</article></section>
<div class="cookie-notice">no</div><ul><li>a</li><li>b</li></ul><!-- no <p>no</p> --></article><footer>no</footer>"""


def test_main_text_of_an_article(spark):
    rows = [(1, "http://a.com/", PAGE), (2, None, None), (3, "x", ""), (4, "http://a.com/", "<main><p>Only</main><p>no"), (5, "u", "plain words"), (1, "http://a.com/", PAGE)]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(pages_of(spark, rows)).select("page_id", "text", "n_chars").collect())
    text = "Head & line\n\nOne <b> two three\n\nFour five\n\na\n\nb"
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0), (4, "Only", 4), (5, "plain words", 11)]
    assert html.extract(pages_of(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>Text of it.</div>', "Text of it."),
        ('<div id="page" class="no-sidebar"><main><p>Text of it.', "Text of it."),
        ('<div class="menu-open sidebar"><article><p>Text of it.</article></div>', "Text of it."),
        ('<article class="post social"><p class="share">Share<p>Real text.</article>', "Real text."),
        ('<article><div class="post-header"><h1>Title</h1></div><figure><img><figcaption>Caption.</figcaption></figure><p>A <math>x</math> b.', "Title\n\nCaption.\n\nA x b."),
        ('<main><p>The main text is long here.</p><p>Still more of it.</p><article class="teaser">Next.</article></main>', "The main text is long here.\n\nStill more of it.\n\nNext."),
        ('<div class="related"><article>Other things.</article></div><article>Own things.</article>', "Own things."),
        ('<article><p>One <span class="ad">buy</span>two.<table><tr><td>a.<td>b.<tr><td>c.</table></article>', "One two.\n\na.\n\nb.\n\nc."),
        ('<body class="menu"><div class="widget">Only this is here.</div>', "Only this is here."),
        ("<article><p>One.<div class=comments><article><p>No.</article></div><footer>No.</footer><p>Two.", "One.\n\nTwo."),
    ],
)
def test_structure_of_pages(page, text):
    assert "\n\n".join(t for t, kind, _ in html.blocks(page) if kind != html.MARKED) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>x</title><body><article><p>Text of it.</article>", "Text of it."),
        ("<html><head><title>x</title><meta charset=utf-8><article><p>Text of it.</article>", "Text of it."),
        ("<head><title>x</title>Words at once.<p>And more.", "Words at once.\n\nAnd more."),
        ('<article><div style="overflow: hidden"><p>Some prose.</p></div>', "Some prose."),
        ('<article><p title="the hidden gem">Some prose.</p><p hidden>No.</p><p hidden="hidden">No.<p data-hidden aria-hidden="true">Yes.', "Some prose.\n\nYes."),
        ('<article><p>See <a title="hidden valley" href=/x>linked words</a> here.', "See linked words here."),
        ('<article><section id="social-history"><h2>Social history</h2><p>Long ago.</section><section id="search-algorithms"><p>They search.</section><div class="story-search">Found it.</div>', "Social history\n\nLong ago.\n\nThey search.\n\nFound it."),
        ('<article><p>One.<menu><li>Do this thing now.</menu><p>Two.', "One.\n\nDo this thing now.\n\nTwo."),
        ('<article><p>One.<div class="ad-slot-3">No.</div><div id="comment-list">No.</div><div class="related-posts">No.</div><p>Two.', "One.\n\nTwo."),
        ('<article><p class=a"b>One.<p title="a > b" class=\'x\'>2 < 3 and <3.<br/>a<b>b</b></article', "One.\n\n2 < 3 and <3. ab"),
        ('<article><div <p>One.</div><img src="x>y"/>Two.<!-- no <p> --><!doctype x><?no?>Three.<!-->Four.', "One.\n\nTwo.Three.Four."),
    ],
)
def test_text_that_only_looks_marked_stays(page, text):
    assert "\n\n".join(t for t, kind, _ in html.blocks(page) if kind != html.MARKED) == text


@pytest.mark.parametrize("piece", ['<a "x ', "<span>a", "<div>", "<a x='", "<p><span>", "</b>", "<!x ", "<td><b>", "<a <", '<p class="', "&amp", "<li>x<i>"])
def test_time_grows_with_the_length_of_malformed_pages(piece):
    import time

    def took(n):
        page = "<article>" + piece * (n // len(piece))
        began = time.process_time()
        html.blocks(page)
        return time.process_time() - began

    small, large = took(500_000), took(4_000_000)
    assert large < 20 and large < 30 * max(small, 0.05)


def test_weak_names_go_where_other_pages_of_the_host_have_them(spark):
    """A name that says more than its mark is decided by the array: over element and name, wherever they stand."""
    body = lambda k: f'<article><h1>The title {k}</h1><p>Text number {k} is here.</p><div class="social-feed">Feed {k} of friend{k}.</div><section id="social-history{k}"><p>A history {k}.</p></section></article>'
    rows = [(k, "http://h.com/x", body(k)) for k in range(4)] + [(9, "http://i.com", body(9))] + [(10 + k, "http://copies.com", body(10)) for k in range(4)]
    got = {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}
    assert all(got[k] == f"The title {k}\n\nText number {k} is here.\n\nA history {k}." for k in range(4))
    assert "Feed 9" in got[9] and all("Feed 10" in got[10 + k] for k in range(4))


def test_short_repeated_labels_inside_articles_go_and_prose_stays(spark):
    passage = "A passage that all of these articles share with each other."
    body = lambda k: f"<article><h1>A title that all the pages here have</h1><p>Text number {k} is about topic{k}.</p><p>{passage}</p><p>Print this page for your friends</p></article>"
    got = {r.page_id: r.text for r in html.extract(pages_of(spark, [(k, "http://h.com/x", body(k)) for k in range(4)] + [(9, "http://i.com", body(9))])).collect()}
    assert all(got[k] == f"A title that all the pages here have\n\nText number {k} is about topic{k}.\n\n{passage}" for k in range(4))
    assert got[9].endswith("friends")  # one page of its host


def test_repeated_runs_are_boilerplate_where_structure_is_silent(spark):
    body = lambda k: f"<body><div>Home About Contact Us Now Please Today</div><p>Text number {k} is about topic{k} and thing{k} only here</p><p>All rights reserved by the owner of site</p></body>"
    rows = [(k, "http://h.com/x", body(k)) for k in range(5)] + [(9, "http://other.com/", body(9))] + [(20 + k, "http://copies.com/", body(20)) for k in range(5)]
    got = {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}
    assert all(got[k] == f"Text number {k} is about topic{k} and thing{k} only here" for k in range(5))
    assert "Home About" in got[9] and all("Home About" in got[20 + k] for k in range(5))  # one distinct page proves nothing


def test_boilerplate_of_a_few_pages_goes_whatever_the_shards(spark, monkeypatch):
    body = lambda k: "<body>" + ("<div>Only some pages have this menu</div>" if k % 10 == 0 else "") + f"<p>Text number {k} is about topic{k} and thing{k} only here</p></body>"
    rows = [(k, "http://h.com/x", body(k)) for k in range(40)] + [(100 + k, "http://h.com/y", "<body><div>A menu that copies of one page have</div></body>") for k in range(4)]
    whole = {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}
    monkeypatch.setattr(html, "SHARD", 5)
    assert {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()} == whole
    assert whole[0] == "Text number 0 is about topic0 and thing0 only here" and whole[100].startswith("A menu")


def test_suffix_runs_equal_brute_force():
    import random

    rng = random.Random(3)
    streams = [[rng.choice("abcdefg") for _ in range(60)] for _ in range(6)] + [["a"] * 3, []]
    streams.append(list(streams[0]))
    got = html.repeated(streams, 4, 3)
    pages = {}
    for k, s in enumerate(dict.fromkeys(map(tuple, streams))):
        for i in range(len(s) - 3):
            pages.setdefault(s[i : i + 4], set()).add(k)
    for s, g in zip(streams, got, strict=True):
        want = [any(0 <= b <= len(s) - 4 and len(pages[tuple(s[b : b + 4])]) >= 3 for b in range(i - 3, i + 1)) for i in range(len(s))]
        assert list(g) == want
