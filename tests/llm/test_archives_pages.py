"""Archives as exact round trips, pages against the known article."""

import io
import random
import base64
import gzip
import hashlib
import html
import json
import re
import time
from urllib.parse import urlparse

from pyspark.sql import functions as F

from tests.conftest import DATA
from verdictlake.llm import html_text, warc


def pages(spark):
    odd = [(10001, None, None), (10002, "u", "same é"), (10003, "u\n v", "same é"), (None, "u", "same é"), (10005, None, ""), (10005, None, "")]
    return spark.read.parquet(f"{DATA}/pages.parquet").unionByName(spark.createDataFrame(odd, "page_id LONG, url STRING, html STRING")).withColumn("file", F.lit(1))


def test_warc_rows(spark):
    df = pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
    last, used, want = {}, set(), []
    for i, payload in rows:
        last[payload] = max(last.get(payload, -1), -1 if i is None else i)
    for i, payload in rows:
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if i == last[payload] and payload not in used:
            used.add(payload)
            want.append((i, len(payload), sha, "response", None))
        else:
            want.append((i, len(payload), sha, "revisit", last[payload]))
    assert sorted(map(tuple, warc.op3(df).collect()), key=str) == sorted(want, key=str)
    assert warc.op3(df.limit(0)).collect() == []


def test_every_record_is_a_member(spark):
    for (uri,) in warc.archive(pages(spark).repartition(3)).collect():
        path = urlparse(uri).path
        data = open(path, "rb").read()
        at = 0
        for line in open(path + ".idx"):
            entry = json.loads(line)
            assert entry["offset"] == at
            member = gzip.decompress(data[at : at + entry["length"]])
            assert member.startswith(b"WARC/1.1\r\nWARC-Type: " + entry["type"].encode()) and member.endswith(b"\r\n\r\n")
            at += entry["length"]
        assert at == len(data)


def test_small_payloads_stay_responses(spark):
    got = warc.read(warc.archive(pages(spark), min_bytes=100)).where("record_type = 'revisit'").collect()
    assert got == []


def test_articles(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.op5(df).collect()}
    assert len(got) == df.count()
    for r in df.collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?p>|</?h1>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_markup():
    page = """<body class="has-sidebar"><header><h1>Site</h1></header><div id=cookie-notice>We use</div><main><article class=post><header><h1>T&amp;T &nbsp; x</h1></header><p>One<br>two <a href="x>y">link</a>, <b>b</b>c<p>Three<ul><li>a<li>b</ul><form><input value=x>f</form><div class="share-buttons">Share</div><aside>x</aside><pre> k  v </pre><section id="comments"><article class="comment"><p>nice</article></section></article></main><footer>f</footer><script>if(a<b){"</p>"}</script>tail"""
    assert html_text.Page(page).text() == "T&T x\n\nOne two link, bc\n\nThree\n\na\n\nb\n\nk v"
    cases = {"": "", "plain & simple &lt;b&gt;": "plain & simple <b>", "<div>a</div>b<div>c": "a\n\nb\n\nc", "<p>x</b></i>y</p></div>z": "xy\n\nz", "<!-- open": "", "<article></article><p>q": "q", "a < b > c <3": "a < b > c <3", "<p hidden>x</p>y": "y"}
    assert {k: html_text.Page(k).text() for k in cases} == cases


def test_template_by_host(spark):
    rows = [(i, f"http://one.example/{i}", f"<div><div>Same box</div><p>Text {i} of its own</p></div>") for i in range(12)]
    rows += [(100 + i, f"http://two.example/{i}", f"<div><div>Same box</div><p>Text {i}</p></div>") for i in range(2)]
    rows += [(200, None, None), (None, "http://one.example/x", "<article><div>Same box</div><p>Same</p></article>")] + [(300 + i, "http://three.example/", "<div>mirror</div>") for i in range(15)]
    got = {r.page_id: r.text for r in html_text.op5(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert all(got[i] == f"Text {i} of its own" for i in range(12))
    assert got[100] == "Same box\n\nText 0" and got[200] == "" and got[None] == "Same"
    assert got[300] == "mirror"  # the same page again and again is one page
    assert html_text.op5(spark.createDataFrame([], "page_id LONG, url STRING, html STRING")).collect() == []


def test_template_does_not_depend_on_host_size(spark):
    box = lambda i: "<div>Same box</div>" if i % 100 == 0 else ""
    rows = [(i, f"http://big.example/{i}", f"<div>{box(i)}<p>Text {i} of its own</p></div>") for i in range(1, 2001)]
    rows += [(2000 + i, f"http://big.example/{i}", f"<div><div>Rare box</div><p>Rare {i}</p></div>") for i in range(1, 3)]
    got = {r.page_id: r.text for r in html_text.op5(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"Text {i} of its own" for i in range(1, 2001))
    assert all(got[2000 + i] == f"Rare box\n\nRare {i}" for i in range(1, 3))  # two pages are not many


def test_small_hosts_without_marks_get_their_template_removed(spark):
    """Pages of plain divs: without removal the boxes would stay in the text."""
    page = lambda h, i: f"<div><div><div>Host {h}</div><div>Read on</div></div><div>Text {i} of {h}<p>More of {i}</p></div><div>By {h}</div></div>"
    rows = [(10 * h + i, f"http://h{h}.example/{i}", page(h, i)) for h in range(20) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    off = {r.page_id: r.text for r in html_text.extract(df, min_pages=1 << 40).collect()}
    for h in range(20):
        for i in range(4):
            assert got[10 * h + i] == f"Text {i} of {h}\n\nMore of {i}"
            assert off[10 * h + i] == f"Host {h}\n\nRead on\n\nText {i} of {h}\n\nMore of {i}\n\nBy {h}"


def test_template_below_a_hundredth_of_the_host(spark):
    rows = [(i, f"http://big.example/{i}", f"<div>{'<div>Same box</div>' if i < 12 else ''}<p>Text {i} of its own</p></div>") for i in range(1500)]
    got = {r.page_id: r.text for r in html_text.op5(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).collect()}
    assert all(got[i] == f"Text {i} of its own" for i in range(1500))


def test_inflating_is_bounded():
    rng = random.Random(1)
    for parts in ([b"x" * 50_000_000], [bytes(rng.randrange(256) for _ in range(100_000)), b"", b"ab" * 3_000_000, b"end"], [b"a" * warc.READ], [b""]):
        data = b"".join(gzip.compress(p) for p in parts)
        chunks = list(warc.inflated(io.BytesIO(data)))
        assert b"".join(chunks) == b"".join(parts) and max(map(len, chunks)) <= warc.READ


def test_broken_markup_takes_linear_time():
    for text in ("<a", "<!", "<a b=\"", "<a 'x", "<![CDATA[", "</", "<?", "<!--", "<a<", "< ", "<b>", "<p>", "<i></b>", "<i><div><b></i>", "<![CDATA[>", "<title>", "&lt", "<a " + "x=' "):
        for tail in ("", ">", "x\">y'>"):
            page = text * (1_000_000 // len(text)) + tail
            began = time.time()
            html_text.Page(page).text()
            assert time.time() - began < 20, text
    began = time.time()
    nested = html_text.Page("<i><div>" + "<b>" * 150_000 + "</i>" * 150_000 + "z").text()
    assert nested == "z" and time.time() - began < 10
    assert html_text.Page("<" + "a" * 1_000_000).text() == "<" + "a" * 1_000_000


def test_a_teaser_beside_the_text_does_not_hide_it():
    body = "Long text " * 40
    assert html_text.Page(f"<div><p>{body}</p></div><article><p>Teaser</p></article>").text() == f"{body.strip()}\n\nTeaser"
    assert html_text.Page(f"<div><p>By line</p></div><article><p>{body}</p></article>").text() == body.strip()


def test_recurrence_is_counted_before_marks(spark):
    page = lambda i: f"<nav>Menu</nav><div><div>Site box</div><p>Text {i}</p><div class=ad>Ad {i}</div></div>"
    df = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(5)], "page_id LONG, url STRING, html STRING")
    assert {(r.text, r.recurring, r.marked) for r in html_text.op5(df).collect()} == {(f"Text {i}", 2, 1) for i in range(5)}
