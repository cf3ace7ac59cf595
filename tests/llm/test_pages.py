"""Operators on pages."""

from __future__ import annotations

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import html_text, urlfilter, warc

SCHEMA = "page_id long, url string, html string, name string, w string"


@pytest.fixture(scope="session")
def odd_pages(spark):
    rows = [
        (1, "http://www.Example.ORG/es/1?x#y", "<p>Hi</p>", "n", "w"),
        (2, "https://example.org/en/1", "<p>Hi</p>", None, None),
        (3, "https://a.example.com", None, None, None),
        (4, None, "", None, None),
        (5, "no scheme", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1", None, None),
        (6, "http://x.com/fr/\r\nevil: header", "é" * 100000, None, None),
        (None, "http://x.com/de/1", "unique", None, None),
        (8, "http://com/fr/a", "<p>twice</p>", None, None),
        (8, "http://com/fr/a", "<p>twice</p>", None, None),
        (9, "http://evilcom/fr/a", "<p>nine</p>", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_warc_round_trip(spark, odd_pages):
    got = warc.round_trip(odd_pages).collect()
    assert len(got) == 10
    html = {r["page_id"]: (r["html"] or "").encode() for r in odd_pages.collect()}
    for r in got:
        body = html[r["page_id"]]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        same = max(i for i, b in html.items() if b == body and i is not None) if r["page_id"] is not None else None
        if r["page_id"] is not None and r["page_id"] != same:
            assert (r["record_type"], r["refers_to"]) == ("revisit", same)
        else:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
    assert warc.round_trip(odd_pages.limit(0)).count() == 0


def test_warc_keeps_payloads_and_smaller_ones_apart(spark, tmp_path, odd_pages):
    path = f"file://{tmp_path}/w"
    warc.write(odd_pages, path, least_bytes=10, per_file=2)
    c = warc.assemble(warc.read_records(spark, path))
    rows = c.select("capture.type", "capture.payload", "request.record_id", "metadata.fields").collect()
    assert len(rows) == 10 and all(r["record_id"] and r["fields"] for r in rows)
    # <p>Hi</p> has nine bytes: both are responses
    assert sorted(bytes(r["payload"]) for r in rows if r["payload"] is not None).count(b"<p>Hi</p>") == 2


def test_warc_files_are_bounded_in_bytes(spark, tmp_path):
    rng = random.Random(2)
    sizes = [rng.choice([0, 10, 900, 5000, 40_000, 300_000]) for _ in range(300)]
    pages = spark.createDataFrame([(i, f"http://x.com/{i}", f"{i}" + "x" * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(2)
    path = tmp_path / "w"
    warc.write(pages, f"file://{path}", per_file=50, file_bytes=100_000)
    files = [f.stat().st_size for f in path.iterdir() if f.name.startswith("part")]
    assert max(n for n in files if n < 300_000) < 100_000 + 50 * 2500 and sum(n >= 300_000 for n in files) == sum(n == 300_000 for n in sizes)
    c = warc.assemble(warc.read_records(spark, f"file://{path}"))
    assert sorted(len(bytes(r["payload"])) for r in c.select("capture.payload").collect()) == sorted(len(str(i)) + n for i, n in enumerate(sizes))


def test_odd_urls_read_back(spark):
    urls = ["http://x.com/\r\nevil: yes", "http://x.com/a%0Ab", "tab\there", "", None, "http://\u00e9.com/\x7f"]
    got = warc.round_trip(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit("same"))).collect()
    assert {r["page_id"]: r["uri"] for r in got} == {i: u or "" for i, u in enumerate(urls)}
    assert warc._clean(F.lit("a\r\nb\x7f")) is not None and spark.range(1).select(warc._clean(F.lit("a\r\nb\x7f"))).first()[0] == "a%0D%0Ab%7F"


def test_units_of_hosts(spark):
    want = {
        "a.b.co.uk": ("a.b.co.uk", "b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk", "co.uk"), "x.example.com:8080": ("x.example.com", "example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "10.0.0.1", "[address]"),
        "[::1]:80": ("[::1]", "[::1]", "[address]"), "me@www.b.de": ("www.b.de", "b.de", "de"), "www.b.com.": ("www.b.com", "b.com", "com"), "localhost": ("localhost", "localhost", "localhost"), "": ("", "", ""), "shop.com.au": ("shop.com.au", "shop.com.au", "com.au"), "www.co.com": ("www.co.com", "co.com", "com"),
    }
    d = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r["h"]: tuple(r)[1:] for r in d.select("h", *urlfilter.units_of(F.col("h"))).collect()} == want


def test_many_rules_are_one_table(spark, odd_pages, monkeypatch):
    rng = random.Random(5)
    rules = [*urlfilter.RULES, *[(rng.choice(["allow", "block"]), rng.choice(["com", "a.com", "b.a.com", "org"]), "/" + "".join(rng.choice("xy") for _ in range(n % 6))) for n in range(40)]]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = [f"http://{rng.choice(['a.com', 'b.a.com', 'c.b.a.com', 'x.org', 'a.net'])}/{''.join(rng.choice('xy') for _ in range(rng.randint(0, 7)))}" for _ in range(200)]
    pages = odd_pages.select("page_id", "url").union(spark.createDataFrame(list(enumerate(urls, 100)), "page_id long, url string"))
    rows = lambda: sorted(map(repr, urlfilter.apply(pages, rules).collect()))
    as_expression = rows()
    monkeypatch.setattr(urlfilter, "MAX_RULES", 3)
    assert rows() == as_expression


def test_the_bound_blocks_pages_without_a_rule(spark):
    urls = [f"http://bad.com/de/{i}" for i in range(60)] + ["http://bad.com/other", "http://bad.com:81/other"] + [f"http://good.com/fr/{i}" for i in range(60)] + ["http://good.com/other"]
    got = {r["page_id"]: r for r in urlfilter.apply(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i]["rule"], got[i]["verdict"]) for i in (60, 61, 122)] == [(None, "block"), (None, "block"), (None, "allow")]


def test_url_rules(spark, odd_pages):
    got = {r["page_id"]: r for r in urlfilter.apply(odd_pages).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.org/en/1", "block")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("a.example.com", "", None)
    assert (got[4]["host"], got[5]["host"]) == ("", "")
    assert got[8]["rule"] == "com/fr/" and got[9]["rule"] is None and got[None]["verdict"] == "block"
    assert urlfilter.apply(odd_pages.limit(0)).count() == 0


def test_reputation_shrinks_from_host_to_suffix(spark):
    rows = [("bad.x.net", 1)] * 50 + [("ok.x.net", 0)] * 50 + [("new.x.net", None)] + [("few.y.net", 1)] + [("z.other.io", None)] + [("clean.w.org", 0)] * 80
    got = {r["host"]: r for r in urlfilter.reputation(spark.createDataFrame(rows, "host string, blocked int")).collect()}
    assert got["bad.x.net"]["block_bound"] > 0.5 > got["ok.x.net"]["block_mean"]
    assert got["ok.x.net"]["block_mean"] < got["new.x.net"]["block_mean"] < got["bad.x.net"]["block_mean"]
    assert got["few.y.net"]["block_bound"] < 0.5 and got["few.y.net"]["block_mean"] > got["clean.w.org"]["block_mean"]


@pytest.fixture(scope="session")
def model():
    return html_text.train()


def test_main_text_on_generated_pages(model):
    rng = random.Random(99)
    pages, gold = zip(*[html_text.compose(rng) for _ in range(150)], strict=True)
    got = html_text.extract(list(pages), model)
    assert sum(a == b for a, b in zip(got, gold, strict=True)) >= 120


BODY = "<h1>A title of it</h1><p>" + "This is a long paragraph of an article with many words in it, and more of them. " * 4 + "</p><p>" + "A second paragraph is here and says some more about all that. " * 3 + "</p>"
LINES = ["A title of it", ("This is a long paragraph of an article with many words in it, and more of them. " * 4).strip(), ("A second paragraph is here and says some more about all that. " * 3).strip()]
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li><li><a href="/c">About</a></li></ul></nav>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><form action=x>{MENU}<article>{BODY}</article></form></body></html>",
        f"<html><head><title>t</title>{MENU}<article>{BODY}</article><footer>&copy; somebody of 2020</footer>",
        f"<body><div id='page'>{MENU}<main>{BODY}</main><form class='login'><label>Name</label><input><button>Go</button></form></div></body>",
        f"<body><article><svg/>{BODY}</article></body>",
        f"<body><article><svg><path d='x'/><text>no prose</text></svg>{BODY}<script>if (a < b) c('</p>')</script></article></body>",
        f"<body>{MENU}<article>{BODY.replace('<p>', '<p data-x=it' + chr(39) + 's>')}</article></body>",
        f"<body>{MENU}<article>{BODY.replace('<p>', '<p title=' + chr(39) + 'a > b' + chr(39) + '>')}</article></body>",
        f"<body><article>{BODY.replace('</p>', '')}</article></body>",
        f"<body><article>{BODY.replace('<p>', '<p><b>')}</article></body>",
        f"<body><!-- <p>not this</p> --><article>{BODY}<!--></article>",
    ],
)
def test_articles_in_odd_pages(model, page):
    assert html_text.extract([page], model)[0].split("\n") == LINES


def test_no_tag_swallows_text(model):
    text = html_text.extract(["<article><img alt='It's'>Main text that we don't want to lose, as it is the article of the page. <p>More text is here as well, and it isn't lost either.</p></article>"], model)[0]
    assert "Main text that we don't want to lose" in text and "isn't lost either" in text


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<p><b>", '<a x="', "<a x='", "<li>", "<!--", "<table><td>", "</div>", "<script>", "<div class=content>", "<button><p>", "<td><div></td>", "<", "&amp;<b>"])
def test_hostile_pages_take_linear_time(model, unit):
    import time

    def took(n: int) -> float:
        start = time.perf_counter()
        html_text.extract([unit * (n // len(unit))], model)
        return time.perf_counter() - start

    took(1000)
    assert took(400_000) < 12 * max(took(100_000), 0.05)


def test_broken_markup_never_fails(model):
    rng = random.Random(4)
    whole = html_text.compose(rng)[0]
    cuts = [whole[: rng.randint(0, len(whole))] for _ in range(60)] + ["<", "<p", "</", "<!--", "<script>x", "<p><p></div></p>", "a&amp b &#x41;", None, "", "<table><tr><td>x<td>y", "<ul><li>a<li>b", "<" * 3000, "<div>" * 3000 + "deep"]
    assert len(html_text.extract(cuts, model)) == len(cuts)


def test_decoding_never_keeps_under_a_dropped_node():
    root = html_text.parse("<div><p>a</p><p>b</p></div>")
    nodes = html_text.elements(root)
    import numpy as np

    keep = html_text.decode(nodes, np.asarray([0.0, -5.0, 3.0, 1.0]))
    assert keep.tolist() == [True, False, False, False]
    assert html_text.decode(nodes, np.asarray([0.0, -2.0, 3.0, -1.0])).tolist() in ([True, True, True, False], [True, True, False, True])


def test_main_text_query(spark, odd_pages):
    got = {r["page_id"]: r for r in html_text.main_text(odd_pages).collect()}
    assert got[3]["text"] == "" and got[3]["n_chars"] == 0 and len(got) == 9
    assert html_text.main_text(odd_pages.limit(0)).count() == 0
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    r = html_text.main_text(pages).first()
    assert r["text"] and "track(" not in r["text"]
