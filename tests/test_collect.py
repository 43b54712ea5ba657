"""Collectors: parsers by hand-written cases, cursors over rounds."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import documents as doc
from gleanery.operators import collect, cursors
from gleanery.operators.state import StateTable

FEED = """<rss><channel><item><title>A &amp; B</title><link>https://a.example/1</link><description><![CDATA[<b>x</b> y]]></description><content:encoded>long</content:encoded>
<category>dev</category><category> </category><dc:subject>ai</dc:subject><guid>g1</guid><dc:date>2026-09-01</dc:date></item>
<item><link>/rel</link><content:encoded>only a body</content:encoded><pubDate>Fri, 04 Sep 2026</pubDate></item></channel>
<entry><title>Trial</title><id>e1</id><link rel="self" href="https://a.example/self"/><link rel="alternate" href="https://a.example/alt"/><updated>2026-09-02</updated><summary>s</summary><content>c</content><category term="t1"/></entry>
<item><title>torn"""


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("v"))


def test_feed_unites_items_and_entries(spark):
    blocks = one(spark, FEED, doc.feed_blocks).select(F.explode("v").alias("b"))
    got = [tuple(r) for r in blocks.select(doc.feed_item(F.col("b")).alias("i")).select("i.*").collect()]
    assert got == [
        ("A & B", "https://a.example/1", "2026-09-01", "x y", "g1", ["dev", "ai"]),
        ("only a body", "/rel", "Fri, 04 Sep 2026", "only a body", "", []),
        ("Trial", "https://a.example/alt", "2026-09-02", "s", "e1", ["t1"]),
    ]


def test_blocks_end_at_links_and_spans(spark):
    html = "<script>var a='<p>no</p>'</script><li><a href='/x'>An offer of ten</a><i>2026-09-01</i></li><h6>Head</h6><p>caf&eacute; &amp; more<br>next"
    page = spark.createDataFrame([(html,)], "t string").select(doc.html_blocks(doc.without_noise(F.col("t"))).alias("b"))
    assert [(b.text, b.href) for b in page.first().b] == [("An offer of ten", "/x"), ("2026-09-01", ""), ("Head", ""), ("caf&eacute; & more", ""), ("next", "")]


def test_dates_belong_to_the_row_before(spark):
    def items(html, ok=lambda t: F.lit(True), most=40):
        page = spark.createDataFrame([(html,)], "t string").select(doc.html_blocks(F.col("t")).alias("b"))
        return [(i.title, i.stated) for i in page.select(doc.html_items(F.col("b"), ok, 10, most).alias("i")).first().i]

    row = lambda title, date: f"<li><a href='/{title[:1]}'>{title}</a><i>{date}</i></li>"
    page = row("First notice here", "2026-09-01") + row("refused notice", "2026-09-02") + row("First NOTICE here", "2026/09/03") + row("Third notice here", "2026-09-01")
    got = items(page, lambda t: ~F.contains(t, F.lit("refused")))
    # a refused or repeated row takes no date with it, and a date that was there before counts for nothing
    assert got == [("First notice here", "2026-09-01"), ("2026-09-02", ""), ("2026/09/03", ""), ("Third notice here", "")]
    assert items(row("First notice here", "2026-09-01"), most=1) == [("First notice here", "")]
    assert items("") == []


def test_json_values_and_fallbacks(spark):
    text = '{"data":{"items":[{"title":null,"description":"<b>bold</b> text","url":"/p/1","n":1.50,"big":1e21,"ok":true},{"title":"T","url":"https://x.example"},7]}}'
    fields = {"title": "title", "summary": "description", "url": "url", "n": "n", "big": "big", "ok": "ok"}
    rows = one(spark, text, lambda c: doc.json_rows(c, "data.items", fields)).select(F.explode("v").alias("m")).where(F.size("m") > 0)
    made = rows.select("m", doc.json_item(F.col("m"), "https://a.example/").alias("i")).collect()
    assert [tuple(r.i) for r in made] == [("bold text", "https://a.example/p/1", "bold text"), ("T", "https://x.example", "")]
    assert (made[0].m["n"], made[0].m["big"], made[0].m["ok"]) == ("1.5", "1" + "0" * 21, "true")
    assert one(spark, '{"a":{}}', lambda c: doc.json_rows(c, "a", {"x": "x"})).first().v == []


def test_search_results_once_each(spark):
    html = """<a class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fa.example%2Fp%3Fq%3D1&amp;rut=1">Deal <b>one</b></a><td>first</td>
    <a href="https://b.example/" class='result-link'>Two</a><td>second</td><a class="result__a" href="https://b.example/">Again</a><a class="result__a" href="https://c.example/"></a>"""
    hits = one(spark, html, doc.search_hits).first().v
    assert [tuple(h) for h in hits] == [("Deal one", "https://a.example/p?q=1", "first"), ("Two", "https://b.example/", "second")]


def test_registry(spark):
    pages = spark.createDataFrame([("s", "https://a.example/", FEED)], "source string, url string, body string")
    assert collect.collect("rss", pages).count() == 3
    with pytest.raises(ValueError, match="no collector"):
        collect.collect("gopher", pages)


def test_row_builder(spark):
    rows = spark.createDataFrame([(" <b>Free</b> tier ", "/p?utm_a=1", "x" * 800, None), ("", "/q", "no title", None), ("Other", "javascript:x", "repost", None)], "title string, link string, summary string, published_at timestamp")
    made = collect.findings(rows, F.lit("s"), F.lit("c"), F.lit("https://a.example/list"), F.lit("2026-01-06").cast("timestamp"), [], ["repost"])
    got = {r.title: (r.url, r.host, len(r.summary), r.kept) for r in made.collect()}
    assert got == {"Free tier": ("https://a.example/p?utm_a=1", "a.example", 700, True), "Other": ("javascript:x", "", 6, False)}
    assert [tuple(r) for r in collect.seen_and_kept(made).collect()] == [("s", 2, 1)]


def test_thin_details_are_refused(spark):
    rows = spark.createDataFrame([("https://a.example/1", "short"), ("https://a.example/2", "kept"), ("https://a.example/list", "list")], "url string, summary string")
    pages = spark.createDataFrame([("https://a.example/1", "<p>" + "body " * 60 + "</p>"), ("https://a.example/2", "slow down"), ("https://a.example/list", "<p>" + "x" * 400)], "page_url string, body string")
    got = {r.url[-4:]: r.summary for r in collect.follow_details(rows, pages, F.lit("https://a.example/list")).collect()}
    assert got == {"le/1": ("body " * 60).strip(), "le/2": "kept", "list": "list"}


def test_fact_cursors_over_rounds(spark, tmp_path):
    state, stored = StateTable(spark, f"file://{tmp_path}/state"), []
    store = lambda df: stored.append({(r.source, r.text) for r in df.collect()})

    def page(*lines):
        rows = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(lines)], "source string, pos int, text string")
        return collect.price_facts(rows, ["pos"])

    cursors.facts_round(state, page(("a", "Plan costs $10 now"), ("a", "no fact at all"), ("a", "free")), store)
    cursors.facts_round(state, page(("a", "plan  COSTS $10 now"), ("a", "Plan costs $12 now"), ("b", "Free credits today")), store)
    cursors.facts_round(state, page(("a", "Plan costs $10 now"), ("b", "Free credits today"), ("b", "20% off today")), store)
    # the first pass of a source is its baseline
    assert stored == [set(), {("a", "Plan costs $12 now")}, {("b", "20% off today")}]

    def broken(df):
        raise OSError

    with pytest.raises(OSError):
        cursors.facts_round(state, page(("b", "30% off today")), broken)
    cursors.facts_round(state, page(("b", "30% off today")), store)  # the cursor did not move
    assert stored[3] == {("b", "30% off today")}


def test_free_and_search_cursors(spark, tmp_path):
    state, stored = StateTable(spark, f"{tmp_path}/state"), []
    store = lambda df: stored.append([r.model_id for r in df.collect()])
    day = 86_400_000
    models = lambda *rows: spark.createDataFrame(list(rows), "model_id string, prompt string, completion string, created_ms long")
    cursors.free_round(state, models(("old", "0", "0", 1 * day), ("new", "0E-10", " 0 ", 95 * day), ("paid", "1", "0", 99 * day), ("odd", "", "0", 99 * day)), 100 * day, store)
    cursors.free_round(state, models(("old", "0", "0", 1 * day), ("paid", "0", "0", 99 * day), ("none", "0", "0", None)), 100 * day, store)
    assert stored == [["new"], ["paid", "none"]]
    sources = spark.createDataFrame([("s", {"queries": "a; b\n", "site": "x.example"}), ("t", {"queries": " "})], "name string, params map<string,string>")
    assert [[tuple(r) for r in cursors.search_round(state, sources).collect()] for _ in range(3)] == [[("s", f"{q} site:x.example")] for q in "aba"]
