"""Queries of the source parsers and catalogue operators, and of the platform itself, and their SQL.

The parsers read documents that are made of the tables: feeds, list pages, articles, JSON and result pages of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import documents as doc
from gleanery.functions.text import clean_text, keyword_gate
from gleanery.operators import collect
from gleanery.session import table

#: Rows that a document made of a table holds at most.
PER_DOCUMENT = 50
SNAPSHOT_AT = "2026-08-25 00:00:00"


def escaped(text: Column) -> Column:
    """Text as it stands in markup; null stays null."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, content: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>")), F.lit(""))


def _documents(rows: DataFrame, keys: list[str], order: str, part: Column, before: str, after: str) -> DataFrame:
    """One ``body`` per ``keys``, the parts of its rows in order; a document holds no more rows than its keys allow."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return rows.groupBy(*keys).agg(parts.alias("_p")).select(*keys, F.concat(F.lit(before), F.array_join(F.transform("_p", lambda x: x.p), ""), F.lit(after)).alias("body"))


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "rss_items").withColumn("page", F.floor(F.col("item_id") / PER_DOCUMENT))
    categories = F.array_join(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: _tag("category", escaped(c))), "")
    body = F.concat(F.lit("<![CDATA["), "content_encoded", F.lit("]]>"))
    parts = [_tag("title", escaped(F.col("title"))), _tag("link", escaped(F.col("link"))), _tag("description", escaped(F.col("description"))), _tag("content:encoded", body)]
    parts += [_tag("pubDate", F.col("pub_date")), _tag("dc:date", F.col("dc_date")), _tag("guid", F.col("item_id").cast("string")), categories]
    odd = F.col("item_id") % 2 == 1
    dates = [_tag("published", F.col("pub_date")), _tag("updated", F.col("dc_date")), _tag("id", F.col("item_id").cast("string"))]
    terms = F.array_join(F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.concat(F.lit('<category term="'), escaped(c), F.lit('"/>'))), "")
    links = F.concat(F.lit('<link rel="self" href="https://x.example/self"/><link rel="alternate" href="'), escaped(F.coalesce("link", F.lit(""))), F.lit('"/>'))
    entry = [_tag("title", escaped(F.col("title"))), links, _tag("summary", escaped(F.col("description"))), _tag("content", escaped(F.col("content_encoded"))), *dates, terms]
    # items and entries in one feed
    item = F.when(odd, F.concat(F.lit("<item>"), *parts, F.lit("</item>"))).otherwise(F.concat(F.lit("<entry>"), *entry, F.lit("</entry>")))
    return _documents(r, ["page"], "item_id", item, "<rss><channel>", "</channel></rss>")


def rss_items(spark: SparkSession, d: str) -> DataFrame:
    """Items and entries of feeds, read back from their text."""
    blocks = _feeds(spark, d).select(F.explode(doc.feed_blocks(F.col("body"))).alias("b"))
    items = blocks.select(doc.feed_item(F.col("b")).alias("i"))
    return items.select(F.col("i.guid").cast("long").alias("item_id"), "i.title", "i.link", "i.stated", "i.summary", F.array_join("i.categories", ",").alias("categories"))


_SCRIPT = "<html><script>var a='<p>no</p>'</script><style>p{}</style><ul>"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the segments table as markup; each is a page of its own."""
    seg = table(spark, d, "html_segments")
    text = escaped(F.coalesce("text", F.lit("")))
    linked = F.concat(F.lit('<a href="'), escaped(F.col("href")), F.lit('">'), text, F.lit("</a>"))
    item = _tag("li", F.when(F.coalesce("href", F.lit("")) != "", linked).otherwise(text))
    return _documents(seg, ["page_id", "url", "fetched_at"], "pos", item, _SCRIPT, "</ul></html>")


def html_segments(spark: SparkSession, d: str) -> DataFrame:
    blocks = _pages(spark, d).select("page_id", doc.without_noise(F.col("body")).alias("h"))
    return blocks.select("page_id", F.explode(doc.html_blocks(F.col("h"))).alias("b")).select("page_id", "b.pos", "b.text", "b.href")


def _notices(spark: SparkSession, d: str) -> DataFrame:
    """Notice lists: rows of a linked title and a date."""
    r = table(spark, d, "rss_items").where(F.trim("title") != "").withColumn("page", F.floor(F.col("item_id") / PER_DOCUMENT))
    row = F.concat(F.lit('<li><a href="'), escaped(F.coalesce("link", F.lit(""))), F.lit('">'), escaped(F.col("title")), F.lit("</a><i>"), F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("</i></li>"))
    return _documents(r, ["page"], "item_id", row, _SCRIPT, "</ul></html>")


def html_row_date(spark: SparkSession, d: str) -> DataFrame:
    """What notice lists offer, each item with the date of the block after it."""
    pages = _notices(spark, d).select("page", doc.html_blocks(doc.without_noise(F.col("body"))).alias("b"))
    items = pages.select("page", F.posexplode(doc.html_items(F.col("b"), lambda t: F.lit(True), 10, 40)).alias("place", "i"))
    return items.select("page", "place", "i.title", "i.link", "i.stated")


def class_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    return docs.select("doc_id", F.explode(doc.class_windows(F.col("text"), "Free", 40)).alias("piece"))


def keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first place of every text on a page, whatever its case."""
    seg = table(spark, d, "html_segments").where(F.trim("text") != "").select("page_id", "pos", "text")
    return collect.keep_first(seg, ["page_id", F.lower("text")], ["pos"]).select("page_id", "pos")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "catalog_snapshots").withColumn("page", F.floor(F.col("row_id") / PER_DOCUMENT))
    model = F.to_json(F.struct("row_id", "id", "name", "description", "context_length", "pricing"))
    return _documents(c, ["page"], "row_id", F.concat(model, F.lit(",")), '{"data":{"items":[', "{}]}}")


def json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Models read from JSON under declared paths."""
    fields = {"row_id": "row_id", "title": "name", "summary": "description", "url": "id", "price": "pricing.prompt", "size": "context_length"}
    rows = _catalogue(spark, d).select(F.explode(doc.json_rows(F.col("body"), "data.items", fields)).alias("m")).where(F.col("m")["row_id"].isNotNull())
    made = rows.select("m", doc.json_item(F.col("m"), "https://models.example/").alias("i"))
    return made.select(F.col("m")["row_id"].cast("long").alias("row_id"), "i.title", "i.url", "i.summary", F.col("m")["price"].alias("price"), F.col("m")["size"].alias("size"))


def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.explode(doc.flatten_json(F.col("props"))).alias("fact"))


def event_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


def hn_rows(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hn_hits")
    link = F.when(F.trim("url") != "", F.col("url")).otherwise(F.concat(F.lit("https://hn.example/item?id="), "object_id"))
    head = F.format_string("%d points, %d comments", F.coalesce("points", F.lit(0)), F.coalesce("num_comments", F.lit(0)))
    return h.select("hit_id", link.alias("link"), head.alias("head"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of search pages, redirectors unwrapped, each URL once a page."""
    h = table(spark, d, "hn_hits").withColumn("page", F.floor(F.col("hit_id") / PER_DOCUMENT))
    target = F.coalesce("url", F.lit(""))
    href = F.when(F.col("hit_id") % 2 == 0, F.concat(F.lit("//d.example/l/?uddg="), F.url_encode(target), F.lit("&amp;rut=1"))).otherwise(escaped(target))
    named = F.when(F.col("hit_id") % 3 == 0, F.concat(F.lit('<a href="'), href, F.lit('" class="result-link">'))).otherwise(F.concat(F.lit('<a class="result__a" href="'), href, F.lit('">')))
    row = F.concat(named, escaped(F.coalesce("title", F.lit(""))), F.lit("</a><td class='result-snippet'>by <b>"), F.coalesce("author", F.lit("")), F.lit("</b></td>"))
    pages = _documents(h, ["page"], "hit_id", row, "<table>", "</table>").where(~doc.is_challenge(F.col("body")))
    hits = pages.select("page", F.explode(doc.search_hits(doc.decode_entities(F.col("body")))).alias("h"))
    return hits.select("page", "h.title", "h.url", "h.snippet")


def search_turns(spark: SparkSession, d: str) -> DataFrame:
    """The query whose turn it is for each source; the cursor is the number of the source."""
    s = table(spark, d, "feed_sources")
    queries = F.concat("name", F.lit(" free;\n ; "), F.coalesce("category", F.lit("")), F.lit(" credits\n"), "name", F.lit(" trial;"))
    turn = collect.next_query(queries, F.when(F.col("source_id") % 2 == 0, F.col("host")), F.col("source_id"))
    return s.select("name", turn.alias("t")).select("name", "t.query", "t.cursor")


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Price facts that the pages of each host tell after a day and that the cursor of the day does not hold; hosts without one are at their baseline."""
    seg = table(spark, d, "html_segments").select(F.col("host").alias("source"), "page_id", "pos", clean_text(F.col("text")).alias("text"), "fetched_at")
    at = F.lit(SNAPSHOT_AT).cast("timestamp")
    old, new = (collect.price_facts(seg.where(c).drop("fetched_at"), ["page_id", "pos"]) for c in (F.col("fetched_at") < at, F.col("fetched_at") >= at))
    return collect.new_facts(new, old).select("source", "fact_key", "page_id", "pos")


def snapshot_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The cursors after the pass of ``snapshot_diff``."""
    seg = table(spark, d, "html_segments").select(F.col("host").alias("source"), "page_id", "pos", clean_text(F.col("text")).alias("text"), "fetched_at")
    at = F.lit(SNAPSHOT_AT).cast("timestamp")
    old, new = (collect.price_facts(seg.where(c).drop("fetched_at"), ["page_id", "pos"]) for c in (F.col("fetched_at") < at, F.col("fetched_at") >= at))
    return collect.cursor_after(new, old)


def _models(spark: SparkSession, d: str, back: int) -> DataFrame:
    """The models of the last snapshot but ``back``, as last delivered."""
    c = table(spark, d, "catalog_snapshots").select("snap_no", "delivery_no", "row_id", "id", "created", "pricing")
    last = c.agg(F.max("snap_no").alias("n"))  # one row
    mine = c.join(F.broadcast(last)).where(F.col("snap_no") == F.col("n") - back).drop("n")
    delivered = mine.agg(F.max("delivery_no").alias("k"))  # one row
    mine = mine.join(F.broadcast(delivered)).where(F.col("delivery_no") == F.col("k"))
    k = F.col("created")
    created_ms = F.when(k < 10**11, k * 1000).when(k < 10**14, k).when(k < 10**17, F.floor(k / 1000)).otherwise(F.floor(k / 10**6))
    made = mine.select(F.lower(F.trim("id")).alias("model_id"), "row_id", F.col("pricing.prompt").alias("prompt"), F.col("pricing.completion").alias("completion"), F.when(k > 0, created_ms.cast("long")).alias("created_ms"))
    one = made.where("model_id <> ''").groupBy("model_id").agg(F.max_by(F.struct("prompt", "completion", "created_ms"), "row_id").alias("v"))
    return one.select("model_id", "v.*")


def catalog_free_diff(spark: SparkSession, d: str) -> DataFrame:
    """Models that cost nothing in the last snapshot and did in the one before, or were not there; the latest ten."""
    old = _models(spark, d, 1)
    known = old.where(collect.zero_price(F.col("prompt")) & collect.zero_price(F.col("completion")))
    return collect.free_flips(_models(spark, d, 0), known, 0).select("model_id", "created_ms")


def catalog_free_first(spark: SparkSession, d: str) -> DataFrame:
    """The same without a cursor: of the free models only those created within the days of grace."""
    return collect.free_flips(_models(spark, d, 0), None, 1_786_000_000_000, 60).select("model_id", "created_ms")


def normalize_rows(spark: SparkSession, d: str) -> DataFrame:
    """Per source, what was seen and what passes the gate, through the shared row builder."""
    r = table(spark, d, "rss_items").select("item_id", F.col("source").alias("_source"), "title", F.col("link"), F.col("description").alias("summary"))
    made = collect.findings(r, F.col("_source"), F.lit("unknown"), F.lit("https://x.example/"), F.lit(SNAPSHOT_AT).cast("timestamp"), ["free", "免费", "%"], ["repost"])
    return collect.seen_and_kept(made)


def finding_rows(spark: SparkSession, d: str) -> DataFrame:
    """The identity of every row that the builder makes."""
    r = table(spark, d, "rss_items").select("item_id", F.col("source").alias("_source"), "title", F.col("link"), F.col("description").alias("summary"))
    made = collect.findings(r, F.col("_source"), F.lit("unknown"), F.lit("https://x.example/"), F.lit(SNAPSHOT_AT).cast("timestamp"), [], [])
    return made.select("item_id", "title", "url", "host", "fingerprint")


def per_source_limit(spark: SparkSession, d: str) -> DataFrame:
    """The first items of each source, as many as it allows."""
    r = table(spark, d, "rss_items").select("source", "item_id")
    most = table(spark, d, "feed_sources").select(F.col("name").alias("source"), F.coalesce("max_items", F.lit(40)).alias("most"))
    limited = r.join(F.broadcast(most), "source", "left").withColumn("most", F.coalesce("most", F.lit(40)))  # a fixed dimension
    return collect.first_of_each(limited, "source", ["item_id"], F.col("most")).select("item_id")


def detail_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Deals that pass a gate, with the text of their page where it says enough."""
    rows = table(spark, d, "deals").select("log_seq", F.lower("url").alias("url"), F.coalesce("summary", F.lit("")).alias("summary"), "title")
    gated = rows.where(keyword_gate(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "summary"), ["free", "免费", "gb"]))
    pages = _pages(spark, d).withColumn("page_url", F.lower("url"))
    latest = collect.keep_first(pages.withColumn("_t", -F.unix_micros("fetched_at")), ["page_url"], ["_t", "page_id"]).select("page_url", "body")
    return collect.follow_details(gated, latest, F.lit("https://x.example/")).select("log_seq", F.col("summary").alias("body"))


def source_dim(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "feed_sources").where(~F.coalesce("disabled", F.lit(False))).select("name", "kind", F.coalesce("max_items", F.lit(40)).alias("max_items"))


def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n")


def events_session(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("since"), "n")


def region_rollup(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


def orders_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


_ALL = (
    rss_items, html_segments, html_row_date, class_windows, keep_first, json_paths, json_flatten, event_props, hn_rows, search_results, search_turns, snapshot_diff,
    snapshot_cursor, catalog_free_diff, catalog_free_first, source_dim, normalize_rows, finding_rows, per_source_limit, detail_enrich, events_tumbling, events_session,
    region_rollup, orders_topk,
)
QUERIES = {f.__name__: f for f in _ALL}


def clean_sql(x: str) -> str:
    """:func:`gleanery.functions.text.clean_text` of a text without entities."""
    return f"trim(regexp_replace(translate(regexp_replace({x}, '<[^>]*>', ' ', 'g'), chr(10) || chr(9), '  '), '[ \\t\\r\\f\\v]+', ' ', 'g'))"


def cut_sql(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) > {n} THEN trim(substring({x}, 1, {n - 1})) || '…' ELSE {x} END)"


def _stated(x: str) -> str:
    return f"(CASE WHEN trim({x}) <> '' THEN trim({x}) END)"


_SEG = "s AS (SELECT page_id, pos, " + clean_sql("text") + " AS text, coalesce(href, '') AS href, lower(url) AS u, fetched_at, host FROM html_segments)"
_PRICE = collect.PRICE_FACT
_FACTS = (
    "WITH " + _SEG + f""",
f AS (SELECT host AS source, page_id, pos, fetched_at >= timestamptz '{SNAPSHOT_AT}+00' AS late, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM s WHERE regexp_matches(text, '{_PRICE}')),
k AS (SELECT source, late, substring(sha256(norm), 1, 16) AS fact_key, min(struct_pack(a := page_id, b := pos)) AS p FROM f WHERE length(norm) >= 8 GROUP BY ALL),
c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY source, late ORDER BY p) <= 30)"""
)
_FREE = """WITH l AS (SELECT max(snap_no) AS n FROM catalog_snapshots), dl AS (SELECT snap_no, max(delivery_no) AS k FROM catalog_snapshots GROUP BY 1),
m AS (SELECT lower(trim(id)) AS model_id, n - c.snap_no AS back, arg_max(struct_pack(p := pricing.prompt, q := pricing.completion, t := CASE WHEN created > 0 THEN CASE WHEN created < 1e11 THEN created * 1000 WHEN created < 1e14 THEN created WHEN created < 1e17 THEN created // 1000 ELSE created // 1000000 END END), row_id) AS v
  FROM catalog_snapshots c JOIN dl ON dl.snap_no = c.snap_no AND c.delivery_no = k, l WHERE c.snap_no >= n - 1 AND trim(id) <> '' GROUP BY 1, 2),
f AS (SELECT model_id, back, v.t AS created_ms FROM m WHERE try_cast(trim(v.p) AS double) = 0 AND try_cast(trim(v.q) AS double) = 0)"""
_ROWS = "r AS (SELECT item_id, source, " + clean_sql("coalesce(title, '')") + " AS title, " + cut_sql(clean_sql("coalesce(description, '')"), 700) + " AS summary, trim(link) AS url FROM rss_items)"

ORACLES = {
    "rss_items": f"""WITH b AS (SELECT *, CASE WHEN item_id % 2 = 1 OR true THEN coalesce({_stated('description')}, {_stated('content_encoded')}, '') END AS raw FROM rss_items),
c AS (SELECT *, {cut_sql(clean_sql('raw'), 500)} AS summary, {clean_sql("coalesce(title, '')")} AS t FROM b)
SELECT item_id, CASE WHEN t <> '' THEN t ELSE {cut_sql('summary', 120)} END AS title, trim(coalesce(link, '')) AS link, coalesce({_stated('pub_date')}, {_stated('dc_date')}, '') AS stated, summary,
  array_to_string(list_filter(list_transform(coalesce(categories, []), lambda x: CASE WHEN item_id % 2 = 1 THEN trim(x) ELSE x END), lambda x: trim(x) <> ''), ',') AS categories FROM c""",
    "html_segments": "WITH " + _SEG + " SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1)::int AS pos, text, href FROM s WHERE text <> ''",
    "html_row_date": f"""WITH n AS (SELECT item_id // {PER_DOCUMENT} AS page, item_id, {clean_sql('title')} AS title, coalesce(link, '') AS link, strftime(timezone('UTC', fetched_at), '%Y-%m-%d') AS day FROM rss_items WHERE trim(title) <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY page, lower(title) ORDER BY item_id) = 1 AND length(title) >= 10 AS made, row_number() OVER (PARTITION BY page, day ORDER BY item_id) = 1 AS dated FROM n),
i AS (SELECT page, item_id * 2 AS o, {cut_sql('title', 120)} AS title, link, CASE WHEN dated THEN day ELSE '' END AS stated FROM p WHERE made UNION ALL SELECT page, item_id * 2 + 1, day, '', '' FROM p WHERE dated AND NOT made),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY o) - 1 AS place FROM i)
SELECT page, place::int AS place, title, link, CASE WHEN place < 39 THEN stated ELSE '' END AS stated FROM k WHERE place < 40""",
    "class_windows": "WITH w AS (SELECT doc_id, text, list_filter(range(1, length(text) + 1), lambda p: substring(lower(text), p, 4) = 'free') AS places FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(CASE WHEN len(places) = 0 THEN [text] ELSE list_transform(places, lambda p: substring(text, p, 40)) END) AS piece FROM w",
    "keep_first": "SELECT page_id, min(pos) AS pos FROM html_segments WHERE trim(text) <> '' GROUP BY page_id, lower(text)",
    "json_paths": f"""WITH c AS (SELECT *, {clean_sql("coalesce(description, '')")} AS t FROM catalog_snapshots)
SELECT row_id, CASE WHEN trim(name) <> '' THEN name ELSE {cut_sql('t', 120)} END AS title, CASE WHEN coalesce(id, '') = '' OR starts_with(id, 'http') THEN coalesce(id, '') ELSE 'https://models.example/' || regexp_replace(id, '^/', '') END AS url,
  {cut_sql('t', 500)} AS summary, pricing.prompt AS price, context_length::varchar AS size FROM c""",
    "json_flatten": "SELECT event_id, 'k=' || (props->>'$.k') AS fact FROM events WHERE coalesce(props->>'$.k', '') <> ''",
    "event_props": "SELECT event_id, (props->>'$.k')::int AS k FROM events",
    "hn_rows": "SELECT hit_id, CASE WHEN trim(url) <> '' THEN url ELSE 'https://hn.example/item?id=' || object_id END AS link, coalesce(points, 0) || ' points, ' || coalesce(num_comments, 0) || ' comments' AS head FROM hn_hits",
    "search_results": f"SELECT page, title, url, snippet FROM (SELECT hit_id // {PER_DOCUMENT} AS page, hit_id, {clean_sql('title')} AS title, CASE WHEN hit_id % 2 = 0 THEN url ELSE trim(url) END AS url, trim('by ' || coalesce(author, '')) AS snippet FROM hn_hits) WHERE title <> '' AND coalesce(url, '') <> '' QUALIFY row_number() OVER (PARTITION BY page, url ORDER BY hit_id) = 1",
    "search_turns": "SELECT name, [name || ' free', trim(coalesce(category, '') || ' credits'), name || ' trial'][source_id % 3 + 1] || CASE WHEN source_id % 2 = 0 THEN ' site:' || host ELSE '' END AS query, source_id + 1 AS cursor FROM feed_sources",
    "snapshot_diff": _FACTS + " SELECT source, fact_key, p.a AS page_id, p.b AS pos FROM c WHERE late AND source IN (SELECT source FROM c WHERE NOT late) AND NOT EXISTS (SELECT 1 FROM c o WHERE NOT o.late AND o.source = c.source AND o.fact_key = c.fact_key)",
    "snapshot_cursor": _FACTS + " SELECT source, fact_key FROM c WHERE late OR source NOT IN (SELECT source FROM c WHERE late)",
    "catalog_free_diff": _FREE + " SELECT model_id, created_ms FROM f WHERE back = 0 AND model_id NOT IN (SELECT model_id FROM f WHERE back = 1) ORDER BY created_ms DESC NULLS LAST, model_id LIMIT 10",
    "catalog_free_first": _FREE + " SELECT model_id, created_ms FROM f WHERE back = 0 AND created_ms > 1786000000000 - 60::bigint * 86400000 ORDER BY created_ms DESC NULLS LAST, model_id LIMIT 10",
    "source_dim": "SELECT name, kind, coalesce(max_items, 40) AS max_items FROM feed_sources WHERE NOT coalesce(disabled, false)",
    "normalize_rows": "WITH " + _ROWS + " SELECT source, count(*) AS seen, count_if(NOT contains(b, 'repost') AND (contains(b, 'free') OR contains(b, '免费') OR contains(b, '%')))::bigint AS kept FROM (SELECT source, lower(title || chr(10) || summary) AS b FROM r WHERE title <> '') GROUP BY 1",
    "finding_rows": "WITH " + _ROWS + r", p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(url, ''), '^https?://', ''), '#.*', ''), '/$', '') AS b FROM r WHERE title <> '') SELECT item_id, title, coalesce(url, '') AS url, lower(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#:]*)', 1)) AS host, substring(sha256(CASE WHEN coalesce(url, '') <> '' THEN lower(replace(b, 'www.', '')) ELSE coalesce(source, '') || '|' || lower(trim(title)) END), 1, 32) AS fingerprint FROM p",
    "per_source_limit": "SELECT item_id FROM rss_items LEFT JOIN (SELECT name, max_items FROM feed_sources) ON source = name QUALIFY row_number() OVER (PARTITION BY source ORDER BY item_id) <= coalesce(max_items, 40)",
    "detail_enrich": "WITH " + _SEG + f""", l AS (SELECT u, page_id FROM s GROUP BY u, page_id, fetched_at QUALIFY row_number() OVER (PARTITION BY u ORDER BY fetched_at DESC, page_id) = 1),
t AS (SELECT s.u, string_agg(text, ' ' ORDER BY pos) AS detail FROM s JOIN l ON s.page_id = l.page_id WHERE text <> '' GROUP BY 1),
g AS (SELECT log_seq, lower(url) AS u, coalesce(summary, '') AS summary, lower(coalesce(title, '') || chr(10) || coalesce(summary, '')) AS b FROM deals)
SELECT log_seq, CASE WHEN length(detail) >= 200 THEN {cut_sql('detail', 2000)} ELSE summary END AS body FROM g LEFT JOIN t ON g.u = t.u WHERE contains(b, 'free') OR contains(b, '免费') OR contains(b, 'gb')""",
    "events_tumbling": "SELECT date_trunc('day', ts)::timestamp AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_session": "WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + interval 6 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM m) SELECT user_id, min(ts) AS since, count(*) AS n FROM s GROUP BY user_id, g",
    "region_rollup": "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "orders_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
}
