"""Queries of the text, URL and clock functions, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import lexicon
from gleanery.functions import clock, text, url
from gleanery.functions.documents import resolve_url as resolve
from gleanery.functions.instants import utc_ms
from gleanery.plans.deal_queries import _FOLD, NOW_TEXT, key_sql
from gleanery.plans.sql_functions import register
from gleanery.session import spread, table

#: A small list of vendors that the test texts hold.
TEST_VENDORS = [("ai", "AI"), ("cloud", "Cloud"), ("labs", "Labs"), ("数据", "数据")]


def _deals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deals")


def title_key(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", text.dedup_key(F.col("title")).alias("key"))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", url.normalize_url(F.col("url")).alias("page"))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", url.fingerprint(F.col("url"), F.col("source"), F.col("title")).alias("fp"))


def hosts(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", url.host_of(F.col("url")).alias("host"))


def clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rss_items").select("item_id", text.clean_text(text.decode_entities(F.col("content_encoded"))).alias("body"))


def gated(spark: SparkSession, d: str) -> DataFrame:
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
    return _deals(spark, d).select("log_seq", text.keyword_gate(blob, ["GPU", "tokens", "免费"], ["waiting list"]).alias("ok"))


def noise(spark: SparkSession, d: str) -> DataFrame:
    """By the words that are never offers and by some of these texts."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.is_noise(t).alias("noise"), text.is_noise(t, ["waiting list", "排队"]).alias("waits"))


def bounded_words(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("text")
    return table(spark, d, "documents").select("doc_id", *[F.coalesce(text.bounded(low, w), F.lit(False)).alias(f"has_{i}") for i, w in enumerate(("off", "free", "gb", "for everyone", "免费"))])


def offer_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every offer by the full word lists; vendors by a list that these texts hold."""
    rows = spread(table(spark, d, "documents").select("doc_id", "text"))
    found = rows.select("doc_id", F.explode(text.scan_offers(F.col("text"), None, TEST_VENDORS)).alias("o"))
    return found.select("doc_id", "o.kind", "o.matched", "o.vendor", "o.evidence")


def vendor_extract(spark: SparkSession, d: str) -> DataFrame:
    """By the full list and by one that these texts hold."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.array_join(text.vendors(t), ",").alias("vendors"), F.array_join(text.vendors(t, TEST_VENDORS), ",").alias("listed"))


def product_extract(spark: SparkSession, d: str) -> DataFrame:
    """By the known families and by how these titles name a version."""
    t = F.col("title")
    return _deals(spark, d).select("log_seq", text.product(t).alias("known"), text.product(t, r"[A-Z][a-z]{5,}-\d+\.\d+").alias("product"))


def discount_stated(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", text.discount_pct(F.concat_ws("\n", "title", "summary")).alias("pct"))


def title_words(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", text.title_keywords(F.col("title"), 4).alias("words"))


def text_blobs(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", F.md5(text.text_blob(F.col("title"), F.col("summary"), F.col("offers"))).alias("blob"))


def first_stated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rss_items").select("item_id", text.coalesce_blank(F.col("content_encoded"), F.col("description"), F.col("title")).alias("body"))


def truncations(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("summary")
    return _deals(spark, d).select("log_seq", text.truncate(s, 40).alias("a"), text.truncate(s, 40, keep_all=True).alias("b"), text.truncate(s, 40, strip=False).alias("c"))


def _blob(spark: SparkSession, d: str) -> DataFrame:
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    rows = spread(_deals(spark, d).select("log_seq", "title", "summary", "published_at", "discovered_at", "meta"))
    return rows.select("log_seq", blob.alias("blob"), F.coalesce("published_at", "discovered_at").alias("anchor"), "meta")


def starts_at(spark: SparkSession, d: str) -> DataFrame:
    return _blob(spark, d).select("log_seq", clock.starts_at(F.col("blob"), F.col("anchor")).alias("moment"))


def expires_at(spark: SparkSession, d: str) -> DataFrame:
    return _blob(spark, d).select("log_seq", clock.expires_at(F.col("blob"), F.col("anchor")).alias("moment"))


def reparsed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows that reading the texts again would change, with what is kept and what is read; an absent reading erases nothing."""
    rows = _blob(spark, d).select("log_seq", clock.expires_at(F.col("blob"), F.col("anchor")).alias("read"), F.try_to_timestamp(F.col("meta")["expires_at"]).alias("kept"))
    return rows.where(F.col("read").isNotNull() & ~F.col("read").eqNullSafe(F.col("kept")))


def reparse_drift(spark: SparkSession, d: str) -> DataFrame:
    blob = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))
    rows = _deals(spark, d).select(blob.alias("blob"), F.coalesce("published_at", "discovered_at").alias("anchor"), F.try_to_timestamp(F.col("meta")["expires_at"]).alias("kept"))
    read = rows.select("kept", clock.expires_at(F.col("blob"), F.col("anchor")).alias("read"))
    return read.agg(F.count_if(F.col("read").isNotNull()).alias("read"), F.count_if((F.col("read") != F.col("kept")) | (F.col("read").isNotNull() & F.col("kept").isNull())).alias("drifted"))


def parse_any_time(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct time as the feeds wrote it, read on the clock of UTC."""
    udf = F.pandas_udf(lambda s: s.map(lambda t: utc_ms(t, "UTC")).astype("Int64"), "long")
    r = table(spark, d, "rss_items")
    raw = r.select(F.explode(F.array("pub_date", "dc_date")).alias("raw")).where(F.trim("raw") != "").distinct()
    return raw.select("raw", udf("raw").alias("ms"))


def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "deals").select("log_seq", F.concat_ws(" ", "fingerprint", "summary").alias("text"))
    return lines.select("log_seq", F.array_join(text.secret_classes(F.col("text")), ",").alias("classes"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Assignments of secrets, made of the fingerprints, with secrets masked."""
    fp = F.coalesce("fingerprint", F.lit("none"))
    line = F.concat(F.lit("seen: "), F.col("log_seq").cast("string"), F.lit(", api_key = '"), fp, F.lit("'; Authorization: Bearer "), fp, F.lit("; password="), F.substring(fp, 1, 6))
    return _deals(spark, d).select("log_seq", text.redact(line).alias("safe"))


def redact_urls(spark: SparkSession, d: str) -> DataFrame:
    u, number = F.trim("url"), F.col("log_seq").cast("string")
    hooked = F.concat(F.lit("https://user"), number, F.lit(":secret@h.example/a/hook/"), F.substring(F.sha2(number, 256), 1, 20))
    return _deals(spark, d).select("log_seq", text.redact_url(u).alias("shown"), text.redact_query(u).alias("named"), text.redact_url(hooked).alias("hook"))


def decode_entities(spark: SparkSession, d: str) -> DataFrame:
    """Texts escaped as markup and read back, and once more only as far as XML needs it."""
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("—"), F.lit("&mdash;")), F.lit("€"), F.lit("&#8364;"))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.decode_entities(escaped)).alias("plain"), F.md5(text.decode_xml_unsafe(escaped)).alias("kept"))


def resolve_url(spark: SparkSession, d: str) -> DataFrame:
    seg = table(spark, d, "html_segments")
    return seg.select("page_id", "pos", resolve(F.col("url"), F.col("href")).alias("absolute"))


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """The search for the page of each deal on the host of its source."""
    hosts = table(spark, d, "feed_sources").select(F.col("name").alias("source"), "host")
    rows = _deals(spark, d).join(F.broadcast(hosts), "source", "left")  # a fixed dimension
    product = text.product(F.coalesce("title", F.lit("")), r"[A-Z][a-z]{5,}-\d+\.\d+")
    return rows.select("log_seq", text.search_query(product, F.coalesce("is_free", F.lit(False)), F.col("host")).alias("query"))


def offer_order(spark: SparkSession, d: str) -> DataFrame:
    """Offers, vendors and tags of each deal in their order."""
    line = F.array_join(F.transform(text.sorted_offers(F.col("offers")), lambda o: F.concat(o.kind, F.lit(":"), o.matched)), ",")
    return _deals(spark, d).select("log_seq", line.alias("offers"), F.array_join(F.array_sort("vendors"), ",").alias("vendors"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


def parsed_hosts(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", url.parsed_host(F.col("url")).alias("host"))


def sql_surface(spark: SparkSession, d: str) -> DataFrame:
    """The functions called from SQL."""
    register(spark)
    _deals(spark, d).createOrReplaceTempView("sql_surface_deals")
    return spark.sql("SELECT log_seq, dedup_key(title) AS key, normalize_url(url) AS page, discount_pct(concat_ws('\\n', title, summary)) AS pct FROM sql_surface_deals")


_ALL = (
    title_key, url_normalize, fingerprint, hosts, clean_bodies, gated, noise, bounded_words, offer_scan, vendor_extract, product_extract, discount_stated,
    title_words, text_blobs, first_stated, truncations, starts_at, expires_at, reparse_drift, reparsed_rows, parse_any_time, secret_scan, redact_text, redact_urls, decode_entities, resolve_url,
    search_queries, offer_order, parsed_hosts, sql_surface,
)
QUERIES = {f.__name__: f for f in _ALL}

_PAGE = r"""lower(regexp_replace(regexp_replace(CASE WHEN NOT contains(b, '?') THEN b ELSE split_part(b, '?', 1) || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END END, '/$', ''), '#[\s\S]*', ''))"""
_PAGES = (
    r"""WITH bare AS (SELECT *, replace(regexp_replace(regexp_replace(trim(url, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)), '^https://', ''), '^http://', ''), 'www.', '') AS b FROM deals),
query_ AS (SELECT *, list_filter(string_split(substring(b, strpos(b, '?') + 1), '&'), lambda p: split_part(p, '=', 1) <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^("""
    + "|".join(url.TRACKING)
    + r""")')) AS kept FROM bare), pages AS (SELECT log_seq, source, title, """
    + _PAGE
    + " AS page FROM query_)"
)


def _has(column: str, word: str) -> str:
    if not word.isascii():
        return f"contains(lower({column}), '{word}')"
    return f"(contains(lower({column}), '{word}') AND regexp_matches(lower({column}), '(^|[^a-z0-9]){re.escape(word)}([^a-z0-9]|$)'))"


_SCAN = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, '{w}' AS matched, text, length(regexp_extract(lower(text), '(?s)^(.*?)" + (f"(^|[^a-z0-9]){re.escape(w)}([^a-z0-9]|$)', 1)) + length(regexp_extract(lower(text), '(?s)^(.*?)(^|[^a-z0-9]){re.escape(w)}([^a-z0-9]|$)', 2))" if w.isascii() else f"{w}', 1))") + f" AS p FROM documents WHERE {_has('text', w)}"
    for kind, ws in lexicon.OFFER_WORDS.items()
    for w in ws
)
_FIRST_VENDOR = "CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{v}'" for w, v in TEST_VENDORS) + " ELSE '' END"
ORACLES = {
    "title_key": "WITH " + key_sql("deals", "title", "q") + " SELECT log_seq, k AS key FROM q WHERE title IS NOT NULL UNION ALL SELECT log_seq, NULL FROM deals WHERE title IS NULL",
    "url_normalize": _PAGES + " SELECT log_seq, page FROM pages",
    "fingerprint": _PAGES + " SELECT log_seq, substring(sha256(CASE WHEN coalesce(page, '') <> '' THEN page ELSE coalesce(source, '') || '|' || lower(trim(coalesce(title, ''))) END), 1, 32) AS fp FROM pages",
    "hosts": r"SELECT log_seq, regexp_extract(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*') AS host FROM deals",
    "clean_bodies": r"SELECT item_id, trim(regexp_replace(translate(regexp_replace(replace(replace(content_encoded, '&lt;', '<'), '&amp;', '&'), '<[^>]*>', ' ', 'g'), chr(10) || chr(9), '  '), '[ \t\r\f\v]+', ' ', 'g')) AS body FROM rss_items",
    "gated": "SELECT log_seq, NOT contains(b, 'waiting list') AND (contains(b, 'gpu') OR contains(b, 'tokens') OR contains(b, '免费')) AS ok FROM (SELECT log_seq, lower(coalesce(title, '') || ' ' || coalesce(summary, '')) AS b FROM deals)",
    "noise": "SELECT doc_id, coalesce(" + " OR ".join(f"contains(lower(text), '{w}')" for w in lexicon.NOISE_WORDS) + ", false) AS noise, coalesce(contains(lower(text), 'waiting list') OR contains(lower(text), '排队'), false) AS waits FROM documents",
    "bounded_words": "SELECT doc_id, " + ", ".join(f"{_has('text', w)} AS has_{i}" for i, w in enumerate(("off", "free", "gb", "for everyone", "免费"))) + " FROM documents",
    "offer_scan": f"WITH s AS ({_SCAN}), w AS (SELECT *, least(greatest(p - 16, 0) + 80, length(text)) AS hi FROM s) SELECT doc_id, kind, matched, {_FIRST_VENDOR} AS vendor, trim(regexp_replace(substring(text, greatest(least(greatest(p - 16, 0), hi - 80), 0) + 1, hi - greatest(least(greatest(p - 16, 0), hi - 80), 0)), '\\s+', ' ', 'g')) AS evidence FROM w",
    "vendor_extract": "SELECT doc_id, " + ", ".join(f"array_to_string(list_filter(v{i}, lambda x, k: list_position(v{i}, x) = k), ',') AS {n}" for i, n in enumerate(("vendors", "listed"))) + " FROM (SELECT doc_id, " + ", ".join("list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{v}' END" for w, v in pairs) + f"], lambda x: x IS NOT NULL) AS v{i}" for i, pairs in enumerate((lexicon.vendor_needles(), TEST_VENDORS))) + " FROM documents)",
    "product_extract": "SELECT log_seq, trim(regexp_extract(title, '" + lexicon.PRODUCT + r"')) AS known, trim(regexp_extract(title, '[A-Z][a-z]{5,}-\d+\.\d+')) AS product FROM deals",
    "discount_stated": r"""SELECT log_seq, greatest(coalesce((10 - try_cast(nullif(regexp_extract(b, '([1-9])\s*折', 1), '') AS int)) * 10, 0), coalesce(list_max(list_filter(list_transform(list_concat(regexp_extract_all(b, '(?i)(\d{1,3})\s*%\s*(?:off|折扣|减免|降价)', 1), regexp_extract_all(b, '(?i)(?:off|discount|折扣)\D{0,12}?(\d{1,3})\s*%', 1)), lambda x: try_cast(x AS int)), lambda n: n BETWEEN 5 AND 100)), 0))::int AS pct FROM (SELECT log_seq, concat_ws(chr(10), title, summary) AS b FROM deals)""",
    "title_words": r"SELECT log_seq, array_to_string(list_filter(regexp_extract_all(title, '[\p{Han}]+|[A-Za-z0-9.\-]+'), lambda w: strlen(w) >= 2 AND NOT list_contains(['" + "','".join(lexicon.STOP_WORDS) + "'], lower(w)))[1:4], ' ') AS words FROM deals",
    "text_blobs": "SELECT log_seq, md5(array_to_string(list_concat([coalesce(title, ''), coalesce(summary, '')], coalesce(list_transform(offers, lambda o: coalesce(o.evidence, '')), [])), chr(10))) AS blob FROM deals",
    "first_stated": "SELECT item_id, coalesce(CASE WHEN trim(content_encoded) <> '' THEN content_encoded END, CASE WHEN trim(description) <> '' THEN description END, CASE WHEN trim(title) <> '' THEN title END, '') AS body FROM rss_items",
    "truncations": "SELECT log_seq, CASE WHEN length(summary) > 40 THEN trim(substring(summary, 1, 39)) || '…' ELSE summary END AS a, CASE WHEN length(summary) > 40 THEN substring(summary, 1, 40) || '…' ELSE summary END AS b, CASE WHEN length(summary) > 40 THEN substring(summary, 1, 39) || '…' ELSE summary END AS c FROM deals",
    "compact_state": _FOLD + ", " + _PAGES[5:] + f""", kept AS (SELECT fingerprint FROM folded WHERE NOT (discovered_at < timestamptz '{NOW_TEXT}+00' - interval 3 day AND (coalesce(meta['pushed'], '') = 'true' OR coalesce(score, 0) < 60)))
SELECT 'official:deal:' || fingerprint AS key FROM kept UNION SELECT 'official:verify:' || page FROM pages JOIN deals USING (log_seq) WHERE trim(url) <> '' AND trim(fingerprint) <> ''""",
    "secret_scan": "SELECT log_seq, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(t, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in text.SECRETS.items()) + ") AS classes FROM (SELECT log_seq, concat_ws(' ', fingerprint, summary) AS t FROM deals)",
    "redact_text": "SELECT log_seq, 'seen: ' || log_seq || ', api_key = ''' || m || '''; Authorization: Bearer ' || m || '; password=' || CASE WHEN length(f) < 4 THEN f ELSE repeat('*', least(6, length(f))::int) END AS safe FROM (SELECT log_seq, f, CASE WHEN length(f) <= 8 THEN repeat('*', length(f)::int) ELSE substring(f, 1, 4) || '…****' || right(f, 2) END AS m FROM (SELECT log_seq, coalesce(fingerprint, 'none') AS f FROM deals))",
    "redact_urls": r"""SELECT log_seq, CASE WHEN trim(url) = '' THEN '' ELSE regexp_extract(url, '^[^?#]*') END AS shown,
  CASE WHEN NOT contains(url, '?') THEN url ELSE split_part(url, '?', 1) || '?' || array_to_string(list_transform(list_sort(list_distinct(list_transform(list_filter(string_split(split_part(split_part(url, '?', 2), '#', 1), '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1)))), lambda p: p || '=***'), '&') || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END END AS named,
  'https://' || (CASE WHEN length('user' || log_seq) <= 8 THEN repeat('*', length('user' || log_seq)::int) ELSE 'user…****' || right('r' || log_seq, 2) END) || '@***@h.example/a/hook/' || substring(h, 1, 4) || '…****' || substring(h, 19, 2) AS hook
FROM (SELECT log_seq, trim(url) AS url, sha256(log_seq::varchar) AS h FROM deals)""",
    "decode_entities": "SELECT doc_id, md5(text) AS plain, md5(replace(replace(text, '&', '&amp;'), '€', '&#8364;')) AS kept FROM documents",
    "resolve_url": r"""SELECT page_id, pos, CASE WHEN coalesce(trim(href), '') = '' THEN '' WHEN regexp_matches(trim(href), '^[a-z]+://') THEN trim(href) WHEN starts_with(trim(href), '#') THEN regexp_replace(url, '#.*', '') || trim(href)
  WHEN starts_with(trim(href), '/') THEN regexp_extract(url, '^[a-z]+://[^/]*') || trim(href) END AS absolute FROM html_segments""",
    "search_queries": r"SELECT log_seq, CASE WHEN coalesce(host, '') <> '' THEN CASE WHEN p <> '' THEN p || ' ' ELSE '' END || CASE WHEN is_free THEN '免费 额度' ELSE '价格 优惠' END || ' site:' || host END AS query FROM (SELECT log_seq, source, is_free, trim(regexp_extract(coalesce(title, ''), '[A-Z][a-z]{5,}-\d+\.\d+')) AS p FROM deals) LEFT JOIN (SELECT name, host FROM feed_sources) ON source = name",
    "offer_order": "SELECT log_seq, array_to_string(list_transform(list_sort(list_transform(offers, lambda o, i: struct_pack(k := o.kind, m := o.matched, i := i))), lambda x: x.k || ':' || x.m), ',') AS offers, array_to_string(list_sort(vendors), ',') AS vendors, array_to_string(list_sort(tags), ',') AS tags FROM deals",
    "parsed_hosts": r"SELECT log_seq, lower(regexp_extract(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host FROM deals",
    "sql_surface": _PAGES + ",\n" + key_sql("deals", "title", "q") + r""", d AS (SELECT log_seq, greatest(coalesce((10 - try_cast(nullif(regexp_extract(b, '([1-9])\s*折', 1), '') AS int)) * 10, 0), coalesce(list_max(list_filter(list_transform(list_concat(regexp_extract_all(b, '(?i)(\d{1,3})\s*%\s*(?:off|折扣|减免|降价)', 1), regexp_extract_all(b, '(?i)(?:off|discount|折扣)\D{0,12}?(\d{1,3})\s*%', 1)), lambda x: try_cast(x AS int)), lambda n: n BETWEEN 5 AND 100)), 0))::int AS pct FROM (SELECT log_seq, concat_ws(chr(10), title, summary) AS b FROM deals))
SELECT q.log_seq, CASE WHEN q.title IS NOT NULL THEN k END AS key, page, pct FROM q JOIN pages ON q.log_seq = pages.log_seq JOIN d ON q.log_seq = d.log_seq""",
}
