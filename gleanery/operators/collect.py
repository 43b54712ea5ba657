"""Collectors: from fetched bodies, catalogues and stored cursors to rows of findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import documents as doc
from gleanery.functions.text import clean_text, contains_any, keyword_gate, split_list, truncate
from gleanery.functions.url import fingerprint, parsed_host

# How a line states a price, a quota or a cut.
PRICE_FACT = (
    r"(?i)(?:[¥$￥]\s*\d|\d+(?:\.\d+)?\s*(?:元|折|%|/1k|/1m|tokens?|credits?)|免费|限时|赠送|试用|白送|no cost|free|credits|off|discount)"
)


def findings(rows: DataFrame, source: Column, category: Column, base: Column, now: Column, keywords: list[str], deny: list[str]) -> DataFrame:
    """Rows ``title``, ``link``, ``summary``, ``published_at`` as findings of a source.

    Titles and summaries are cleaned, summaries cut to 700 characters, links resolved against the source's own page. ``seen`` is true for
    every row with a title; ``kept`` for those that pass the gate. Rows without a title are left out.
    """
    title = clean_text(F.coalesce("title", F.lit("")))
    summary = truncate(clean_text(F.coalesce("summary", F.lit(""))), 700)
    made = rows.withColumns({"title": title, "summary": summary, "source": source, "category": category}).where(F.col("title") != "")
    resolved = doc.resolve_url(base, F.col("link"))
    made = made.withColumn("url", F.coalesce(resolved, F.trim("link")))
    return made.withColumns(
        {
            "fingerprint": fingerprint(F.col("url"), F.col("source"), F.col("title")),
            "discovered_at": now,
            "host": parsed_host(F.col("url")),
            "kept": keyword_gate(F.concat("title", F.lit("\n"), "summary"), keywords, deny),
        }
    )


def seen_and_kept(made: DataFrame) -> DataFrame:
    """Per source how many rows were seen and how many the gate kept."""
    return made.groupBy("source").agg(F.count("*").alias("seen"), F.count_if("kept").alias("kept"))


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of every key, by an aggregate, never by gathering the rows of a key."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    one = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(named)]).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r"))
    return one.select("_r.*")


def first_of_each(rows: DataFrame, key: str, order: list[str | Column], most: int | Column) -> DataFrame:
    """At most ``most`` rows of each key, in order.

    The rank filter is pushed below the shuffle as a group limit, so of a hot key only ``most`` rows of every partition are sent.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def page_text(html: Column) -> Column:
    """The visible text of an article page, in one line."""
    return clean_text(F.regexp_replace(doc.without_noise(html), r"(?s)<[^>]*(?:>|\z)", " "))


def follow_details(rows: DataFrame, pages: DataFrame, list_url: Column, least: int = 200, most: int = 2_000) -> DataFrame:
    """``rows`` (with ``url``, ``summary``) whose own page says more than ``least`` characters take its text, cut to ``most``, as summary.

    ``pages`` has one ``body`` per ``page_url``. The list page itself is never read as a detail, and a thin page, as of a server
    that asks to slow down, leaves the row as it is.
    """
    told = pages.select(F.col("page_url"), page_text(F.col("body")).alias("_detail"))
    joined = rows.join(told, (rows.url == told.page_url) & (rows.url != list_url), "left")
    return joined.withColumn("summary", F.when(F.char_length("_detail") >= least, truncate(F.col("_detail"), most)).otherwise(F.col("summary"))).drop("_detail", "page_url")


def fact_key(text: Column) -> Column:
    """What a fact is known by: 16 hex digits of the hash of its text, whatever its case and blanks."""
    return F.substring(F.sha2(normal(text), 256), 1, 16)


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def price_facts(lines: DataFrame, order: list[str], focus: str = "", keywords: list[str] | None = None, deny: list[str] | None = None, most: int = 30) -> DataFrame:
    """The price facts of each ``source``'s page, ``lines`` of ``source``, ``text`` and the columns of ``order``: with ``fact_key``.

    A fact states a price, quota or cut, holds ``focus`` if given, passes the gate and has eight characters or more; of equal ones the
    first counts, and of a page at most ``most``.
    """
    text = F.col("text")
    told = lines.where(text.rlike(PRICE_FACT) & keyword_gate(text, keywords or [], deny) & (F.char_length(normal(text)) >= 8))
    if focus:
        told = told.where(contains_any(text, [focus]))
    told = told.withColumn("fact_key", fact_key(text))
    return first_of_each(keep_first(told, ["source", "fact_key"], order), "source", order, most)


def new_facts(facts: DataFrame, known: DataFrame) -> DataFrame:
    """Facts that a source's cursor does not hold. ``known`` has ``source``, ``fact_key``; a source without any is at its baseline and gives nothing."""
    begun = known.select("source").distinct()
    return facts.join(begun, "source", "left_semi").join(known.select("source", "fact_key").distinct(), ["source", "fact_key"], "left_anti")


def cursor_after(facts: DataFrame, known: DataFrame) -> DataFrame:
    """The cursors after a pass: of every source that told facts its whole current set, of the others what was known."""
    current = facts.select("source", "fact_key").distinct()
    return current.unionByName(known.select("source", "fact_key").join(current.select("source").distinct(), "source", "left_anti"))


def zero_price(price: Column) -> Column:
    """Whether a price is stated and is exactly zero, however written; one that is missing or unreadable is not."""
    return F.coalesce(F.trim(price).try_cast("double") == 0, F.lit(False))


def free_flips(models: DataFrame, known: DataFrame | None, now_ms: int, grace_days: int = 14, most: int = 10) -> DataFrame:
    """Models that became free: ``models`` has ``model_id``, ``prompt``, ``completion``, ``created_ms``; ``known`` the ids that were free.

    Without a cursor (``known`` is None) only models created within ``grace_days`` count. The latest come first, at most ``most`` of them.
    """
    free = models.where(zero_price(F.col("prompt")) & zero_price(F.col("completion")))
    if known is None:
        new = free.where(F.col("created_ms") > now_ms - grace_days * 86_400_000)
    else:
        new = free.join(known.select("model_id").distinct(), "model_id", "left_anti")
    return new.orderBy(F.desc_nulls_last("created_ms"), "model_id").limit(most)


def next_query(queries: Column, site: Column, cursor: Column) -> Column:
    """The query whose turn it is, of a written list, and the cursor after it; null without queries."""
    listed = split_list(queries)
    turn = F.try_element_at(listed, (F.pmod(F.coalesce(cursor, F.lit(0)), F.greatest(F.size(listed), F.lit(1))) + 1).cast("int"))
    scoped = F.when(F.coalesce(site, F.lit("")) != "", F.concat(turn, F.lit(" site:"), site)).otherwise(turn)
    return F.when(F.size(listed) > 0, F.struct(scoped.alias("query"), (F.coalesce(cursor, F.lit(0)) + 1).alias("cursor")))


Collector = Callable[[DataFrame], DataFrame]


def _feed(pages: DataFrame) -> DataFrame:
    blocks = pages.select("source", "url", F.explode(doc.feed_blocks(F.col("body"))).alias("_b"))
    return blocks.select("source", "url", doc.feed_item(F.col("_b")).alias("i")).select("source", "url", "i.title", "i.link", "i.summary", "i.stated")


def _html(pages: DataFrame) -> DataFrame:
    blocks = pages.select("source", "url", doc.html_blocks(doc.without_noise(F.col("body"))).alias("_b"))
    items = blocks.select("source", "url", F.explode(doc.html_items(F.col("_b"), lambda t: F.lit(True))).alias("i"))
    return items.select("source", "url", "i.title", "i.link", "i.summary", "i.stated")


def _json(pages: DataFrame) -> DataFrame:
    fields = {"title": "title", "summary": "description", "url": "url", "stated": "published_at"}
    rows = pages.select("source", "url", F.explode(doc.json_rows(F.col("body"), "items", fields)).alias("m"))
    made = rows.select("source", "url", "m", doc.json_item(F.col("m")).alias("i"))
    return made.select("source", "url", "i.title", F.col("i.url").alias("link"), "i.summary", F.coalesce(F.col("m")["stated"], F.lit("")).alias("stated"))


def _search(pages: DataFrame) -> DataFrame:
    hits = pages.where(~doc.is_challenge(F.col("body"))).select("source", "url", F.explode(doc.search_hits(F.col("body"))).alias("h"))
    return hits.select("source", "url", "h.title", F.col("h.url").alias("link"), F.col("h.snippet").alias("summary"), F.lit("").alias("stated"))


#: What reads the bodies of each kind of source; more can be added.
REGISTRY: dict[str, Collector] = {"rss": _feed, "html": _html, "json": _json, "search": _search}


def collect(kind: str, pages: DataFrame) -> DataFrame:
    """Rows ``source``, ``url``, ``title``, ``link``, ``summary``, ``stated`` of fetched pages (``source``, ``url``, ``body``) of one kind."""
    if kind not in REGISTRY:
        raise ValueError(f"no collector for sources of kind {kind!r}; known are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](pages)
