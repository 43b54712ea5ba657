"""Parsing of fetched documents: feeds, pages, JSON and search results, as Column expressions over the raw text."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gleanery.functions.text import clean_text, decode_entities, let, truncate

#: Tags whose end, or whose presence for ``br``, ends a block of a page. Fixed values.
BLOCKS = "li p div section article tr h1 h2 h3 h4 h5 h6 td th dd dt figcaption span a".split()


def between(text: Column, tag: str) -> Column:
    """The content of the first element of a name, without CDATA marks; '' if there is none."""
    inner = F.regexp_extract(text, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))


def all_between(text: Column, tag: str) -> Column:
    """The contents of all elements of a name, blank ones left out."""
    inner = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    bare = F.transform(inner, lambda c: F.trim(F.regexp_replace(c, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))
    return F.filter(bare, lambda c: c != "")


def feed_blocks(xml: Column) -> Column:
    """The items of a feed and then its entries, as raw text; works on feeds that are not well-formed."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    return F.concat(items, F.regexp_extract_all(xml, F.lit(r"(?is)<entry\b.*?</entry>"), F.lit(0)))


def first_of(*columns: Column) -> Column:
    """The first that is not blank, else ''."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns], F.lit(""))


def plain(text: Column) -> Column:
    """Entities decoded, tags and line breaks to blanks, blanks single."""
    return clean_text(decode_entities(text))


def feed_item(block: Column) -> Column:
    """An item or entry as a struct: title, link (alternate preferred), date as written, summary, guid, categories.

    Of an item the description comes before its content, of an entry the summary. A title that is missing is cut from the summary.
    """
    entry = block.rlike(r"(?is)^<entry\b")
    links = F.regexp_extract_all(block, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    alternate = F.filter(links, lambda x: ~x.rlike(r"(?i)\brel\s*=") | x.rlike(r"(?i)\brel\s*=\s*[\"'](?:alternate)?[\"']"))
    tag = F.coalesce(F.get(alternate, F.lit(0)), F.get(links, F.lit(0)), F.lit(""))
    href = F.regexp_extract(tag, r"(?i)\bhref\s*=\s*[\"']([^\"']*)", 1)
    of_item = first_of(*(between(block, t) for t in ("description", "content:encoded", "encoded", "content")))
    of_entry = first_of(between(block, "summary"), between(block, "content"))
    summary = truncate(plain(F.when(entry, of_entry).otherwise(of_item)), 500)
    title = plain(between(block, "title"))
    terms = F.filter(F.regexp_extract_all(block, F.lit(r"(?is)<category\b[^>]*?\bterm\s*=\s*[\"']([^\"']*)"), F.lit(1)), lambda t: F.trim(t) != "")
    return F.struct(
        F.when(title != "", title).otherwise(truncate(summary, 120)).alias("title"),
        F.when(entry, href).otherwise(first_of(between(block, "link"), href)).alias("link"),
        F.when(entry, first_of(between(block, "published"), between(block, "updated")))
        .otherwise(first_of(*(between(block, t) for t in ("pubDate", "updated", "dc:date", "date"))))
        .alias("stated"),
        summary.alias("summary"),
        F.when(entry, between(block, "id")).otherwise(between(block, "guid")).alias("guid"),
        F.when(entry, terms).otherwise(F.concat(all_between(block, "category"), all_between(block, "dc:subject"))).alias("categories"),
    )


_NOISE = r"(?is)<(?:script|style|noscript|template)[^>]*>.*?</(?:script|style|noscript|template)>"


def without_noise(html: Column) -> Column:
    """A page with its entities decoded, without scripts, styles and templates."""
    return F.regexp_replace(decode_entities(html), _NOISE, " ")


def html_blocks(html: Column) -> Column:
    """The blocks of a page in order, as structs of ``pos``, ``text``, ``href``: cut at the ends of blocks, blanks single, empty ones left out.

    ``html`` comes from :func:`without_noise`.
    """
    made = F.transform(
        F.split(html, rf"</(?:{'|'.join(BLOCKS)})>|<br\s*/?>"),
        lambda p: F.struct(
            clean_text(F.regexp_replace(p, r"(?s)<[^>]*(?:>|\z)", " ")).alias("text"),
            F.regexp_extract(p, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)[\"']", 1).alias("href"),
        ),
    )
    kept = F.filter(made, lambda b: b.text != "")
    return F.transform(kept, lambda b, i: F.struct(i.alias("pos"), b.text.alias("text"), b.href.alias("href")))


def html_items(blocks: Column, ok: Callable[[Column], Column], min_text: int = 10, most: int = 40) -> Column:
    """What a list page offers: structs of ``title``, ``link``, ``summary``, ``stated`` from its blocks in order.

    A block is passed over if it is shorter than ``min_text``, if its text was there before, whatever its case, or if ``ok`` of title and summary
    does not hold. A block without a link that is little more than a date dates the item of the block right before it. At most ``most`` items.
    """
    item = "struct<title:string,link:string,summary:string,stated:string>"

    def fold(b: Column) -> Column:
        keys = F.transform(b, lambda s: F.lower(s.text))
        marked = F.transform(b, lambda s, i: F.struct(s.text.alias("text"), s.href.alias("href"), (F.array_position(keys, F.lower(s.text)) == i + 1).alias("first")))

        def step(acc: Column, s: Column) -> Column:
            title, summary = truncate(s.text, 120), truncate(s.text, 700)
            date = F.when(s.href == "", row_date(s.text)).otherwise(F.lit(""))
            last = F.element_at(acc.out, -1)
            dated = F.struct(last.title.alias("title"), last.link.alias("link"), last.summary.alias("summary"), date.alias("stated"))
            made = F.struct(title.alias("title"), s.href.alias("link"), summary.alias("summary"), F.lit("").alias("stated"))
            state = lambda out, carry: F.struct(out.alias("out"), F.lit(carry).alias("carry"))
            return (
                F.when(F.size(acc.out) >= most, acc)
                .when((F.char_length(s.text) < min_text) | ~s.first, state(acc.out, False))
                .when((date != "") & acc.carry, state(F.concat(F.slice(acc.out, F.lit(1), F.size(acc.out) - 1), F.array(dated)), False))
                .when(~ok(F.concat(title, F.lit("\n"), summary)), state(acc.out, False))
                .otherwise(state(F.concat(acc.out, F.array(made)), True))
            )

        begin = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(False).alias("carry"))
        return F.aggregate(marked, begin, step)["out"]

    return let(blocks, fold)


def class_windows(html: Column, needle: str, size: int = 4000) -> Column:
    """A window of ``size`` characters from each occurrence of a needle, whatever its case; the whole page if it has none.

    Windows may overlap: the page is split at the needle, and every window runs on from its split.
    """
    low, word = F.lower(html), needle.lower()
    n = len(word)

    def windows(pieces: Column) -> Column:
        places = F.aggregate(
            F.slice(pieces, 1, F.size(pieces) - 1),
            F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found")),
            lambda s, p: F.struct((s.at + F.char_length(p) + n).alias("at"), F.array_append(s.found, s.at + F.char_length(p)).alias("found")),
        )["found"]
        return F.when(F.size(pieces) <= 1, F.array(html)).otherwise(F.transform(places, lambda a: F.substr(html, a, F.lit(size))))

    return let(F.split(low, "\\Q" + word + "\\E"), windows)


def row_date(text: Column) -> Column:
    """The date of a block that is little more than one, '' if it is not."""
    return F.when(F.char_length(text) <= 24, F.regexp_extract(text, r"(20\d{2}[-/]\d{1,2}[-/]\d{1,2})", 1)).otherwise("")


def search_hits(html: Column) -> Column:
    """The results of a search page, each URL once: structs of title, url (redirectors unwrapped), snippet.

    A result is a link of a result class, whichever attribute comes first; its snippet stands in the 1,200 characters after it. Results
    without a title or a target are left out.
    """
    anchors = F.regexp_extract_all(
        html, F.lit(r"(?is)<a\b[^>]*class=[\"'][^\"']*result[^\"']*[\"'][^>]*>.*?</a>.*?(?=<a\b[^>]*class=[\"'][^\"']*result|\z)"), F.lit(0)
    )

    def hit(a: Column) -> Column:
        href = F.trim(F.replace(F.regexp_extract(a, r"(?i)\bhref\s*=\s*[\"']([^\"']*)", 1), F.lit("&amp;"), F.lit("&")))
        whole = F.when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).otherwise(href)
        target = F.url_decode(F.regexp_extract(whole, r"[?&]uddg=([^&]*)", 1))
        title = clean_text(F.regexp_extract(a, r"(?is)^(<a\b.*?</a>)", 1))
        snippet = clean_text(F.substring(F.regexp_replace(a, r"(?is)^<a\b.*?</a>", ""), 1, 1200))
        return F.struct(title.alias("title"), F.when(F.contains(whole, F.lit("/l/?")), target).otherwise(whole).alias("url"), snippet.alias("snippet"))

    def once(hits: Column) -> Column:
        stated = F.filter(hits, lambda h: (h.title != "") & (h.url != ""))
        return let(stated, lambda k: F.filter(k, lambda h, i: F.array_position(F.transform(k, lambda x: x.url), h.url) == i + 1))

    return once(F.transform(anchors, hit))


def is_challenge(html: Column) -> Column:
    """Whether a search page asks for proof of being human instead of answering. Fixed values."""
    return html.rlike(r"(?i)anomaly-modal|/anomaly\.js|id=[\"']challenge-form[\"']|cc=botnet")


def _at(node: object, path: list[str]) -> object:
    for key in path:
        node = node.get(key) if isinstance(node, dict) else None
    return node


def _scalar(node: object) -> str | None:
    if node is None or isinstance(node, dict | list):
        return None
    if isinstance(node, bool):
        return "true" if node else "false"
    if isinstance(node, float):  # written out, without an exponent or a fraction of zero
        written = format(Decimal(repr(node)), "f")
        return written.rstrip("0").rstrip(".") if "." in written else written
    return str(node)


def json_rows(text: Column, items_path: str, fields: dict[str, str]) -> Column:
    """Rows under a dotted path as an array of maps, one entry per field found at its own path; an object counts as one row.

    The paths are a matter of configuration and may differ by source, so the tree is walked in Arrow batches.
    """
    where, paths = [p for p in items_path.split(".") if p], {k: v.split(".") for k, v in fields.items()}

    @F.pandas_udf("array<map<string,string>>")
    def walk(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict[str, str]] | None:
            try:
                node = _at(json.loads(t), where) if t else None
            except ValueError:
                return None
            rows = node if isinstance(node, list) else [node] if isinstance(node, dict) and node else []
            return [{k: v for k, p in paths.items() if (v := _scalar(_at(r, p))) is not None} for r in rows]

        return s.map(one)

    return walk(text)


def json_item(row: Column, url_prefix: str = "") -> Column:
    """A row of :func:`json_rows` with fields ``title``, ``summary``, ``url`` as a struct: a missing title is cut from the summary, relative
    URLs are joined to a prefix."""
    summary = plain(F.coalesce(row["summary"], F.lit("")))
    url = F.coalesce(row["url"], F.lit(""))
    joined = F.concat(F.lit(url_prefix.removesuffix("/") + "/"), F.regexp_replace(url, "^/", ""))
    return F.struct(
        first_of(row["title"], truncate(summary, 120)).alias("title"),
        (F.when((url != "") & ~F.startswith(url, F.lit("http")), joined).otherwise(url) if url_prefix else url).alias("url"),
        truncate(summary, 500).alias("summary"),
    )


def flatten_json(text: Column) -> Column:
    """``path=value`` of every scalar of a JSON text, sorted; nulls and empty strings are left out."""

    @F.pandas_udf(ArrayType(StringType()))
    def flat(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str] | None:
            try:
                todo = [("", json.loads(t))] if t else []
            except ValueError:
                return None
            out = []
            while todo:
                path, node = todo.pop()
                children = node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else None
                if children is not None:
                    todo += [(f"{path}.{k}" if path else str(k), v) for k, v in children]
                elif (v := _scalar(node)) not in (None, ""):
                    out.append(f"{path}={v}")
            return sorted(out)

        return s.map(one)

    return flat(text)


def resolve_url(base: Column, ref: Column) -> Column:
    """An absolute URL for a reference found on a page; null for scripts and mail, '' for nothing."""

    @F.pandas_udf(StringType())
    def join(b: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(b, r):
            y = (y or "").strip()
            out.append("" if not y else None if y.lower().startswith(("javascript:", "mailto:")) else urljoin(x or "", y))
        return pd.Series(out, dtype=object)

    return join(base, ref)
