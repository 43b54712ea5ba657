"""Text functions as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote_plus, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery import lexicon
from gleanery.schema import OFFER

#: ASCII letters and digits, what a word of an ASCII needle may not touch.
_WORD = "[a-z0-9]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; it also keeps the generated code of long rules small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strings(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column, needles: list[str]) -> Column:
    """Whether the text holds a needle, whatever the case; blank needles count for nothing."""
    low = F.lower(text)
    return either(*[F.contains(low, F.lit(n.lower())) for n in needles if n])


def keyword_gate(text: Column, keywords: list[str], deny: list[str] | None = None) -> Column:
    """No denied word, and a keyword if there are any."""
    ok = contains_any(text, keywords) if [k for k in keywords if k] else F.lit(True)
    return F.coalesce(~contains_any(text, deny or []) & ok, F.lit(False))


def is_noise(text: Column, words: list[str] = lexicon.NOISE_WORDS) -> Column:
    return F.coalesce(contains_any(text, words), F.lit(False))


def bounded(text: Column, needle: str) -> Column:
    """Whether a needle occurs; an ASCII one must stand alone as a word."""
    low = F.lower(text)
    if not needle.isascii():
        return F.contains(low, F.lit(needle.lower()))
    return F.contains(low, F.lit(needle.lower())) & low.rlike(f"(?<!{_WORD}){_quoted(needle.lower())}(?!{_WORD})")


def _quoted(word: str) -> str:
    return re.escape(word).replace("\\ ", " ")


def _alone(word: str) -> str:
    """A pattern of a lower-case ASCII word that stands alone; '' for other words, which need not."""
    return f"(?<!{_WORD}){_quoted(word)}(?!{_WORD})" if word.isascii() else ""


def _until(word: str) -> str:
    """A pattern whose group is all that comes before the first occurrence of a lower-case word that stands alone."""
    return f"(?s)^(.*?)(?<!{_WORD}){_quoted(word)}(?!{_WORD})" if word.isascii() else f"(?s)^(.*?){_quoted(word)}"


def evidence_window(text: Column, before: Column, span: int = 80, lead: int = 16) -> Column:
    """The text around a place: ``span`` characters from ``lead`` before it, moved back where the text ends; blanks collapsed."""
    n = F.char_length(text)
    hi = F.least(F.greatest(before - lead, F.lit(0)) + span, n)
    lo = F.greatest(F.least(F.greatest(before - lead, F.lit(0)), hi - span), F.lit(0))
    return F.trim(F.regexp_replace(F.substr(text, lo + 1, hi - lo), r"\s+", " "))


def vendors(text: Column, needles: list[tuple[str, str]] | None = None) -> Column:
    """Vendors named in a text, distinct, in byte order of the words that name them."""
    pairs = lexicon.vendor_needles() if needles is None else needles
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(v).alias("v")) for w, v in pairs])
    low = F.lower(text)
    return F.array_distinct(F.transform(F.filter(table, lambda p: F.contains(low, p.w)), lambda p: p.v))


def product(text: Column, pattern: str = lexicon.PRODUCT) -> Column:
    """The first versioned product name, '' if there is none."""
    return F.trim(F.regexp_extract(text, pattern, 0))


def scan_offers(text: Column, words: dict[str, list[str]] | None = None, vendor_words: list[tuple[str, str]] | None = None) -> Column:
    """Every offer a text names, in the order of the word lists: kind, word, first vendor, product, evidence.

    All words are sought in the text in lower case, which is made once; only for those it contains it is asked whether they stand alone.
    """
    listed = [
        F.struct(F.lit(kind).alias("kind"), F.lit(w).alias("matched"), F.lit(w.lower()).alias("low"), F.lit(_alone(w.lower())).alias("alone"), F.lit(_until(w.lower())).alias("until"))
        for kind, ws in (lexicon.OFFER_WORDS if words is None else words).items()
        for w in ws
    ]
    if not listed:
        return F.array().cast(f"array<{OFFER}>")

    def scan(low: Column) -> Column:
        held = F.filter(F.array(*listed), lambda w: F.contains(low, w.low))
        before = lambda w: F.char_length(F.call_function("regexp_extract", low, w["until"], F.lit(1)))
        # a word of another script is where it is first found; an ASCII one must stand alone
        place = lambda w: F.when(w["alone"] == "", F.instr(low, w.low) - 1).when(F.rlike(low, w["alone"]), before(w))
        placed = F.transform(held, lambda w: F.struct(w.kind.alias("kind"), w.matched.alias("matched"), place(w).alias("at")))
        alone = F.filter(placed, lambda w: w["at"].isNotNull())
        about = F.struct(F.coalesce(F.get(vendors(text, vendor_words), F.lit(0)), F.lit("")).alias("vendor"), product(text).alias("product"))
        made = lambda b: F.transform(
            alone,
            lambda o: F.struct(
                o.kind.alias("kind"), o.matched.alias("matched"), b.vendor.alias("vendor"), b["product"].alias("product"), evidence_window(text, o["at"]).alias("evidence")
            ),
        )
        return F.when(F.size(held) > 0, let(about, made)).otherwise(F.array().cast(f"array<{OFFER}>"))

    return let(F.lower(text), scan)


def offer_kinds(offers: Column) -> Column:
    """The kinds of offers, distinct in order, joined by commas."""
    return F.array_join(F.array_distinct(F.transform(offers, lambda o: o.kind)), ",")


def discount_pct(text: Column) -> Column:
    """The deepest cut stated: the first "N折", else any "N% off" or "off … N%" from 5 to 100; 0 if none."""
    # fixed values: how cuts are written
    zhe = F.regexp_extract(text, r"([1-9])\s*折", 1).try_cast("int")
    found = F.concat(
        F.regexp_extract_all(text, F.lit(r"(?i)(\d{1,3})\s*%\s*(?:off|折扣|减免|降价)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(r"(?i)(?:off|discount|折扣)\D{0,12}?(\d{1,3})\s*%"), F.lit(1)),
    )
    values = F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: (n >= 5) & (n <= 100))
    return F.greatest(F.coalesce((10 - zhe) * 10, F.lit(0)), F.coalesce(F.array_max(values), F.lit(0)))


def dedup_key(title: Column) -> Column:
    """What reposts of a title share: no wrapper or label in front, no punctuation, lower case; '' if too little is left.

    Wrappers close within 24 bytes; all of them are taken off, then up to two labels of one to six characters.
    """
    # fixed values: how wrappers and labels are written
    wrapper = r"^[ \t]*(?:\[[^\]]*\]|【[^】]*】|\([^)]*\)|（[^）]*）)"

    def unwrap(acc: Column, _: Column) -> Column:
        head = F.ltrim(F.regexp_extract(acc, wrapper, 0))
        closing = F.octet_length(head) - F.octet_length(F.right(head, F.lit(1)))
        return F.when((head != "") & (closing > 0) & (closing < 24), F.trim(F.regexp_replace(acc, wrapper, ""))).otherwise(acc)

    # a title has no more wrappers than opening brackets
    most = F.char_length(title) - F.char_length(F.translate(title, "[【(（", "")) + 1
    s = F.ltrim(F.aggregate(F.sequence(F.lit(1), F.coalesce(most, F.lit(1))), F.trim(title), unwrap))
    for _ in range(2):
        s = F.trim(F.regexp_replace(s, "^[^：:]{1,6}[：:]", ""))
    key = F.trim(F.regexp_replace(F.lower(F.regexp_replace(s, r"[^\p{IsHan}\p{L}\p{N}]+", " ")), " +", " "))
    return F.when(F.char_length(key) < 8, F.lit("")).otherwise(F.trim(F.substring(key, 1, 80)))


def clean_text(text: Column) -> Column:
    """Without tags and line breaks, blanks single, none at the ends. Entities are decoded before by :func:`decode_entities`."""
    # fixed values: what a tag is, and which blanks are single
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(text, r"(?s)<[^>]*>", " "), "\n\t", "  "), "[ \t\r\f\x0b]+", " "))


# How an entity is written.
_ENTITY = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]{1,9});")


def _entity(m: re.Match) -> str:
    body = m[1]
    if body[0] != "#":
        return lexicon.ENTITIES.get(body.lower(), m[0])
    number = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
    return chr(number) if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000 else m[0]


@F.pandas_udf(StringType())
def _decode(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or "&" not in t else _ENTITY.sub(_entity, t))


def decode_entities(text: Column) -> Column:
    """HTML entities decoded in one pass, so that nothing is decoded twice; unknown ones stay."""
    return F.when(F.contains(text, F.lit("&")), _decode(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)


@F.pandas_udf(StringType())
def _decode_unsafe(s: pd.Series) -> pd.Series:
    keep = {"amp", "lt", "gt", "quot", "apos"}
    return s.map(lambda t: t if t is None or "&" not in t else _ENTITY.sub(lambda m: m[0] if m[1][0] == "#" or m[1].lower() in keep else _entity(m), t))


def decode_xml_unsafe(text: Column) -> Column:
    """Only the named entities that XML does not define, so that a feed's escaped markup stays escaped until it is parsed."""
    return _decode_unsafe(text)


def split_list(text: Column) -> Column:
    """The entries of a list written with semicolons or line breaks, trimmed, blank ones left out."""
    parts = F.split(F.replace(text, F.lit(";"), F.lit("\n")), "\n")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def search_query(product: Column, is_free: Column, domain: Column) -> Column:
    """A query for the page of an offer on its vendor's own domain; null without a domain. The words asked for."""
    words = F.when(is_free, F.lit("免费 额度")).otherwise(F.lit("价格 优惠"))
    named = F.when(F.trim(F.coalesce(product, F.lit(""))) != "", F.concat(F.trim(product), F.lit(" "), words)).otherwise(words)
    return F.when(F.coalesce(domain, F.lit("")) != "", F.concat(named, F.lit(" site:"), domain))


def sorted_offers(offers: Column) -> Column:
    """Offers by kind and word, in byte order; equal ones keep their order."""
    keyed = F.transform(offers, lambda o, i: F.struct(o.kind.alias("k"), o.matched.alias("m"), i.alias("i"), o.alias("o")))
    return F.transform(F.array_sort(keyed, lambda a, b: F.when(F.struct(a.k, a.m, a.i) < F.struct(b.k, b.m, b.i), -1).otherwise(1)), lambda x: x.o)


def truncate(text: Column, n: int, keep_all: bool = False, strip: bool = True) -> Column:
    """At most ``n`` characters, the last an ellipsis; with ``keep_all`` the ellipsis comes after ``n`` characters."""
    head = F.substring(text, 1, n if keep_all else n - 1)
    return F.when(F.char_length(text) > n, F.concat(F.trim(head) if strip and not keep_all else head, F.lit("…"))).otherwise(text)


def text_blob(title: Column, summary: Column, offers: Column) -> Column:
    """Everything textual: title, summary and the evidence of the offers, by lines."""
    evidence = F.coalesce(F.transform(offers, lambda o: F.coalesce(o.evidence, F.lit(""))), F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))), evidence), "\n")


def coalesce_blank(*columns: Column) -> Column:
    """The first that is not blank, as it is; '' if none."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns], F.lit(""))


def ends_in_question(title: Column) -> Column:
    return F.regexp_replace(F.trim(title), r"[ ！!]+\z", "").rlike(r"(?:\?|？|吗|呢|吧|么)\z")


def claimable(title: Column, is_free: Column, pct: Column, offers: Column) -> Column:
    """An offer that can be taken: some signal of one, and no question or gripe."""
    signal = (
        F.coalesce(is_free, F.lit(False))
        | (F.coalesce(pct, F.lit(0)) > 0)
        | F.coalesce(F.exists(offers, lambda o: o.kind.isin("free", "discount", "trial", "credit", "coupon")), F.lit(False))
    )
    t = F.coalesce(title, F.lit(""))
    return ~(ends_in_question(t) | t.rlike(lexicon.DOUBT)) & signal


def title_keywords(title: Column, most: int = 6) -> Column:
    """The words of a title worth a search, joined by blanks: Han runs and words of two bytes or more, no stop words."""
    # fixed values: what a word is
    found = F.regexp_extract_all(title, F.lit(r"[\p{IsHan}]+|[A-Za-z0-9.\-]+"), F.lit(0))
    kept = F.filter(found, lambda w: (F.octet_length(w) >= 2) & ~F.lower(w).isin(lexicon.STOP_WORDS))
    return F.array_join(F.slice(kept, 1, most), " ")


# How a secret is assigned in a text.
_SECRET = re.compile(r"(?i)((?:authorization|api[_-]?key|secret|password|token|webhook)\s*[=:]\s*)([\"']?)((?:bearer|basic|digest|token)\s+)?([^\s,;'\"]{4,})", re.A)


def mask(secret: str) -> str:
    """A secret shortened so that it is known again but cannot be used."""
    s = secret.strip()
    return "*" * len(s) if len(s) <= 8 else f"{s[:4]}…****{s[-2:]}"


def mask_assignments(text: str) -> str:
    """``name: value`` secrets in a text masked; schemes and quotes stay."""
    return _SECRET.sub(lambda m: m[1] + m[2] + (m[3] or "") + mask(m[4]), text)


@F.pandas_udf(StringType())
def redact(s: pd.Series) -> pd.Series:
    """:func:`mask_assignments` of every text."""
    return s.map(lambda t: t if t is None else mask_assignments(t))


@F.pandas_udf(StringType())
def redact_url(s: pd.Series) -> pd.Series:
    """A URL that can be shown: no query, users masked, and what follows ``/hook/`` in the path; '' for a blank one."""

    def one(raw: str | None) -> str | None:
        if raw is None or not raw.strip():
            return raw if raw is None else ""
        try:
            u = urlsplit(raw)
        except ValueError:
            return mask(raw)
        user, at, host = u.netloc.rpartition("@")
        shown = f"{u.scheme}://" + (f"{mask(user.partition(':')[0])}@***@" if at else "") + host
        head, hook, tail = u.path.partition("/hook/")
        return shown + (head + hook + mask(tail) if hook else u.path)

    return s.map(one)


@F.pandas_udf(StringType())
def redact_query(s: pd.Series) -> pd.Series:
    """A URL whose parameters keep their names, sorted, and lose their values."""

    def one(raw: str | None) -> str | None:
        if not raw or "?" not in raw:
            return raw
        try:
            u = urlsplit(raw)
        except ValueError:
            return raw
        names = sorted({unquote_plus(p.partition("=")[0]) for p in u.query.split("&") if p})
        return urlunsplit(u._replace(query="&".join(f"{n}=***" for n in names))) if u.query else raw

    return s.map(one)


# Classes of credentials by how they are written.
SECRETS = {
    "assignment": r"(?i)\b(?:api[_-]?key|secret|password|token)\b\s*[=:]\s*[\"']?[^\s,;'\"]{8,}",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}",
    "basic": r"(?i)\bbasic\s+[A-Za-z0-9+/]{16,}={0,2}",
    "cloud_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "cloud_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "repository_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    "fine_token": r"\bgithub_pat_[A-Za-z0-9_]{20,}",
    "forge_token": r"\bglpat-[A-Za-z0-9_-]{16,}",
    "chat_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "chat_hook": r"https://hooks\.[a-z0-9.-]+/services/[A-Za-z0-9/]{16,}",
    "bot_hook": r"/open-apis/bot/v\d/hook/[A-Za-z0-9-]{8,}",
    "model_key": r"\bsk-[A-Za-z0-9_-]{16,}",
    "payment_key": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "package_token": r"\bnpm_[A-Za-z0-9]{30,}",
    "index_token": r"\bpypi-[A-Za-z0-9_-]{30,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "web_token": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    "url_password": r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]{3,}@",
    "private_host": r"\b(?:10\.\d{1,3}|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.\d{1,3}\.\d{1,3}\b",
    "carrier_host": r"\b100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d{1,3}\.\d{1,3}\b",
    "hex": r"\b[0-9a-f]{32,}\b",
}


def secret_classes(text: Column, classes: dict[str, str] | None = None) -> Column:
    """The classes of credentials a text holds, in order."""
    found = [F.when(text.rlike(p), F.lit(name)) for name, p in (SECRETS if classes is None else classes).items()]
    return F.filter(F.array(*found), lambda c: c.isNotNull())


def clamp(value: str | None, default: int, low: int, high: int) -> int:
    """A number given as text, within limits; the default if it is none or below."""
    try:
        n = int(value) if value is not None else default
    except ValueError:
        return default
    return default if n < low else min(n, high)
