"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, by how their names begin.
TRACKING = ("utm_", "spm", "from", "ref", "share_", "scene", "clickid", "msclkid", "gclid", "force_", "abtest", "callback", "timestamp", "sign")


def normalize_url(url: Column) -> Column:
    """The page a URL leads to: no scheme, no ``www.``, no tracking parameters, no trailing slash, no anchor, lower case.

    A slash is only trimmed where the whole ends in one before its anchor is cut. Null stays null, blank becomes ''.
    """
    bare = F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), "^https://", ""), "^http://", ""), F.lit("www."), F.lit(""))
    cut = F.instr(bare, "?")
    query = F.substr(bare, cut + 1)
    tracks = "^(?:" + "|".join(TRACKING) + ")"
    kept = F.filter(F.split(query, "&"), lambda p: (F.substring_index(p, "=", 1) != "") & ~F.lower(F.substring_index(p, "=", 1)).rlike(tracks))
    base = F.substr(bare, F.lit(1), cut - 1)
    whole = F.when(cut == 0, bare).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))
    return F.lower(F.regexp_replace(F.regexp_replace(whole, r"/\z", ""), "(?s)#.*", ""))


def fingerprint(url: Column, source: Column, title: Column) -> Column:
    """The identity of a finding: 32 hex digits of the hash of its page, or of source and title if it has none."""
    page = F.coalesce(normalize_url(url), F.lit(""))
    other = F.concat(F.coalesce(source, F.lit("")), F.lit("|"), F.lower(F.trim(F.coalesce(title, F.lit("")))))
    return F.substring(F.sha2(F.when(page != "", page).otherwise(other), 256), 1, 32)


def host_of(url: Column) -> Column:
    """Host in lower case without user and port; works without a scheme; '' if there is none."""
    s = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    s = F.regexp_replace(s, "^[a-z][a-z0-9+.-]*://", "")
    s = F.regexp_extract(s, "^[^/?#]*", 0)
    s = F.regexp_replace(s, "^.*@", "")
    return F.regexp_replace(s, r":[^\]:]*\z", "")


def parsed_host(url: Column) -> Column:
    """Host in lower case of a URL with a scheme; '' for one without."""
    host = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(F.regexp_replace(host, r"^\[(.*)\]\z", "$1"))


def host_suffixes(host: Column) -> Column:
    """Every dot-suffix of a host, the longest first."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
