"""The read interface: findings, sources, events and the state of things as JSON over WSGI, and as tables of text."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from urllib.parse import parse_qs

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import clamp
from gleanery.operators import history, rounds

HEADERS = [
    ("Cache-Control", "no-store"),
    ("X-Content-Type-Options", "nosniff"),
    ("X-Frame-Options", "DENY"),
    ("Referrer-Policy", "no-referrer"),
    ("Content-Security-Policy", "default-src 'self'; connect-src 'self'; base-uri 'none'; frame-ancestors 'none'"),
]
#: The newest findings that a page is taken from.
SCANNED = 2_000


def page(folded: DataFrame, query: dict[str, str]) -> dict:
    """A page of findings, newest first, and how many of those scanned are reposts, whatever the page shows."""
    newest = history.recent(folded, SCANNED)
    found = history.find(
        newest, clamp(query.get("min"), 0, 0, 100), query.get("category", ""), query.get("source", ""), query.get("q", ""), query.get("dupes") == "1"
    )
    rows = found.orderBy(F.desc("discovered_at"), F.asc("first_seq")).limit(clamp(query.get("limit"), 50, 0, 500)).collect()  # 500 at most
    count = newest.where(F.col("dup_of").isNotNull()).count()
    return {"count": len(rows), "deals": [r.asDict(recursive=True) for r in rows], "folded_duplicates": count}


def status(folded: DataFrame, state: DataFrame, sources: DataFrame, now: Column, min_score: int = 40) -> dict:
    """One document of what is kept, what a briefing would carry and how much of it is the vendors' own."""
    s = history.stats(folded).first()
    live = history.live(folded, now, min_score).agg(F.count("*").alias("n"), F.count_if(F.size("vendors") > 0).alias("v")).first()
    held = sources.agg(F.count("*").alias("n"), F.count_if(~F.coalesce("disabled", F.lit(False))).alias("on")).first()
    return {
        "store": {
            "deals_seen": s.findings, "duplicates": s.reposts, "pushed": s.pushed, "cursors": state.count(), "oldest": s.first_found or "", "newest": s.last_found or "",
            "live_in_briefing": live.n, "live_verified": live.v,
        },
        "sources": {"configured": held.n, "enabled": held.on},
    }


class ReadApi:
    """A WSGI application over tables that are read anew for every request; it only answers GET and HEAD."""

    def __init__(self, log: Callable[[], DataFrame], sources: DataFrame, state: Callable[[], DataFrame], now: Callable[[], Column], reports: Callable[[], list[dict]]) -> None:
        self.log, self.sources, self.state, self.now, self.reports = log, sources, state, now, reports
        self.routes: dict[str, Callable[[dict[str, str]], object]] = {
            "/healthz": lambda q: {"status": "ok"},
            "/api/v1/deals": lambda q: page(self.folded(), q),
            "/api/v1/status": lambda q: status(self.folded(), self.state(), self.sources, self.now()),
            "/api/v1/sources": lambda q: [r.asDict() for r in self.health().collect()],  # one row per source
            "/api/v1/runs": lambda q: self.reports()[-clamp(q.get("n"), 24, 1, 24) :],
            "/api/v1/events": lambda q: [r.asDict() for r in self.events().limit(500).collect()],
        }

    def folded(self) -> DataFrame:
        return history.fold_duplicates(history.collapse(self.log()))

    def health(self) -> DataFrame:
        idle = rounds.idleness(self.log(), self.sources, self.now())
        kept = rounds.delivery(history.collapse(self.log()), self.sources)
        verdict = rounds.health(F.col("idle"), F.col("rows"), F.lit(False))
        return idle.join(kept, "name", "left").select("name", "idle", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), verdict.alias("verdict"))

    def events(self) -> DataFrame:
        at = lambda k: history.meta_time(k)
        rows = self.folded().where(F.col("dup_of").isNull()).select("fingerprint", "title", at("starts_at").alias("starts_at"), at("expires_at").alias("ends_at"))
        return rounds.nearest_moments(rows, "fingerprint", self.now(), 24 * 30, 72 * 60).orderBy("moment", "title")

    def __call__(self, environ: dict, start_response: Callable) -> Iterable[bytes]:
        method, path = environ.get("REQUEST_METHOD", "GET"), environ.get("PATH_INFO", "/")
        query = {k: v[0] for k, v in parse_qs(environ.get("QUERY_STRING", "")).items()}
        try:
            if method not in ("GET", "HEAD"):
                code, body = "405 Method Not Allowed", {"error": "method_not_allowed"}
            elif path not in self.routes:
                code, body = "404 Not Found", {"error": "not_found"}
            else:
                code, body = "200 OK", self.routes[path](query)
        except Exception:  # an answer that fails shows nothing of why
            code, body = "500 Internal Server Error", {"error": "internal"}
        data = json.dumps(body, ensure_ascii=False, default=str).encode()
        start_response(code, [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(data))), *HEADERS])
        return [b"" if method == "HEAD" else data]


def text_table(rows: DataFrame, most: int = 100) -> str:
    """The first rows as a table of text with aligned columns."""
    held = [[("" if v is None else str(v)).replace("\n", " ") for v in r] for r in rows.limit(most).collect()]
    width = [max(map(len, column)) for column in zip(rows.columns, *held)]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(line, width)).rstrip() for line in [[c.upper() for c in rows.columns], *held])
