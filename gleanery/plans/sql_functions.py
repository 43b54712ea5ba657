"""The functions of the engine for use in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import clock, text, url
from gleanery.functions.instants import utc_ms
from gleanery.schema import OFFER
from gleanery.sources.pages import PageSource

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|[A-Za-z_][A-Za-z_0-9.]*|\d+(?:\.\d+)?[LDF]?|->|<=>|<=|>=|<>|!=|\s+|.", re.S)
_INFIX = {"=", "<", ">", "<=", ">=", "<=>", "+", "-", "*", "/", "%", "and", "or"}


def infix(sql: str) -> str:
    """The text of a column expression, whose operators stand before their arguments, as the parser reads it."""
    tokens = _TOKEN.findall(sql)

    def group(i: int) -> tuple[list[str], int]:
        """The comma-separated parts of the parentheses that open at ``i``, and the place after them."""
        parts, now, i = [], [], i + 1
        while tokens[i] != ")":
            if tokens[i] == ",":
                parts.append("".join(now))
                now, i = [], i + 1
            else:
                piece, i = one(i)
                now.append(piece)
        return [*parts, "".join(now)], i + 1

    def one(i: int) -> tuple[str, int]:
        t = tokens[i]
        if t == "(":
            parts, i = group(i)
            return f"({', '.join(parts)})", i
        if i + 1 < len(tokens) and tokens[i + 1] == "(" and (t in _INFIX or t == "!"):
            parts, j = group(i + 1)
            if t == "!":
                return f"(NOT {parts[0]})", j
            return (f"({t}{parts[0]})" if len(parts) == 1 else "(" + f" {t} ".join(p.strip() for p in parts) + ")"), j
        return t, i + 1

    out, i = [], 0
    while i < len(tokens):
        piece, i = one(i)
        out.append(piece)
    return "".join(out)


def define(spark: SparkSession, name: str, parameters: str, returns: str, make: Callable[..., Column]) -> None:
    """Makes a column expression known to SQL as a function of its own, so that it stays inside the plan."""
    names = [p.split()[0] for p in parameters.split(", ")]
    body = infix(make(*map(F.col, names))._jc.node().sql())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")

#: Functions that are column expressions: name, parameters, what they return, and the expression.
FUNCTIONS: tuple[tuple[str, str, str, Callable[..., Column]], ...] = (
    ("normalize_url", "u STRING", "STRING", url.normalize_url),
    ("host_of", "u STRING", "STRING", url.host_of),
    ("fingerprint_of", "u STRING, s STRING, t STRING", "STRING", url.fingerprint),
    ("dedup_key", "t STRING", "STRING", text.dedup_key),
    ("clean_text", "t STRING", "STRING", text.clean_text),
    ("discount_pct", "t STRING", "INT", text.discount_pct),
    ("title_keywords", "t STRING", "STRING", text.title_keywords),
    ("expires_at", "t STRING, a TIMESTAMP", "TIMESTAMP", clock.expires_at),
    ("starts_at", "t STRING, a TIMESTAMP", "TIMESTAMP", clock.starts_at),
    ("scan_offers", "t STRING", f"ARRAY<{OFFER}>", text.scan_offers),
)


def register(spark: SparkSession) -> None:
    """Makes the functions of texts, URLs and clocks, ``scan_offers`` (an array, for ``inline`` over a subquery), ``scan_words`` and the ``pages`` source known to SQL."""

    @F.pandas_udf("bigint")
    def to_utc_ms(raw: pd.Series, zone: pd.Series) -> pd.Series:
        return pd.Series([utc_ms(r, z) for r, z in zip(raw, zone)], dtype="Int64")

    @F.udtf(returnType="word string, place int")
    class ScanWords:
        """Every occurrence of each word of a comma-separated list in a text, whatever its case."""

        def eval(self, body: str, words: str):  # noqa: ANN201
            low = (body or "").lower()
            for w in filter(None, (x.strip().lower() for x in (words or "").split(","))):
                at = low.find(w)
                while at >= 0:
                    yield w, at
                    at = low.find(w, at + 1)

    for name, parameters, returns, make in FUNCTIONS:
        define(spark, name, parameters, returns, make)
    spark.udf.register("decode_entities", text._decode)
    spark.udf.register("redact_text", text.redact)
    spark.udf.register("utc_ms", to_utc_ms)
    spark.udtf.register("scan_words", ScanWords)
    spark.dataSource.register(PageSource)
