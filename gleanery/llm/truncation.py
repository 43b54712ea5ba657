"""Texts cut off by field limits: right-censored length fits per source, combined with how the text ends."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.lookalikes import skeleton
from gleanery.session import keep, spread

#: An opening is judged by its counts from so many sentences on.
MIN_SENTENCES = 6
#: Of sentences that are complete without an end fewer than this share have one.
SIGNED_SHARE = 0.1
#: Bounds of the log odds that an unended sentence is complete as it stands: however many sentences speak for it, however many against it, and
#: if none is known.
COMPLETE, INCOMPLETE, UNKNOWN = 7.0, -6.0, -4.0
#: What an open end says by itself, as log odds of a cut.
OPEN_END = 1.1
#: A length is a candidate limit if so many texts of the source have exactly it, and so many times what its neighbours have.
LIMIT_COUNT, LIMIT_EXCESS = 5, 5.0
#: No length says more than this about its texts, and no source has fewer texts cut elsewhere.
SUREST, RAREST = 0.98, 0.02

_TAG = re.compile(r"<[^<>]*>")
_NAME = re.compile(r"[A-Z][a-z]{7,}(?:-[\d.]+)?(?:[- ](?:lite|pro|mini|flash|nano|turbo|max|Max|Turbo))*")
_HOST = re.compile(r"[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?![\w-])")
_DIGITS = re.compile(r"\d+")
_DOTS = re.compile(r"\.{3,}|…+")
_END = re.compile(r"[.!?]+[”\"'’»)\]]*(?=\s|$)|[。!?！？]+[”\"'’」』)]*")
_HYPHEN = re.compile(r"[^\W_]-…?$")
_OPEN_ENTITY = re.compile(r"&(?:#\d{0,6}|#x[0-9a-f]{0,5}|[A-Za-z]{1,8})$")
_OPEN_TAG = re.compile(r"<[A-Za-z/][^<>]*$|<$")
_LINK = re.compile(r"https?://\S*$")
_WHOLE_LINK = re.compile(r"https?://[\w.-]+\.[a-z]{2,}(?:/\S+)?$")
_BRACKETED = re.compile(r"\[\s*…\s*\]$|\(\s*…\s*\)$")
_START = re.compile(r"(?<=\s)[A-Z㐀-鿿©]")
_HAN = re.compile(r"[㐀-鿿]")


def plain(text: str) -> str:
    """The text without tags, in one form of its characters, every run of dots one ellipsis."""
    return _DOTS.sub("…", skeleton(_TAG.sub(" ", text)))


def sentences(text: str) -> list[tuple[str, bool]]:
    """Sentences of a plain text and whether each has its end; only the last may lack it."""
    out, at = [], 0
    for m in _END.finditer(text):
        if (piece := text[at : m.end()].strip()) and not _END.fullmatch(piece):
            out.append((piece, True))
        at = m.end()
    if rest := text[at:].strip():
        out.append((rest, False))
    return out


def openings(sentence: str) -> tuple[str, str]:
    """How a sentence begins, at two lengths, with names, hosts and numbers blanked."""
    s = _DIGITS.sub("0", _NAME.sub("N", _HOST.sub("D", sentence[:80]))).rstrip("… ")
    n = 6 if _HAN.search(s[:6]) else 12
    return s[:n], s[: n // 2]


def ending(text: str) -> tuple[str, str]:
    """What the end of a text shows: ``cut``, ``whole``, or ``open`` with the unended sentence."""
    raw = text.rstrip()
    if raw.endswith("�") or _OPEN_ENTITY.search(raw) or _OPEN_TAG.search(raw):
        return "cut", ""
    t = plain(raw)
    if not t:
        return "whole", ""
    if _BRACKETED.search(t) or _HYPHEN.search(t):
        return "cut", ""
    if link := _LINK.search(t):
        return ("whole" if _WHOLE_LINK.match(link.group()) else "cut"), ""
    last, ended = sentences(t)[-1] if sentences(t) else ("", True)
    if ended:
        return ("cut" if re.search(r"[A-Za-z]-\d+\.$", last) else "whole"), ""
    return "open", last


LOOKED = "kind string, source string, h long, state string, starts array<struct<long:string,short:string>>, opening string, ended double, unended double, copied double"


def look(texts: DataFrame) -> DataFrame:
    """Every text looked at once: ``texts`` has ``source``, ``h``, ``text``, ``copies`` and ``p``, the posterior that its length was a limit.

    Rows of kind ``text`` give how it ends and, for an open end, the ``starts`` its last sentence may have: phrases without an end follow
    one another without a sign between. Rows of kind ``count`` give, summed over a batch, how many sentences with an ``opening``
    have their end. A sentence that was cut at a limit says nothing about its kind, so unended ones count by 1 - ``p``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[float]] = {}
            texts: list[tuple] = []
            for source, h, text, copies, p in zip(*(batch[c].tolist() for c in ("source", "h", "text", "copies", "p"))):
                state, last = ending(text)
                starts = []
                if state == "open":
                    places = [0, *(m.start() for m in _START.finditer(last))]
                    starts = [dict(zip(("long", "short"), openings(last[at:]))) for at in places]
                texts.append(("text", source, h, state, starts, "", 0.0, 0.0, 0.0))
                for s, done in sentences(plain(text)):
                    for o in set(openings(s)):
                        c = counts.setdefault(o, [0.0, 0.0, 0.0])
                        if done:
                            c[0] += 1
                        else:
                            c[1] += 1 - p
                            c[2] += (1 - p) * copies
            texts += [("count", "", 0, "", [], o, *c) for o, c in counts.items()]
            yield pd.DataFrame(texts, columns=["kind", "source", "h", "state", "starts", "opening", "ended", "unended", "copied"])

    return texts.select("source", "h", "text", "copies", "p").mapInPandas(run, LOOKED)


def completeness(looked: DataFrame, weights: DataFrame) -> DataFrame:
    """``source``, ``h``, ``lo``: the log odds that each open text is complete as it stands, by how all sentences that begin alike end.

    ``weights`` has ``source``, ``h``, ``own``: what a text itself added to the unended sentences, which is no evidence for it. All openings
    of all texts are counted and joined; an opening that is cut short itself counts with all that begin so.
    """
    counts = keep(
        looked.where("kind = 'count'").groupBy("opening").agg(*(F.sum(c).alias(c) for c in ("ended", "unended", "copied")))
    )
    prefixes = counts.where("ended > 0").select(F.explode(F.sequence(F.lit(1), F.char_length("opening") - 1)).alias("n"), "opening", "ended").where("n >= 1 and n < length(opening)")
    extended = prefixes.groupBy(F.substring("opening", F.lit(1), F.col("n")).alias("long")).agg(F.sum("ended").alias("more"))
    starts = looked.where("kind = 'text' and state = 'open'").select("source", "h", F.posexplode("starts").alias("k", "o"))
    starts = starts.select("source", "h", "k", "o.long", "o.short").join(weights, ["source", "h"])
    named = lambda key, names: counts.select(F.col("opening").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    found = starts.join(named("long", {"ended": "e1", "unended": "u1", "copied": "c1"}), "long", "left")
    found = found.join(named("short", {"ended": "e2", "unended": "u2"}), "short", "left").join(extended, "long", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    own = F.when(F.col("k") == 0, F.col("own")).otherwise(0.0)
    full = F.when(F.col("long").rlike("[㐀-鿿]"), 6).otherwise(12)
    more = F.when(F.char_length("long") < full, zero(F.col("more"))).otherwise(0.0)
    u1, u2 = F.greatest(F.lit(0.0), zero(F.col("u1")) - own), F.greatest(F.lit(0.0), zero(F.col("u2")) - own)
    e1, e2 = zero(F.col("e1")) + more, zero(F.col("e2"))
    found = found.select("source", "h", e1.alias("e1"), u1.alias("u1"), e2.alias("e2"), u2.alias("u2"), zero(F.col("c1")).alias("c1"), more.alias("more"))
    n1, n2 = F.col("e1") + F.col("u1"), F.col("e2") + F.col("u2")

    def graded(ended: Column, n: Column) -> Column:
        # the more sentences, the surer; at SIGNED_SHARE they speak neither way
        return F.greatest(F.lit(INCOMPLETE), F.least(F.lit(COMPLETE), 1.5 * F.log(n + 1) * (1 - (ended + 0.2) / (n + 1) / SIGNED_SHARE)))

    copies = (F.col("e1") + F.col("e2") == 0) & (F.col("c1") >= MIN_SENTENCES)  # no text ever ends it: copies are all there is to judge by
    lo = (
        F.when((n1 >= MIN_SENTENCES) | ((F.col("more") > 0) & (n1 > F.col("more"))), graded(F.col("e1"), n1))
        .when(n2 >= MIN_SENTENCES, graded(F.col("e2"), n2))
        .when(copies, 1.5 * F.log(F.col("c1") + 1))
        .otherwise(UNKNOWN)
    )
    return found.select("source", "h", lo.alias("lo")).groupBy("source", "h").agg(F.max("lo").alias("lo"))


def fit_censored(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, float]]:
    """Candidate limits of one source and the probability that a value of exactly that length was censored there.

    The uncensored lengths are log-normal; at each candidate limit a share q of the longer texts is cut. Mean, deviation and
    q are fitted by maximum likelihood (expectation-maximisation over which of the values at a limit are censored).
    """
    by = dict(zip(lengths.tolist(), counts.tolist()))
    total = sum(by.values())
    limits = []
    for n, k in by.items():
        around = [by.get(n + d, 0) for d in range(-10, 11) if d]
        if n > 20 and k >= LIMIT_COUNT and k > LIMIT_EXCESS * (sum(around) / len(around) + 0.25):
            limits.append(n)
    if not limits:
        return []
    x = np.log(np.maximum(lengths, 1).astype(float))
    w = counts.astype(float)
    mean, dev = float(np.average(x, weights=w)), max(0.1, float(np.sqrt(np.average((x - x.mean()) ** 2, weights=w))))
    at = [int(np.flatnonzero(lengths == n)[0]) for n in limits]
    q = np.full(len(limits), 0.5)
    post = np.full(len(limits), 0.5)
    for _ in range(60):
        z = (x[at] - mean) / dev
        density = np.exp(-0.5 * z * z) / (dev * math.sqrt(2 * math.pi) * lengths[at])
        tail = np.maximum(1e-9, np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z]))
        cut = q * tail
        post = cut / (cut + (1 - q) * density + 1e-300)
        censored = post * w[at]
        longer = np.array([w[lengths > n].sum() for n in limits])
        q = np.clip(censored / (censored + longer + 1e-9), 1e-4, 0.9999)
        # a censored value stands for the mean and square of the truncated tail beyond its limit
        hazard = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        beyond = mean + dev * hazard
        beyond2 = dev**2 * (1 + z * hazard) + 2 * mean * beyond - mean**2
        seen = w.copy()
        seen[at] -= censored
        mass = seen.sum() + censored.sum()
        new = float((seen @ x + censored @ beyond) / mass)
        var = float((seen @ (x * x) + censored @ beyond2) / mass) - new * new
        mean, dev = new, math.sqrt(max(var, 0.01))
    return [(int(n), float(p)) for n, p in zip(limits, post) if total]


def censoring(measured: DataFrame) -> DataFrame:
    """``source``, ``unit``, ``length``, ``posterior`` of the candidate limits of each source.

    ``measured`` has ``source``, ``unit``, ``length``. Only counts per length reach a task, one row per distinct length of a source.
    """
    counts = measured.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        found = fit_censored(pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame([(pdf["source"].iloc[0], pdf["unit"].iloc[0], n, p) for n, p in found], columns=["source", "unit", "length", "posterior"])

    return counts.groupBy("source", "unit").applyInPandas(fit, "source string, unit string, length int, posterior double")


def judged(texts: DataFrame) -> DataFrame:
    """``texts`` (``rec``, ``rec_id``, ``source``, ``text``) as ``rec``, ``rec_id``, ``source``, ``cut``.

    Null and blank texts are left out. Sources are told apart regardless of case and blanks around; a null source is one of its
    own. Repeated rows are judged alike. The log odds of a cut are those of the length, by the censoring posterior at a limit and by how
    often the source cuts elsewhere, plus what an open end says, less those that such a sentence is complete. A text whose last
    sentence has its end is complete, one that breaks within a sign, a tag or a word with a hyphen is cut.
    """
    source = F.coalesce(F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")), F.lit(""))
    stated = texts.where(F.col("text").rlike(r"\S")).select(
        "rec", "rec_id", F.concat_ws("/", "rec", source).alias("source"), F.xxhash64("text").alias("h"), F.char_length("text").alias("chars"), F.octet_length("text").alias("bytes"), "text"
    )
    # copies of one text say nothing about limits or openings, so every text counts once per source
    once = keep(stated.groupBy("source", "h").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"), F.any_value("chars").alias("chars"), F.any_value("bytes").alias("bytes")))
    limits = keep(censoring(once.select("source", F.inline(_units()))))
    for unit in ("chars", "bytes"):
        # a handful of limits per source
        one = limits.where(F.col("unit") == unit).select("source", F.col("length").alias(unit), F.col("posterior").alias(f"p_{unit}"))
        once = once.join(one, ["source", unit], "left")
    p = F.least(F.lit(SUREST), F.greatest(F.coalesce("p_chars", F.lit(0.0)), F.coalesce("p_bytes", F.lit(0.0))))
    once = once.select("source", "h", "text", "copies", p.alias("p"))
    looked = keep(look(spread(once)))
    measured = keep(once.select("source", "h", "p"))
    lo = completeness(looked, measured.select("source", "h", (1 - F.col("p")).alias("own")))
    ends = keep(looked.where("kind = 'text'").select("source", "h", "state").join(measured, ["source", "h"]).join(lo, ["source", "h"], "left"))
    # how often a source cuts where there is no limit
    loose = (F.col("state") == "cut") | (F.coalesce("lo", F.lit(COMPLETE)) < 0)
    base = ends.where(F.col("p") < 0.5).groupBy("source").agg(F.greatest(F.lit(RAREST), (F.count_if(loose) + 1) / (F.count("*") + 5)).alias("base"))
    q = F.greatest("p", F.coalesce("base", F.lit(0.2)))
    odds = F.log(q / (1 - q)) + OPEN_END - F.col("lo")
    cut = F.when(F.col("state") == "cut", True).when(F.col("state") == "whole", False).otherwise(odds >= 0)
    verdict = ends.join(base, "source", "left").select("source", "h", cut.alias("cut"))
    name = F.substring("source", F.instr("source", "/") + 1, F.char_length("source"))
    return stated.select("rec", "rec_id", "source", "h").join(verdict, ["source", "h"]).select("rec", "rec_id", name.alias("source"), "cut")


def _units() -> Column:
    return F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])


def _texts(deals: DataFrame, hits: DataFrame) -> DataFrame:
    a = deals.select(F.lit("deal").alias("rec"), F.col("log_seq").alias("rec_id"), "source", F.col("summary").alias("text"))
    return a.unionByName(hits.select(F.lit("hn").alias("rec"), F.col("hit_id").alias("rec_id"), "source", F.col("story_text").alias("text")))


def truncated_records(deals: DataFrame, hits: DataFrame) -> DataFrame:
    """``rec``, ``rec_id``, ``source`` of the deals and hits whose text was cut."""
    return judged(_texts(deals, hits)).where("cut").select("rec", "rec_id", "source").distinct()


def truncation_by_source(deals: DataFrame, hits: DataFrame) -> DataFrame:
    """How often each source truncates: ``source``, ``texts``, ``truncated``, ``share``."""
    counts = judged(_texts(deals, hits)).groupBy("source").agg(F.count("*").alias("texts"), F.count_if("cut").alias("truncated"))
    return counts.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 4))
