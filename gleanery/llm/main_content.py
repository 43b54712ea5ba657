"""Main content of pages: the maximum-scoring run of segments, with weights learned from link-labelled pages."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.lookalikes import skeleton
from gleanery.session import drawn, spread

#: Pages and summaries the weights are learned from, about; both bound what the driver gathers.
TRAINING_PAGES = 1_200
TRAINING_SUMMARIES = 3_000
#: What every further region of a page costs, and the bound of a segment's score either way, so that no paragraph outweighs a whole menu.
REGION_COST, MOST = 2.0, 12.0
#: Features kept, the most frequent ones; it bounds the broadcast.
FEATURES = 60_000

_WORD = re.compile(r"[^\W\d_㐀-鿿]+|\d+|[㐀-鿿]+|[^\w\s]")
_BARS = frozenset("|›>/»·•")
_HAN = re.compile(r"[㐀-鿿]")


def words(text: str) -> list[str]:
    """Lower-case words, 0 for any number, pairs of neighbouring ideographs, and signs."""
    out: list[str] = []
    for w in _WORD.findall(skeleton(text).lower()):
        if w.isdigit():
            out.append("0")
        elif w in _BARS:
            out.append("|")
        elif _HAN.match(w) and len(w) > 1:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        else:
            out.append(w)
    return out


def features(ws: list[str], kind: str) -> set[str]:
    """What the score of a segment sums over: its tag, words, neighbouring words, and its short text as a whole."""
    out = {"#", f"@{kind}", *ws}
    out.update(f"{x} {y}" for x, y in zip(ws, ws[1:]))
    if len(ws) <= 12:
        out.add("=" + " ".join(ws))
    return out


def link_kind(href: str | None, host: str | None) -> str:
    """Where a segment links: nowhere, into the site's own navigation, to a named item, or out."""
    if href is None or not href.strip():
        return "none"
    href = href.strip()
    if href[0] == "#":
        return "nav:fragment"
    absolute = re.match(r"[a-z]+://([^/]*)", href, re.I)
    if absolute:
        if re.match(r"(?:ads?|adserver|banners?|clicks?)\d*\.", absolute[1], re.I):
            return "nav:ads"
        return "nav:self" if host and absolute[1].lower().endswith(host.lower()) else "out"
    parts = [p for p in href.split("/") if p]
    if not parts or parts[0].isdigit():
        return "nav:index"
    return "item" if len(parts) > 1 and not parts[-1].isdigit() else f"nav:{parts[0].lower()[:20]}"


def _count_weights(rows: list[set[str]], furniture: list[bool], first: bool) -> dict[str, float]:
    """Log-odds of the features from counts, positive for content."""
    count = (Counter(), Counter())
    for feats, f in zip(rows, furniture):
        count[f].update(feats)
    # at first much furniture is still among the unlabelled: a word speaks for furniture from a tenth of labelled uses
    shift = math.log(9) if first else math.log((count[0]["#"] + 1) / (count[1]["#"] + 1))
    out = {}
    for w, n in (count[0] + count[1]).most_common(FEATURES):
        if n >= 3 and w[0] not in "#@":
            out[w] = max(-4.0, min(4.0, math.log((count[0][w] + 0.3) / (count[1][w] + 0.3)) - shift))
    return out


def _logistic(rows: list[set[str]], furniture: list[bool], names: list[str], steps: int = 90, ridge: float = 3e-4) -> dict[str, float]:
    """Weights of the features by logistic regression (full batch, Adam)."""
    at = {w: i for i, w in enumerate(names)}
    ids = [[at[w] for w in feats if w in at] for feats in rows]
    flat = np.fromiter((i for r in ids for i in r), np.int64)
    length = np.array([len(r) for r in ids])
    start = np.concatenate(([0], np.cumsum(length)[:-1]))
    y = 1.0 - np.array(furniture, float)
    w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.add.reduceat(w[flat], start)))
        g = np.bincount(flat, np.repeat(p - y, length), len(names)) / len(y) + ridge * w / max(1, len(names)) * 1e2
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return dict(zip(names, w.round(3).tolist()))


def fit(segments: list[tuple[str | None, str | None, str | None]], summaries: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and tags for segments, and of words alone for running text; positive for content.

    Pages label themselves at first: a segment that links into the site's navigation is furniture. Segments without such a
    link, and the pieces of the summaries, are unlabelled and start as content. In each round the unlabelled get the
    label of their score and the weights are learned anew, at last by logistic regression.
    """
    parsed = [(words(t), link_kind(h, host)) for t, h, host in segments if t and t.strip()]
    parsed += [(ws, "none") for t in summaries for p in pieces(skeleton(t)) if (ws := words(p))]
    if not parsed:
        return {}, {}
    rows = [features(ws, kind) for ws, kind in parsed]
    fixed = [kind.startswith("nav:") for _, kind in parsed]
    furniture = list(fixed)
    for r in range(3):
        weights = _count_weights(rows, furniture, r == 0)
        furniture = [f or sum(weights.get(w, 0.0) for w in feats) < 0 for f, feats in zip(fixed, rows)]
    names = ["#", *(w for w, n in Counter(w for feats in rows for w in feats).most_common(FEATURES) if n >= 3 and w != "#")]
    weights = _logistic(rows, furniture, names)
    furniture = [f or sum(weights.get(w, 0.0) for w in feats) < 0 for f, feats in zip(fixed, rows)]
    return weights, _logistic(rows, furniture, [w for w in names if w[0] not in "@="])


def score(ws: list[str], kind: str, weights: dict[str, float]) -> float:
    """How much a segment is content: the sum over its words and its tag."""
    get = weights.get
    return sum(get(w, 0.0) for w in features(ws, kind))


def best_regions(scores: list[float], cost: float = math.inf) -> list[tuple[int, int]]:
    """Bounds of the contiguous regions with the greatest sum, less ``cost`` for each but the first; found in one scan.

    With an infinite cost it is the one maximum-scoring run. There is none if no score is positive. Of equal ones the shortest is taken.
    """
    inside, outside = -math.inf, -math.inf  # the best that ends inside a region at this place, or after one
    opened: list[tuple[bool, bool]] = []  # for each place, whether its region begins there, and whether as the first
    closed: list[bool] = []  # whether what is best outside after a place ends a region there
    for s in scores:
        first, again = 0.0, outside - cost
        if inside > 0 and inside >= again:
            inside, begin = inside + s, (False, False)
        elif again > first:
            inside, begin = again + s, (True, False)
        else:
            inside, begin = s, (True, True)
        opened.append(begin)
        closed.append(inside > outside)
        outside = max(outside, inside)
    out: list[tuple[int, int]] = []
    if outside <= 0:
        return out
    i = len(scores) - 1
    while True:
        while not closed[i]:
            i -= 1
        end = i + 1
        while not opened[i][0]:
            i -= 1
        out.append((i, end))
        if opened[i][1]:
            return out[::-1]
        i -= 1


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest sum; (0, 0) if no score is positive."""
    return next(iter(best_regions(scores)), (0, 0))


def furniture_of(page: list[tuple[str | None, str | None, str | None]], weights: dict[str, float], cost: float = REGION_COST) -> list[bool]:
    """For each segment of a page (text, href, host) in order, whether it is not main body.

    The body is what lies in the best regions of content scores: a block of furniture within the body splits it only if it outweighs
    the cost of one more region, and what stands alone among furniture is body only if it does. Whatever a segment scores itself, its
    region decides.
    """
    scores = [-5.0 if not t or not t.strip() else max(-MOST, min(MOST, score(words(t), link_kind(h, host), weights))) for t, h, host in page]
    out = [True] * len(scores)
    for lo, hi in best_regions(scores, cost):
        out[lo:hi] = [False] * (hi - lo)
    return out


_PIECE = re.compile(r"(?<=[。！？!?…）)🎉])\s*|(?<=[.])\s+|(?<=\S)\s{2,}|(?<=/\d)\s|(?<=/\d\d)\s|(?<=/\d\d\d)\s")


def pieces(text: str) -> list[str]:
    """Sentences and what stands between them."""
    return [p for p in _PIECE.split(text) if p and p.strip()]


def furniture_run(text: str, weights: dict[str, float]) -> float:
    """The strongest furniture evidence of a run of words in ``text``: the same scan on negated weights.

    The best run of each piece is scanned for, and the whole piece is scored with its bias.
    """
    best = 0.0
    get = weights.get
    for piece in pieces(skeleton(text)):
        ws = words(piece)
        best = max(best, -score(ws, "none", weights))
        steps = [-get(w, 0.0) - (get(f"{before} {w}", 0.0) if before else 0.0) for before, w in zip([None, *ws], ws)]
        lo, hi = best_run(steps)
        best = max(best, sum(steps[lo:hi]) - RUN_COST)
    return best


#: Furniture evidence from which a summary counts as carrying furniture, and what a run inside a piece costs.
SUMMARY_THRESHOLD, RUN_COST = 3.0, 3.6


def learn(segments: DataFrame, summaries: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights from about TRAINING_PAGES pages and TRAINING_SUMMARIES texts, chosen by thresholds on a hash; everything is classified with them."""
    pages = drawn(segments.select("page_id").distinct(), F.col("page_id"), TRAINING_PAGES)
    rows = segments.join(pages, "page_id", "left_semi").select("text", "href", "host").collect()
    texts = drawn(summaries.where(F.col("text").rlike(r"\S")), F.col("text"), TRAINING_SUMMARIES).select("text").distinct().collect()
    return fit(sorted((tuple(r) for r in rows), key=repr), sorted(r.text for r in texts))


def page_furniture(segments: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``page_id``, ``pos`` of each segment that is not main body; null and blank segments are not.

    A page is scanned in order where its segments meet; pages are independent, and only one page is held at a time.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page: list[tuple] = []
        current, out = None, []

        def flush() -> None:
            for row, drop in zip(page, furniture_of([r[2:] for r in page], weights)):
                if drop:
                    out.append(row[:2])

        for batch in batches:
            for row in zip(*(batch[c].tolist() for c in ("page_id", "pos", "text", "href", "host"))):
                if row[0] != current:
                    flush()
                    page, current = [], row[0]
                page.append(row)
            if out:
                yield pd.DataFrame(out, columns=["page_id", "pos"])
                out.clear()
        flush()
        if out:
            yield pd.DataFrame(out, columns=["page_id", "pos"])

    picked = segments.select(F.col("page_id").cast("long"), F.col("pos").cast("int"), "text", "href", "host").dropna(subset=["page_id", "pos"])
    return picked.repartition("page_id").sortWithinPartitions("page_id", "pos").mapInPandas(scan, "page_id long, pos int")


def text_furniture(rows: DataFrame, identifier: str, text: str, weights: dict[str, float]) -> DataFrame:
    """``identifier`` of each row whose text carries page furniture; null and blank texts carry none."""

    @F.pandas_udf("double")
    def evidence(s: pd.Series) -> pd.Series:
        return s.map(lambda t: furniture_run(t, weights) if t else 0.0)

    return spread(rows.select(identifier, text)).where(F.col(text).rlike(r"\S")).where(evidence(text) >= SUMMARY_THRESHOLD).select(identifier)


def boilerplate(segments: DataFrame, deals: DataFrame) -> DataFrame:
    """What is not main body: segments of pages and deals whose summary carries furniture, as ``rec``, ``rec_id``, ``pos``."""
    of_segments, of_text = learn(segments, deals.select(F.col("summary").alias("text")))
    a = page_furniture(segments, of_segments).select(F.lit("segment").alias("rec"), F.col("page_id").alias("rec_id"), "pos")
    b = text_furniture(deals, "log_seq", "summary", of_text).select(F.lit("deal").alias("rec"), F.col("log_seq").alias("rec_id"), F.lit(-1).alias("pos"))
    return a.unionByName(b).distinct()
