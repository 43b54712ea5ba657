"""Evaluation passages inside training documents: the q-gram lemma on diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.lookalikes import skeleton
from gleanery.session import spread

#: Length of the character q-grams.
Q = 6
#: A leak holds so many words of the passage in order, or so many ideographs; of so many words at most EDITS are altered, added or missing.
MIN_WORDS, MIN_HAN, EDITS = 15, 30, 3
#: Matches less edits of a stretch of MIN_WORDS words that spends the whole budget.
LEAST_SCORE = MIN_WORDS - MIN_WORDS * (EDITS + 1) // (MIN_WORDS - EDITS - 1)
#: Width of a diagonal band in units; bands overlap by half. A stretch of under twice the least length, which any longer leak holds, shifts by fewer.
BAND = 24
#: Units without a common q-gram within which the hits of one leak follow each other.
GAP = 80
#: A word is an item's own if at most so many items have it.
RARE = 2
#: Letters in a row that make a phrase; one that more than RARE items have is a stock phrase. In Chinese, Q characters do.
STOCK = Q + 2
#: Evaluation items the workers hold; more are refused rather than dropped.
MAX_ITEMS = 100_000
#: Letters of documents that are hashed together.
CHUNK = 400_000

_UNIT = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def units(text: str) -> list[str]:
    """Words, and single ideographs, in lower case and one form of their characters, without punctuation."""
    return _UNIT.findall((text if text.isascii() else skeleton(text)).lower())


def letters(us: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the units run together, and for each letter the number of its unit."""
    codes = np.frombuffer("".join(us).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(us)), [len(u) for u in us])


def grams(codes: np.ndarray, size: int = Q) -> np.ndarray:
    """A 64-bit hash of every q-gram, or of every run of ``size`` letters."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    return h


def least_grams(sizes: list[int], window: int) -> int:
    """The q-grams that any stretch of ``window`` units keeps under the edit budget, by the q-gram lemma.

    A stretch of n letters has n - Q + 1 q-grams; an altered, added or missing unit of w letters destroys at most w + Q - 1 of them. The
    budget of EDITS units takes the longest ones. At least one q-gram is asked for.
    """
    least = None
    for i in range(max(1, len(sizes) - window + 1)):
        part = sizes[i : i + window]
        kept = sum(part) - Q + 1 - sum(w + Q - 1 for w in sorted(part)[-EDITS:])
        least = kept if least is None else min(least, kept)
    return max(1, least or 0)


class Items:
    """All evaluation items: their q-grams with places, the q-grams a leak must keep, and which words only one item has."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids = [r[0] for r in rows]
        self.units = [units(r[1]) for r in rows]
        self.placed: dict[int, dict[str, list[int]]] = {}
        held: dict[str, int] = {}
        first: dict[tuple[str, ...], int] = {}  # copies of an item are one item where it is counted who has what
        self.same = np.array([first.setdefault(tuple(us), i) for i, us in enumerate(self.units)], np.int64)
        for us in first:
            for u in set(us):
                held[u] = held.get(u, 0) + 1
        # what an item is about: long words that it repeats and hardly any other item has; failing that, does not repeat
        rare = [[u for u in us if held[u] <= RARE and len(u) >= Q and not u.isdigit()] for us in self.units]
        self.own = [{u for u in us if us.count(u) > 1} or set(us) for us in rare]
        hashes, item, place, own, coded, hans = [], [], [], [], [], []
        self.unit_of, self.unit_of_gram, least = [], [], []
        for i, us in enumerate(self.units):
            codes, at = letters(us)
            g = grams(codes)
            coded.append(codes)
            hashes.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
            inside = np.concatenate(([0], np.cumsum(np.array([us[k] in self.own[i] for k in at], int)))) if len(at) else np.zeros(1, int)
            own.append(inside[Q : Q + len(g)] - inside[: len(g)] == Q)
            self.unit_of.append(at)
            self.unit_of_gram.append(at[: len(g)])
            han = sum(len(u) == 1 and "㐀" <= u <= "鿿" for u in us) > len(us) / 2
            hans.append(han)
            # names and numbers within Chinese count by their letters, so a leak may have far fewer units
            least.append(least_grams([1] * MIN_HAN if han else list(map(len, us)), MIN_HAN if han else MIN_WORDS))
        self.least = np.array(least, np.int64)
        h, it, pl, ow = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place, own))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order].astype(np.uint64), it[order].astype(np.int64), pl[order].astype(np.int64)
        self.own_gram = ow[order].astype(bool)
        self.unit = np.concatenate(self.unit_of_gram)[order].astype(np.int64) if self.unit_of_gram else pl
        self.distinct, self.first, self.count = np.unique(self.hash, return_index=True, return_counts=True)
        # q-grams outside of what further items say alike; a passage of which they are half is no stock phrase, whatever its words
        self.rare_places = self._rare_places(coded, hans)
        begins = np.concatenate(([0], np.cumsum([len(x) for x in place])))
        flat = np.concatenate(self.rare_places) if self.rare_places else np.zeros(0, bool)
        self.rare_gram = flat[begins[self.item] + self.place]
        # some bits of a hash, to pass over most of a corpus without search; sixteen times as many as there are q-grams
        self.mask = np.uint64((1 << max(16, (16 * len(self.distinct)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(self.distinct & self.mask).astype(np.int64)] = True

    def _rare_places(self, coded: list[np.ndarray], hans: list[bool]) -> list[np.ndarray]:
        """Per item, which of its q-grams hold no letter of a run of STOCK letters, or Q ideographs, that more than RARE items have."""
        out = [np.zeros(max(0, len(c) - Q + 1), bool) for c in coded]
        for kind, size in ((False, STOCK), (True, Q)):
            of = [i for i, h in enumerate(hans) if h == kind]
            if not of:
                continue
            runs = [grams(coded[i], size) for i in of]
            _, which = np.unique(np.concatenate(runs), return_inverse=True)
            holders = np.unique(np.stack([which, np.repeat(self.same[of], list(map(len, runs)))]), axis=1)[0]
            shared = (np.bincount(holders) > RARE)[which] if len(which) else np.zeros(0, bool)
            for i, common in zip(of, np.split(shared, np.cumsum(list(map(len, runs)))[:-1])):
                ends = np.zeros(len(coded[i]) + 1, int)
                ends[: len(common)] += common
                ends[size : size + len(common)] -= common
                inside = np.concatenate(([0], np.cumsum(np.cumsum(ends[:-1]) > 0)))
                n = len(out[i])
                out[i] = inside[Q : Q + n] == inside[:n]
        return out

    def where(self, item: int) -> dict[str, list[int]]:
        """The places of each unit of an item."""
        got = self.placed.get(item)
        if got is None:
            got = self.placed[item] = {}
            for j, u in enumerate(self.units[item]):
                got.setdefault(u, []).append(j)
        return got

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``codes``, entry of an item's q-gram) for all q-grams that an item has."""
        g = grams(codes)
        none = np.zeros(0, np.int64)
        if not len(g) or not len(self.distinct):
            return none, none
        near = np.flatnonzero(self.bits[(g & self.mask).astype(np.int64)])
        at = np.searchsorted(self.distinct, g[near])
        at[at == len(self.distinct)] = 0
        hit = self.distinct[at] == g[near]
        near, at = near[hit], at[hit]
        n = self.count[at]
        return np.repeat(near, n), np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


Region = tuple[int, int, int, int, int]


def candidate_regions(pos: np.ndarray, entry: np.ndarray, unit_of: np.ndarray, items: Items, own: bool = True) -> list[Region]:
    """(item, from, to, lowest, highest diagonal), all in units, where a document shares enough q-grams with an item in one diagonal band.

    ``pos`` and ``entry`` are the hits of the document. A unit of whatever length that is added or missing shifts the diagonal by one, so the edits
    within the budget shift it by less than half a band; bands overlap by half, so every leak's q-grams lie in one band. A band is retained
    if it holds as many as the lemma leaves to the item's shortest leak. With ``own`` an item needs a q-gram within a word of its own, or half as
    many rare q-grams as that, which any leak that :func:`verified` lets pass has.
    """
    if not len(pos):
        return []
    item = items.item[entry]
    unit = unit_of[pos]
    diagonal = unit - items.unit[entry]
    low = diagonal.min()
    span = int((diagonal.max() - low) // BAND + 3)
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for shift in (0, BAND // 2):
        key = item * span + (diagonal - low + shift) // BAND
        order = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.diff(key[order], prepend=-1))
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(order)]):
            i = int(item[order[s]])
            if e - s < items.least[i]:
                continue
            rows = order[s:e]
            # hits far apart on one band are separate regions
            for part in [rows] if unit[rows[-1]] - unit[rows[0]] <= GAP else np.split(rows, np.flatnonzero(np.diff(unit[rows]) > GAP) + 1):
                hit = entry[part]
                if len(part) >= items.least[i] and (not own or items.own_gram[hit].any() or items.rare_gram[hit].sum() * 2 >= items.least[i]):
                    d = diagonal[part]
                    last = int(unit_of[min(int(pos[part[-1]]) + Q, len(unit_of)) - 1]) + 1
                    found.setdefault(i, []).append((int(unit[part[0]]), last, int(d.min()), int(d.max())))
    out = []
    for i, regions in found.items():
        regions.sort()
        merged = [list(regions[0])]
        for a, b, lo, hi in regions[1:]:
            m = merged[-1]
            if a <= m[1] + MIN_WORDS:
                m[1], m[2], m[3] = max(b, m[1]), min(lo, m[2]), max(hi, m[3])
            else:
                merged.append([a, b, lo, hi])
        out += [(i, a, b, lo, hi) for a, b, lo, hi in merged]
    return out


def aligned(doc: list[str], passage: list[str], lowest: int, highest: int, gain: int = 1) -> list[tuple[int, int]]:
    """Pairs of equal units of the best local alignment (match ``gain``, edit -1), in order, on the diagonals from ``lowest`` to ``highest``.

    The diagonal of a pair is its place in ``doc`` less that in ``passage``; only the cells of the band are filled.
    """
    n, width = len(passage), highest - lowest + 1
    best, end = 0, (0, 0)
    rows: list[list[int]] = []
    above = [0] * (width + 2)
    for i, u in enumerate(doc):
        row = [0] * (width + 2)  # cell k holds passage unit j = i - highest + k - 1; both rims stay 0
        base = i - highest - 1
        for k in range(max(1, -base), min(width, n - 1 - base) + 1):
            s = above[k] + (gain if u == passage[base + k] else -1)
            if (t := above[k + 1] - 1) > s:
                s = t
            if (t := row[k - 1] - 1) > s:
                s = t
            if s > 0:
                row[k] = s
                if s > best:
                    best, end = s, (i, k)
        rows.append(row)
        above = row
    pairs = []
    i, k = end
    while i >= 0 and rows and rows[i][k] > 0:
        s, j = rows[i][k], i - highest - 1 + k
        over = rows[i - 1] if i else [0] * (width + 2)
        if doc[i] == passage[j] and s == over[k] + gain:
            pairs.append((i, j))
            i -= 1
        elif s == over[k] - 1:
            i -= 1
        elif s == over[k + 1] - 1:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return pairs[::-1]


def holds(part: list[str], pairs: list[tuple[int, int]], item: int, items: Items, own: bool = True) -> bool:
    """Whether any stretch of the aligned pairs is a leak: long enough, within the edit budget, and, with ``own``, no stock phrase.

    A stretch is a stock phrase unless it holds half of the item's own words that stand in it, or half of its q-grams are rare ones.
    """
    n = len(pairs)
    if n < MIN_WORDS:
        return False
    at, to = np.array(pairs, np.int64).T
    matched = [part[i] for i in at.tolist()]
    count = np.arange(1, n + 1)
    sums = lambda x: np.concatenate(([0], np.cumsum(x)))
    size = sums([len(u) for u in matched])
    han = sums([len(u) == 1 and "㐀" <= u <= "鿿" for u in matched])
    if own:
        passage = items.units[item]
        words = [w for w in items.own[item] if w in passage[to[0] : to[-1] + 1]]
        seen = [(sums([u == w for u in passage]), sums([u == w for u in matched])) for w in words]
        # q-grams of the item all of whose units are matched side by side
        chain = np.concatenate(([0], np.cumsum((np.diff(at) != 1) | (np.diff(to) != 1))))
        run = np.full(len(passage), -1)
        run[to] = chain
        first, last = items.unit_of[item][: len(items.unit_of_gram[item])], items.unit_of[item][Q - 1 :]
        kept = (run[first] >= 0) & (run[first] == run[last])
        every = sums(np.bincount(first[kept], minlength=len(passage)))
        rare = sums(np.bincount(first[kept & items.rare_places[item]], minlength=len(passage)))
    for p in range(n - MIN_WORDS + 1):
        q = np.arange(p + MIN_WORDS - 1, n)
        m = count[q] - p
        span = np.maximum(at[q] - at[p], to[q] - to[p]) + 1
        # Chinese is measured in characters, those of the words and numbers within it included
        good = ((han[q + 1] - han[p]) * 2 <= m) | (size[q + 1] - size[p] >= MIN_HAN)
        good &= (span - m) * MIN_WORDS <= (EDITS + 1) * span
        if own and good.any():
            q = q[good]
            there, got = np.zeros(len(q), int), np.zeros(len(q), int)
            for a, b in seen:
                there += a[to[q] + 1] > a[to[p]]
                got += b[q + 1] > b[p]
            e, r = every[to[q] + 1] - every[to[p]], rare[to[q] + 1] - rare[to[p]]
            good = (got > 0) & (got * 2 >= there) | (r * 2 >= e) & (r * 2 >= items.least[item])
        if good.any():
            return True
    return False


def dense(part: list[str], where: dict[str, list[int]], lowest: int, highest: int) -> bool:
    """Whether the units with an equal one in the band are as close in any stretch as those of a leak are; nothing else needs an alignment."""
    surplus, least, before = 0, 0, [0] * MIN_WORDS  # of the stretch from the start, and the least of those MIN_WORDS units ago and earlier
    for i, u in enumerate(part):
        least = min(least, before[i % MIN_WORDS]) if i >= MIN_WORDS else 0
        before[i % MIN_WORDS] = surplus
        surplus += EDITS + 1 if any(lowest <= i - j <= highest for j in where.get(u, ())) else EDITS + 1 - MIN_WORDS
        if i >= MIN_WORDS - 1 and surplus >= min(least, before[(i + 1) % MIN_WORDS]):
            return True
    return False


def verified(doc: list[str], region: Region, items: Items, own: bool = True) -> bool:
    """Whether a region holds enough of the passage: its words in order within the edit budget, and, with ``own``, more than a stock phrase.

    The best local alignment is looked at first. It may end before an edit that the budget allows, or join stretches across more edits than that, so
    an alignment of cheaper edits follows, and what lies before and after in the document.
    """
    item, start, stop, lowest, highest = region
    passage = items.units[item]
    lo, hi = max(0, start - MIN_WORDS), min(len(doc), stop + MIN_WORDS)
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if not dense(doc[lo:hi], items.where(item), lowest - lo - 2 * EDITS, highest - lo + 2 * EDITS):
            continue
        part, band = doc[lo:hi], (lowest - lo - 2 * EDITS, highest - lo + 2 * EDITS)
        pairs = aligned(part, passage, *band)
        # a leak of the least length has so many more matches than edits, and a longer one more
        if 2 * len(pairs) - max(pairs[-1][0] - pairs[0][0], pairs[-1][1] - pairs[0][1]) - 1 < LEAST_SCORE if pairs else True:
            continue
        if holds(part, pairs, item, items, own) or holds(part, aligned(part, passage, *band, gain=2 * EDITS), item, items, own):
            return True
        todo += [(lo, lo + pairs[0][0]), (lo + pairs[-1][0] + 1, hi)]
    return False


def leaked(texts: list[str], items: Items, own: bool = True) -> list[tuple[int, int]]:
    """(number of the text, number of the item) of every leak in some texts; the texts are hashed together."""
    words = [units(t) for t in texts]
    sizes = [sum(map(len, us)) for us in words]
    codes = np.frombuffer("\0".join("".join(us) for us in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    pos, entry = items.hits(codes)
    if not len(pos):
        return []
    starts = np.concatenate(([0], np.cumsum(np.array(sizes) + 1)))
    text = np.searchsorted(starts, pos, "right") - 1
    # hits of items of which a text can hold no leak: too few, or none that is the item's own
    pair = text * len(items.ids) + items.item[entry]
    which, back, count = np.unique(pair, return_inverse=True, return_counts=True)
    least = items.least[which % len(items.ids)]
    able = count >= least
    if own:
        able &= (np.bincount(back, items.own_gram[entry]) > 0) | (np.bincount(back, items.rare_gram[entry]) * 2 >= least)
    keep = able[back]
    pos, entry, text = pos[keep], entry[keep], text[keep]
    bounds, out = np.flatnonzero(np.diff(text, prepend=-1)), []
    for s, e in zip(bounds.tolist(), [*bounds[1:].tolist(), len(pos)]):
        n = int(text[s])
        us = words[n]
        unit_of = np.repeat(np.arange(len(us)), [len(u) for u in us])
        done = set()
        for region in candidate_regions(pos[s:e] - starts[n], entry[s:e], unit_of, items, own):
            if region[0] not in done and verified(us, region, items, own):
                done.add(region[0])
                out.append((n, region[0]))
    return out


def leaks(documents: DataFrame, evaluation: DataFrame, own: bool = True) -> DataFrame:
    """``doc_id``, ``item_id`` of every document that holds a passage of an item, wholly or in part.

    Every document is read once, whole. Null and blank texts hold nothing; repeated documents and repeated items are
    reported each. A passage without a word of the item's own is a stock phrase that any text may share; with ``own`` false such passages
    are reported as well. The evaluation set is what the caller holds out, of MAX_ITEMS items at most: all of it goes to every worker.
    """
    rows = [(r.item_id, r.text) for r in evaluation.select("item_id", "text").where(F.col("text").rlike(r"\S")).limit(MAX_ITEMS + 1).collect()]
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} evaluation items; split them into several runs")
    if not rows:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(rows)
        for batch in batches:
            ids, texts, out, at = batch["doc_id"].tolist(), batch["text"].tolist(), [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                out += [(ids[at + n], items.ids[i]) for n, i in leaked(texts[at:to], items, own)]
                at = to
            yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")

    texts = spread(documents.select(F.col("doc_id").cast("long"), "text")).where(F.col("text").rlike(r"\S"))
    return texts.mapInPandas(scan, "doc_id long, item_id long").distinct()
