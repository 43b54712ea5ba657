"""One form for texts that look the same: vocabulary tries walked by a weighted edit automaton."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.session import keep, spread

#: At most so many vocabulary words are sent to the workers, the most frequent ones; it bounds the broadcast.
VOCABULARY_LIMIT = 60_000
#: A word enters the vocabulary once it occurs so often.
MIN_COUNT = 3
#: Copies of one spelling that are paired with every copy of another spelling; later copies pair with the first ones only.
COPIES = 8

# Letters of other scripts and the Latin letters they look like, in two rows each.
_CYRILLIC = "АВЕЅІЈКМНОРСТУХԌԚԜаеһіјорсѕухԁԛԝѵ"
_CYRILLIC_AS = "ABESIJKMHOPCTYXGQWaehijopcsyxdqwv"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοϲν"
_GREEK_AS = "ABEZHIKMNOPTYXCjocv"
_LATIN = "ɑɡ"
_LATIN_AS = "ag"
_HYPHENS = "‐‑‒⁃−˗﹣－"
_LOOKS = dict(zip(_CYRILLIC + _GREEK + _LATIN + _HYPHENS, _CYRILLIC_AS + _GREEK_AS + _LATIN_AS + "-" * len(_HYPHENS)))
_LIGATURES = {*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), 0x0132, 0x0133}
_BLANK_FILLERS = {0x3164, 0xFFA0, 0x2800}


def ignorable(ch: str) -> bool:
    """Characters that show nothing: format controls, joiners, variation selectors, fillers."""
    o = ord(ch)
    return unicodedata.category(ch) == "Cf" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5)


def symbols(ch: str) -> str:
    """What a character looks like, as a string of basic letters and marks; '' if it is invisible, ' ' for any blank.

    Width, ligatures, radical and compatibility ideographs, precomposed accents and look-alike scripts are resolved. Case,
    accents, circled and raised digits, the ellipsis and variant ideographs are kept apart.
    """
    o = ord(ch)
    if ch.isspace() or o in _BLANK_FILLERS:
        return " "
    if ignorable(ch):
        return ""
    form = unicodedata.decomposition(ch)
    if form.startswith(("<wide>", "<narrow>", "<noBreak>", "<small>")) or o in _LIGATURES or 0x2E80 <= o <= 0x2FDF:
        ch = unicodedata.normalize("NFKC", ch)
    return "".join(_LOOKS.get(c, c) for c in unicodedata.normalize("NFD", ch))


class _Table(dict):
    """``symbols`` as a translation table that fills itself."""

    def __missing__(self, o: int) -> str:
        self[o] = s = symbols(chr(o))
        return s


_TABLE = _Table()


def _skeleton(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text.translate(_TABLE)).split())


def skeleton(text: str) -> str:
    """The look of a text: the table applied to every character, marks composed, blanks single and none at the ends."""
    # most texts hold nothing but characters that look like themselves
    return _skeleton(text) if _odd().search(text) else " ".join(text.split())


class VocabularyTrie:
    """Words by what their letters look like, searched by a weighted edit automaton.

    Reading a character that looks like the edge's letter is free, whatever its script, width or encoding, and so are
    ignorable characters; any other substitution, insertion or deletion costs 1. A search returns the spelling of the
    cheapest word within the budget. With budget 0 only words that look the same are found.
    """

    def __init__(self, words: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.spelling: list[str | None] = [None]
        for word in words:
            self.add(word)

    def add(self, word: str) -> None:
        at = 0
        for s in word.translate(_TABLE):
            nxt = self.children[at].get(s)
            if nxt is None:
                nxt = self.children[at][s] = len(self.children)
                self.children.append({})
                self.spelling.append(None)
            at = nxt
        if self.spelling[at] is None:
            self.spelling[at] = word

    def _closure(self, states: dict[int, int], budget: int) -> dict[int, int]:
        """Adds the states reached by skipping letters of a word."""
        todo = list(states.items())
        while todo:
            at, cost = todo.pop()
            if cost < budget:
                for nxt in self.children[at].values():
                    if states.get(nxt, budget + 1) > cost + 1:
                        states[nxt] = cost + 1
                        todo.append((nxt, cost + 1))
        return states

    def find(self, token: str, budget: int = 0) -> str | None:
        states = self._closure({0: 0}, budget)
        for ch in token:
            for s in _TABLE[ord(ch)]:  # nothing for an ignorable character: its edit is free
                after: dict[int, int] = {}
                for at, cost in states.items():
                    if cost < budget and after.get(at, budget + 1) > cost + 1:
                        after[at] = cost + 1
                    if cost < budget:
                        for edge, nxt in self.children[at].items():
                            step = cost + (edge != s)
                            if after.get(nxt, budget + 1) > step:
                                after[nxt] = step
                    elif (nxt := self.children[at].get(s)) is not None and after.get(nxt, budget + 1) > cost:
                        after[nxt] = cost
                states = self._closure(after, budget)
                if not states:
                    return None
        ends = [(cost, self.spelling[at]) for at, cost in states.items() if self.spelling[at] is not None]
        return min(ends)[1] if ends else None


_CYRILLIC_OF = {a: c for c, a in zip(_CYRILLIC, _CYRILLIC_AS)}
_GREEK_OF = {a: g for g, a in zip(_GREEK, _GREEK_AS)}
_ONLY_CYRILLIC = re.compile("[Ѐ-ӿԀ-ԯ]")
_ONLY_GREEK = re.compile("[Ͱ-Ͽ]")
_ONLY_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def by_table(token: str) -> str:
    """The spelling of a token that no vocabulary word looks like, from its look alone.

    If letters of one other script remain that have no Latin twin, and none that only Latin has, the twins are
    spelled in that script; otherwise in Latin.
    """
    look = unicodedata.normalize("NFD", token).translate(_TABLE)
    rest = "".join(c for c in look if c not in _CYRILLIC_OF)
    if _ONLY_CYRILLIC.search(look) and not _ONLY_LATIN.search(rest):
        look = "".join(_CYRILLIC_OF.get(c, c) for c in look)
    elif _ONLY_GREEK.search(look) and not _ONLY_LATIN.search("".join(c for c in look if c not in _GREEK_OF)):
        look = "".join(_GREEK_OF.get(c, c) for c in look)
    return unicodedata.normalize("NFC", look)


_SCRIPTS = "A-Za-zÀ-ÖØ-öø-ɏɑɡͰ-ϿЀ-ԯ̀-ͯἀ-῿Ａ-Ｚａ-ｚﬀ-ﬆ"
_INVISIBLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿"
_TOKEN = re.compile(f"[{_SCRIPTS}][{_SCRIPTS}{_INVISIBLE}]*")


class Canonicalizer:
    """Texts in canonical spelling; remembers tokens seen."""

    MEMORY = 200_000

    def __init__(self, words: list[str]) -> None:
        self.trie = VocabularyTrie(words)
        self.known: dict[str, str] = {}

    def token(self, token: str) -> str:
        out = self.known.get(token)
        if out is None:
            out = self.trie.find(token)
            if out is None:
                out = by_table(token)
            if len(self.known) < self.MEMORY:
                self.known[token] = out
        return out

    def text(self, text: str) -> str:
        parts, end = [], 0
        for m in _TOKEN.finditer(text):
            parts.append(text[end : m.start()].translate(_TABLE))
            parts.append(self.token(m.group()))
            end = m.end()
        parts.append(text[end:].translate(_TABLE))
        return " ".join(unicodedata.normalize("NFC", "".join(parts)).split())


_WORDS = r"[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]+"


def vocabulary(texts: Column, rows: DataFrame, limit: int = VOCABULARY_LIMIT, min_count: int = MIN_COUNT) -> list[str]:
    """The canonical spellings: frequent words of one script, counted over all rows.

    Of words that look the same the Latin spelling is canonical if it occurs anywhere in the rows, else the most frequent.
    """
    words = rows.select(F.explode(F.regexp_extract_all(texts, F.lit(_WORDS), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    plain = words.where(F.col("w").rlike(r"^(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[Ѐ-ӿ]+|[Ͱ-Ͽ]+)$"))
    look = F.translate("w", _CYRILLIC + _GREEK, _CYRILLIC_AS + _GREEK_AS)
    best = plain.withColumn("look", look).groupBy("look").agg(
        F.max(F.col("w") == F.col("look")).alias("latin"), F.max_by("w", F.struct("n", "w")).alias("top"), F.sum("n").alias("n")
    )
    chosen = best.where(F.col("n") >= min_count).select("n", F.when(F.col("latin"), F.col("look")).otherwise(F.col("top")).alias("w"))
    # the least count of which the limit still holds all words; counts of counts are few
    sizes = sorted(((r.n, r.k) for r in chosen.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = 1 << 62, 0
    for n, k in sizes:
        held += k
        if held > limit:
            break
        least = n
    return sorted(r.w for r in chosen.where(F.col("n") >= least).select("w").collect())


_WIDE_SIGNS = "".join(chr(0xFEE0 + o) for o in range(0x21, 0x7F) if not chr(o).isalpha())
_SIGNS = "".join(chr(o) for o in range(0x21, 0x7F) if not chr(o).isalpha())
#: Ranges of characters that mostly stand for themselves: Latin letters, common signs, ideographs, pictures.
_PLAIN = ((0x21, 0x28F), (0x2013, 0x2014), (0x2018, 0x201F), (0x2022, 0x2026), (0x2039, 0x203A), (0x20AC, 0x20AC), (0x2116, 0x2122), (0x3001, 0x3017), (0x4E00, 0x9FFF), (0x1F300, 0x1FAFF))


def self_evident() -> list[tuple[int, int]]:
    """Ranges of code points that look like themselves alone, whatever surrounds them; tested one by one."""
    out: list[tuple[int, int]] = []
    for lo, hi in _PLAIN:
        for o in range(lo, hi + 1):
            if _skeleton(chr(o)) == chr(o):
                if out and out[-1][1] == o - 1:
                    out[-1] = (out[-1][0], o)
                else:
                    out.append((o, o))
    return out


@cache
def _odd() -> re.Pattern:
    """Characters that are not self-evident, plain blanks aside."""
    return re.compile("[^ \\t\\n\\r" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in self_evident()) + "]")


@cache
def _other() -> str:
    """A pattern of what is not self-evident: other characters, two blanks in a row or a blank at an end."""
    return "[^ " + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in self_evident()) + "]|  |^ | $"


def canonical_text(text: Column, words: list[str]) -> Column:
    """``text`` in canonical spelling, so that texts that look the same are equal; null stays null, blank becomes ''.

    Texts of characters that stand for themselves never leave the JVM.
    """

    @F.pandas_udf(StringType())
    def spelled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        canon = Canonicalizer(words)
        for s in batches:
            yield pd.Series([None if t is None else canon.text(t) for t in s], dtype=object)

    signs = F.translate(text, _WIDE_SIGNS, _SIGNS)
    other = signs.rlike(_other())
    return F.when(other, spelled(F.when(other, text))).otherwise(signs)


def looks(rows: DataFrame, fields: list[str], identifier: str) -> DataFrame:
    """``field``, ``id`` and hashes of the value as it is (``raw``) and in canonical spelling (``look``), of values that are not blank."""
    flat = spread(rows.select(F.col(identifier), *fields)).select(
        F.col(identifier).alias("id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("raw")) for f in fields]))
    ).where(F.col("raw").rlike(r"\S"))
    words = vocabulary(F.col("raw"), flat)
    # spelled once, then read by every step; only hashes are kept
    return keep(flat.select("field", "id", F.md5("raw").alias("raw"), F.md5(canonical_text(F.col("raw"), words)).alias("look")))


def several_spellings(keyed: DataFrame) -> DataFrame:
    """Of ``keyed`` the rows whose look has several spellings; copies are folded before spellings meet."""
    several = keyed.groupBy("field", "look").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a < b").select("field", "look")
    return keyed.join(several, ["field", "look"], "left_semi")


def lookalike_members(rows: DataFrame, fields: list[str], identifier: str) -> DataFrame:
    """Every row whose value looks like another spelling: ``field``, ``identifier``, ``class_id`` (the least identifier of all that look
    alike) and ``spelling_id`` (the least one with the same string). With pairs of spellings this gives all pairs of rows."""
    members = several_spellings(looks(rows, fields, identifier))
    spelled = members.groupBy("field", "look", "raw").agg(F.min("id").alias("spelling_id"))
    classes = spelled.groupBy("field", "look").agg(F.min("spelling_id").alias("class_id"))
    named = spelled.join(classes, ["field", "look"])
    return members.join(named, ["field", "look", "raw"]).select("field", F.col("id").alias(identifier), "class_id", "spelling_id").distinct()


def lookalike_pairs(rows: DataFrame, fields: list[str], identifier: str, copies: int = COPIES) -> DataFrame:
    """Pairs of rows whose values of a field differ as strings but look the same, as ``field``, ``<identifier>_a``, ``<identifier>_b``.

    Null and blank values pair with nothing. Rows that look the same form a class; every spelling of it is linked with every other. The
    first ``copies`` rows of a spelling pair with all rows of the others; later copies of the same string pair with those
    first rows only, so that a huge group of exact copies stays linear while no link between different strings is lost;
    :func:`lookalike_members` gives the class of every copy.
    """
    members = several_spellings(looks(rows, fields, identifier))
    # row_number() <= copies is pushed below the exchange as a group limit: a spelling's copies are never gathered
    spelled = Window.partitionBy("field", "look", "raw").orderBy("id")
    heads = members.withColumn("k", F.row_number().over(spelled)).where(F.col("k") <= copies).select("field", "look", F.col("raw").alias("raw2"), F.col("id").alias("id2"))
    joined = members.join(heads, ["field", "look"]).where(F.col("raw") != F.col("raw2"))
    a, b = F.least("id", "id2"), F.greatest("id", "id2")
    return joined.select("field", a.alias(f"{identifier}_a"), b.alias(f"{identifier}_b")).distinct()
