"""Text decoded with the wrong encoding: candidate decodings compared by description length under per-language dictionaries."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import keep, spread

#: Size in bytes of a language's dictionary, which holds the most frequent phrases of all texts; this bounds what the driver gathers.
DICTIONARY_BYTES = 48_000
#: Lines with a character that fewer of a language's documents have do not teach; garbled documents are fewer than that.
RARE_SHARE = 0.06
#: A character is common if this share of all documents has it.
COMMON_SHARE = 0.003
#: Cost in bytes of undoing one wrong decoding, by kind, and what it must save beyond that as a share of the changed stretch: UTF-8 read as a
#: single-byte encoding, UTF-8 read as a wider one, a wider one read as another or as single bytes, single-byte ones. The more bytes allow
#: a reading, the more it must pay.
CHAIN_COST = {"utf-8": (0.5, 0.0), "wide utf-8": (2.0, 0.08), "multi": (5.0, 0.08), "single": (9.0, 0.15)}
#: Wrong decodings on top of one another, and readings of a line that are followed up at each step, the shortest ones.
MAX_STEPS, BEAM = 3, 3
#: What a character costs in bytes that no text has but a reading brings in, and one that only stands for something lost.
UNSEEN, LOST = 4.0, 3.0
#: Cost in bytes of undoing one single-byte Latin encoding read as another; what it saves is told by the neighbours of the signs.
LATIN_COST = 0.6

# Encodings that text is mistaken for, by kind.
_LATIN = ("cp1252", "latin-1", "cp1250", "cp437", "cp850", "mac_roman", "iso8859-2")
_CYRILLIC = ("cp1251", "cp866", "koi8-r", "mac_cyrillic", "iso8859-5")
_SINGLE = _LATIN + _CYRILLIC
_MULTI = ("gbk", "cp932", "big5hkscs", "cp949")


def _bytes_of(codec: str) -> dict[int, int]:
    """Code point to byte; bytes the codec leaves undefined stand for the control of the same number, as browsers read them."""
    out = {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out.setdefault(b, b)
    return out


_ENCODE = {c: {**{i: i for i in range(128)}, **_bytes_of(c)} for c in _SINGLE}
_RUN = {c: re.compile("[" + "".join(re.escape(chr(o)) for o in m) + "]+") for c, m in _ENCODE.items()}
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: A first and a second byte of UTF-8 as each single-byte encoding shows them; without such a pair there is nothing to decode.
_PAIR = {
    c: re.compile("[" + "".join(re.escape(chr(o)) for o, x in m.items() if 0xC2 <= x <= 0xF4) + "][" + "".join(re.escape(chr(o)) for o, x in m.items() if 0x80 <= x <= 0xBF) + "]")
    for c, m in _ENCODE.items()
}
_HAN = re.compile("[㐀-鿿]")
_CYR = re.compile("[Ѐ-ӿ]")
_DIGIT = re.compile("[0-9]")
#: What lines of lone signs of single-byte Latin encodings do not have.
_OTHER = re.compile(r"[^\x00-\x7f]{2}|[Ͱ-ῼ⺀-\U0010ffff\x80-\x84\x86-\x9f─-╿]")
_ACCENTED = re.compile("[À-ɏ]")
#: Signs that no right text has: replacement characters, C1 controls, private use, unassigned planes.
_BROKEN = re.compile("[�\x80-\x84\x86-\x9f\ue000-\uf8ff\U000e0200-\U0010ffff]")


def _translation(wrong: str, right: str) -> dict[int, str]:
    """What each sign beyond ASCII of the wrong encoding is in the right one; what would be broken there is left out."""
    table = {o: bytes([b]).decode(right, "replace") for o, b in _ENCODE[wrong].items() if b > 127}
    return {o: c for o, c in table.items() if not _BROKEN.match(c)}


#: Single-byte Latin encodings read as one another, Windows and Latin-1 on one side.
_SWAPS = {
    (wrong, right): _translation(wrong, right)
    for other in ("cp437", "cp850", "mac_roman", "cp1250", "iso8859-2")
    for plain in ("cp1252", "latin-1")
    for wrong, right in ((other, plain), (plain, other))
}
#: Signs that single-byte Latin encodings have; one of them with its neighbours.
_SIGNED = re.compile("[" + "".join(re.escape(chr(o)) for o in sorted({o for w, _ in _SWAPS for o in _ENCODE[w] if o > 127})) + "]")
_SIGN = re.compile("(?=(.[" + "".join(re.escape(chr(o)) for o in sorted({o for w, _ in _SWAPS for o in _ENCODE[w] if o > 127})) + "].))", re.S)


def neighbourhoods(text: str) -> list[str]:
    """Each sign beyond ASCII of a text with the characters at both its sides; digits count as one, line ends as blanks."""
    return _SIGN.findall(_DIGIT.sub("0", f" {text} ".replace("\n", " ")))


def swapped(word: str, wrong: str, right: str) -> str:
    """The word as another single-byte Latin encoding; signs without a place in either stay."""
    return word.translate(_SWAPS[wrong, right])


def candidates(line: str) -> list[tuple[str, str, str]]:
    """(text, wrong encoding, right encoding) of every way to undo one wrong decoding of the line or of runs within it."""
    out = []
    for wrong in _SINGLE:
        if not _PAIR[wrong].search(line):
            continue
        table, run = _ENCODE[wrong], _RUN[wrong]
        utf8, changed = [], False
        at = 0
        for m in run.finditer(line):
            s = m.group()
            if s.isascii():
                continue
            data = s.translate(table).encode("latin-1")
            pieces, i = [], 0
            for u in _UTF8.finditer(data):
                pieces.append(s[i : u.start()])
                try:
                    pieces.append(u.group().decode("utf-8"))
                    changed = True
                except UnicodeDecodeError:
                    pieces.append(s[u.start() : u.end()])
                i = u.end()
            pieces.append(s[i:])
            utf8.append((m.start(), m.end(), "".join(pieces)))
        if changed:
            parts = []
            for a, b, text in utf8:
                parts += [line[at:a], text]
                at = b
            out.append(("".join([*parts, line[at:]]), wrong, "utf-8"))
    latin_high = bool(re.search("[\x80-ÿ]{2}", line))
    if latin_high and not _HAN.search(line):
        for wrong in ("cp1252", "latin-1"):
            data = _encode_all(line, wrong)
            if data is not None:
                for right in ("gbk", "big5hkscs", "cp932", "cp949"):
                    out += _decode_all(data, wrong, right)
                for right in ("cp1251", "koi8-r", "cp866"):
                    out += _decode_all(data, wrong, right)
    if latin_high and _CYR.search(line):
        for right in ("cp1251", "koi8-r", "cp866"):
            fixed = _RUN_GBK.sub(lambda m: m.group().encode("latin-1").decode(right, "replace"), line)
            out.append((fixed, "latin-1", right))
    if latin_high and _HAN.search(line):
        fixed = _RUN_GBK.sub(lambda m: _or_same(m.group(), "gbk"), line)
        if fixed != line:
            out.append((fixed, "cp1252", "gbk"))
    if _CYR.search(line) or re.search("[─-╿]", line):
        for wrong in _CYRILLIC:
            data = _encode_all(line, wrong)
            if data is not None:
                for right in _CYRILLIC:
                    if right != wrong:
                        out += _decode_all(data, wrong, right)
                out += _decode_all(data, wrong, "gbk")
        # a stretch of few words is told by signs that no word has
        words = line.split(" ")
        odd = [bool(_DRAWN.search(w)) for w in words]
        if any(odd) and not all(odd):
            for wrong in ("cp866", "koi8-r", "mac_cyrillic"):
                for right in _CYRILLIC:
                    if right != wrong:
                        fixed = [_reread(w, wrong, right) if o else w for w, o in zip(words, odd)]
                        if fixed != words:
                            out.append((" ".join(fixed), wrong, right))
    if re.search("[一-鿿豈-﫿｡-ﾟ가-힣]", line):
        for wrong in _MULTI:
            for right in ("utf-8",) if wrong == "gbk" else ("utf-8", "gbk"):
                fixed = _wide_runs(line, wrong, right)
                if fixed is not None:
                    out.append((fixed, wrong, right))
    return out


_RUN_GBK = re.compile("[\x80-ÿ]{2,}")
_WITHIN = re.compile("[A-Za-z][㐀-鿿][a-z]")
_DRAWN = re.compile("[─-╿▀-▟√∙°†ћќѓ]")


def _reread(word: str, wrong: str, right: str) -> str:
    """A word's bytes in one single-byte encoding read in another; unchanged if it has signs outside the first."""
    table = _ENCODE[wrong]
    if any(ord(c) not in table for c in word):
        return word
    return bytes(table[ord(c)] for c in word).decode(right, "replace")


def _or_same(s: str, codec: str) -> str:
    try:
        return s.encode("latin-1").decode(codec)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return s


class _Bytes(dict):
    """A single-byte encoding as a translation table; signs outside it become question marks."""

    def __missing__(self, o: int) -> int:
        return 63


_TO_BYTES = {c: _Bytes(m) for c, m in _ENCODE.items()}


def _encode_all(line: str, codec: str) -> bytes | None:
    """The line as bytes; blanks and signs outside the encoding may be few, then they become question marks."""
    out = line.translate(_TO_BYTES[codec])
    lost = out.count("?") - line.count("?")
    return out.encode("latin-1") if lost * 12 <= len(line) else None


def _decode_all(data: bytes, wrong: str, right: str) -> list[tuple[str, str, str]]:
    text = data.decode(right, "replace")
    bad = text.count("�")
    return [(text, wrong, right)] if bad * 12 <= len(text) else []


#: What UTF-8 leaves in the bytes of a wider encoding: characters in a row, or a short one within a word.
_TRACE = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){2}|(?<=[A-Za-z])[\xc2-\xdf][\x80-\xbf](?![\x80-\xff])|(?<![\x80-\xff])[\xe0-\xf4][\x80-\xbf]{2,3}(?![\x80-\xff])")
_ASCII = re.compile("[\x00-\x7f]+")
_SHORT_RUNS: dict[tuple[str, str, str], str] = {}


def _reread_run(s: str, wrong: str, right: str) -> str:
    whole = s.replace("�", "")
    data = whole.encode(wrong, "ignore")
    if len(data.decode(wrong, "ignore")) * 10 < len(whole) * 9 or not data:
        return s
    text = data.decode(right, "ignore")
    return text if text != whole and len(text.encode(right, "ignore")) * 10 >= len(data) * 8 else s


def _wide_runs(line: str, wrong: str, right: str) -> str | None:
    """Runs of the line whose bytes in a multi-byte encoding are text in another, decoded.

    Nearly all of a run must have bytes there, and nearly all bytes must decode; what was lost already stays lost.
    """
    if right == "utf-8" and not _TRACE.search(line.encode(wrong, "ignore")):
        return None

    def fix(m: re.Match) -> str:
        s = m.group()
        if len(s) > 6:
            return _reread_run(s, wrong, right)
        out = _SHORT_RUNS.get((s, wrong, right))
        if out is None:
            out = _reread_run(s, wrong, right)
            if len(_SHORT_RUNS) < 200_000:
                _SHORT_RUNS[s, wrong, right] = out
        return out

    fixed = _WIDE_RUN.sub(fix, line)
    return fixed if fixed != line else None


_WIDE_RUN = re.compile(r"[^\x00-\x7f，。：；、！？（）“”‘’…—\s]+")


class _Costs(dict):
    """Costs of characters by how rare they are; those that no text has all cost the same."""

    def __init__(self, rarity: dict[str, float], unseen: float) -> None:
        super().__init__({c: LOST if _BROKEN.match(c) else x for c, x in rarity.items()})
        self.unseen = unseen

    def __missing__(self, c: str) -> float:
        self[c] = x = LOST if _BROKEN.match(c) else self.unseen
        return x


class Lengths:
    """Description lengths in bytes: compressed under a dictionary per language, and each character beyond ASCII by how many texts have it.

    A compressor's literals cost the same whatever they are; what is rare over all texts costs more to tell.
    """

    WORDS = 50_000

    def __init__(self, dictionaries: dict[str, bytes], near: dict[str, int] | None = None, characters: dict[str, int] | None = None, total: int = 0) -> None:
        self.by = {}
        self.near = near or {}
        self.words: dict[str, dict[tuple[str, str], str]] = {}
        n = max(total, 2)
        unseen = math.log2(n / 0.5) / 8
        rarity = {c: math.log2((n + 1) / (k + 0.5)) / 8 for c, k in (characters or {}).items()}
        self.given, self.read = _Costs(rarity, unseen), _Costs(rarity, unseen + UNSEEN)
        for lang, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.by[lang] = zstandard.ZstdCompressor(
                dict_data=d, level=3, write_content_size=False, write_checksum=False, write_dict_id=False
            )
        self.spaced = [x for x in self.by if x not in ("zh", "ru")]

    def rare(self, text: str, given: bool = False) -> float:
        """What the characters beyond ASCII cost by how rare they are.

        A text as ``given`` may be in a language of its own; a reading of it that brings in characters no text has must tell each of them.
        """
        return sum(map((self.given if given else self.read).__getitem__, _ASCII.sub("", text)))

    def packed(self, text: str) -> int:
        langs = ["zh"] if _HAN.search(text) else ["ru"] if _CYR.search(text) else self.spaced if _ACCENTED.search(text) else ["en"]
        data = text.encode("utf-8", "replace")
        return min((len(self.by[x].compress(data)) for x in langs if x in self.by), default=len(data))

    def signs(self, text: str) -> float:
        """Bytes that tell the signs beyond ASCII from their neighbours, up to a constant per sign."""
        return -sum(math.log2(self.near.get(n, 0) + 0.5) for n in neighbourhoods(text)) / 8

    def gains(self, word: str) -> dict[tuple[str, str], str]:
        """The word as other single-byte Latin encodings that take fewer bytes."""
        got = self.words.get(word)
        if got is None:
            now = self.signs(word)
            got = {k: new for k in _SWAPS if (new := swapped(word, *k)) != word and self.signs(new) < now}
            if len(self.words) < self.WORDS:
                self.words[word] = got
        return got

    def swaps(self, line: str) -> list[tuple[str, str, str]]:
        """(text, wrong encoding, right encoding) of the line, and of its words that gain, as other single-byte Latin encodings."""
        if not self.near:
            return []
        words = line.split(" ")
        gains = [{} if w.isascii() or not _SIGNED.search(w) else self.gains(w) for w in words]
        out = []
        for k in dict.fromkeys(k for g in gains for k in g):
            out += [(swapped(line, *k), *k), (" ".join(g.get(k, w) for w, g in zip(words, gains)), *k)]
        return out


def changed(before: str, after: str) -> str:
    """The stretch of a text that another has differently: without what they begin and end with alike."""
    n = min(len(before), len(after))
    i = 0
    while i < n and before[i] == after[i]:
        i += 1
    j = 0
    while j < n - i and before[-1 - j] == after[-1 - j]:
        j += 1
    return before[i : len(before) - j]


def step_cost(size: int, wrong: str, right: str) -> float:
    """What one undone decoding of a stretch of ``size`` bytes costs to tell."""
    wide = wrong in _MULTI
    kind = ("wide utf-8" if wide else "utf-8") if right == "utf-8" else "multi" if wide or right in _MULTI else "single"
    base, share = CHAIN_COST[kind]
    return base + share * size


def restore(line: str, lengths: Lengths) -> tuple[str, list[str]]:
    """The line with wrong decodings undone, and the chain of encodings undone, outermost first; unchanged if no chain pays.

    Of all chains of up to MAX_STEPS the one of the least description length is taken, the costs of its steps included. The chains
    are searched breadth first; at each step the BEAM shortest readings are followed up. A stretch saves at most its own bytes:
    what a compressor's choice of matches elsewhere in the line adds to that is chance.
    """
    best: tuple[float, str, list[str]] = (0.0, line, [])
    seen = {line}
    front: list[tuple[float, str, list[str]]] = [(0.0, line, [])]  # what is saved so far, the reading, the chain
    for _ in range(MAX_STEPS):
        after: list[tuple[float, str, list[str]]] = []
        for saved, text, chain in front:
            rare, packed, utf8 = lengths.rare(text, not chain), -1, False
            for new, wrong, right in candidates(text):
                if new in seen:
                    continue
                seen.add(new)
                size = len(_ASCII.sub("", changed(text, new)).encode("utf-8", "replace"))
                gain = rare - lengths.rare(new) - step_cost(size, wrong, right)
                if gain + size <= 0:
                    continue
                if packed < 0:
                    packed = lengths.packed(text)
                if gain + min(size, packed) <= 0:  # pays nothing even if the line compressed to nothing
                    continue
                shorter = min(size, packed - lengths.packed(new))
                if right == "utf-8" and wrong in ("cp1252", "latin-1"):  # the commonest mistake saves at least the bytes it takes off
                    shorter = max(shorter, size - len(_ASCII.sub("", changed(new, text)).encode()))
                gain += shorter
                utf8 = utf8 or (right == "utf-8" and gain > 0)
                after.append((saved + gain, new, [*chain, f"{right} read as {wrong}"]))
            # what is UTF-8 is no other single-byte encoding
            if not utf8 and not chain:
                told = lengths.signs(text)
                for new, wrong, right in lengths.swaps(text):
                    gain = told - lengths.signs(new) - LATIN_COST
                    if gain > 0 and new not in seen:
                        seen.add(new)
                        after.append((saved + gain, new, [f"{right} read as {wrong}"]))
        after.sort(key=lambda x: -x[0])
        front = after[:BEAM]
        if front and front[0][0] > best[0]:
            best = front[0]
        front = [f for f in front if f[2][-1].startswith("utf-8") and f[0] > -2]  # only UTF-8 is mistaken twice
        if not front:
            break
    return best[1], best[2]


def language(column: str = "lang") -> F.Column:
    """The two letters a language tag begins with, in lower case."""
    return F.lower(F.substring(F.trim(column), 1, 2))


#: What phrases are split at: their marks, words up to a number, and Latin words within Chinese; these are what one text has and others do not.
_APART = re.compile(r"(?<=[.!?。！？，,])\s*|(?<![!-~])[!-/:-~]*+[0-9][0-9.,]*+|(?<=[㐀-鿿])[!-~]++|(?<![!-~])[!-~]++(?=[㐀-鿿])")


def learn_dictionaries(texts: DataFrame, counts: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary per language of the most frequent phrases of all its ``distinct_texts``.

    Lines with characters that are rare in their language are left out, so that garbled lines do not teach. ``counts`` are those of :func:`count_signs`.
    """
    by_language = texts.select(F.explode("langs").alias("lang"), "text")
    sizes = {r.lang: r["count"] for r in by_language.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return {}
    needed = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, max(2.0, RARE_SHARE * n))))
    usual: dict[str, str] = dict.fromkeys(sizes, "")
    for r in counts.where((F.col("kind") == "char") & (F.col("n") >= F.try_element_at(needed, F.col("lang")))).collect():
        usual[r.lang] += r.key
    right = {lang: re.compile(f"[\x00-\x7f{re.escape(cs)}]*") for lang, cs in usual.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, Counter] = {lang: Counter() for lang in right}
            for text, langs in zip(batch["text"], batch["langs"]):
                for line in text.split("\n"):
                    if _BROKEN.search(line):
                        continue
                    phrases = None
                    for lang in langs:
                        if right[lang].fullmatch(line):
                            if phrases is None:
                                phrases = [p for s in _APART.split(line) if (p := s.strip())]
                            found[lang].update(phrases)
            yield pd.DataFrame([(lang, p, n) for lang, c in found.items() for p, n in c.items()], columns=["lang", "s", "n"])

    rows = keep(texts.mapInPandas(count, "lang string, s string, n long").groupBy("lang", "s").agg(F.sum("n").alias("n")))
    # per language the least count that a dictionary reaches, and what room is left for phrases of that count
    levels = rows.groupBy("lang", "n").agg(F.sum(F.octet_length("s")).alias("size")).collect()
    least, room = {}, dict.fromkeys(sizes, DICTIONARY_BYTES)
    for r in sorted(levels, key=lambda r: (r.lang, -r.n)):
        if room[r.lang] > 0 and r.lang not in least:
            if r["size"] > room[r.lang]:
                least[r.lang] = r.n
            else:
                room[r.lang] -= r["size"]
    above = F.create_map(*(F.lit(x) for lang in sizes for x in (lang, least.get(lang, 0))))
    chosen = sorted(((r.lang, -r.n, r.s) for r in rows.where(F.col("n") > F.try_element_at(above, F.col("lang"))).collect()))
    for lang, n in least.items():  # equally frequent ones in the order of a hash, as many as can fit
        level = rows.where((F.col("lang") == lang) & (F.col("n") == n)).orderBy(F.xxhash64("s"), "s").limit(room[lang] + 1)
        for r in level.collect():
            chosen.append((lang, -n, r.s))
            room[lang] -= len(r.s.encode())
            if room[lang] < 0:
                break
    by: dict[str, list[str]] = {lang: [] for lang in sizes}
    for lang, _, phrase in chosen:
        by[lang].append(phrase)
    # the most frequent last, where matches are nearest
    return {lang: " ".join(reversed(data)).encode()[-DICTIONARY_BYTES:] for lang, data in by.items()}


def count_signs(texts: DataFrame) -> DataFrame:
    """``kind``, ``lang``, ``key``, ``n``: how many ``distinct_texts`` have each character beyond ASCII, over all and by language, and each neighbourhood of a sign."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for t, langs in zip(batch["text"], batch["langs"]):
                chars = set(_ASCII.sub("", t))
                for lang in ("", *langs):
                    found.update(("char", lang, c) for c in chars)
                found.update(("near", "", x) for x in set(neighbourhoods(t)))
            found["total", "", ""] += len(batch)
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["kind", "lang", "key", "n"])

    odd = texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    return keep(odd.mapInPandas(count, "kind string, lang string, key string, n long").groupBy("kind", "lang", "key").agg(F.sum("n").alias("n")))


def statistics(counts: DataFrame) -> tuple[dict[str, int], int, dict[str, int]]:
    """How many distinct texts have each character beyond ASCII, the number of texts, and how many have each neighbourhood of a sign; all of them."""
    by: dict[str, dict[str, int]] = {"char": {}, "total": {}, "near": {}}
    for r in counts.where("lang = ''").collect():
        by[r.kind][r.key] = r.n
    return by["char"], sum(by["total"].values()), by["near"]


def distinct_texts(documents: DataFrame) -> DataFrame:
    """``text``, ``langs``: each text once however many copies there are, and the languages these are said to be in; copies are folded before they are sent."""
    lang = F.when(language().rlike("^[a-z]{2}$"), language())
    return documents.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.collect_set(lang).alias("langs")).select("text", "langs")


class Repairer:
    """Finds and restores wrongly decoded lines."""

    MEMORY = 50_000

    def __init__(self, dictionaries: dict[str, bytes], characters: dict[str, int], total: int, near: dict[str, int] | None = None) -> None:
        self.lengths = Lengths(dictionaries, near, characters, total)
        self.common = frozenset(c for c, n in characters.items() if n >= max(3, COMMON_SHARE * total))
        # ideographs and signs that are common need no look; letters of alphabets are always looked at where they meet
        self.settled = {c for c in self.common if _HAN.match(c) or c in "，。：；、！？（）【】《》“”‘’…—–·•€£✓🎉«»"}
        # those that begin a run of UTF-8 read as a wider encoding: a first byte of three
        leads = {c for c in self.settled for w in ("gbk", "cp932", "big5hkscs") if c.encode(w, "ignore")[:1] >= b"\xe2"}
        self.leads = re.compile("(?:^|[\x00-\x7f，。：；、！？（）“”‘’…—])[" + "".join(map(re.escape, sorted(leads))) + "]") if leads else None
        self.known: dict[str, tuple[str, list[str]]] = {}

    def line(self, line: str) -> tuple[str, list[str]]:
        if line.isascii():
            return line, []
        held = set(_ASCII.sub("", line))
        odd = held - self.settled
        if not odd and not (self.leads and self.leads.search(line)) and _HAN.search(line) and not _WITHIN.search(line):
            return line, []
        if not odd and (_HAN.search(line) or not self.lengths.near) and all(_wide_runs(line, wrong, "utf-8") is None for wrong in _MULTI):
            return line, []
        # without two such characters side by side, only single-byte encodings can be mistaken for one another
        if not _OTHER.search(line) and not self.lengths.swaps(line):
            return line, []
        got = self.known.get(line)
        if got is None:
            got = restore(line, self.lengths)
            if not got[1] and _BROKEN.search(line):
                got = (line, ["?"])
            if len(self.known) < self.MEMORY:
                self.known[line] = got
        return got

    def text(self, text: str) -> tuple[str, list[str]]:
        parts = text.split("\n")
        lines, chain = [], []
        for part in parts:
            fixed, how = self.line(part)
            lines.append(fixed)
            chain += [h for h in how if h not in chain]
        if chain and chain != ["?"]:
            # what a document is known to suffer from needs no further cost on its other lines
            for i, part in enumerate(parts):
                if lines[i] == part and not part.isascii():
                    for fixed, wrong, right in candidates(part):
                        if f"{right} read as {wrong}" in chain and right == "utf-8" and len(fixed) < len(lines[i]) and "�" not in fixed:
                            lines[i] = fixed
        return "\n".join(lines), chain


def repaired(documents: DataFrame) -> DataFrame:
    """Documents with a wrongly decoded stretch: ``doc_id``, ``restored`` (the text with what could be undone), ``chain`` (how).

    A chain of ``?`` marks stretches that are broken beyond repair. Null, blank and ASCII texts are right as they stand. Every
    line of every text is looked at; repeated documents are reported each.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull())
    # documents without any sign beyond ASCII need no look
    odd = texts.where(F.col("text").rlike(r"[^\x00-\x7f]"))
    distinct = keep(distinct_texts(texts))
    counts = count_signs(distinct)
    dictionaries, (characters, total, near) = learn_dictionaries(distinct, counts), statistics(counts)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repairer = Repairer(dictionaries, characters, total, near)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"]):
                fixed, chain = repairer.text(text)
                if chain:
                    out.append((doc_id, fixed, chain))
            yield pd.DataFrame(out, columns=["doc_id", "restored", "chain"])

    return spread(odd.select("doc_id", "text")).mapInPandas(scan, "doc_id long, restored string, chain array<string>")
