"""New batches against all history: a pivot-distance table, pruned by the triangle inequality, verified by the true metric."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleanery.functions.url import normalize_url
from gleanery.llm.lookalikes import skeleton
from gleanery.session import exists, keep, read_or_empty, read_text, spread, write_text

#: Titles within this distance are one announcement.
RADIUS = 40
#: A fact weighs a multiple of this, letters one each: a distance below it counts letters alone.
LATTICE = 1 << 20
#: The multiples are spread over so many values, so that sums of facts differ and the first pivot tells titles apart.
SPREAD = 1 << 32
#: Facts of a title that are weighed one by one; those of longer lists are weighed as one, which compares as equal or not just the same.
MOST_FACTS = 1_000
#: A word is common, and no name, if this share of all titles has it, or FEWEST titles; there are at most words per title / share.
#: Their numbers must fall into FEWEST of so many buckets as well: one announcement, however often it is reposted, makes no word common.
COMMON_SHARE, FEWEST, BUCKETS = 0.0005, 12, 64
#: A word is a unit if so large a part of its uses follow a number, and belongs to the name before it if so large a part follow a long word.
UNIT_SHARE, SUFFIX_SHARE = 0.5, 0.9

# Words for months and product variants, traditional letters and the simplified ones.
_MONTHS = "january february march april may june july august september october november december".split()
_VARIANTS = frozenset("mini pro lite flash max nano turbo ultra plus air".split())
_TRADITIONAL = str.maketrans(
    "費領開時間貝優惠註冊發佈終戶專屬試點數據雲聽說權圖測內轉資訊動態關閉員擇載續適應戰隊電腦會業務開啟點擊獎勵僅歡",
    "费领开时间贝优惠注册发布终户专属试点数据云听说权图测内转资讯动态关闭员择载续适应战队电脑会业务开启点击奖励仅欢",
)
#: Small Cyrillic letters whose capitals look Latin, so that case does not matter.
_CAPITALS = str.maketrans("вкмнт", "bkmht")
_CURRENCY = "€$£¥₽"
_LABEL = re.compile(r"^\s*(?:\[[^\]\d]{1,23}\]|\([^)\d]{1,23}\)|【[^】\d]{1,23}】|[^\s:]{1,6}:)\s*")
_ASIDE = re.compile(r"\s*(?:\[[^\]\d]{1,23}\]|\([^)\d]{1,23}\)|【[^】\d]{1,23}】|[~!.:;)(^_-]+)\s*$")
_NUMBER, _WORD = re.compile(r"\d+"), re.compile(r"[a-z]+|[㐀-鿿]")
_AFTER, _ENDS = re.compile(r"\d ?([a-z]+|[㐀-鿿])"), re.compile(r"[a-z]{6,} ([a-z]{2,6})(?![a-z])")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[a-z]+|[€$£¥₽%#]|[^\W\d_]")


def fold(title: str) -> str:
    """A title without case, accents, look-alikes and traditional forms, and without the labels and asides around it."""
    t = skeleton(title).lower().translate(_TRADITIONAL)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).translate(_CAPITALS)
    for pattern in (_LABEL, _ASIDE):
        for _ in range(6):
            cut = pattern.sub("", t, count=1)
            if cut == t or not cut:
                break
            t = cut
    return t


def _key(word: str) -> str:
    """Letters in order, so that swapped letters do not matter."""
    return "".join(sorted(word))


_MONTH_KEYS = {_key(m): m[:3] for m in _MONTHS} | {_key(m[:3]): m[:3] for m in _MONTHS}


@dataclass(frozen=True)
class Words:
    """What the titles teach about words: which are common, and so no names, which are units of amounts, and which end a vendor's name."""

    common: list[str] = field(default_factory=list)
    units: list[str] = field(default_factory=list)
    suffixes: list[str] = field(default_factory=list)


class Facts:
    """Splits folded titles into what must agree and the rest; remembers words seen."""

    MEMORY = 300_000

    def __init__(self, words: Words) -> None:
        self.common = {_key(w) for w in words.common}
        self.heads = {w for w in words.common if len(w) >= 6}
        self.units = {_key(w) for w in words.units}
        self.suffixes = words.suffixes
        self.known: dict[str, str | None] = {}

    def name(self, word: str) -> str | None:
        """The part of a long word that is a name of its own: names of common vendors glued in front of it are taken off."""
        if word in self.known:
            return self.known[word]
        out: str | None = word
        if len(word) < 6 or _key(word) in self.common:
            out = None
        else:
            for n in range(len(word) - 1, 5, -1):
                if word[:n] in self.heads:
                    rest = next((word[n + len(x) :] for x in self.suffixes if word.startswith(x, n)), word[n:])
                    out = rest if len(rest) >= 5 and _key(rest) not in self.common else None
                    break
        if len(self.known) < self.MEMORY:
            self.known[word] = out
        return out

    def split(self, folded: str) -> tuple[list[str], str]:
        """Amounts with their units, edition, date, names and variant as a sorted list of facts; and the letters of the rest, sorted."""
        tokens = _TOKEN.findall(folded)
        facts, rest, named = [], [], False
        for i, t in enumerate(tokens):
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            if t[0].isdigit():
                before = tokens[i - 1] if i else ""
                unit = before if before and before in _CURRENCY else after if after and after in _CURRENCY else ""
                if not unit and after and before != "第" and _key(after) in self.units:
                    unit = _key(after)
                facts.append(f"{t.lstrip('0') or '0'}{unit}")
            elif t in _VARIANTS:
                facts.append(t)
            elif t.isascii() and t.isalpha():
                if _key(t) in _MONTH_KEYS:
                    facts.append(_MONTH_KEYS[_key(t)])
                elif (name := self.name(t)) is not None:
                    facts.append("=" + _key(name))
                    named = True
                else:
                    rest.append(t)
            elif t not in _CURRENCY and t not in "%#":
                rest.append(t)
        letters = "".join(sorted("".join(rest)))
        # without a name nothing but its words sets the title apart from others with these facts
        if not named or len(letters) >= LATTICE:
            facts.append("~" + letters)
            letters = ""
        facts.sort()
        if len(facts) > MOST_FACTS:
            facts = [" ".join(facts)]
        return facts, letters


Point = tuple[list[int], str]


def fact_number(fact: str) -> int:
    """What stands for a fact: its weight in lattice steps and the bits that choose its sides."""
    return int.from_bytes(hashlib.blake2b(fact.encode(), digest_size=6).digest(), "big")


def weight(number: int) -> int:
    return LATTICE * (1 + number % SPREAD)


def distance(a: Point, b: Point) -> int:
    """The metric: the weights of the facts, and one for each letter, that one title states more often than the other.

    It is the weighted city-block distance of two bags.
    """
    total = 0
    if a[0] != b[0]:
        x, y = Counter(a[0]), Counter(b[0])
        total = sum(weight(f) * n for f, n in ((x - y) + (y - x)).items())
    if a[1] != b[1]:
        x, y = Counter(a[1]), Counter(b[1])
        total += sum(((x - y) + (y - x)).values())
    return total


#: Pivots, each a bag: the empty title, and titles that hold every fact and letter of one half of all, more often than any title does.
PIVOTS = 4


def pivot_distances(point: Point) -> list[int]:
    """Distances to the pivots, less what is the same for all titles.

    To a pivot that holds more of a fact than a title does, the title is nearer by what it holds; to one without the fact, farther.
    """
    facts, letters = point
    out = [sum(weight(f) for f in facts) + len(letters)]
    for k in range(1, PIVOTS):
        side = sum(weight(f) if f >> (31 + k) & 1 else -weight(f) for f in facts)
        out.append(side + sum(n if ord(c) >> (k - 1) & 1 else -n for c, n in Counter(letters).items()))
    return out


POINT = "cell long, pk long, facts array<long>, letters string, d array<long>"


def pivot_table(titles: DataFrame, words: Words) -> DataFrame:
    """``id`` and the point of each folded title: ``facts``, ``letters``, the distances ``d`` to the pivots, the ``cell`` of the
    first distance, in which all lie that are in reach, and ``pk``, which stands for the point. This is what history stores."""

    @F.pandas_udf(POINT)
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        facts = Facts(words)
        for s in batches:
            out = []
            for folded in s:
                stated, letters = facts.split(folded)
                numbers = [fact_number(f) for f in stated]
                d = pivot_distances((numbers, letters))
                pk = hashlib.blake2b("\n".join([*stated, letters]).encode(), digest_size=8).digest()
                out.append((d[0] // LATTICE, int.from_bytes(pk, "big", signed=True), numbers, letters, d))
            yield pd.DataFrame(out, columns=["cell", "pk", "facts", "letters", "d"])

    return titles.select("id", place("folded").alias("p")).select("id", "p.*")


def folded_titles(rows: DataFrame, identifier: str, title: str) -> DataFrame:
    """``id``, ``folded`` of rows whose title is not blank; a title of signs only keeps its signs."""

    @F.pandas_udf(StringType())
    def to_fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: fold(t) or t)

    stated = spread(rows.select(identifier, title)).where(F.col(title).rlike(r"\S"))
    return stated.select(F.col(identifier).cast("long").alias("id"), to_fold(title).alias("folded"))


def learn_words(titles: DataFrame) -> Words:
    """Common words and units, counted over all titles, each word once a title."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[tuple[str, int], list[int]] = {}
            for title in batch["folded"]:
                bucket = zlib.crc32(" ".join(sorted(_NUMBER.findall(title))).encode()) % BUCKETS
                for kind, pattern in enumerate((_WORD, _AFTER, _ENDS)):
                    for w in set(pattern.findall(title)):
                        seen.setdefault((w, bucket), [0, 0, 0])[kind] += 1
            if seen:
                n, after, ends = zip(*seen.values())
                yield pd.DataFrame({"w": [w for w, _ in seen], "b": [b for _, b in seen], "n": n, "after": after, "ends": ends})

    spots = titles.select("folded").mapInPandas(count, "w string, b int, n long, after long, ends long").groupBy("w", "b").agg(*[F.sum(k).alias(k) for k in ("n", "after", "ends")])
    counts = spots.groupBy("w").agg(*[F.sum(k).alias(k) for k in ("n", "after", "ends")], F.count("*").alias("b"))
    least = max(FEWEST, COMMON_SHARE * titles.count())
    rows = counts.where((F.col("n") >= least) & (F.col("b") >= FEWEST)).collect()  # at most words per title / COMMON_SHARE
    return Words(
        sorted(r.w for r in rows if len(r.w) >= 3),
        sorted(r.w for r in rows if r.after >= UNIT_SHARE * r.n and _key(r.w) not in _MONTH_KEYS),
        sorted(r.w for r in rows if r.ends >= SUFFIX_SHARE * r.n and 2 <= len(r.w) <= 6),
    )


def _in_reach(radius: int, a: str = "a", b: str = "b") -> Column:
    """The triangle inequality: points whose distances to any pivot differ by more than the radius are farther apart than it."""
    near = [F.abs(F.col(f"{a}.d")[k] - F.col(f"{b}.d")[k]) <= radius for k in range(PIVOTS)]
    out = near[0]
    for n in near[1:]:
        out = out & n
    return out


def _verified(pairs: DataFrame, radius: int) -> DataFrame:
    """Of pairs of points ``a`` and ``b`` those within the radius by the true metric."""

    @F.pandas_udf("boolean")
    def near(fa: pd.Series, la: pd.Series, fb: pd.Series, lb: pd.Series) -> pd.Series:
        return pd.Series([distance((list(w), x), (list(v), y)) <= radius for w, x, v, y in zip(fa, la, fb, lb)])

    return pairs.where(near("a.facts", "a.letters", "b.facts", "b.letters"))


def link_points(points: DataFrame, leaders: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Links of new points to leaders, ``pk`` and ``leader`` (a ``pk``), and the points that become leaders themselves.

    In the order of arrival a point leads if no earlier leader lies within ``radius``; every point is linked to all earlier leaders within
    it. As that depends on earlier leaders only, a point gets the same links whether history came at once or in batches, and history
    need not be compared again. Both sides are range-partitioned by the distance to the first pivot; pairs are pruned by the
    others and verified by the metric. The first point of a cell leads; what lies near a leader is found by a join, which splits hot
    cells; only points near no leader go through a sweep, which holds leaders alone.
    """
    taken = leaders.select("cell").distinct().withColumn("led", F.lit(True))
    first = points.join(taken, "cell", "left_anti").groupBy("cell").agg(F.min_by(F.struct("pk", "facts", "letters", "d", "id"), "id").alias("l"))
    first = first.select("cell", "l.*")
    known = leaders.select(*first.columns).unionByName(first)
    pairs = points.alias("a").join(known.alias("b"), "cell").where((F.col("a.pk") != F.col("b.pk")) & _in_reach(radius))
    found = keep(_verified(pairs, radius).select(F.col("a.pk").alias("pk"), F.col("b.pk").alias("leader")))
    # cells with one point have nothing to sweep
    led = first.select("pk").unionByName(found.select("pk")).distinct()
    rest = points.join(led, "pk", "left_anti").repartitionByRange("cell").sortWithinPartitions("cell", "id")

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, []
        for batch in batches:
            out = []
            for cell, pk, facts, letters, d in zip(*(batch[c].tolist() for c in ("cell", "pk", "facts", "letters", "d"))):
                if cell != current:
                    current, held = cell, []
                point = (list(facts), letters)
                near = any(all(abs(x - y) <= radius for x, y in zip(d, e)) and distance(point, other) <= radius for other, e in held)
                if not near:
                    held.append((point, list(d)))
                    out.append(pk)
            yield pd.DataFrame({"pk": pd.Series(out, dtype="int64")})

    swept = keep(rest.select("cell", "pk", "facts", "letters", "d").mapInPandas(sweep, "pk long"))
    later = points.join(swept, "pk", "left_semi")
    more = points.alias("a").join(later.alias("b"), "cell").where((F.col("a.id") > F.col("b.id")) & _in_reach(radius))
    links = found.unionByName(_verified(more, radius).select(F.col("a.pk").alias("pk"), F.col("b.pk").alias("leader")))
    return links, first.select("pk").unionByName(swept)


def components(members: DataFrame) -> DataFrame:
    """``id``, ``first``: the least id that each row is tied to through shared classes, from pairs ``id``, ``cls``.

    Labels pass from rows to classes and back, and from each label's own row, so that long chains are halved; every round is cut
    by a table in the shared folder.
    """
    sized = members.groupBy("cls").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("cls")
    edges = keep(members.join(sized, "cls", "left_semi").distinct())
    labels = edges.groupBy("id").agg(F.min("id").alias("first"))
    while True:
        of_class = edges.join(labels, "id").groupBy("cls").agg(F.min("first").alias("first"))
        near = edges.join(of_class, "cls").groupBy("id").agg(F.min("first").alias("first"))
        jump = near.select(F.col("id").alias("first"), F.col("first").alias("farther"))
        new = near.join(jump, "first", "left").select("id", F.least("first", "farther").alias("first"))
        moved = keep(new.join(labels.withColumnRenamed("first", "old"), "id").select("id", "first", (F.col("first") < F.col("old")).alias("moved")))
        labels = moved.select("id", "first")
        if not moved.where("moved").limit(1).count():
            return labels


def pages(rows: DataFrame, identifier: str, url: str) -> DataFrame:
    """``id`` and ``cls`` of the page that each row's URL leads to, a 64-bit hash; rows without a page are left out."""
    page = F.transform(F.array(normalize_url(F.col(url))), lambda p: F.when(p != "", F.xxhash64(p)))
    return rows.select(F.col(identifier).cast("long").alias("id"), F.explode(F.filter(page, lambda p: p.isNotNull())).alias("cls"))


class History:
    """What was accepted so far, in a folder, as tables that only grow: a part a batch, written again as a whole if a batch is repeated.

    ``points`` are the pivot-distance table of distinct titles with their leaders marked, range-partitioned by the first distance;
    ``classes`` the first row of every title and page that ties rows; ``rows`` every row with its first row; ``merges`` the first
    rows that a later row tied to earlier ones.
    """

    TABLES = {
        "points": f"{POINT}, id long, leader boolean",
        "classes": "cls long, first long",
        "rows": "id long, first long",
        "merges": "old long, first long",
    }

    def __init__(self, spark: SparkSession, folder: str, words: Words | None = None) -> None:
        self.spark, self.folder = spark, folder
        kept = read_text(spark, f"{folder}/words.json")
        if kept is None:
            if words is None:
                raise ValueError("a history begins with the words that its titles are measured by")
            write_text(spark, f"{folder}/words.json", json.dumps(asdict(words)))
        self.words = Words(**json.loads(kept)) if kept is not None else words

    def read(self, name: str, but: int | None = None) -> DataFrame:
        """A table, without the part of batch ``but``."""
        schema = self.TABLES[name]
        df = read_or_empty(self.spark, f"{self.folder}/{name}", f"{schema}, batch int")
        return (df if but is None else df.where(F.col("batch") != but)).drop("batch")

    def append(self, name: str, df: DataFrame, batch: int) -> None:
        df.select(*[c.split()[0] for c in self.TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def resolved(self, firsts: DataFrame, but: int | None = None) -> DataFrame:
        """``firsts`` (with a column ``first``) after all merges; a merge leads to an earlier row, so every step ends."""
        merges = self.read("merges", but).groupBy("old").agg(F.min("first").alias("into"))
        while True:
            step = firsts.join(merges, F.col("first") == F.col("old"), "left")
            firsts = keep(step.select(*[c for c in firsts.columns if c != "first"], F.coalesce("into", "first").alias("first"), F.col("into").isNotNull().alias("_moved")))
            if not firsts.where("_moved").limit(1).count():
                return firsts.drop("_moved")
            firsts = firsts.drop("_moved")

    def accept(self, rows: DataFrame, batch: int, identifier: str = "log_seq", title: str = "title", url: str = "url") -> None:
        """Checks a batch against everything accepted and appends it. Identifiers are unique, not null, and ascend from batch to batch.

        Of history only leaders in the cells of the batch's titles, and classes that its rows state, are read; older rows whose
        announcements the batch shows to be one are merged without being read.
        """
        ids = rows.select(F.col(identifier).cast("long").alias("id"))
        table = keep(pivot_table(folded_titles(rows, identifier, title), self.words))
        points = keep(table.groupBy("pk").agg(F.min("id").alias("id"), *[F.any_value(c).alias(c) for c in ("cell", "facts", "letters", "d")]))
        old = self.read("points", batch)
        fresh = points.join(old.select("pk"), "pk", "left_anti")
        leaders = old.where("leader").join(fresh.select("cell").distinct(), "cell", "left_semi")
        links, led = link_points(fresh, leaders)
        links = keep(links)
        by_title = table.select("id", F.col("pk").alias("cls"))
        by_link = links.join(fresh.select("pk", "id"), "pk").select("id", F.col("leader").alias("cls"))
        stated = keep(by_title.unionByName(by_link).unionByName(pages(rows, identifier, url)).distinct())
        known = self.resolved(self.read("classes", batch).join(stated.select("cls").distinct(), "cls", "left_semi"), batch)
        tied = keep(components(stated.unionByName(known.select(F.col("first").alias("id"), "cls"))))
        was = known.select(F.col("first").alias("old")).distinct()
        self.append("merges", tied.join(was, tied.id == was.old).where(F.col("first") < F.col("old")).select("old", "first"), batch)
        firsts = keep(ids.select("id").distinct().join(tied, "id", "left").select("id", F.coalesce("first", "id").alias("first")))
        self.append("rows", firsts, batch)
        news = stated.join(firsts, "id").groupBy("cls").agg(F.min("first").alias("first"))
        self.append("classes", news.join(known.select("cls"), "cls", "left_anti"), batch)
        marked = fresh.join(led.distinct().withColumn("leader", F.lit(True)), "pk", "left").withColumn("leader", F.coalesce("leader", F.lit(False)))
        self.append("points", marked.repartitionByRange("cell").sortWithinPartitions("cell"), batch)

    def ties(self) -> DataFrame:
        """``id``, ``first`` of every accepted row that is not the first of its announcement."""
        return self.resolved(self.read("rows")).where(F.col("id") != F.col("first"))


def announcements(rows: DataFrame, identifier: str = "log_seq", title: str = "title", url: str = "url") -> DataFrame:
    """Each later row of an announcement with its first row, as ``<identifier>_a`` (first) and ``<identifier>_b``.

    Rows are one announcement if their URLs lead to one page, or if their titles lie within RADIUS of one leading title: then the facts
    agree and the rest differs by little. Null and blank titles and URLs tie nothing. Identifiers are unique and ascend with arrival.
    All rows are one batch to an empty history; :class:`History` gives the same result in several.
    """
    titles = keep(folded_titles(rows, identifier, title))
    table = keep(pivot_table(titles, learn_words(titles)))
    # only cells with several points have anything to compare
    several = table.groupBy("cell").agg(F.min("pk").alias("a"), F.max("pk").alias("b")).where("a < b").select("cell")
    points = keep(table.join(several, "cell", "left_semi").groupBy("pk").agg(F.min("id").alias("id"), *[F.any_value(c).alias(c) for c in ("cell", "facts", "letters", "d")]))
    links, _ = link_points(points, points.limit(0))
    by_title = table.select("id", F.col("pk").alias("cls"))
    by_link = links.join(points.select("pk", "id"), "pk").select("id", F.col("leader").alias("cls"))
    found = components(keep(by_title.unionByName(by_link).unionByName(pages(rows, identifier, url)))).where(F.col("id") != F.col("first"))
    return found.select(F.col("first").alias(f"{identifier}_a"), F.col("id").alias(f"{identifier}_b"))


def announcements_in_batches(
    rows: DataFrame, folder: str, batch_no: str = "batch_no", parts: int = 4, identifier: str = "log_seq", title: str = "title", url: str = "url"
) -> DataFrame:
    """:func:`announcements` of rows that arrive in ``parts`` portions of consecutive batches, each checked against the history of those before.

    The words are learned over all rows, so that the result is that of one batch.
    """
    words = learn_words(keep(folded_titles(rows, identifier, title)))
    history = History(rows.sparkSession, folder, words)
    span = rows.agg(F.min(batch_no).alias("lo"), F.max(batch_no).alias("hi")).first()
    portion = F.floor((F.coalesce(batch_no, F.lit(span.lo or 0)) - F.lit(span.lo or 0)) * parts / ((span.hi or 0) - (span.lo or 0) + 1))
    for n in range(parts):
        history.accept(rows.where(portion == n), n, identifier, title, url)
    return history.ties().select(F.col("first").alias(f"{identifier}_a"), F.col("id").alias(f"{identifier}_b"))
