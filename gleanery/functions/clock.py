"""Opening times and deadlines written in texts, as Column expressions. Wall clocks are in the reader's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import let

ZONE = "Asia/Shanghai"
#: A date without a year lies at most so many days ahead of the text.
YEARLESS_DAYS = 45

# How a Chinese notice leads in to its own end, and, in the rules below, how dates, clocks and durations are written.
_LEAD = "(?:截止|截至|有效期至|核销期限|使用期限|结束时间|活动至|到期|开放至|持续至|顺延至|延期至|延长至|免费至|限免至)"
_TAIL = r"([\s\S]*)"
_CLOCK = r"^(?:日|号)?\s*(凌晨|上午|中午|下午|晚上)?\s*(\d{1,2})\s*[:时点]\s*(\d{1,2})?"
_NUMERALS = "一二三四五六七八九十"


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match; null if it took no part."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _int(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i).try_cast("int")


def _instant(y: Column, m: Column, d: Column, clock: Column, zone: str) -> Column:
    """An instant of the zone, null for an impossible date."""
    ok = y.between(2000, 2100) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.try_make_timestamp(y, m, d, clock.h, clock.mi, clock.s.cast("decimal(8,6)"), F.lit(zone)))


def _hour(word: Column, hour: Column) -> Column:
    return F.when(word.isin("下午", "晚上") & (hour < 12), hour + 12).when((word == "中午") & (hour < 11), hour + 12).otherwise(hour)


def _time(h: int | Column, mi: int | Column, s: int) -> Column:
    h, mi = (F.lit(x) if isinstance(x, int) else x for x in (h, mi))
    return F.struct(h.alias("h"), mi.alias("mi"), F.lit(s).alias("s"))


def _clock_after(rest: Column) -> Column:
    """The clock that hugs a date; 24 is the end of that day; without one the last second of the day."""
    stated = F.struct(F.regexp_extract(rest, _CLOCK, 1).alias("word"), _int(rest, _CLOCK, 2).alias("h"), F.coalesce(_int(rest, _CLOCK, 3), F.lit(0)).alias("mi"))
    read = let(stated, lambda c: F.when(c.h <= 24, F.struct(_hour(c.word, c.h).alias("h"), c.mi.alias("mi"))))
    return let(read, lambda c: F.when(c.h == 24, _time(23, 59, 0)).when(c.h.isNotNull() & (c.mi <= 59), _time(c.h, c.mi, 0)).otherwise(_time(23, 59, 59)))


def _english_month(text: Column) -> Column:
    names = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])
    return F.nullif(F.array_position(names, F.lower(F.substring(text, 1, 3))).cast("int"), F.lit(0))


def _yearless(parts: Column, anchor: Column, zone: str) -> Column:
    """Month ``m`` and day ``d`` in the anchor's year, or the next if that is past; refused when impossible or too far ahead."""

    def choose(x: Column) -> Column:
        year = F.year(F.from_utc_timestamp(anchor, zone))
        last = anchor + F.make_dt_interval(F.lit(YEARLESS_DAYS))
        both = F.struct(_instant(year, x.m, x.d, x.c, zone).alias("this"), _instant(year + 1, x.m, x.d, x.c, zone).alias("next"))
        return let(
            both,
            lambda t: F.when(t.this >= anchor, F.when(t.this <= last, t.this)).when((t.this < anchor) & (t.next >= anchor) & (t.next <= last), t.next),
        )

    return let(let(parts, lambda p: F.struct(p.m.alias("m"), p.d.alias("d"), _clock_after(p.r).alias("c"))), choose)


def expires_at(text: Column, anchor: Column, zone: str = ZONE) -> Column:
    """The deadline a text states, null if none can be read.

    Rules are tried in order, each on its first match: a date after a lead-in, an English one, a date before a closing word, a
    date with 前, the end of a range, a date without year, the end of an abbreviated range, a stated duration. The last
    three need an ``anchor``, the text's own time.
    """

    def dated(y: Column, m: Column, d: Column, rest: Column) -> Column:
        parts = F.struct(y.alias("y"), m.alias("m"), d.alias("d"), _clock_after(rest).alias("c"))
        return let(parts, lambda p: _instant(p.y, p.m, p.d, p.c, zone))

    def if_met(pattern: str, rule: Column) -> Column:
        # one search per rule decides; its parts are only taken out of a text that has them
        return F.when(text.rlike(pattern), rule)

    def ymd(pattern: str) -> Column:
        p = pattern + _TAIL
        return if_met(pattern, dated(_int(text, p, 1), _int(text, p, 2), _int(text, p, 3), F.regexp_extract(text, p, 4)))

    lead = ymd(rf"{_LEAD}[^0-9\n]{{0,6}}?(20\d{{2}})\s*[-/.年]\s*(\d{{1,2}})\s*[-/.月]\s*(\d{{1,2}})")
    stated = r"(?i)(?:until|ends?\s+(?:on|by)|deadline|valid\s+(?:thru|through|until))\s+([a-z]{3,9})\.?\s+(\d{1,2})[, ]+(\d{4})"
    en = stated + _TAIL
    english = if_met(stated, dated(_int(text, en, 3), _english_month(F.regexp_extract(text, en, 1)), _int(text, en, 2), F.regexp_extract(text, en, 4)))
    suffix = ymd(r"(20\d{2})-(\d{1,2})-(\d{1,2})\s*(?:前结束|截止|到期|失效|过期)")
    before = ymd(r"(20\d{2})\s*[-/.年]\s*(\d{1,2})\s*[-/.月]\s*(\d{1,2})\s*日?\s*(?:之?前)")

    def md(pattern: str) -> Column:
        p = pattern + _TAIL
        return if_met(pattern, _yearless(F.struct(_int(text, p, 1).alias("m"), _int(text, p, 2).alias("d"), F.regexp_extract(text, p, 3).alias("r")), anchor, zone))

    yearless = F.coalesce(md(rf"{_LEAD}[^0-9\n]{{0,6}}?(\d{{1,2}})月(\d{{1,2}})日"), md(r"(\d{1,2})月(\d{1,2})日\s*(?:之?前)"))

    sr = r"(\d{1,2})月(\d{1,2})[日号]?[^\d\n]{0,3}?(?:至|到|~|—|–|-)\s*(\d{1,2})\s*[日号]"
    abbreviated, sr = sr, sr + _TAIL
    tail = F.struct(_int(text, sr, 1).alias("m"), _int(text, sr, 3).alias("d"), F.regexp_extract(text, sr, 4).alias("r"))
    short = if_met(abbreviated, _yearless(F.when(_int(text, sr, 3) > _int(text, sr, 2), tail), anchor, zone))
    return F.coalesce(lead, english, suffix, before, _range_end(text, zone), yearless, short, _duration_end(text, anchor, zone))


def _range_end(text: Column, zone: str) -> Column:
    """The second of two joined full dates; a clock right after it must be a possible one."""
    p = r"^([\s\S]*?)(?:至|到|~|—|–)\s*(20\d{2})[-/.年]\s*(\d{1,2})[-/.月]\s*(\d{1,2})" + _TAIL
    hugging = r"^\s*(\d{1,2})\s*[:时点]\s*(\d{1,2})?"
    parts = F.struct(
        F.regexp_extract(text, p, 1).alias("head"), _int(text, p, 2).alias("y"), _int(text, p, 3).alias("m"), _int(text, p, 4).alias("d"), F.regexp_extract(text, p, 5).alias("r")
    )

    def read(x: Column) -> Column:
        clock = let(
            F.struct(_int(x.r, hugging, 1).alias("h"), F.coalesce(_int(x.r, hugging, 2), F.lit(0)).alias("mi")),
            lambda c: F.when(c.h.isNull(), _time(23, 59, 59)).when((c.h <= 23) & (c.mi <= 59), _time(c.h, c.mi, 0)),
        )
        return F.when(x.head.rlike(r"20\d{2}[-/.年]\s*\d{1,2}[-/.月]\s*\d{1,2}"), let(clock, lambda c: _instant(x.y, x.m, x.d, c, zone)))

    return F.when(text.rlike(r"(?:至|到|~|—|–)\s*20\d{2}[-/.年]"), let(parts, read))


def _duration_end(text: Column, anchor: Column, zone: str) -> Column:
    """The end of a window stated as a duration; any date written in the text outranks it. Months overflow into the next."""
    p = rf"(?:限时|限免|为期)[^0-9\n{_NUMERALS}两]{{0,4}}?([{_NUMERALS}两]|\d{{1,2}})\s*(小时|天|日|周|个月|月)"
    dated = text.rlike(r"\d{1,2}\s*月\s*\d{1,2}\s*[日号]|20\d{2}\s*[-/.年]\s*\d{1,2}")
    said = F.when(~dated, F.struct(F.regexp_extract(text, p, 1).alias("n"), F.regexp_extract(text, p, 2).alias("unit")))

    def number(x: Column) -> Column:
        word = F.nullif(F.array_position(F.array(*map(F.lit, _NUMERALS)), F.when(x.n == "两", F.lit("二")).otherwise(x.n)).cast("int"), F.lit(0))
        return F.struct(F.coalesce(x.n.try_cast("int"), word).alias("n"), x.unit.alias("unit"))

    def end(x: Column) -> Column:
        local = F.to_date(F.from_utc_timestamp(anchor, zone))
        n = F.when(x.unit == "周", x.n * 7).otherwise(x.n)
        months = F.date_add(F.add_months(F.trunc(local, "month"), x.n), F.dayofmonth(local) - 1)
        day = F.when(x.unit.isin("个月", "月"), months).otherwise(F.date_add(local, n))
        last = let(day, lambda t: F.try_make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.lit(23), F.lit(59), F.lit(59).cast("decimal(8,6)"), F.lit(zone)))
        hours = F.when(x.n <= 72, anchor + F.make_dt_interval(F.lit(0), x.n))
        return F.when(x.n >= 1, F.when(x.unit == "小时", hours).when(n <= 366, last))

    return F.when(text.rlike(p), let(let(said, number), end))


def starts_at(text: Column, anchor: Column, zone: str = ZONE) -> Column:
    """The first date with an hour that a text states as an opening, null if none.

    Dates inside a deadline sentence and impossible ones are passed over. A date without year is in the anchor's.
    """
    core = (
        r"(?:(\d{4})年)?(\d{1,2})月(\d{1,2})日?[^0-9]{0,8}?(上午|中午|下午|晚上|凌晨)?[^0-9]{0,4}?(\d{1,2})\s*(?:时|点|:)\s*(\d{1,2})?"
    )
    found = F.regexp_extract_all(F.translate(text, "：", ":"), F.lit(rf"(?:{_LEAD}[^0-9\n]{{0,6}})?(?:{core})"), F.lit(0))
    year = F.year(F.from_utc_timestamp(anchor, zone))

    def one(m: Column) -> Column:
        parts = F.struct(
            F.coalesce(_int(m, core, 1), year).alias("y"), _int(m, core, 2).alias("m"), _int(m, core, 3).alias("d"),
            _hour(F.regexp_extract(m, core, 4), _int(m, core, 5)).alias("h"), F.coalesce(_int(m, core, 6), F.lit(0)).alias("mi"),
        )
        opening = F.when(~m.rlike("^" + _LEAD), parts)
        return let(opening, lambda x: F.when((x.h <= 23) & (x.mi <= 59), _instant(x.y, x.m, x.d, _time(x.h, x.mi, 0), zone)))

    first = F.get(F.filter(F.transform(found, one), lambda t: t.isNotNull()), F.lit(0))
    return F.when(F.contains(text, F.lit("月")), first)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """The calendar day of an instant on the reader's clock."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")
