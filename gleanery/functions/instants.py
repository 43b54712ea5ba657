"""Exhaustive reading of written times as instants."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[AaPp]\.?[Mm]\.?)?"
_ZONE = r"\s*(?P<z>Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{1,5}(?:[+-]\d{1,2})?)?"
_MON = r"(?P<mon>[A-Za-z]{3,9})\.?"
_SHAPES = [
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:[T\s]+{_CLOCK}{_ZONE})?",
        r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?" + _ZONE,
        rf"(?P<y>\d{{4}})年(?P<m>\d{{1,2}})月(?P<d>\d{{1,2}})日?(?:\s*{_CLOCK}{_ZONE})?",
        rf"(?:[A-Za-z]{{3,9}}\.?,?\s+)?(?P<d>\d{{1,2}})[\s-]{_MON}[\s-](?P<y>\d{{4}})(?:,?\s+{_CLOCK}{_ZONE})?",
        rf"(?:[A-Za-z]{{3,9}}\.?,\s+)?{_MON}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}{_ZONE})?",
        rf"(?P<m>\d{{1,2}})[-/](?P<d>\d{{1,2}})[-/](?P<y>\d{{4}})(?:[T\s]+{_CLOCK}{_ZONE})?",
        rf"[A-Za-z]{{3}}\s+{_MON}\s+(?P<d>\d{{1,2}})\s+{_CLOCK}{_ZONE}\s+(?P<y>\d{{4}})",
    )
]


@lru_cache(maxsize=64)
def _zone(name: str | None) -> ZoneInfo:
    try:
        return ZoneInfo(name or "UTC")
    except Exception:
        return ZoneInfo("UTC")


@lru_cache(maxsize=4096)
def _abbreviation(abbr: str, name: str | None, year: int) -> timedelta | None:
    """The offset an abbreviation stands for in the zone named."""
    if abbr in ("Z", "GMT", "UTC", "UT"):
        return timedelta(0)
    zone = _zone(name)
    for month in range(1, 13):
        at = datetime(year, month, 1, 12, tzinfo=zone)
        if at.tzname() == abbr:
            return at.utcoffset()
    return None


def epoch_ms(number: int) -> int | None:
    """Milliseconds of an epoch number in seconds, milli-, micro- or nanoseconds, told by its size."""
    if number <= 0:
        return None
    for bound, numerator, denominator in ((10**11, 1000, 1), (10**14, 1, 1), (10**17, 1, 1000), (10**20, 1, 10**6)):
        if number < bound:
            return number * numerator // denominator
    return None


def utc_ms(raw: str | None, tz_name: str | None) -> int | None:
    """Milliseconds since 1970 of a written time, rounded down, or None if it states none.

    A time without zone is on the clock of ``tz_name``; a zone abbreviation is that zone's own,
    and one unknown there falls back to its clock; a bare date is its local midnight. A wall time
    that occurs twice is the earlier instant, one that is skipped has the offset before the
    change. Null, blank, zero, year 1, words and impossible dates state no time.
    """
    if raw is None:
        return None
    text = raw.strip()
    if not text:
        return None
    if text.isascii() and text.isdigit():
        if len(text) >= 9:
            return epoch_ms(int(text))
        if len(text) != 8:
            return None
        text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
    for shape in _SHAPES:
        found = shape.fullmatch(text)
        if found:
            return _instant(found.groupdict(), tz_name)
    return None


def _instant(g: dict[str, str | None], tz_name: str | None) -> int | None:
    month = int(g["m"]) if g.get("m") else _MONTHS.get((g.get("mon") or "")[:3].lower())
    year, day, hour, minute, second = int(g["y"]), int(g["d"]), int(g.get("h") or 0), int(g.get("mi") or 0), int(g.get("s") or 0)
    if g.get("ap"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"][0] in "Pp" else 0)
    extra = timedelta(0)
    if (hour, minute, second) == (24, 0, 0):
        hour, extra = 0, timedelta(days=1)
    if second == 60:
        second, extra = 59, extra + timedelta(seconds=1)
    if year <= 1 or month is None:
        return None
    try:
        wall = datetime(year, month, day, hour, minute, second) + extra
    except (ValueError, OverflowError):
        return None
    written, offset = g.get("z"), None
    if written and written[0] in "+-":
        digits = written[1:].replace(":", "").ljust(4, "0")
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:])) * (-1 if written[0] == "-" else 1)
    elif written:
        offset = _abbreviation(written.upper(), tz_name, year)
    zone = _zone(tz_name) if offset is None else timezone(offset) if abs(offset) < timedelta(days=1) else timezone.utc
    ms = (wall.replace(tzinfo=zone, fold=0) - _EPOCH) // timedelta(milliseconds=1)
    return ms + int((g.get("f") or "0")[:3].ljust(3, "0"))
