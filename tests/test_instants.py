"""Written times as instants."""

from datetime import datetime, timezone

import pytest

from gleanery.functions.instants import utc_ms
from gleanery.operators.time_dictionary import build_dictionary, normalise_instants, publication_instants


def ms(*args, milli=0):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1000) + milli


@pytest.mark.parametrize(
    ("raw", "zone", "want"),
    [
        ("Sun, 29 Mar 2026 00:54:33 +0100", "UTC", ms(2026, 3, 28, 23, 54, 33)),
        ("2026-04-05T03:31:43+10:00", "Europe/Berlin", ms(2026, 4, 4, 17, 31, 43)),
        ("2025-08-17T23:38:44.373404077Z", "UTC", ms(2025, 8, 17, 23, 38, 44, milli=373)),
        ("20260618T175942Z", "Asia/Shanghai", ms(2026, 6, 18, 17, 59, 42)),
        ("2025年9月29日 16:09", "Europe/Berlin", ms(2025, 9, 29, 14, 9)),
        ("Mar 7, 2026 10:49 PM", "UTC", ms(2026, 3, 7, 22, 49)),
        ("Sep 28, 2025 12:34 AM", "UTC", ms(2025, 9, 28, 0, 34)),
        ("08-23-2026", "Asia/Shanghai", ms(2026, 8, 22, 16)),
        ("2025/07/09", "America/New_York", ms(2025, 7, 9, 4)),
        ("Mon, 07 Jul 2025 20:08:58 CST", "Asia/Shanghai", ms(2025, 7, 7, 12, 8, 58)),
        ("Thu, 11 Sep 2025 09:11:27 EDT", "America/New_York", ms(2025, 9, 11, 13, 11, 27)),
        ("1768331375", "UTC", 1768331375000),
        ("1782025375132", "UTC", 1782025375132),
        ("1782025375132999", "UTC", 1782025375132),
        # twice in Berlin: the earlier; skipped: the offset before the change
        ("2025-10-26 02:30:00", "Europe/Berlin", ms(2025, 10, 26, 0, 30)),
        ("2026-03-29 02:30:00", "Europe/Berlin", ms(2026, 3, 29, 1, 30)),
        # an abbreviation settles which of the two it is
        ("Sun, 26 Oct 2025 02:30:00 CET", "Europe/Berlin", ms(2025, 10, 26, 1, 30)),
        *((x, "UTC", None) for x in (None, "", "  ", "0", "N/A", "just now", "0001-01-01T00:00:00Z", "2026-02-30", "x" * 5000)),
    ],
)
def test_utc_ms(raw, zone, want):
    assert utc_ms(raw, zone) == want


def test_dictionary_grows(spark, tmp_path):
    path = str(tmp_path / "times")
    rows = lambda *x: spark.createDataFrame([(i, r, None, 1) for i, r in enumerate(x)], "id int, raw string, tz_name string, utc int")
    assert build_dictionary(rows("2026-01-01", "2026-01-01", "no time", None, ""), path).count() == 2
    got = {r.id: r.utc_ms for r in normalise_instants(rows("2026-01-01", "2026-01-02", "2026-01-02", None), path).collect()}
    assert got == {0: ms(2026, 1, 1), 1: ms(2026, 1, 2), 2: ms(2026, 1, 2), 3: None}
    assert spark.read.parquet(path).count() == 3


def test_empty_tables(spark, sf):
    t = lambda n: spark.read.parquet(f"{sf}/{n}.parquet").limit(0)
    assert publication_instants(t("rss_items"), t("hn_hits"), t("catalog_snapshots"), t("feed_sources")).count() == 0
