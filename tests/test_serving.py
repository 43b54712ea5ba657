"""Configuration, the read interface and SQL functions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from gleanery.serving import config as C
from gleanery.serving.api import ReadApi, text_table
from tests.test_rounds import LOG, row

SOURCE = {"name": "a", "kind": "RSS ", "url": "https://a.example/feed"}


def test_durations():
    assert [C.seconds(x) for x in ("20m", 90, "1h30m", "1.5s", "250ms")] == [1200, 90, 5400, 1.5, 0.25]
    for bad in ("", "5", "1x", "h"):
        with pytest.raises(C.ConfigError):
            C.seconds(bad)


def test_env_file():
    assert C.env_file("# c\n\nA=1\nB = 'two'\r\nC=x=y", {"A": "0"}) == {"A": "0", "B": "two", "C": "x=y"}
    with pytest.raises(C.ConfigError):
        C.env_file("A", {})


def test_load(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"interval_s": "20m", "sources": [SOURCE], "extra_sources": [{**SOURCE, "name": "b", "disabled": True, "params": {"x": " "}}]}))
    c = C.load(spark, f"file://{path}", {"GLEANERY_URGENT_SCORE": "70", "GLEANERY_SERVE": "no"})
    assert (c.interval_s, c.urgent_score, c.serve, c.require_offer) == (1200, 70, False, True)
    assert [(s.name, s.kind) for s in c.sources] == [("a", "rss"), ("b", "rss")] and [s.name for s in c.enabled()] == ["a"]
    assert c.sources[1].param("x", "d") == "d"
    assert C.load(spark, f"{tmp_path}/absent.json", {}) == C.check(C.Config())
    assert [r.place for r in C.source_table(spark, c.sources).orderBy("place").collect()] == [0, 1]


def test_refusals():
    for wrong in ({"interval_s": 5}, {"urgent_score": 101}, {"timezone": "Mars/X"}, {"daily_at": "25:00"}, {"log_level": "loud"}, {"event_per_day": -1}, {"data_dir": " "}):
        with pytest.raises(C.ConfigError):
            C.check(C.Config(**wrong))
    for wrong in ([{**SOURCE, "name": " "}], [SOURCE, SOURCE], [{**SOURCE, "kind": "x"}], [{**SOURCE, "url": "ftp://a"}], [{**SOURCE, "trust": 11}]):
        with pytest.raises(C.ConfigError):
            C.check(C.Config(sources=[C.Source(**s) for s in wrong]))


def test_bind():
    for ok in ("127.0.0.1:1", "[::1]:80", "100.64.0.1:80", "10.0.0.1:80", "localhost:80"):
        C.check_bind(ok, False, False)
    for bad in ("0.0.0.0:80", ":80", "8.8.8.8:80", "a.example:80", "127.0.0.1"):
        with pytest.raises(C.ConfigError):
            C.check_bind(bad, False, False)
    C.check_bind("0.0.0.0:80", True, False)


def test_extras_are_unique(spark):
    a = C.source_table(spark, [C.Source(**SOURCE)])
    b = C.source_table(spark, [C.Source(**{**SOURCE, "name": "b"})])
    assert C.with_extras(a, b).count() == 2
    with pytest.raises(Exception, match="two sources are named a"):
        C.with_extras(a, a).collect()


def test_backup_age(spark, tmp_path):
    now = datetime.datetime(2026, 1, 6, tzinfo=datetime.UTC)
    with pytest.raises(FileNotFoundError):
        C.backup_age(spark, str(tmp_path), now)
    for text, ok in (("", False), ("soon x", False), ("2026-01-05T00:00:00Z a.tar", True)):
        (tmp_path / "backup.stamp").write_text(text)
        if ok:
            assert C.backup_age(spark, str(tmp_path), now) == (86_400, "a.tar")
        else:
            with pytest.raises(ValueError):
                C.backup_age(spark, str(tmp_path), now)
        (tmp_path / ".backup.stamp.crc").unlink(missing_ok=True)


@pytest.fixture(scope="module")
def api(spark):
    at = F.lit("2026-01-06 00:00:00").cast("timestamp")
    rows = [row("a", 1, score=90), row("b", 2, "[x] an offer, that is long enough!", 80), row("c", 3, "Another offer, quite long", 30, {"expires_at": "2026-01-07T00:00:00Z"})]
    log = spark.createDataFrame(rows, LOG).withColumns({"discovered_at": at, "summary": F.lit("s"), "vendors": F.array(F.lit("v"))})
    sources = spark.createDataFrame([(1, "s", False), (2, "quiet", False)], "source_id int, name string, disabled boolean")
    return ReadApi(lambda: log, sources, lambda: spark.createDataFrame([], "key string"), lambda: at, lambda: [{"new": 3}])


def ask(api, path, query="", method="GET"):
    got = {}
    body = b"".join(api({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query}, lambda code, headers: got.update(code=code, headers=dict(headers))))
    return got["code"][:3], json.loads(body) if body else None, got["headers"]


def test_findings(api):
    code, body, headers = ask(api, "/api/v1/deals")
    assert code == "200" and [d["fingerprint"] for d in body["deals"]] == ["a", "c"] and body["folded_duplicates"] == 1
    assert headers["X-Frame-Options"] == "DENY"
    assert ask(api, "/api/v1/deals", "dupes=1&limit=2&min=50")[1]["count"] == 2
    assert ask(api, "/api/v1/deals", "q=ANOTHER&limit=-4")[1]["count"] == 1
    assert ask(api, "/api/v1/deals", "source=none")[1] == {"count": 0, "deals": [], "folded_duplicates": 1}


def test_other_routes(api):
    assert ask(api, "/healthz")[1] == {"status": "ok"}
    s = ask(api, "/api/v1/status")[1]
    assert s["store"]["deals_seen"] == 3 and s["store"]["duplicates"] == 1 and s["sources"] == {"configured": 2, "enabled": 2}
    assert {(r["name"], r["verdict"]) for r in ask(api, "/api/v1/sources")[1]} == {("s", "ok"), ("quiet", "never")}
    assert ask(api, "/api/v1/runs")[1] == [{"new": 3}]
    assert [e["fingerprint"] for e in ask(api, "/api/v1/events")[1]] == ["c"]
    assert ask(api, "/none")[0] == "404" and ask(api, "/healthz", method="POST")[0] == "405" and ask(api, "/healthz", method="HEAD")[1] is None
    broken = ReadApi(lambda: 1 / 0, None, None, None, None)
    assert ask(broken, "/api/v1/deals")[:2] == ("500", {"error": "internal"})


def test_text_table(spark):
    df = spark.createDataFrame([("a", 1), ("long\nname", None)], "name string, n int")
    assert text_table(df) == "NAME       N\na          1\nlong name"
