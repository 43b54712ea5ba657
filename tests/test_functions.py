"""Text, URL, clock and document functions, and the additive score."""

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.documents import class_windows, is_challenge
from gleanery.functions.url import host_of, normalize_url
from gleanery.operators import rounds
from gleanery.sources.pages import PageSource, blocked


def values(spark, rows, make):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r.v for r in df.select("i", make(F.col("s")).alias("v")).orderBy("i").collect()]


def test_normalize_url(spark):
    rows = ["https://www.A.example/p/?utm_x=1&q=2#top", "http://a.example/p/#x", "a.example/?from=1", " https://a.example/t/ ", "", None]
    assert values(spark, rows, normalize_url) == ["a.example/p/?q=2", "a.example/p/", "a.example", "a.example/t", "", None]


def test_host_of(spark):
    rows = ["https://u:p@www.A.example:8080/x", "a.example/x?y", "https://[::1]:80/", "", None]
    assert values(spark, rows, host_of) == ["www.a.example", "a.example", "[::1]", "", ""]


def test_dedup_key(spark):
    rows = ["[福利] 推广：Free GPU hours today", "【公告】【转】free gpu HOURS, today!", "(a) short", None, "", "[" + "x" * 30 + "] long wrapper stays"]
    assert values(spark, rows, T.dedup_key) == ["free gpu hours today", "free gpu hours today", "", None, "", "x" * 30 + " long wrapper stays"]


def test_bounded_words(spark):
    rows = ["freedom", "it is free now", "FREE", "feel free-ish", "sugarfree", None]
    assert values(spark, rows, lambda c: F.coalesce(T.bounded(c, "free"), F.lit(False))) == [False, True, True, True, False, False]


def test_scan_and_evidence(spark):
    rows = ["智谱 glm-4.5 免费试用，三折优惠", "nothing", ""]
    got = values(spark, rows, T.scan_offers)
    assert [o.matched for o in got[0]] == ["免费", "免费试用", "三折", "试用"]
    assert got[0][0].vendor == "智谱AI" and got[0][0].product == "glm-4.5" and got[0][0].evidence == rows[0]
    assert got[1] == [] and got[2] == []


def test_discount(spark):
    assert values(spark, ["8.5折", "全场三折", "20% off and 70% off", "save 3% off", "off up to 40%", ""], T.discount_pct) == [50, 0, 70, 0, 40, 0]


def test_claimable(spark):
    df = spark.createDataFrame([("free?", True), ("free", True), ("求助 free", True), ("申请教程", True), ("x", False), (None, True)], "t string, f boolean")
    none = F.array().cast("array<struct<kind:string>>")
    assert [r.v for r in df.select(T.claimable(F.col("t"), F.col("f"), F.lit(0), none).alias("v")).collect()] == [False, True, False, True, False, True]


def test_windows_and_challenge(spark):
    assert values(spark, ["aaXbbx", "none"], lambda c: class_windows(c, "x", 3)) == [["Xbb", "x"], ["none"]]
    assert values(spark, ["<div class=anomaly-modal>", "fine"], is_challenge) == [True, False]


def test_score(spark):
    args = dict(vendor=F.lit(True), product=F.lit(True), official=F.lit(False), trust=F.lit(99), n_offers=F.lit(2), age=F.lit(3600))
    s = rounds.score(F.array(F.lit("trial"), F.lit("free")), F.lit(60), **args)
    top_up = rounds.score(F.array(), F.lit(7), F.lit(False), F.lit(False), F.lit(False), F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("double"))
    row = spark.range(1).select(s.alias("s"), top_up.alias("t")).first()
    assert row.s.score == 100 and row.s.why[:2] == ["+12 cut", "+45 free"]
    assert row.t.score == 24 and row.t.why == ["+0 cut", "+24 stated cut"]


def test_freshness_edges(spark):
    day = 86_400
    ages = [-5, day, day + 1, 3 * day, 7 * day, 7 * day + 1, 30 * day, 30 * day + 1, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a long")
    got = [r.v for r in df.orderBy("i").select(rounds.freshness(F.col("a")).alias("v")).collect()]
    assert got == [12, 12, 8, 8, 4, 0, 0, -12, 0]


def test_page_source(spark, tmp_path):
    (tmp_path / "https%3A%2F%2Fa.example%2F1").write_text("<p>hi</p>")
    spark.dataSource.register(PageSource)
    df = spark.read.format("pages").option("urls", "https://a.example/1\nhttps://b.example/2").option("root", str(tmp_path)).load()
    assert {(r.url, r.status.split(":")[0]) for r in df.collect()} == {("https://a.example/1", "ok"), ("https://b.example/2", "error")}


def test_egress_guard():
    assert blocked("169.254.169.254", True) and blocked("127.0.0.1") and blocked("10.0.0.1") and blocked("::ffff:10.0.0.1")
    assert not blocked("127.0.0.1", True) and not blocked("93.184.216.34")


def test_fetching_with_guard_redirects_and_retries(monkeypatch):
    """A local server: loopback is refused unless allowed, also behind a redirect; 5xx is tried again; the final URL is told."""
    import http.server
    import threading
    import urllib.error

    import pytest

    from gleanery.sources import pages

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
            elif self.path == "/away":
                self.send_response(302)
                self.send_header("Location", "http://169.254.169.254/latest")
            else:
                self.send_response(500 if self.path == "/busy" and asked.count("/busy") < 2 else 200)
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    monkeypatch.setattr(pages, "PAUSE_AFTER_S", 0.01)
    try:
        assert pages.fetch_http(f"{base}/moved", True) == ("body", f"{base}/page")
        assert pages.fetch_http(f"{base}/busy", True)[0] == "body" and asked.count("/busy") == 2
        for url, private in ((f"{base}/page", False), (f"{base}/away", True)):
            with pytest.raises((PermissionError, urllib.error.URLError)) as refused:
                pages.fetch_http(url, private)
            assert "not to be fetched" in str(refused.value)
    finally:
        server.shutdown()


def test_sql_functions(spark):
    from gleanery.plans.sql_functions import register

    register(spark)
    row = spark.sql("SELECT decode_entities('a &amp; b') AS a, redact_text('token=abcdefghij') AS b, utc_ms('2026-01-01', 'UTC') AS c").first()
    assert (row.a, row.b, row.c) == ("a & b", "token=abcd…****ij", 1767225600000)
    assert [tuple(r) for r in spark.sql("SELECT * FROM scan_words('Free and free', 'free, x')").collect()] == [("free", 0), ("free", 9)]


def test_expressions_in_sql(spark):
    """Functions registered for SQL are the column expressions themselves."""
    from gleanery.plans.sql_functions import FUNCTIONS, register

    register(spark)
    rows = [("【转】Free GPU hours, today!", "https://www.A.example/p/?utm_x=1&q=2#top", "8.5折 20% off"), ("x", "", "限时免费至9月20日"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, u string, s string").withColumn("a", F.lit("2026-09-10 08:00:00").cast("timestamp"))
    df.createOrReplaceTempView("texts")
    for name, parameters, _, make in FUNCTIONS:
        names = [p.split()[0] for p in parameters.split(", ")]
        want = [r.v for r in df.select(make(*map(F.col, names)).alias("v")).collect()]
        assert [r.v for r in spark.sql(f"SELECT {name}({', '.join(names)}) AS v FROM texts").collect()] == want, name
    assert spark.sql("SELECT inline(o) FROM (SELECT scan_offers(s) AS o FROM texts)").count() > 0
