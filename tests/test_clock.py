"""Opening times, deadlines, masks and links by hand-written cases."""

from pyspark.sql import functions as F

from gleanery.functions import clock, text
from gleanery.functions.documents import resolve_url
from gleanery.functions.instants import utc_ms

_STARTS = [
    ("消费券将于2026年9月18日上午10点开抢", "2026-09-18 02:00:00"),
    ("9月21日晚上8:30开放领取", "2026-09-21 12:30:00"),
    ("截止9月20日 10:00，9月22日 9:00开抢", "2026-09-22 01:00:00"),
    ("9月31日 10:00 开抢", None),
    ("9月25日 24:00 开放", None),
    ("下周开放", None),
]
_ENDS = [
    ("截止日期：2026年9月30日", "2026-09-30 15:59:59"),
    ("限时免费开放至2026年8月31日 18:00", "2026-08-31 10:00:00"),
    ("Free until September 30, 2026", "2026-09-30 15:59:59"),
    ("2026-09-18 前结束", "2026-09-18 15:59:59"),
    ("需在 2026 年 12 月 31 日前注册", "2026-12-31 15:59:59"),
    ("2026年9月18日10:00至2026年9月25日", "2026-09-25 15:59:59"),
    ("限时免费至9月20日", "2026-09-20 15:59:59"),
    ("8月28日前领取", None),
    ("活动时间9月20日至27日", "2026-09-27 15:59:59"),
    ("限时免费一周", "2026-09-17 15:59:59"),
    ("限时三十天", None),
    ("限免 48 小时", "2026-09-12 08:00:00"),
    ("截止到2026年9月31日", None),
    ("截止9月20日24:00", "2026-09-20 15:59:00"),
    ("限时一个月", "2026-10-10 15:59:59"),
    ("长期有效", None),
]
_TIMES = ["2026-09-01T10:00:00+08:00", "Fri, 04 Sep 2026 10:00:00 GMT", "1788000000", "1788000000000", "2026/09/01", "09-01-2026", "0", "just now", "2026-02-30"]
_SECRETS = [
    ("token = abcdefgh1234", "token = abcd…****34"),
    ("Authorization: Bearer sk-123456789", "Authorization: Bearer sk-1…****89"),
    ("password: 'abc4567'", "password: '*******'"),
    ("nothing here", "nothing here"),
]
_ENTITIES = [("a &amp;lt; b", "a &lt; b"), ("&#65;&#x42;&hellip;", "AB…"), ("&unknown; &NBSP;x", "&unknown;  x"), ("plain", "plain")]
_REFS = [
    ("https://a.example/x/y", "../z?q=1", "https://a.example/z?q=1"),
    ("https://a.example/x/", "/abs", "https://a.example/abs"),
    ("https://a.example/", "//b.example/c", "https://b.example/c"),
    ("https://a.example/", "javascript:void(0)", None),
    ("https://a.example/", "", ""),
]
ANCHOR = "2026-09-10 08:00:00"


def _moments(spark, cases, make):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.m for r in df.select("i", make(F.col("t"), F.lit(ANCHOR).cast("timestamp")).cast("string").alias("m")).orderBy("i").collect()]
    assert got == [m for _, m in cases]


def test_starts_at(spark):
    _moments(spark, _STARTS, clock.starts_at)


def test_expires_at(spark):
    _moments(spark, _ENDS, clock.expires_at)


def test_parse_any_time():
    assert [utc_ms(t, "UTC") for t in _TIMES] == [1788228000000, 1788516000000, 1788000000000, 1788000000000, 1788220800000, 1788220800000, None, None, None]


def test_redaction(spark):
    for make, cases in (
        (text.redact, _SECRETS),
        (text.decode_entities, _ENTITIES),
        (text.redact_url, [("https://h.example/open/hook/abcdefghijkl?x=1", "https://h.example/open/hook/abcd…****kl"), ("https://longname:pw@h.example/p", "https://********@***@h.example/p"), ("  ", ""), (None, None)]),
        (text.redact_query, [("https://h.example/p?b=1&a=2&b=3", "https://h.example/p?a=***&b=***"), ("https://h.example/p", "https://h.example/p"), (None, None)]),
        (text.decode_xml_unsafe, [("&lt;b&gt; &mdash; &#65;", "&lt;b&gt; — &#65;"), (None, None)]),
        (text.split_list, [("a; b\n;c\n", ["a", "b", "c"]), ("", []), (None, None)]),
    ):
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
        assert [r.v for r in df.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()] == [w for _, w in cases]


def test_resolve_url(spark):
    df = spark.createDataFrame(_REFS, "base string, ref string, want string")
    assert all(r.got == r.want for r in df.select("want", resolve_url(F.col("base"), F.col("ref")).alias("got")).collect())


def test_all_wrappers_come_off(spark):
    df = spark.createDataFrame([("[a]" * 9 + "Free GPU hours today",)], "t string")
    assert df.select(text.dedup_key(F.col("t")).alias("k")).first().k == "free gpu hours today"
