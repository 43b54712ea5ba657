"""The log, the state and streaming rounds."""

import io
import json

from pyspark.sql import functions as F

from gleanery.operators import history
from gleanery.operators.delivery import App, Console, FanOut, FileDrop, Message, Relay, card, signature
from gleanery.operators.state import StateTable
from gleanery.sources.logs import read_log
from gleanery.session import read_text
from gleanery.streaming.round import Channel, Round, judge, next_delay, source_budget, start

LOG = "fingerprint string, log_seq long, title string, url string, source string, category string, score int, is_free boolean, discount_pct int, offers array<struct<kind:string>>, discovered_at timestamp, meta map<string,string>"


def row(fp, seq, title="An offer that is long enough", score=50, meta=None, category="ai_free"):
    return (fp, seq, title, f"https://a.example/{fp}", "s", category, score, True, 0, [], None, meta or {})


def test_collapse_keeps_first_place_and_last_values(spark):
    log = spark.createDataFrame([row("a", 1, score=1), row("b", 2), row("a", 3, score=9), row(None, 4), row(" ", 5)], LOG)
    got = {(r.fingerprint, r.first_seq, r.log_seq, r.score) for r in history.collapse(log).collect()}
    assert got == {("a", 1, 3, 9), ("b", 2, 2, 50)}
    again = history.collapse(history.collapse(log).drop("first_seq"))
    assert again.count() == 2


def test_fold(spark):
    log = spark.createDataFrame([row("a", 1), row("b", 2, "[x] an offer, that is long enough!"), row("c", 3, "short"), row("d", 4, meta={"dup_of": "z"})], LOG)
    got = {r.fingerprint: r.dup_of for r in history.fold_duplicates(history.collapse(log)).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": "z"}


def test_live_edges(spark):
    t = lambda s: {"expires_at": f"2026-01-06T00:00:0{s}Z"}
    rows = [row("now", 1, "one offer long enough", meta=t(0)), row("past", 2, "two offers long enough", meta={"expires_at": "2026-01-05T23:59:59Z"})]
    rows += [row("dated", 3, "three offers long enough", category="voucher"), row("bad", 4, "four offers long enough", meta={"expires_at": "soon"})]
    log = spark.createDataFrame(rows, LOG)
    live = history.live(history.fold_duplicates(history.collapse(log)), F.lit("2026-01-06 00:00:00").cast("timestamp"), 40)
    assert {r.fingerprint for r in live.collect()} == {"now", "bad"}


def test_empty_log(spark):
    folded = history.fold_duplicates(history.collapse(spark.createDataFrame([], LOG)))
    assert folded.count() == 0 and history.stats(folded).first().findings == 0


def test_state(spark, tmp_path):
    state = StateTable(spark, str(tmp_path / "state"))
    put = lambda *kv: state.put(spark.createDataFrame([(k, v, None) for k, v in kv], "key string, value string, updated_at timestamp"))
    put(("a", "1"), ("b", "1"))
    put(("b", "2"), ("digest:x", "0"))
    assert {(r.key, r.value) for r in state.read().collect()} == {("a", "1"), ("b", "2")}


def test_log_reading(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"fingerprint": "a", "published_at": "0001-01-01T00:00:00Z"}) + '\n{"fingerprint": "b"\n{"title": "x"}\n')
    rows = read_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r.fingerprint, r.published_at) for r in rows] == [("a", None)]


def test_stream_stores_and_reminds_once(spark, tmp_path):
    rows = [row("a", 1, score=90, meta={"expires_at": "2026-01-06T05:00:00Z"}), row("a", 2, score=95), row("b", 3, "another offer, long enough"), row("c", 4, "refused one")]
    spark.createDataFrame(rows, LOG).write.parquet(str(tmp_path / "in/1"))
    sent = io.StringIO()
    run = Round(f"file://{tmp_path}/out", FanOut([Console(sent), FileDrop(spark, f"file://{tmp_path}/drop", "20260106")]), F.lit("2026-01-06 00:00:00").cast("timestamp"), F.col("title") == "refused one")
    go = lambda ck: start(spark.readStream.schema(LOG).parquet(str(tmp_path / "in/*")), run, str(tmp_path / ck)).awaitTermination()
    go("ck")
    spark.createDataFrame([row("b", 5), row("d", 6, "one more offer here")], LOG).write.parquet(str(tmp_path / "in/2"))
    go("ck")  # restart: goes on
    go("ck")  # nothing new
    log = spark.read.parquet(str(tmp_path / "out/log"))
    assert sorted(r.fingerprint for r in log.collect()) == ["a", "b", "d"]
    assert spark.read.parquet(str(tmp_path / "out/reminded")).count() == 1
    assert sent.getvalue().count("[EVENT]") == 1 and sent.getvalue().count("[URGENT]") == 1
    run(spark.createDataFrame([row("d", 7), row("e", 8, "yet another offer")], LOG), 1)  # a repeated batch overwrites itself
    assert spark.read.parquet(str(tmp_path / "out/log")).where("fingerprint = 'd'").count() == 1


def at(s):
    return F.lit(s).cast("timestamp")


def test_same_findings_under_any_path(spark, tmp_path):
    """State is found wherever it is kept: the same finding in two batches is stored once, as a plain path and as a URI."""
    for folder in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        for batch in (0, 1):
            Round(folder, Console(io.StringIO()), at("2026-01-06 00:00:00"), F.lit(False))(spark.createDataFrame([row("a", 1), row(f"n{batch}", 2, f"fresh offer number {batch}")], LOG), batch)
        assert sorted(r.fingerprint for r in spark.read.parquet(f"{folder}/log").collect()) == ["a", "n0", "n1"]


def test_titles_fold_and_budgets_hold(spark, tmp_path):
    sent = io.StringIO()
    make = lambda now: Round(f"file://{tmp_path}/out", Console(sent), at(now), F.lit(False), urgent=Channel(most=2, per_day=3))
    batch = lambda *rows: spark.createDataFrame(list(rows), LOG)
    make("2026-01-06 00:00:00")(batch(row("a", 1, "First offer long enough", 90), row("b", 2, "[x] first offer, long enough!", 95), row("c", 3, "Second offer long enough", 85), row("d", 4, "Third offer long enough", 99)), 0)
    report = lambda n: json.loads(read_text(spark, f"{tmp_path}/out/reports/{n}.json"))
    assert report(0) == {"new": 4, "dupes": 1, "urgent_sent": 2, "urgent_held": 1, "event_sent": 0, "event_held": 0}
    log = {r.fingerprint: r.meta.get("dup_of") for r in spark.read.parquet(f"{tmp_path}/out/log").collect()}
    assert log == {"a": None, "b": "a", "c": None, "d": None}
    make("2026-01-06 01:00:00")(batch(row("e", 5, "Fourth offer long enough", 90), row("f", 6, "Fifth offer long enough", 91), row("g", 7, "SECOND offer - long enough", 99)), 1)
    assert report(1) == {"new": 3, "dupes": 1, "urgent_sent": 1, "urgent_held": 1, "event_sent": 0, "event_held": 0}  # one was left of the day's three
    make("2026-01-07 20:00:00")(batch(row("h", 8, "Sixth offer long enough", 90)), 2)
    assert report(2)["urgent_sent"] == 1  # a new day


def test_a_failed_sink_charges_and_marks_nothing(spark, tmp_path):
    class Bad:
        def send(self, message):
            raise OSError

    rows = spark.createDataFrame([row("a", 1, score=10, meta={"expires_at": "2026-01-06T05:00:00Z"})], LOG)
    try:
        Round(str(tmp_path / "o"), Bad(), at("2026-01-06 00:00:00"), F.lit(False))(rows, 0)
    except OSError:
        pass
    else:
        raise AssertionError
    out = io.StringIO()
    Round(str(tmp_path / "o"), Console(out), at("2026-01-06 00:00:00"), F.lit(False))(rows, 0)  # the batch is tried again
    assert "[EVENT]" in out.getvalue()


def test_configured_order_of_sources(spark):
    cols = LOG
    batch = spark.createDataFrame([row("a", 1)[:4] + ("late",) + row("a", 1)[5:], row("a", 2)[:4] + ("early",) + row("a", 2)[5:]], cols)
    order = spark.createDataFrame([("early", 0), ("late", 1)], "source string, place int")
    got = judge(batch, batch.limit(0), F.lit(False), order).collect()
    assert [(r.source, r.log_seq) for r in got] == [("early", 2)]


def test_flags_and_compaction(spark, tmp_path):
    old = F.lit("2025-12-01 00:00:00").cast("timestamp")
    log = spark.createDataFrame([row("a", 1, score=10), row("b", 2, "another offer, long enough", 90), row("c", 3, "[y] another offer long enough", 90)], LOG).withColumn("discovered_at", old)
    marks = history.flagged(log, spark.createDataFrame([("b",), ("zz",)], "fingerprint string"), "pushed", 4)
    assert [(r.fingerprint, r.log_seq, r.meta) for r in marks.collect()] == [("b", 4, {"pushed": "true"})]
    kept = history.compact(log.unionByName(marks), at("2026-01-06 00:00:00"), 3, f"{tmp_path}/compacted")
    assert {(r.fingerprint, r.meta.get("dup_of")) for r in kept.collect()} == {("c", "b")}


def test_state_by_uri(spark, tmp_path):
    for path in (f"file://{tmp_path}/s", f"{tmp_path}/s"):
        state = StateTable(spark, path)
        state.set({"k": path})
        assert StateTable(spark, path).get("k") == path and state.get("none") is None


def test_card_and_relay():
    body = card(Message("urgent", "t", [{"score": 9, "title": "x", "url": "u"}]), timestamp=1, secret="s")
    assert body["card"]["elements"][0]["content"] == "**9** [x](u)" and len(body["sign"]) == 44
    Relay(["true"]).send(Message("test", "t"))
    try:
        Relay(["sh", "-c", "echo token=abcdefgh1234 >&2; exit 3"]).send(Message("test", "t"))
    except RuntimeError as e:
        assert str(e) == "token=abcd…****34"
    else:
        raise AssertionError


def test_app_delivery():
    calls, now = [], [0.0]

    def call(path, body, token):
        calls.append((path, body.get("msg_type"), token))
        if path == "token":
            return {"token": f"t{len(calls)}", "expire": 300}
        return {"message_id": "m"} if body["msg_type"] == "text" or now[0] else {"message": "card refused"}

    app = App(call, {"id": "x"}, "me", lambda: now[0])
    app.send(Message("test", "t"))
    now[0] = 179.0
    app.send(Message("test", "t"))
    now[0] = 181.0  # within two minutes of the token's end
    app.send(Message("test", "t"))
    assert calls == [("token", None, None), ("message", "interactive", "t1"), ("message", "text", "t1"), ("message", "interactive", "t1"), ("token", None, None), ("message", "interactive", "t5")]
    try:
        App(lambda p, b, t: {"token": "t", "expire": 9} if p == "token" else {"message": "no secret=abcdefghij"}, {}, "me").send(Message("test", "t"))
    except RuntimeError as e:
        assert "abcd…****ij" in str(e)
    else:
        raise AssertionError


def test_pace():
    assert [next_delay(1800, 180, lambda d=d: d) for d in (0, 0.5, 1)] == [1620, 1800, 1980] and next_delay(1, 60, lambda: 0) == 1
    assert [source_budget(s) for s in (1800, 60, 20)] == [1770, 30, 30]


def test_reparse_and_narrow_lists(spark):
    rows = [row("a", 1, meta={"expires_at": "2026-01-05T00:00:00Z", "x": "1"}), row("b", 2, "another offer, long enough", meta={"starts_at": "2026-01-01T00:00:00Z", "pushed": "true"}), row("c", 3, "[x] third offer, long enough", meta={"dup_of": "a"})]
    log = spark.createDataFrame(rows, LOG)
    read = F.when(F.col("fingerprint") != "b", at("2026-01-07 00:00:00"))
    got = {r.fingerprint: (r.changed, r.meta) for r in history.reparsed(log, F.lit(None).cast("timestamp"), read).collect()}
    assert got["a"] == (True, {"x": "1", "expires_at": "2026-01-07T00:00:00Z"}) and got["b"][0] is False and got["b"][1]["starts_at"] and got["c"] == (False, {"dup_of": "a"})
    folded = history.fold_duplicates(history.collapse(log.withColumns({"vendors": F.array(F.lit("v")), "tags": F.array("fingerprint")})))
    names = lambda **k: {r.fingerprint for r in history.find(folded, **k).collect()}
    assert names() == {"a", "b"} and names(pushed=True) == {"b"} and names(pushed=False) == {"a"} and names(tag="a") == {"a"} and names(verified=False) == set() and names(dupes=True) == {"a", "b", "c"}


def test_fan_out_fails_only_if_all_do():
    class Bad:
        def send(self, message):
            raise OSError

    out = io.StringIO()
    FanOut([Bad(), Console(out)]).send(Message("test", "t"))
    assert "[TEST] t" in out.getvalue()
    try:
        FanOut([Bad()]).send(Message("test", "t"))
    except ExceptionGroup:
        pass
    else:
        raise AssertionError
    assert len(signature(1, "s")) == 32
