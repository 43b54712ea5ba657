"""Queries over the log of findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import lexicon
from gleanery.functions.text import clamp, claimable, dedup_key, is_noise, offer_kinds, text_blob, truncate
from gleanery.functions.url import host_of, normalize_url
from gleanery.operators import history, rounds
from gleanery.session import table

NOW_TEXT = "2026-01-06 00:00:00"
EVENT_NOW_TEXT = "1996-06-15 00:00:00"


def now() -> F.Column:
    """The instant the queries over findings are asked at."""
    return F.lit(NOW_TEXT).cast("timestamp")


def event_now() -> F.Column:
    """The instant the queries over dated events are asked at."""
    return F.lit(EVENT_NOW_TEXT).cast("timestamp")


def _deals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "deals")


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return history.fold_duplicates(history.collapse(_deals(spark, d)))


def log_collapse(spark: SparkSession, d: str) -> DataFrame:
    return history.collapse(_deals(spark, d).select("fingerprint", "log_seq", "title", "score", "source")).select(
        "fingerprint", "first_seq", F.col("log_seq").alias("last_seq"), "title", "score", "source"
    )


def near_dup_fold(spark: SparkSession, d: str) -> DataFrame:
    return _folded(spark, d).where(F.col("dup_of").isNotNull()).select("fingerprint", "dup_of")


def live_offers(spark: SparkSession, d: str) -> DataFrame:
    top = history.top_live(_folded(spark, d), now(), 40, 200)
    return top.select("fingerprint", "title", "source", "score", F.unix_micros("discovered_at").alias("discovered_us"), F.unix_micros("expires_at").alias("expires_us"))


def title_clash(spark: SparkSession, d: str) -> DataFrame:
    keyed = _deals(spark, d).where(F.trim("fingerprint") != "").select("log_seq", "fingerprint", dedup_key(F.col("title")).alias("k")).where("k <> ''")
    owners = keyed.groupBy("k").agg(F.min_by("fingerprint", "log_seq").alias("owner"))
    return keyed.join(owners, "k").where(F.col("fingerprint") != F.col("owner")).select("log_seq", "owner")


def seen_antijoin(spark: SparkSession, d: str) -> DataFrame:
    rows = _deals(spark, d).select("log_seq", "batch_no", "fingerprint")
    last = rows.agg(F.max("batch_no").alias("last"))
    marked = rows.join(F.broadcast(last))  # one row
    new = marked.where(F.col("batch_no") == F.col("last"))
    seen = marked.where(F.col("batch_no") < F.col("last")).select("fingerprint")
    return new.join(seen, "fingerprint", "left_anti").select("log_seq")


def store_stats(spark: SparkSession, d: str) -> DataFrame:
    row = history.stats(_folded(spark, d))
    return row.withColumns({c: F.unix_micros(c) for c in ("first_found", "last_found")})


def briefing_quality(spark: SparkSession, d: str) -> DataFrame:
    live = history.live(_folded(spark, d), now(), 40)
    n, official = F.count("*"), F.count_if(F.size("vendors") > 0)
    return live.agg(n.alias("total"), official.alias("verified"), F.round(F.lit(100) * official / n).cast("int").alias("share"))


def briefing_sections(spark: SparkSession, d: str) -> DataFrame:
    live = history.live(_folded(spark, d), now(), 40)
    fresh = rounds.seconds_between(F.col("discovered_at"), now()) < 86_400
    return live.groupBy(F.when(fresh, F.lit("fresh")).otherwise(F.lit("ongoing")).alias("section")).agg(F.count("*").alias("n"))


def deals_filter(spark: SparkSession, d: str) -> DataFrame:
    return history.find(_folded(spark, d), 30, "discount", "", "GPU").select("fingerprint", "score")


def deals_search(spark: SparkSession, d: str) -> DataFrame:
    """A source's findings, reposts among them."""
    return history.find(_folded(spark, d), 0, "", "zuruxleko-feed", "", True).select("fingerprint", "score", "dup_of")


def folded_count(spark: SparkSession, d: str) -> DataFrame:
    """How many of the newest 2,000 findings are reposts, whatever page of them is shown."""
    return history.recent(_folded(spark, d), 2_000).agg(F.count("*").alias("scanned"), F.count_if(F.col("dup_of").isNotNull()).alias("folded"))


def deals_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the read interface: of the newest 2,000 findings those that match, as many as asked for within limits."""
    newest = history.recent(_folded(spark, d), 2_000)
    page = newest.where(F.col("dup_of").isNull() & (F.coalesce("score", F.lit(0)) >= clamp("30", 0, 0, 100)))
    return page.orderBy(F.desc("discovered_at"), F.asc("first_seq")).limit(clamp("9999", 50, 1, 500)).select("fingerprint", "score")


def source_delivery(spark: SparkSession, d: str) -> DataFrame:
    return rounds.delivery(history.collapse(_deals(spark, d)), table(spark, d, "feed_sources"))


def source_idleness(spark: SparkSession, d: str) -> DataFrame:
    return rounds.idleness(_deals(spark, d), table(spark, d, "feed_sources"), now()).select("name", "idle")


def source_health(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "feed_sources")
    idle = rounds.idleness(_deals(spark, d), sources, now())
    kept = rounds.delivery(history.collapse(_deals(spark, d)), sources)
    off = sources.select("name", "disabled")
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    joined = idle.join(kept, "name", "left").join(off, "name", "left")
    return joined.select("name", rounds.health(F.col("idle"), rows, F.col("disabled")).alias("verdict"), rows.alias("rows"))


def doctor(spark: SparkSession, d: str) -> DataFrame:
    """The report on sources: what fails first, then what is to be watched."""
    status = F.when(F.col("verdict").isin("never", "silent"), "fail").when(F.col("verdict").isin("late", "barren"), "warn").otherwise("ok")
    checks = source_health(spark, d).select("name", status.alias("status"), F.col("verdict").alias("detail"))
    place = table(spark, d, "feed_sources").select("name", F.col("source_id").alias("pos"))
    return rounds.by_severity(checks.join(F.broadcast(place), "name")).select("name", "status", "detail")  # a fixed dimension


def upkeep(spark: SparkSession, d: str) -> DataFrame:
    """Whether each batch would have allowed a compaction after the one ten batches before, behind a backup at its start."""
    b = _deals(spark, d).groupBy("batch_no").agg(F.min("discovered_at").alias("first"), F.max("discovered_at").alias("last"))
    before = b.select((F.col("batch_no") + 10).alias("batch_no"), F.col("last").alias("compacted"))
    return b.join(before, "batch_no", "left").select("batch_no", rounds.upkeep_due(F.col("last"), F.col("compacted"), F.col("first"), 3, 24 * 300).alias("due"))


def round_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _deals(spark, d)
    score = F.coalesce("score", F.lit(0))
    return rows.groupBy("batch_no").agg(
        F.count("*").alias("found"), F.countDistinct("fingerprint").alias("findings"), F.count_if(score >= 60).alias("good"), F.count_if(score >= 80).alias("urgent"),
        F.greatest(F.lit(0).cast("long"), F.count_if(score >= 80) - 5).alias("held"), F.count_if(F.size("vendors") > 0).alias("verified"),
        F.count_if(F.coalesce(F.size("vendors"), F.lit(0)) <= 0).alias("third_party"), F.countDistinct(F.lower(F.trim("source"))).alias("sources"),
        F.count_if(F.trim("url") != "").alias("linked"),
    )


def source_round(spark: SparkSession, d: str) -> DataFrame:
    """What each source gave to each round."""
    rows = _deals(spark, d).withColumn("source", F.lower(F.trim("source")))
    return rows.groupBy("batch_no", "source").agg(F.count("*").alias("found"), F.countDistinct("fingerprint").alias("stored"))


def marked_pushed(spark: SparkSession, d: str) -> DataFrame:
    """Log rows that mark the best findings as pushed, numbered after the last one."""
    log = _deals(spark, d)
    after = (log.agg(F.max("log_seq").alias("m")).first().m or 0) + 1
    marks = history.flagged(log, log.where("score >= 95 and trim(fingerprint) <> ''"), "pushed", after)
    return marks.select("log_seq", "fingerprint", F.col("meta")["pushed"].alias("pushed"))


def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    newest = round_report(spark, d).select("batch_no", "found", "findings", "good").orderBy(F.desc("batch_no")).limit(24)  # the ring of runs
    return newest.orderBy("batch_no")


def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    pushed = _deals(spark, d).where(F.col("meta")["pushed"] == "true")
    from gleanery.functions.clock import local_day

    return rounds.budget_left(pushed, local_day(F.col("discovered_at")), 40)


def daily_due(spark: SparkSession, d: str) -> DataFrame:
    last = _deals(spark, d).groupBy("source").agg(F.max("discovered_at").alias("last"))
    return last.select("source", rounds.slot_due(now(), 7, 30, F.col("last"), "Asia/Shanghai").alias("due"))


def freshness_tiers(spark: SparkSession, d: str) -> DataFrame:
    age = rounds.seconds_between(F.col("published_at"), now())
    return _deals(spark, d).select("log_seq", F.when(F.col("published_at").isNotNull(), rounds.freshness(age)).otherwise(0).alias("points"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "feed_sources").select(F.lower(F.trim("name")).alias("_s"), "trust", F.col("host").alias("_host"))
    rows = _deals(spark, d).withColumn("_s", F.lower(F.trim("source"))).join(F.broadcast(sources), "_s", "left")  # a fixed dimension
    offers = F.coalesce("offers", F.array().cast(rows.schema["offers"].dataType))
    host = host_of(F.col("url"))
    official = F.coalesce((host == F.col("_host")) | F.endswith(host, F.concat(F.lit("."), F.col("_host"))), F.lit(False))
    s = rounds.score(
        F.transform(offers, lambda o: o.kind),
        F.col("discount_pct"),
        F.coalesce(F.size("vendors") > 0, F.lit(False)),
        F.coalesce(F.exists(offers, lambda o: o.product.isNotNull()), F.lit(False)),
        official,
        F.col("trust"),
        F.size(offers),
        rounds.seconds_between(F.col("published_at"), now()),
    )
    return rows.withColumn("s", s).withColumn("offers", offers)


def score_deals(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("log_seq", "s.score", F.array_join("s.why", "; ").alias("why"))


def score_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The category of every deal, and why the scorer refuses it."""
    rows = _scored(spark, d)
    noise = is_noise(text_blob(F.col("title"), F.col("summary"), F.col("offers")), ["waiting list", "排队"])
    free = F.exists("offers", lambda o: o.kind == "free")
    kind = rounds.category(F.col("discount_pct"), free, F.size("offers"), F.when(F.col("log_seq") % 2 == 0, F.col("category")))
    why = rounds.rejection(noise, history.meta_time("expires_at"), now(), F.col("s.score"))
    return rows.select("log_seq", kind.alias("category"), why.alias("reject"))


def screen_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why each deal does not reach the reader, and the deadline that is read whether it does or not."""
    text = text_blob(F.col("title"), F.col("summary"), F.col("offers"))
    deadline = history.meta_time("expires_at")
    reason = rounds.full_screen(
        text, F.col("published_at"), F.greatest(F.lit(0), F.coalesce(F.size("offers"), F.lit(0))), deadline, F.coalesce("score", F.lit(0)), is_noise(text, ["waiting list"]), now(),
        ["repost", "转"], ["free", "gb", "tokens", "元", "%"], ["a", "e", "i", "新", "免"], 24 * 240, True,
    )
    return _deals(spark, d).select("log_seq", reason.alias("reason"), F.unix_micros(deadline).alias("deadline_us"))


def offer_kind_list(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).where(F.col("offers").isNotNull()).select("log_seq", offer_kinds(F.col("offers")).alias("kinds"))


def claimable_deals(spark: SparkSession, d: str) -> DataFrame:
    return _deals(spark, d).select("log_seq", claimable(F.col("title"), F.col("is_free"), F.col("discount_pct"), F.col("offers")).alias("ok"))


def compact_keep(spark: SparkSession, d: str) -> DataFrame:
    return history.compactable(_folded(spark, d), now(), 3).select("fingerprint")


def compact_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _deals(spark, d).where(F.trim("fingerprint") != "")
    state = rows.select(F.concat(F.lit("official:deal:"), "fingerprint").alias("key")).distinct().unionByName(
        rows.where(F.trim("url") != "").select(F.concat(F.lit("official:verify:"), normalize_url(F.col("url"))).alias("key")).distinct()
    )
    return history.prune_state(state, history.compactable(_folded(spark, d), now(), 3)).select("key")


def render_lines(spark: SparkSession, d: str) -> DataFrame:
    icon = F.when(F.col("is_free"), F.lit("🆓")).when(F.col("category") == "ai_free", F.lit("🤖")).when(F.col("category") == "discount", F.lit("🏷️")).otherwise(F.lit("🔎"))
    title = truncate(F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" ")), 60)
    return _deals(spark, d).select(
        "log_seq", F.array_join(F.array(icon, F.coalesce("score", F.lit(0)).cast("string"), title, F.coalesce("url", F.lit(""))), " ").alias("line")
    )


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as dated events: they open on their date and close with their last shipment."""
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ends_at"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("starts_at"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("title"), "o_custkey")
    return orders.join(last, orders.o_orderkey == last.l_orderkey, "left").select("o_orderkey", "o_custkey", "title", "starts_at", "ends_at")


def _day(n: int) -> F.Column:
    return F.make_dt_interval(F.lit(n))


def upcoming(spark: SparkSession, d: str) -> DataFrame:
    return history.in_period(_events(spark, d), "starts_at", event_now(), event_now() + _day(30)).select("o_orderkey", "title")


def expiring(spark: SparkSession, d: str) -> DataFrame:
    return history.in_period(_events(spark, d), "ends_at", event_now(), event_now() + _day(30)).select("o_orderkey", "title")


def event_window(spark: SparkSession, d: str) -> DataFrame:
    mark = rounds.window_mark(F.col("starts_at"), F.col("ends_at"), event_now(), 48, 60)
    return _events(spark, d).select("o_orderkey", mark.alias("due")).where(F.col("due").isNotNull())


def due_events(spark: SparkSession, d: str) -> DataFrame:
    due = rounds.nearest_moments(_events(spark, d), "o_orderkey", event_now(), 24 * 14, 60)
    reminded = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey")  # marks of those already reminded
    return rounds.not_reminded(due, reminded, "o_orderkey").select("o_orderkey", "moment", "due")


def due_counts(spark: SparkSession, d: str) -> DataFrame:
    due = rounds.nearest_moments(_events(spark, d), "o_orderkey", event_now(), 24 * 14, 60)
    return due.agg(F.count_if(F.col("due") == "opening").alias("opening"), F.count_if(F.col("due") == "closing").alias("closing"))


def upcoming_events(spark: SparkSession, d: str) -> DataFrame:
    due = rounds.nearest_moments(_events(spark, d), "o_orderkey", event_now(), 24 * 30, 72 * 60)
    reminded = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", F.lit(True).alias("reminded"))
    return due.join(reminded, "o_orderkey", "left").select("o_orderkey", "moment", "due", F.coalesce("reminded", F.lit(False)).alias("reminded"))


def vendor_for_host(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "html_segments").select(F.lower("host").alias("host")).distinct()
    domains = table(spark, d, "feed_sources").select(F.col("host").alias("domain"), F.col("name").alias("vendor"))
    return rounds.vendor_of_host(hosts, domains.unionByName(domains.select(F.concat(F.lit("blog."), "domain").alias("domain"), "vendor")))


def official_host(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "feed_sources").select(F.lower(F.trim("name")).alias("_s"), F.col("host").alias("site"))
    rows = _deals(spark, d).select("log_seq", F.lower(F.trim("source")).alias("_s"), host_of(F.col("url")).alias("host"))
    own = (F.col("host") == F.col("site")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("site")))
    return rows.join(F.broadcast(hosts), "_s").select("log_seq", own.alias("official"))  # a fixed dimension


def _vendor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Entry pages of the sources: which categories each has follows from its number."""
    s = table(spark, d, "feed_sources")
    made = [("pricing", 2), ("free", 3), ("plans", 5), ("activity", 1), ("docs", 7)]
    each = F.filter(F.array(*[F.when(F.col("source_id") % n == 0, F.struct(F.lit(c).alias("k"), F.concat("url", F.lit(f"/{c}")).alias("v"))) for c, n in made]), lambda x: x.isNotNull())
    return s.select(F.lower(F.trim("name")).alias("_s"), F.map_from_entries(each).alias("pages"))


def canonical_page(spark: SparkSession, d: str) -> DataFrame:
    """The entry page of each deal's source for what its offers are."""
    rows = _deals(spark, d).select("log_seq", F.lower(F.trim("source")).alias("_s"), F.transform(F.coalesce("offers", F.array().cast(_deals(spark, d).schema["offers"].dataType)), lambda o: o.kind).alias("kinds"))
    joined = rows.join(F.broadcast(_vendor_pages(spark, d)), "_s")  # a fixed dimension
    return joined.select("log_seq", rounds.page_for(F.col("kinds"), F.col("pages"), lexicon.PAGE_ORDER).alias("page"))


def _ladder(spark: SparkSession, d: str, probed: F.Column, outage: bool) -> DataFrame:
    rows = _deals(spark, d).withColumn("host", host_of(F.col("url")))
    domains = table(spark, d, "feed_sources").select(F.col("host").alias("domain"), F.col("name").alias("vendor"))
    owned = rounds.vendor_of_host(rows.select("log_seq", "host", "vendors", "published_at", "discovered_at", "url", "score"), domains)
    cached = F.when(F.col("published_at").isNotNull(), F.col("url"))
    marked = owned.withColumn("wants", F.col("vendor").isNull() & (F.coalesce(F.get("vendors", F.lit(0)), F.lit("")) != ""))
    looked = rounds.lookup_budget(marked, ["log_seq"], "wants", 16).withColumn("probe", F.when(F.col("looked"), probed))
    ladder = rounds.link_ladder(F.col("vendor"), F.get("vendors", F.lit(0)), cached, F.col("discovered_at"), F.col("probe"), now())
    kind = F.col("l.kind")
    delta = F.when((kind == "unresolved") & (F.lit(outage) | ~F.col("looked")), 0).otherwise(F.col("l.delta"))
    return looked.withColumn("l", ladder).select("log_seq", kind.alias("kind"), delta.alias("delta"), "looked", "score")


def link_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """How far each link can be trusted, with pages probed for the first sixteen deals that need it; the others wait at no cost."""
    return _ladder(spark, d, F.when(F.col("log_seq") % 2 == 0, F.col("url")), False).select("log_seq", "kind", "delta", "looked")


def verified_order(spark: SparkSession, d: str) -> DataFrame:
    """The first deals by their score after the verdicts on their links, then by number."""
    rows = _ladder(spark, d, F.lit(None).cast("string"), True)
    bumped = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce("score", F.lit(0)) + F.col("delta")))
    return rows.select("log_seq", bumped.alias("score")).orderBy(F.desc("score"), "log_seq").limit(100)


_ALL = (
    log_collapse, near_dup_fold, live_offers, title_clash, seen_antijoin, store_stats, briefing_quality, briefing_sections, deals_filter, deals_search, folded_count, deals_page,
    source_delivery,
    source_idleness, source_health, doctor, upkeep, round_report, source_round, marked_pushed, recent_runs, daily_budget, daily_due, freshness_tiers, score_deals, score_verdicts, screen_reasons, offer_kind_list,
    claimable_deals, compact_keep, compact_state, render_lines, upcoming, expiring, event_window, due_events, due_counts, upcoming_events, vendor_for_host,
    official_host, canonical_page, link_verdicts, verified_order,
)
QUERIES = {f.__name__: f for f in _ALL}

# The key of a title: wrappers off (unrolled), labels off, signs out. RE2 has no byte lengths within a pattern, so a step checks the head it would cut.
_W = r"^[ \t]*(?:\[[^\]]*\]|【[^】]*】|\([^)]*\)|（[^）]*）)"
_STEP = (
    "CASE WHEN regexp_extract({x}, '%s') <> '' AND strlen(ltrim(regexp_extract({x}, '%s'))) - strlen(right(regexp_extract({x}, '%s'), 1)) < 24 "
    "THEN trim(regexp_replace({x}, '%s', '')) ELSE {x} END" % (_W, _W, _W, _W)
)


def key_sql(source: str, column: str, name: str) -> str:
    """CTEs that end in ``name`` with the column ``k``."""
    out = [f"{name}0 AS (SELECT *, trim({column}) AS k0 FROM {source})"]
    for i in range(6):
        out.append(f"{name}{i + 1} AS (SELECT *, {_STEP.format(x=f'k{i}')} AS k{i + 1} FROM {name}{i})")
    label = "trim(regexp_replace({x}, '^[^：:]{{1,6}}[：:]', ''))"
    cut = label.format(x=label.format(x="ltrim(k6)"))
    words = f"trim(regexp_replace(lower(regexp_replace({cut}, '[^\\p{{Han}}\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' +', ' ', 'g'))"
    out.append(f"{name}7 AS (SELECT *, {words} AS kw FROM {name}6)")
    out.append(f"{name} AS (SELECT *, CASE WHEN length(kw) < 8 THEN '' ELSE trim(substring(kw, 1, 80)) END AS k FROM {name}7)")
    return ",\n".join(out)


_CUR = """WITH cur AS (SELECT fingerprint, first_seq, v.* FROM (
  SELECT fingerprint, min(log_seq) AS first_seq, arg_max(struct_pack(title := title, summary := summary, source := source, category := category, offers := offers,
    vendors := vendors, is_free := is_free, discount_pct := discount_pct, score := score, discovered_at := discovered_at, meta := meta), log_seq) AS v
  FROM deals WHERE trim(fingerprint) <> '' GROUP BY fingerprint))"""
_FOLD = (
    _CUR
    + ",\n"
    + key_sql("cur", "title", "q")
    + """,
own AS (SELECT k, arg_min(fingerprint, first_seq) AS owner FROM q WHERE k <> '' GROUP BY k),
folded AS (SELECT q.*, CASE WHEN own.owner <> q.fingerprint THEN own.owner END AS dup_of FROM q LEFT JOIN own USING (k)),
clocked AS (SELECT *, date_trunc('second', try_cast(meta['expires_at'] AS timestamptz)) AS expires_at FROM folded),
live AS (SELECT * FROM clocked WHERE dup_of IS NULL AND coalesce(score, 0) >= 40
  AND (coalesce(is_free, false) OR coalesce(discount_pct, 0) > 0 OR coalesce(len(list_filter(offers, lambda o: o.kind IN ('free','discount','trial','credit','coupon'))) > 0, false))
  AND NOT regexp_matches(regexp_replace(trim(coalesce(title, '')), '[ ！!]+$', ''), '(\\?|？|吗|呢|吧|么)$') AND NOT regexp_matches(coalesce(title, ''), '"""
    + lexicon.DOUBT
    + f"""')
  AND CASE WHEN expires_at IS NULL THEN coalesce(category, '') <> 'voucher' ELSE expires_at >= timestamptz '{NOW_TEXT}+00' END)"""
)
_EVENTS = """WITH ev AS (SELECT o_orderkey, 'order ' || o_orderkey AS title, o_orderdate AS s, e FROM orders
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


_HEALTH = _CUR + f""", i AS (SELECT lower(trim(source)) AS s, max(discovered_at) AS last FROM deals GROUP BY 1), n AS (SELECT lower(trim(source)) AS s, count(*) AS n FROM cur GROUP BY 1),
g AS (SELECT name, coalesce(disabled, false) AS off, CASE WHEN last IS NOT NULL THEN greatest(0, floor(epoch(timestamptz '{NOW_TEXT}+00') - epoch(last))) END AS idle, CASE WHEN coalesce(disabled, false) THEN 0 ELSE coalesce(n, 0) END::bigint AS rows
  FROM feed_sources LEFT JOIN i ON lower(trim(name)) = i.s LEFT JOIN n ON lower(trim(name)) = n.s),
h AS (SELECT name, rows, CASE WHEN off THEN 'off' WHEN idle IS NULL THEN 'never' WHEN idle > 604800 THEN 'silent' WHEN idle > 129600 THEN 'late' WHEN rows = 0 THEN 'barren' ELSE 'ok' END AS verdict FROM g)"""
_LADDER = f"""WITH h AS (SELECT *, regexp_extract(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*') AS host FROM deals),
o AS (SELECT DISTINCT host FROM h WHERE EXISTS (SELECT 1 FROM feed_sources f WHERE h.host = f.host OR ends_with(h.host, '.' || f.host))),
w AS (SELECT *, host IN (SELECT host FROM o) AS own, coalesce(vendors[1], '') AS named FROM h),
b AS (SELECT *, NOT own AND named <> '' AND row_number() OVER (PARTITION BY NOT own AND named <> '' ORDER BY log_seq) <= 16 AS looked FROM w),
k AS (SELECT log_seq, looked, score, CASE WHEN own THEN 'own_domain' WHEN named = '' THEN 'third_party'
  WHEN published_at IS NOT NULL AND coalesce(url, '') <> '' AND discovered_at > timestamptz '{NOW_TEXT}+00' - interval 7 day THEN 'verified' WHEN looked AND {{probe}} THEN 'verified' ELSE 'unresolved' END AS kind FROM b)"""
_SCORE = f"""WITH j AS (SELECT d.*, s.trust, s.host AS site, regexp_extract(regexp_replace(lower(trim(coalesce(d.url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*') AS h,
  coalesce(list_transform(d.offers, lambda o: o.kind), []) AS kinds, coalesce(d.discount_pct, 0) AS pct, epoch(timestamptz '{NOW_TEXT}+00') - epoch(d.published_at) AS age
  FROM deals d LEFT JOIN feed_sources s ON lower(trim(d.source)) = lower(trim(s.name))),
p AS (SELECT *, list_contains(kinds, 'free') AS free, CASE WHEN pct >= 50 THEN 12 WHEN pct >= 30 THEN 8 WHEN pct >= 10 THEN 4 ELSE 0 END AS bonus,
  CASE WHEN list_contains(kinds, 'free') THEN 'free' WHEN list_contains(kinds, 'credit') THEN 'credit' WHEN list_contains(kinds, 'discount') THEN 'discount' WHEN list_contains(kinds, 'trial') THEN 'trial' WHEN list_contains(kinds, 'coupon') THEN 'coupon' END AS k,
  coalesce(len(vendors) > 0, false) AS v, coalesce(len(list_filter(offers, lambda o: o.product IS NOT NULL)) > 0, false) AS m, coalesce(h = site OR ends_with(h, '.' || site), false) AS o,
  greatest(0, least(10, coalesce(trust, 0))) AS t, CASE WHEN age IS NULL THEN 0 WHEN age <= 86400 THEN 12 WHEN age <= 259200 THEN 8 WHEN age <= 604800 THEN 4 WHEN age > 2592000 THEN -12 ELSE 0 END AS f FROM j),
q AS (SELECT *, CASE k WHEN 'free' THEN 45 WHEN 'credit' THEN 30 WHEN 'discount' THEN 24 WHEN 'trial' THEN 20 WHEN 'coupon' THEN 16 ELSE 0 END AS base FROM p),
r AS (SELECT *, CASE WHEN NOT free AND pct > 0 THEN greatest(0, 24 - bonus - base) ELSE 0 END AS top FROM q)"""


def _moments(hours: int, minutes: int) -> str:
    t = f"timestamp '{EVENT_NOW_TEXT}'"
    return (
        _EVENTS
        + f""", m AS (SELECT o_orderkey, s AS moment, 'opening' AS due FROM ev WHERE s BETWEEN {t} - interval {minutes} minute AND {t} + interval {hours} hour
  UNION ALL SELECT o_orderkey, e, 'closing' FROM ev WHERE e > {t} AND e <= {t} + interval {hours} hour),
n AS (SELECT o_orderkey, min(moment) AS moment, arg_min(due, struct_pack(a := moment, b := due = 'closing')) AS due FROM m GROUP BY 1)"""
    )


ORACLES = {
    "log_collapse": "SELECT fingerprint, min(log_seq) AS first_seq, max(log_seq) AS last_seq, arg_max(struct_pack(x := title), log_seq).x AS title, arg_max(struct_pack(x := score), log_seq).x AS score, arg_max(struct_pack(x := source), log_seq).x AS source FROM deals WHERE trim(fingerprint) <> '' GROUP BY fingerprint",
    "near_dup_fold": _FOLD + " SELECT fingerprint, dup_of FROM folded WHERE dup_of IS NOT NULL",
    "live_offers": _FOLD + " SELECT fingerprint, title, source, score, epoch_us(discovered_at) AS discovered_us, epoch_us(expires_at) AS expires_us FROM live ORDER BY score DESC, discovered_at DESC, first_seq LIMIT 200",
    "title_clash": "WITH rows_ AS (SELECT * FROM deals WHERE trim(fingerprint) <> ''),\n" + key_sql("rows_", "title", "q") + ", own AS (SELECT k, arg_min(fingerprint, log_seq) AS owner FROM q WHERE k <> '' GROUP BY k) SELECT log_seq, owner FROM q JOIN own USING (k) WHERE fingerprint <> owner",
    "seen_antijoin": "SELECT log_seq FROM deals d WHERE batch_no = (SELECT max(batch_no) FROM deals) AND NOT EXISTS (SELECT 1 FROM deals e WHERE e.batch_no < d.batch_no AND e.fingerprint = d.fingerprint)",
    "store_stats": _FOLD + " SELECT count(*) AS findings, count_if(dup_of IS NOT NULL)::bigint AS reposts, count_if(coalesce(meta['pushed'], '') = 'true')::bigint AS pushed, epoch_us(min(discovered_at)) AS first_found, epoch_us(max(discovered_at)) AS last_found FROM folded",
    "briefing_quality": _FOLD + " SELECT count(*) AS total, count_if(len(vendors) > 0)::bigint AS verified, round(100 * count_if(len(vendors) > 0)::double / count(*))::int AS share FROM live",
    "briefing_sections": _FOLD + f" SELECT CASE WHEN timestamptz '{NOW_TEXT}+00' - discovered_at < interval 24 hour THEN 'fresh' ELSE 'ongoing' END AS section, count(*) AS n FROM live GROUP BY 1",
    "deals_filter": _FOLD + " SELECT fingerprint, score FROM folded WHERE dup_of IS NULL AND coalesce(score, 0) >= 30 AND category = 'discount' AND contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '')), 'gpu')",
    "deals_page": _FOLD + ", newest AS (SELECT * FROM folded ORDER BY discovered_at DESC NULLS LAST, first_seq LIMIT 2000) SELECT fingerprint, score FROM newest WHERE dup_of IS NULL AND coalesce(score, 0) >= 30 ORDER BY discovered_at DESC NULLS LAST, first_seq LIMIT 500",
    "source_delivery": _CUR + " SELECT name, coalesce(n, 0)::bigint AS rows FROM feed_sources LEFT JOIN (SELECT lower(trim(source)) AS s, count(*) AS n FROM cur GROUP BY 1) ON lower(trim(name)) = s WHERE NOT coalesce(disabled, false)",
    "source_idleness": f"SELECT name, greatest(0, floor(epoch(timestamptz '{NOW_TEXT}+00') - epoch(last)))::bigint AS idle FROM feed_sources LEFT JOIN (SELECT lower(trim(source)) AS s, max(discovered_at) AS last FROM deals GROUP BY 1) ON lower(trim(name)) = s WHERE last IS NOT NULL UNION ALL SELECT name, NULL FROM feed_sources WHERE lower(trim(name)) NOT IN (SELECT lower(trim(source)) FROM deals WHERE source IS NOT NULL)",
    "round_report": "SELECT batch_no, count(*) AS found, count(DISTINCT fingerprint) AS findings, count_if(coalesce(score, 0) >= 60)::bigint AS good, count_if(coalesce(score, 0) >= 80)::bigint AS urgent, greatest(0, count_if(coalesce(score, 0) >= 80) - 5)::bigint AS held, count_if(len(vendors) > 0)::bigint AS verified, count_if(coalesce(len(vendors), 0) = 0)::bigint AS third_party, count(DISTINCT lower(trim(source))) AS sources, count_if(trim(url) <> '')::bigint AS linked FROM deals GROUP BY 1",
    "recent_runs": "SELECT batch_no, count(*) AS found, count(DISTINCT fingerprint) AS findings, count_if(coalesce(score, 0) >= 60)::bigint AS good FROM deals GROUP BY 1 ORDER BY 1 DESC LIMIT 24",
    "daily_budget": "SELECT strftime(timezone('Asia/Shanghai', discovered_at), '%Y-%m-%d') AS day, count(*) AS sent, greatest(0, 40 - count(*))::bigint AS left FROM deals WHERE meta['pushed'] = 'true' GROUP BY 1",
    "daily_due": f"SELECT source, max(discovered_at) IS NULL OR max(discovered_at) < timestamptz '2026-01-05 23:30:00+00' AS due FROM deals WHERE timestamptz '{NOW_TEXT}+00' >= timestamptz '2026-01-05 23:30:00+00' GROUP BY 1",
    "freshness_tiers": f"SELECT log_seq, CASE WHEN published_at IS NULL THEN 0 WHEN a <= 86400 THEN 12 WHEN a <= 259200 THEN 8 WHEN a <= 604800 THEN 4 WHEN a > 2592000 THEN -12 ELSE 0 END AS points FROM (SELECT *, epoch(timestamptz '{NOW_TEXT}+00') - epoch(published_at) AS a FROM deals)",
    "score_deals": _SCORE + """
SELECT log_seq, greatest(0, least(100, bonus + base + top + CASE WHEN v THEN 10 ELSE 0 END + CASE WHEN m THEN 12 ELSE 0 END + CASE WHEN o THEN 10 ELSE 0 END + t + CASE WHEN len(kinds) > 1 THEN 4 ELSE 0 END + f))::int AS score,
  concat_ws('; ', CASE WHEN pct > 0 THEN '+' || bonus || ' cut' END, CASE WHEN base > 0 THEN '+' || base || ' ' || k END, CASE WHEN top > 0 THEN '+24 stated cut' END, CASE WHEN v THEN '+10 vendor' END, CASE WHEN m THEN '+12 product' END,
  CASE WHEN o THEN '+10 official' END, CASE WHEN t > 0 THEN '+' || t || ' trust' END, CASE WHEN len(kinds) > 1 THEN '+4 several offers' END, CASE WHEN f > 0 THEN '+' || f || ' age' WHEN f < 0 THEN f || ' age' END) AS why FROM r""",
    "source_health": _HEALTH + " SELECT name, verdict, rows FROM h",
    "link_verdicts": _LADDER.format(probe="log_seq % 2 = 0 AND coalesce(url, '') <> ''") + " SELECT log_seq, kind, CASE kind WHEN 'own_domain' THEN 8 WHEN 'verified' THEN 8 WHEN 'unresolved' THEN CASE WHEN looked THEN -6 ELSE 0 END ELSE 0 END AS delta, looked FROM k",
    "screen_reasons": f"""WITH x AS (SELECT *, lower(concat_ws(chr(10), coalesce(title, ''), coalesce(summary, ''), array_to_string(list_transform(offers, lambda o: coalesce(o.evidence, '')), chr(10)))) AS b, date_trunc('second', try_cast(meta['expires_at'] AS timestamptz)) AS dl FROM deals)
SELECT log_seq, CASE WHEN contains(b, 'repost') OR contains(b, '转') THEN 'denied' WHEN NOT (contains(b, 'free') OR contains(b, 'gb') OR contains(b, 'tokens') OR contains(b, '元') OR contains(b, '%')) THEN 'not required'
  WHEN epoch(timestamptz '{NOW_TEXT}+00') - epoch(published_at) > 240 * 86400 THEN 'too old' WHEN coalesce(len(offers), 0) = 0 THEN 'no offer' WHEN contains(b, 'waiting list') THEN 'noise' WHEN dl < timestamptz '{NOW_TEXT}+00' THEN 'expired'
  WHEN coalesce(score, 0) <= 0 THEN 'low signal' WHEN NOT (contains(b, 'a') OR contains(b, 'e') OR contains(b, 'i') OR contains(b, '新') OR contains(b, '免')) THEN 'not allowed' ELSE '' END AS reason, epoch_us(dl) AS deadline_us FROM x""",
    "offer_kind_list": "SELECT log_seq, array_to_string(list_transform(list_filter(list_transform(offers, lambda o, i: struct_pack(k := o.kind, i := i)), lambda x: list_position(list_transform(offers, lambda o: o.kind), x.k) = x.i), lambda x: x.k), ',') AS kinds FROM deals WHERE offers IS NOT NULL",
    "claimable_deals": "SELECT log_seq, (coalesce(is_free, false) OR coalesce(discount_pct, 0) > 0 OR coalesce(len(list_filter(offers, lambda o: o.kind IN ('free','discount','trial','credit','coupon'))) > 0, false)) AND NOT regexp_matches(regexp_replace(trim(coalesce(title, '')), '[ ！!]+$', ''), '(\\?|？|吗|呢|吧|么)$') AND NOT regexp_matches(coalesce(title, ''), '" + lexicon.DOUBT + "') AS ok FROM deals",
    "compact_keep": _FOLD + f" SELECT fingerprint FROM folded WHERE NOT (discovered_at < timestamptz '{NOW_TEXT}+00' - interval 3 day AND (coalesce(meta['pushed'], '') = 'true' OR coalesce(score, 0) < 60))",
    "render_lines": "SELECT log_seq, CASE WHEN is_free THEN '🆓' WHEN category = 'ai_free' THEN '🤖' WHEN category = 'discount' THEN '🏷️' ELSE '🔎' END || ' ' || coalesce(score, 0) || ' ' || (CASE WHEN length(t) > 60 THEN trim(substring(t, 1, 59)) || '…' ELSE t END) || ' ' || coalesce(url, '') AS line FROM (SELECT *, replace(coalesce(title, ''), chr(10), ' ') AS t FROM deals)",
    "upcoming": _EVENTS + f" SELECT o_orderkey, title FROM ev WHERE s BETWEEN timestamp '{EVENT_NOW_TEXT}' AND timestamp '{EVENT_NOW_TEXT}' + interval 30 day",
    "expiring": _EVENTS + f" SELECT o_orderkey, title FROM ev WHERE e BETWEEN timestamp '{EVENT_NOW_TEXT}' AND timestamp '{EVENT_NOW_TEXT}' + interval 30 day",
    "event_window": _EVENTS + f" SELECT o_orderkey, CASE WHEN s BETWEEN timestamp '{EVENT_NOW_TEXT}' - interval 60 minute AND timestamp '{EVENT_NOW_TEXT}' + interval 48 hour THEN 'opening' ELSE 'closing' END AS due FROM ev WHERE s BETWEEN timestamp '{EVENT_NOW_TEXT}' - interval 60 minute AND timestamp '{EVENT_NOW_TEXT}' + interval 48 hour OR (e > timestamp '{EVENT_NOW_TEXT}' AND e <= timestamp '{EVENT_NOW_TEXT}' + interval 48 hour)",
    "due_events": _moments(336, 60) + " SELECT * FROM n WHERE o_orderkey % 5 <> 0",
    "due_counts": _moments(336, 60) + " SELECT count_if(due = 'opening')::bigint AS opening, count_if(due = 'closing')::bigint AS closing FROM n",
    "upcoming_events": _moments(720, 4320) + " SELECT *, o_orderkey % 5 = 0 AS reminded FROM n",
    "vendor_for_host": "WITH dom AS (SELECT host AS domain, name AS vendor FROM feed_sources UNION ALL SELECT 'blog.' || host, name FROM feed_sources) SELECT h.host, (SELECT arg_max(vendor, length(domain)) FROM dom WHERE h.host = domain OR h.host LIKE '%.' || domain) AS vendor FROM (SELECT DISTINCT lower(host) AS host FROM html_segments) h",
    "official_host": "SELECT log_seq, h = site OR ends_with(h, '.' || site) AS official FROM (SELECT log_seq, lower(trim(source)) AS s, regexp_extract(regexp_replace(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#]*') AS h FROM deals) JOIN (SELECT lower(trim(name)) AS n, host AS site FROM feed_sources) ON s = n",
    "canonical_page": """WITH p AS (SELECT lower(trim(name)) AS s, CASE WHEN source_id % 3 = 0 THEN url || '/free' END AS fr, url || '/activity' AS ac, CASE WHEN source_id % 7 = 0 THEN url || '/docs' END AS dc, CASE WHEN source_id % 5 = 0 THEN url || '/plans' END AS pl, CASE WHEN source_id % 2 = 0 THEN url || '/pricing' END AS pr FROM feed_sources),
r AS (SELECT log_seq, lower(trim(source)) AS s, list_filter(list_transform(coalesce(offers, []), lambda o: o.kind), lambda k: k IN ('free', 'credit', 'trial', 'coupon', 'discount'))[1] AS k FROM deals)
SELECT log_seq, CASE WHEN k = 'discount' THEN coalesce(pr, pl, ac) WHEN k IS NOT NULL THEN coalesce(fr, ac) ELSE coalesce(pr, pl, dc, ac) END AS page FROM r JOIN p USING (s)""",
    "deals_search": _FOLD + " SELECT fingerprint, score, dup_of FROM folded WHERE source = 'zuruxleko-feed'",
    "folded_count": _FOLD + ", newest AS (SELECT * FROM folded ORDER BY discovered_at DESC NULLS LAST, first_seq LIMIT 2000) SELECT count(*) AS scanned, count_if(dup_of IS NOT NULL)::bigint AS folded FROM newest",
    "doctor": _HEALTH + " SELECT name, CASE WHEN verdict IN ('never', 'silent') THEN 'fail' WHEN verdict IN ('late', 'barren') THEN 'warn' ELSE 'ok' END AS status, verdict AS detail FROM h",
    "upkeep": "WITH b AS (SELECT batch_no, min(discovered_at) AS f, max(discovered_at) AS l FROM deals GROUP BY 1) SELECT b.batch_no, coalesce((p.l IS NULL OR epoch(b.l) - epoch(p.l) >= 3 * 86400) AND epoch(b.l) - epoch(b.f) <= 24 * 300 * 3600, false) AS due FROM b LEFT JOIN b p ON p.batch_no + 10 = b.batch_no",
    "source_round": "SELECT batch_no, lower(trim(source)) AS source, count(*) AS found, count(DISTINCT fingerprint) AS stored FROM deals GROUP BY 1, 2",
    "marked_pushed": "WITH m AS (SELECT fingerprint, max(log_seq) AS last FROM deals WHERE fingerprint IN (SELECT fingerprint FROM deals WHERE score >= 95 AND trim(fingerprint) <> '') GROUP BY 1) SELECT (SELECT max(log_seq) FROM deals) + row_number() OVER (ORDER BY last) AS log_seq, fingerprint, 'true' AS pushed FROM m",
    "score_verdicts": _SCORE + f""", x AS (SELECT *, greatest(0, least(100, bonus + base + top + CASE WHEN v THEN 10 ELSE 0 END + CASE WHEN m THEN 12 ELSE 0 END + CASE WHEN o THEN 10 ELSE 0 END + t + CASE WHEN len(kinds) > 1 THEN 4 ELSE 0 END + f)) AS s,
  lower(concat_ws(chr(10), coalesce(title, ''), coalesce(summary, ''), array_to_string(list_transform(offers, lambda z: coalesce(z.evidence, '')), chr(10)))) AS b, date_trunc('second', try_cast(meta['expires_at'] AS timestamptz)) AS dl FROM r)
SELECT log_seq, CASE WHEN log_seq % 2 = 0 AND coalesce(category, '') NOT IN ('', 'unknown') THEN category WHEN pct >= 50 THEN 'discount' WHEN free THEN 'ai_free' WHEN len(kinds) > 0 THEN 'discount' ELSE 'unknown' END AS category,
  CASE WHEN contains(b, 'waiting list') OR contains(b, '排队') THEN 'noise' WHEN dl < timestamptz '{NOW_TEXT}+00' THEN 'expired' WHEN s <= 0 THEN 'low_signal' ELSE '' END AS reject FROM x""",
    "verified_order": _LADDER.format(probe="false") + " SELECT log_seq, greatest(0, least(100, coalesce(score, 0) + CASE WHEN kind IN ('own_domain', 'verified') THEN 8 ELSE 0 END))::int AS score FROM k ORDER BY 2 DESC, 1 LIMIT 100",
}
