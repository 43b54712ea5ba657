"""A round of collection: gating, scoring, reminders, budgets and the health of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import contains_any

#: Points of the additive score; pass other ones to weigh signals differently.
WEIGHTS = {
    "free": 45, "credit": 30, "discount": 24, "trial": 20, "coupon": 16, "vendor": 10, "product": 12, "official": 10, "several": 4,
    "deep": 12, "middle": 8, "shallow": 4, "fresh": 12, "recent": 8, "week": 4, "stale": 12,
}


def freshness(age: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    """Points for an age in seconds; negative ages count as fresh, an unknown one as nothing."""
    day = 86_400
    return (
        F.when(age <= day, weights["fresh"])
        .when(age <= 3 * day, weights["recent"])
        .when(age <= 7 * day, weights["week"])
        .when(age > 30 * day, -weights["stale"])
        .otherwise(0)
    )


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from start to end, fractions included; null if either is."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)


def score(
    kinds: Column, pct: Column, vendor: Column, product: Column, official: Column, trust: Column, n_offers: Column, age: Column, weights: dict[str, int] = WEIGHTS
) -> Column:
    """``score`` from 0 to 100 and ``why``, the reasons in order with their points.

    Free counts alone; otherwise the best kind of offer does. A stated cut without an offer of its worth is topped up.
    """
    w = weights
    pct = F.coalesce(pct, F.lit(0))
    bonus = F.when(pct >= 50, w["deep"]).when(pct >= 30, w["middle"]).when(pct >= 10, w["shallow"]).otherwise(0)
    free = F.array_contains(kinds, "free")
    base = F.when(free, w["free"])
    for k in ("credit", "discount", "trial", "coupon"):
        base = base.when(F.array_contains(kinds, k), w[k])
    base = base.otherwise(0)
    first = F.when(free, F.lit("free"))
    for k in ("credit", "discount", "trial", "coupon"):
        first = first.when(F.array_contains(kinds, k), F.lit(k))
    top_up = F.when(~free & (pct > 0), F.greatest(F.lit(0), w["discount"] - bonus - base)).otherwise(0)
    trusted = F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(trust, F.lit(0))))
    fresh = freshness(age, w)

    def reason(points: Column | int, name: Column | str, when: Column) -> Column:
        p = F.lit(points) if isinstance(points, int) else points
        label = F.lit(name) if isinstance(name, str) else name
        return F.when(when, F.concat(F.when(p >= 0, F.lit("+")).otherwise(F.lit("")), p.cast("string"), F.lit(" "), label))

    why = F.array(
        reason(bonus, "cut", pct > 0),
        reason(base, first, base > 0),
        reason(w["discount"], "stated cut", top_up > 0),
        reason(w["vendor"], "vendor", vendor),
        reason(w["product"], "product", product),
        reason(w["official"], "official", official),
        reason(trusted, "trust", trusted > 0),
        reason(w["several"], "several offers", n_offers > 1),
        reason(fresh, "age", age.isNotNull() & (fresh != 0)),
    )
    flag = lambda c, points: F.when(c, points).otherwise(0)
    total = bonus + base + top_up + flag(vendor, w["vendor"]) + flag(product, w["product"]) + flag(official, w["official"]) + trusted
    total = total + flag(n_offers > 1, w["several"]) + F.when(age.isNotNull(), fresh).otherwise(0)
    return F.struct(F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int").alias("score"), F.filter(why, lambda x: x.isNotNull()).alias("why"))


def category(pct: Column, free: Column, n_offers: Column, stated: Column) -> Column:
    """What a finding is: as its source states, else by a deep cut, by being free, by any offer."""
    found = F.when(F.coalesce(pct, F.lit(0)) >= 50, "discount").when(F.coalesce(free, F.lit(False)), "ai_free").when(n_offers > 0, "discount").otherwise("unknown")
    return F.when(~F.coalesce(stated, F.lit("")).isin("", "unknown"), stated).otherwise(found)


def rejection(noise: Column, deadline: Column, now: Column, score: Column) -> Column:
    """Why a scorer refuses a finding: ``noise``, ``expired`` (strictly before now) or ``low_signal``; '' if it does not."""
    return screen(("noise", noise), ("expired", deadline < now), ("low_signal", score <= 0))


def full_screen(
    text: Column, published: Column, n_offers: Column, deadline: Column, score: Column, noise: Column, now: Column, deny: list[str], require: list[str], allow: list[str],
    max_age_hours: int, require_offer: bool,
) -> Column:
    """The reason why a finding does not reach the reader, in order: denied, not required, too old, no offer, the scorer's, not allowed; '' if it does.

    Findings without a time are not too old; lists that are empty ask for nothing.
    """
    age = seconds_between(published, now)
    told = [n for n in require if n], [n for n in allow if n]
    return screen(
        ("denied", contains_any(text, deny)),
        ("not required", ~contains_any(text, told[0]) if told[0] else F.lit(False)),
        ("too old", age > max_age_hours * 3600 if max_age_hours > 0 else F.lit(False)),
        ("no offer", n_offers <= 0 if require_offer else F.lit(False)),
        ("noise", noise),
        ("expired", deadline < now),
        ("low signal", score <= 0),
        ("not allowed", ~contains_any(text, told[1]) if told[1] else F.lit(False)),
    )


def screen(*rules: tuple[str, Column]) -> Column:
    """The first reason, in order, for which a finding is refused; '' if none applies."""
    out = None
    for reason, refused in rules:
        refused = F.coalesce(refused, F.lit(False))
        out = F.when(refused, F.lit(reason)) if out is None else out.when(refused, F.lit(reason))
    return F.lit("") if out is None else out.otherwise(F.lit(""))


def window_mark(start: Column, end: Column, now: Column, lead_hours: int, grace_minutes: int) -> Column:
    """Whether an event is due: ``opening`` from ``grace`` after to ``lead`` before it opens, ``closing`` within ``lead`` of its end."""
    lead, grace = F.make_dt_interval(F.lit(0), F.lit(lead_hours)), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace_minutes))
    return F.when(start.between(now - grace, now + lead), F.lit("opening")).when((end > now) & (end <= now + lead), F.lit("closing"))


def nearest_moments(events: DataFrame, key: str, now: Column, lead_hours: int, grace_minutes: int) -> DataFrame:
    """The nearest due moment per key: ``key``, ``title``, ``moment``, ``due``; of equal moments the opening one."""
    lead, grace = F.make_dt_interval(F.lit(0), F.lit(lead_hours)), F.make_dt_interval(F.lit(0), F.lit(0), F.lit(grace_minutes))
    opening = F.when(F.col("starts_at").between(now - grace, now + lead), F.struct(F.col("starts_at").alias("moment"), F.lit("opening").alias("due")))
    closing = F.when((F.col("ends_at") > now) & (F.col("ends_at") <= now + lead), F.struct(F.col("ends_at").alias("moment"), F.lit("closing").alias("due")))
    flat = events.select(key, "title", F.explode(F.filter(F.array(opening, closing), lambda m: m.isNotNull())).alias("m")).select(key, "title", "m.*")
    rank = F.struct(F.col("moment"), (F.col("due") == "closing").alias("c"))
    return flat.groupBy(key).agg(F.min_by("title", rank).alias("title"), F.min("moment").alias("moment"), F.min_by("due", rank).alias("due"))


def not_reminded(due: DataFrame, reminded: DataFrame, key: str) -> DataFrame:
    """Due events of which nobody was reminded yet."""
    return due.join(reminded.select(key).distinct(), key, "left_anti")


def budget_left(sent: DataFrame, day: Column, maximum: int) -> DataFrame:
    """What each channel may still send on each local day; the count starts anew every day."""
    return sent.groupBy(day.alias("day")).agg(F.count("*").alias("sent")).withColumn("left", F.greatest(F.lit(0).cast("long"), F.lit(maximum) - F.col("sent")))


def slot_due(now: Column, hour: int, minute: int, last: Column, zone: str) -> Column:
    """Whether today's slot on the reader's clock has come and nothing was sent since; missed days are not made up."""
    local = F.from_utc_timestamp(now, zone)
    slot = F.to_utc_timestamp(F.date_trunc("day", local) + F.make_dt_interval(F.lit(0), F.lit(hour), F.lit(minute)), zone)
    return (now >= slot) & (last.isNull() | (last < slot))


def delivery(current: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows kept per enabled source, 0 where it delivered nothing."""
    counts = current.groupBy(F.lower(F.trim("source")).alias("_s")).agg(F.count("*").alias("n"))
    names = sources.where(~F.coalesce("disabled", F.lit(False))).select("name", F.lower(F.trim("name")).alias("_s"))
    return names.join(counts, "_s", "left").select("name", F.coalesce("n", F.lit(0).cast("long")).alias("rows"))


def idleness(log: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Seconds since each source last delivered, at least 0; null if it never did. Ordered: never, then longest, then as configured."""
    last = log.groupBy(F.lower(F.trim("source")).alias("_s")).agg(F.max("discovered_at").alias("last"))
    names = sources.select("source_id", "name", F.lower(F.trim("name")).alias("_s"))
    idle = F.greatest(F.lit(0).cast("long"), F.floor(seconds_between(F.col("last"), now)).cast("long"))
    rows = names.join(last, "_s", "left").select("source_id", "name", "last", F.when(F.col("last").isNotNull(), idle).alias("idle"))
    return rows.orderBy(F.col("last").isNull().desc(), F.desc("idle"), "source_id")


def vendor_of_host(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """``hosts`` with the ``vendor`` whose domain is their longest suffix; null if none.

    A host is expanded to its dot-suffixes, so that the lookup is an equi-join.
    """
    from gleanery.functions.url import host_suffixes

    spread = hosts.select("host").distinct().where(F.col("host") != "").select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    best = spread.join(domains, "domain").groupBy("host").agg(F.max_by("vendor", F.char_length("domain")).alias("vendor"))
    return hosts.join(best, "host", "left")


def page_for(kinds: Column, pages: Column, order: dict[str, list[str]]) -> Column:
    """The entry page for what an offer is: the first kind that has one decides, else the general order."""

    def first(categories: list[str]) -> Column:
        return F.coalesce(*[F.try_element_at(pages, F.lit(c)) for c in categories])

    chosen = F.transform(
        kinds,
        lambda k: F.coalesce(*[F.when(k == kind, first(cats)) for kind, cats in order.items() if kind]),
    )
    return F.coalesce(F.get(F.filter(chosen, lambda p: p.isNotNull()), F.lit(0)), first(order[""]))


def link_ladder(own_vendor: Column, named_vendor: Column, cached_url: Column, cached_at: Column, probed_url: Column, now: Column, ttl_days: int = 7) -> Column:
    """How far a link can be trusted, and what that is worth: own domain, no vendor, cached verdict, probed page, unresolved."""
    fresh = (cached_at > now - F.make_dt_interval(F.lit(ttl_days))) & (F.coalesce(cached_url, F.lit("")) != "")
    step = lambda kind, delta, url: F.struct(F.lit(kind).alias("kind"), F.lit(delta).alias("delta"), url.alias("url"))
    nothing = F.lit(None).cast("string")
    return (
        F.when(own_vendor.isNotNull(), step("own_domain", 8, nothing))
        .when(F.coalesce(named_vendor, F.lit("")) == "", step("third_party", 0, nothing))
        .when(fresh, step("verified", 8, cached_url))
        .when(F.coalesce(probed_url, F.lit("")) != "", step("verified", 8, probed_url))
        .otherwise(step("unresolved", -6, nothing))
    )


def by_severity(checks: DataFrame, status: str = "status", position: str = "pos") -> DataFrame:
    """Report rows with failures first, then warnings, then what is well; otherwise in their order."""
    rank = F.when(F.col(status) == "fail", 0).when(F.col(status) == "warn", 1).otherwise(2)
    return checks.orderBy(rank, position)


def lookup_budget(rows: DataFrame, order: list[str], wants: str, most: int = 16) -> DataFrame:
    """``rows`` with ``looked``: whether each may be looked up, the first ``most`` in order that want it.

    The rank is only taken over rows that want one, which the limit keeps to ``most``.
    """
    first = rows.where(F.col(wants)).orderBy(*order).limit(most).select(*order).withColumn("looked", F.lit(True))
    return rows.join(F.broadcast(first), order, "left").withColumn("looked", F.coalesce("looked", F.lit(False)))  # ``most`` rows


def health(idle: Column, rows: Column, disabled: Column, patience_hours: int = 36, delivery_days: int = 7) -> Column:
    """What is to be said of a source: ``off``, ``never``, ``silent`` beyond its patience, ``barren`` if it is heard but keeps nothing, ``ok``."""
    return (
        F.when(F.coalesce(disabled, F.lit(False)), "off")
        .when(idle.isNull(), "never")
        .when(idle > delivery_days * 86_400, "silent")
        .when((idle > patience_hours * 3600), "late")
        .when(F.coalesce(rows, F.lit(0)) == 0, "barren")
        .otherwise("ok")
    )


def upkeep_due(now: Column, last_compact: Column, last_backup: Column, every_days: int = 7, backup_hours: int = 36) -> Column:
    """Whether the log may be compacted: not within ``every_days`` of the last time, and only behind a backup younger than ``backup_hours``."""
    rested = last_compact.isNull() | (seconds_between(last_compact, now) >= every_days * 86_400)
    return F.coalesce(rested & (seconds_between(last_backup, now) <= backup_hours * 3600), F.lit(False))
