"""The append-only log of findings: collapse, folding of reposts, and what is asked of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import claimable, dedup_key


def collapse(log: DataFrame, key: str = "fingerprint", order: str = "log_seq") -> DataFrame:
    """One row per key: the values of its last occurrence, and ``first_seq`` for the order of its first.

    Rows without a key are left out. Aggregates combine before the shuffle, so a key that holds much of the log is no hot spot.
    """
    rows = log.where(F.trim(key) != "")
    one = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), order).alias("_last"), F.min(order).alias("first_seq"))
    return one.select(key, *[F.col("_last")[c].alias(c) for c in log.columns if c != key], "first_seq")


def fold_duplicates(current: DataFrame, title: str = "title") -> DataFrame:
    """``dup_of`` for later findings whose title says what an earlier one said; the first owner keeps it.

    Findings already tagged in ``meta`` neither own nor get a key. Owners are found by an aggregate, never by gathering a group.
    """
    tagged = F.coalesce(F.col("meta")["dup_of"], F.lit(""))
    keyed = current.withColumn("dedup_key", F.when(tagged == "", dedup_key(F.col(title))).otherwise(F.lit("")))
    owners = keyed.where(F.col("dedup_key") != "").groupBy("dedup_key").agg(F.min_by("fingerprint", "first_seq").alias("owner"))
    folded = keyed.join(owners, "dedup_key", "left")
    other = F.when(F.col("owner") != F.col("fingerprint"), F.col("owner"))
    return folded.withColumn("dup_of", F.coalesce(F.when(tagged != "", tagged), other)).drop("owner")


def meta_time(key: str) -> Column:
    """A time kept in ``meta`` as text, to the second; null if absent or unreadable."""
    return F.date_trunc("second", F.try_to_timestamp(F.col("meta")[key]))


def recent(current: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first, ties in the order of first appearance."""
    ordered = current.orderBy(F.desc("discovered_at"), F.asc("first_seq"))
    return ordered.limit(limit) if limit else ordered


def live(folded: DataFrame, now: Column, min_score: int) -> DataFrame:
    """Findings that can be claimed now: no repost, good enough, and open; a deadline exactly now is still open.

    Dated events, vouchers and what has an opening time, must state a deadline.
    """
    deadline = meta_time("expires_at")
    dated = (F.coalesce(F.col("category"), F.lit("")) == "voucher") | meta_time("starts_at").isNotNull()
    is_open = F.when(deadline.isNull(), ~dated).otherwise(deadline >= now)
    ok = claimable(F.col("title"), F.col("is_free"), F.col("discount_pct"), F.col("offers"))
    return folded.withColumn("expires_at", deadline).where(F.col("dup_of").isNull() & (F.coalesce("score", F.lit(0)) >= min_score) & ok & is_open)


def top_live(folded: DataFrame, now: Column, min_score: int, limit: int) -> DataFrame:
    """The briefing: the best live findings, by score, then newest, then first seen."""
    return live(folded, now, min_score).orderBy(F.desc("score"), F.desc("discovered_at"), F.asc("first_seq")).limit(limit)


def in_period(events: DataFrame, moment: str, since: Column, through: Column) -> DataFrame:
    """Events whose moment lies in a closed period, by moment and then title."""
    return events.where(F.col(moment).between(since, through)).orderBy(moment, "title")


def stats(folded: DataFrame) -> DataFrame:
    """One row: distinct findings, reposts among them, pushed ones, and the span of discovery."""
    pushed = F.coalesce(F.col("meta")["pushed"], F.lit("")) == "true"
    return folded.agg(
        F.count("*").alias("findings"),
        F.count_if(F.col("dup_of").isNotNull()).alias("reposts"),
        F.count_if(pushed).alias("pushed"),
        F.min("discovered_at").alias("first_found"),
        F.max("discovered_at").alias("last_found"),
    )


def compactable(folded: DataFrame, now: Column, keep_days: int, min_score: int = 60) -> DataFrame:
    """What a compaction keeps: young findings, and old ones of good score that were not pushed; all if ``keep_days`` is 0 or less."""
    if keep_days <= 0:
        return folded
    old = F.col("discovered_at") < now - F.make_dt_interval(F.lit(keep_days))
    pushed = F.coalesce(F.col("meta")["pushed"], F.lit("")) == "true"
    return folded.where(~(F.coalesce(old, F.lit(False)) & (pushed | (F.coalesce("score", F.lit(0)) < min_score))))


def prune_state(state: DataFrame, kept: DataFrame, prefix: str = "official:deal:") -> DataFrame:
    """State rows whose finding is still kept, and all rows that belong to no finding."""
    bound = state.where(F.startswith("key", F.lit(prefix))).withColumn("_fp", F.expr(f"substring(key, {len(prefix) + 1})"))
    still = bound.join(kept.select(F.col("fingerprint").alias("_fp")).distinct(), "_fp", "left_semi").drop("_fp")
    return still.unionByName(state.where(~F.startswith("key", F.lit(prefix))))


def merge_state(disk: DataFrame, changed: DataFrame) -> DataFrame:
    """State after an update: changed keys win, all others stay; retired keys are dropped."""
    return disk.join(changed.select("key"), "key", "left_anti").unionByName(changed).where(~F.startswith("key", F.lit("digest:")))


def find(
    folded: DataFrame, min_score: int = 0, category: str = "", source: str = "", needle: str = "", dupes: bool = False, pushed: bool | None = None, tag: str = "",
    verified: bool | None = None,
) -> DataFrame:
    """Findings of a category and source, if given, that score enough and hold a text, whatever its case; reposts only if asked for.

    ``pushed`` and ``verified`` (a vendor is known) narrow the list either way, ``tag`` to findings that carry it.
    """
    ok = F.coalesce("score", F.lit(0)) >= min_score
    if not dupes:
        ok = ok & F.col("dup_of").isNull()
    if category.strip():
        ok = ok & (F.col("category") == category.strip())
    if source.strip():
        ok = ok & (F.col("source") == source.strip())
    if needle.strip():
        text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit("")))
        ok = ok & F.contains(F.lower(text), F.lit(needle.strip().lower()))
    if pushed is not None:
        ok = ok & ((F.coalesce(F.col("meta")["pushed"], F.lit("")) == "true") == pushed)
    if verified is not None:
        ok = ok & (F.coalesce(F.size("vendors") > 0, F.lit(False)) == verified)
    if tag.strip():
        ok = ok & F.coalesce(F.array_contains("tags", tag.strip()), F.lit(False))
    return folded.where(ok)


def _other_than(key: str) -> Callable[[Column, Column], Column]:
    return lambda k, v: k != key


def reparsed(rows: DataFrame, starts_at: Column, expires_at: Column) -> DataFrame:
    """Rows with the times that their texts are read to state in ``meta``; an absent reading erases nothing. ``changed`` tells which differ.

    Reposts keep what they have.
    """
    old = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    kept = {k: F.try_to_timestamp(old[k]) for k in ("starts_at", "expires_at")}
    read = {"starts_at": starts_at, "expires_at": expires_at}
    moved = {k: read[k].isNotNull() & ~read[k].eqNullSafe(kept[k]) & (F.coalesce(old["dup_of"], F.lit("")) == "") for k in kept}
    meta = old
    for k in kept:
        stamp = F.date_format(read[k], "yyyy-MM-dd'T'HH:mm:ss'Z'")  # the session's clock is UTC
        meta = F.when(moved[k], F.map_concat(F.map_filter(meta, _other_than(k)), F.create_map(F.lit(k), stamp))).otherwise(meta)
    return rows.withColumn("changed", moved["starts_at"] | moved["expires_at"]).withColumn("meta", meta)


def flagged(log: DataFrame, fingerprints: DataFrame, flag: str, next_seq: int) -> DataFrame:
    """New log rows that mark findings: the last row of each with ``flag`` set in ``meta``, numbered from ``next_seq`` in the order of the log.

    The log only grows; its collapse then shows the flag. Findings the log does not know give nothing.
    """
    last = collapse(log.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_semi"))
    meta = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: k != flag)
    ranked = last.withColumn("meta", F.map_concat(meta, F.create_map(F.lit(flag), F.lit("true"))))
    number = F.row_number().over(Window.orderBy("log_seq")) + (next_seq - 1)  # as many rows as are marked at once
    return ranked.withColumn("log_seq", number.cast("long")).select(*log.columns)


def compact(log: DataFrame, now: Column, keep_days: int, path: str, min_score: int = 60) -> DataFrame:
    """Rewrites the log, collapsed and folded, without what is old and done with; ``path`` is a new version, beside the old one."""
    kept = compactable(fold_duplicates(collapse(log)), now, keep_days, min_score)
    tag = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: k != "dup_of")
    tagged = kept.withColumn("meta", F.when(F.col("dup_of").isNotNull(), F.map_concat(tag, F.create_map(F.lit("dup_of"), F.col("dup_of")))).otherwise(F.col("meta")))
    tagged.select(*log.columns).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)
