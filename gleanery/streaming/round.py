"""Rounds as a stream: every micro-batch is judged against the log, appended once, and reminded of once."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.clock import ZONE
from gleanery.functions.text import dedup_key
from gleanery.functions.url import fingerprint
from gleanery.operators import rounds
from gleanery.operators.delivery import Sink, message
from gleanery.operators.state import StateTable
from gleanery.schema import REMINDED
from gleanery.session import children, read_or_empty, write_text


def judge(batch: DataFrame, log: DataFrame, refused: Column, order: DataFrame | None = None) -> DataFrame:
    """The rows of a batch that are new: the first of each fingerprint, in source and item order, unknown to the log, not refused.

    The log is all history: no watermark lets a finding in again. ``order`` (``source``, ``place``) gives the configured order of
    sources; without it they go by name. A row whose title an earlier one owns, in the log or in the batch, is kept and tagged
    ``dup_of`` in ``meta``.
    """
    keyed = batch.withColumn("fingerprint", F.coalesce(F.nullif(F.trim("fingerprint"), F.lit("")), fingerprint(F.col("url"), F.col("source"), F.col("title"))))
    columns = [c for c in keyed.columns if c != "fingerprint"]
    if order is not None:
        keyed = keyed.join(F.broadcast(order.select("source", F.col("place").alias("_place"))), "source", "left")  # one row per configured source
    else:
        keyed = keyed.withColumn("_place", F.lit(0))
    first = keyed.groupBy("fingerprint").agg(
        F.min_by(F.struct(*columns), F.struct("_place", "source", "log_seq")).alias("_r"), F.min(F.struct("_place", "source", "log_seq")).alias("_o")
    )
    rows = first.select("fingerprint", "_r.*", "_o").where(~F.coalesce(refused, F.lit(False))).join(log.select("fingerprint"), "fingerprint", "left_anti")
    rows = rows.withColumn("_key", dedup_key(F.col("title")))
    owned = log.where(F.coalesce(F.col("meta")["dup_of"], F.lit("")) == "").select(dedup_key(F.col("title")).alias("_key"), "fingerprint", "log_seq").where("_key <> ''")
    owned = owned.groupBy("_key").agg(F.min_by("fingerprint", "log_seq").alias("_old"))
    here = rows.where("_key <> ''").groupBy("_key").agg(F.min_by("fingerprint", "_o").alias("_new"))
    owner = F.coalesce("_old", F.when(F.col("_new") != F.col("fingerprint"), F.col("_new")))
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    tagged = rows.join(owned, "_key", "left").join(here, "_key", "left").withColumn(
        "meta", F.when(owner.isNotNull(), F.map_concat(F.map_filter(meta, lambda k, v: k != "dup_of"), F.create_map(F.lit("dup_of"), owner))).otherwise(meta)
    )
    return tagged.select("fingerprint", *columns)


@dataclass
class Channel:
    """What is sent of one kind: at most ``most`` at once and ``per_day`` a local day; 0 is silence, None no limit."""

    most: int = 5
    per_day: int | None = None


class Round:
    """One micro-batch. Its rows go to a folder of their own that a repeated run overwrites, so nothing is stored twice.

    The log, the marks of reminders, the budgets and the reports are tables on whatever file system ``folder`` names.
    """

    def __init__(
        self,
        folder: str,
        sink: Sink,
        now: Column,
        refused: Column,
        urgent_score: int = 80,
        lead_hours: int = 24,
        urgent: Channel | None = None,
        event: Channel | None = None,
        order: DataFrame | None = None,
        zone: str = ZONE,
    ) -> None:
        self.folder, self.log, self.reminded = folder, f"{folder}/log", f"{folder}/reminded"
        self.sink, self.now, self.refused, self.urgent_score, self.lead = sink, now, refused, urgent_score, lead_hours
        self.channels, self.order, self.zone = {"urgent": urgent or Channel(), "event": event or Channel()}, order, zone

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = f"{self.log}/batch_id={batch_id}"
        others = [p for p in children(spark, self.log) if p.rsplit("/", 1)[-1].startswith("batch_id=") and not p.endswith(f"/batch_id={batch_id}")]
        old = spark.read.schema(batch.schema).parquet(*others) if others else batch.limit(0)
        judge(batch, old, self.refused, self.order).write.mode("overwrite").parquet(mine)
        new = spark.read.schema(batch.schema).parquet(mine)
        own = F.coalesce(F.col("meta")["dup_of"], F.lit("")) == ""
        urgent = self.send(spark, "urgent", new.where(own & (F.coalesce("score", F.lit(0)) >= self.urgent_score)), [F.desc("score"), F.asc("title")], "new findings")
        event = self.remind(spark)
        counts = new.agg(F.count("*").alias("new"), F.count_if(~own).alias("dupes")).first()
        report = {"new": counts.new, "dupes": counts.dupes, "urgent_sent": urgent[0], "urgent_held": urgent[1], "event_sent": event[0], "event_held": event[1]}
        write_text(spark, f"{self.folder}/reports/{batch_id}.json", json.dumps(report))

    def budget(self, spark: SparkSession, channel: str) -> tuple[StateTable, str, int, int | None]:
        """The state, today on the reader's clock, how many were sent today and how many may still be; a new day starts anew."""
        state = StateTable(spark, f"{self.folder}/state")
        today = spark.range(1).select(F.date_format(F.from_utc_timestamp(self.now, self.zone), "yyyy-MM-dd").alias("d")).first().d
        kept = json.loads(state.get(f"{channel}:sent") or "{}")
        sent = kept.get("n", 0) if kept.get("date") == today else 0
        limit = self.channels[channel].per_day
        return state, today, sent, None if limit is None else max(0, limit - sent)

    def send(self, spark: SparkSession, channel: str, due: DataFrame, order: list[Column], what: str) -> tuple[int, int]:
        """Sends the first of what is due within the budget: (sent, held). The budget is charged only after the sink took the message."""
        rows, held = self.take(spark, channel, due, order)
        if rows:
            self.sink.send(message(channel, f"{len(rows)} {what}", rows))
            self.charge(spark, channel, len(rows))
        return len(rows), held

    def take(self, spark: SparkSession, channel: str, due: DataFrame, order: list[Column]) -> tuple[list, int]:
        *_, left = self.budget(spark, channel)
        most = self.channels[channel].most if left is None else min(self.channels[channel].most, left)
        total = due.count()
        rows = due.orderBy(*order).limit(most).collect() if most > 0 and total else []  # at most ``most``
        return rows, total - len(rows)

    def charge(self, spark: SparkSession, channel: str, n: int) -> None:
        state, today, sent, _ = self.budget(spark, channel)
        state.set({f"{channel}:sent": json.dumps({"date": today, "n": sent + n})})

    def remind(self, spark: SparkSession) -> tuple[int, int]:
        """Reminds of what closes soon; marked only after the sink took it, so a failed one is tried again."""
        log = spark.read.parquet(self.log)
        clock = F.try_to_timestamp(F.col("meta")["expires_at"])
        own = F.coalesce(F.col("meta")["dup_of"], F.lit("")) == ""
        events = log.where(own).select("fingerprint", "title", "url", "score", F.try_to_timestamp(F.col("meta")["starts_at"]).alias("starts_at"), clock.alias("ends_at"))
        due = rounds.nearest_moments(events, "fingerprint", self.now, self.lead, 0)
        due = rounds.not_reminded(due, read_or_empty(spark, self.reminded, REMINDED), "fingerprint")
        rows, held = self.take(spark, "event", due, [F.asc("moment"), F.asc("title")])
        if rows:
            self.sink.send(message("event", f"{len(rows)} due", rows))
            marks = spark.createDataFrame([(r.fingerprint, r.moment) for r in rows], REMINDED)
            marks.write.mode("append").parquet(self.reminded)
            self.charge(spark, "event", len(rows))
        return len(rows), held


def start(findings: DataFrame, run: Round, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs rounds over a stream of findings until what is there is done, or one ``every`` interval; a restart goes on where it stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return findings.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def next_delay(interval_s: float, jitter_s: float, draw: Callable[[], float] = random.random) -> float:
    """Seconds to the next round: the interval, earlier or later by up to the jitter, and a second at least."""
    return max(1.0, interval_s + (2 * draw() - 1) * max(0.0, jitter_s))


def source_budget(interval_s: float, margin_s: float = 30.0) -> float:
    """Seconds that a source may take: the interval less a margin, and never less than the margin."""
    return max(margin_s, interval_s - margin_s)
