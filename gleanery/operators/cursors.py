"""Cursors of collectors between rounds: what each source showed last, kept as state rows.

A round reads the cursors, emits its rows, and moves the cursors only after the rows are stored: a round that fails is repeated, and
fingerprints keep what it stored twice from counting twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import collect
from gleanery.operators.state import StateTable

FACTS, FREE, TURN = "snapshot:facts:", "catalogue:free", "search:cursor:"


def known_facts(state: DataFrame) -> DataFrame:
    """``source``, ``fact_key`` of all cursors; one that cannot be read counts as absent, so that its source begins anew."""
    mine = state.where(F.startswith("key", F.lit(FACTS)))
    keys = F.from_json("value", "array<string>")
    return mine.select(F.expr(f"substring(key, {len(FACTS) + 1})").alias("source"), F.explode(keys).alias("fact_key"))


def facts_round(state: StateTable, facts: DataFrame, store: Callable[[DataFrame], None]) -> None:
    """One pass over price facts (``source``, ``fact_key`` and what else is to be stored): new ones are stored, then the cursors move."""
    known = known_facts(state.read())
    store(collect.new_facts(facts, known))
    # a page has a bounded number of facts
    after = facts.groupBy("source").agg(F.sort_array(F.collect_set("fact_key")).alias("k"))
    state.put(after.select(F.concat(F.lit(FACTS), "source").alias("key"), F.to_json("k").alias("value"), F.current_timestamp().alias("updated_at")))


def free_round(state: StateTable, models: DataFrame, now_ms: int, store: Callable[[DataFrame], None], grace_days: int = 14, most: int = 10) -> None:
    """One pass over a catalogue: models that became free are stored, then the set of free ones replaces the cursor."""
    kept = state.get(FREE)
    spark = models.sparkSession
    known = None if kept is None else spark.createDataFrame([(kept,)], "v string").select(F.explode(F.from_json("v", "array<string>")).alias("model_id"))
    store(collect.free_flips(models, known, now_ms, grace_days, most))
    free = models.where(collect.zero_price(F.col("prompt")) & collect.zero_price(F.col("completion")))
    ids = free.agg(F.to_json(F.sort_array(F.collect_set("model_id"))).alias("v")).first()  # the ids of one catalogue
    state.set({FREE: ids.v})


def search_round(state: StateTable, sources: DataFrame) -> DataFrame:
    """``name``, ``query`` of the query whose turn it is for each source (``name``, ``params``); the cursors move on."""
    cursors = state.read().where(F.startswith("key", F.lit(TURN))).select(F.expr(f"substring(key, {len(TURN) + 1})").alias("name"), F.col("value").try_cast("int").alias("_c"))
    turn = collect.next_query(F.col("params")["queries"], F.col("params")["site"], F.col("_c"))
    rows = sources.join(cursors, "name", "left").select("name", turn.alias("t")).where(F.col("t").isNotNull()).select("name", "t.query", "t.cursor")
    held = rows.collect()  # one row per source
    if held:
        state.set({TURN + r.name: str(r.cursor) for r in held})
    return sources.sparkSession.createDataFrame([(r.name, r.query) for r in held], "name string, query string")
