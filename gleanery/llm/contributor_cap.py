"""Capping records per contributor: cutoffs found by parallel bisection on counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.session import keep

#: The bounds of every contributor are split at FANOUT - 1 midpoints per round, all counted together.
FANOUT = 1_024


def _search(hist: DataFrame, bounds: DataFrame, groups: list[str], fanout: int = FANOUT) -> DataFrame:
    """Per group the cutoff, the smallest value with at most ``want`` records above it, and the room left at it.

    ``hist`` has counts ``n`` per group and whole number ``v``; ``bounds`` has ``lo``, ``hi``, ``want`` per group, where
    at most ``want`` records have v > hi and more have v > lo. Every round counts, for all groups in one pass, the
    records above each midpoint, and keeps the part between the two midpoints where the count passes ``want``; the
    count above that part is carried along, so only records between the bounds are counted again.
    """
    state = bounds.withColumn("above", F.lit(0).cast("long"))
    while True:
        state = keep(state)
        if (state.agg(F.max(F.col("hi") - F.col("lo")).alias("width")).first().width or 0) <= 1:
            return state.select(*groups, F.col("hi").alias("cutoff"), (F.col("want") - F.col("above")).alias("room"))
        stepped = state.withColumn("step", F.ceil((F.col("hi") - F.col("lo")) / fanout).cast("long"))
        inside = hist.join(stepped, groups).where((F.col("v") > F.col("lo")) & (F.col("v") <= F.col("hi")))
        # cell c holds lo + c * step < v <= lo + (c + 1) * step
        cell = F.expr("int((v - lo - 1) div step)")
        cells = inside.groupBy(*groups, cell.alias("c")).agg(F.sum("n").alias("n"))
        packed = cells.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("c", "n")), asc=False).alias("cells"))  # at most fanout
        # from the highest cell downwards: stop in the first that would exceed what is wanted
        walk = F.aggregate(
            "cells",
            F.struct(F.lit(-1).alias("c"), F.col("above").alias("above"), F.lit(False).alias("done")),
            lambda s, x: F.when(s.done, s)
            .when(s.above + x.n > F.col("want"), F.struct(x.c.alias("c"), s.above.alias("above"), F.lit(True).alias("done")))
            .otherwise(F.struct(s.c.alias("c"), (s.above + x.n).alias("above"), F.lit(False).alias("done"))),
        )
        lo = F.col("lo") + F.col("w.c") * F.col("step")
        state = (
            stepped.join(packed, groups)
            .withColumn("w", walk)
            .select(*groups, lo.alias("lo"), F.least("hi", lo + F.col("step")).alias("hi"), "want", F.col("w.above").alias("above"))
        )


def cap_dropped(
    rows: DataFrame, groups: list[Column], score: str, identifier: str, cap: int | None = None, share: float | None = None
) -> DataFrame:
    """The rows to drop (``identifier``) so that each contributor keeps at most ``cap`` rows, or a ``share`` of its rows.

    Kept are the rows with the higher score; null scores come last; ties go to the smaller identifier. Rows with
    a null in any group column aren't capped. ``score`` is a whole number; ``identifier`` is a unique, non-null
    bigint. Empty input gives an empty result; further columns are ignored, whatever their names.

    The cutoff of every contributor is found by parallel bisection: score bounds per contributor, counts above the
    midpoints in one pass over a histogram, until the bounds meet; the identifiers of the rows at the cutoff are
    searched the same way. No contributor's rows are ever sorted or gathered in one task, so one that holds a third of
    all rows costs no more than its share of the counting.
    """
    if (cap is None) == (share is None):
        raise ValueError("give either cap or share")
    names = [f"g{i}" for i in range(len(groups))]
    base = keep(
        rows.select(*[g.alias(n) for g, n in zip(groups, names)], F.col(score).cast("long").alias("v"), F.col(identifier).cast("long").alias("id")).dropna(
            subset=names
        )
    )
    counts = base.groupBy(*names, "v").agg(F.count("*").alias("n"))
    want = F.lit(cap).cast("long") if cap is not None else F.floor(F.col("rows") * F.lit(share)).cast("long")
    # a null score is one below the contributor's lowest
    over = keep(
        counts.groupBy(*names)
        .agg(F.sum("n").alias("rows"), (F.coalesce(F.min("v"), F.lit(0)) - 1).alias("unknown"), F.coalesce(F.max("v"), F.lit(0)).alias("hi"))
        .withColumn("want", want)
        .where(F.col("rows") > F.col("want"))
    )
    hist = keep(counts.join(over.select(*names, "unknown"), names).withColumn("v", F.coalesce("v", "unknown")).drop("unknown"))
    cutoff = _search(hist, over.select(*names, (F.col("unknown") - 1).alias("lo"), "hi", "want"), names)
    below = keep(
        base.join(over.select(*names, "unknown"), names)
        .withColumn("v", F.coalesce("v", "unknown"))
        .join(cutoff, names)
        .where(F.col("v") <= F.col("cutoff"))
        .select(*names, "id", (F.col("v") == F.col("cutoff")).alias("tied"), "room")
    )
    # of the rows at the cutoff the smallest identifiers stay: the same search, from -id downwards
    ties = below.where("tied").select(*names, (-F.col("id")).alias("v"), F.lit(1).cast("long").alias("n"), "room")
    tied = ties.groupBy(*names).agg((F.min("v") - 1).alias("lo"), F.max("v").alias("hi"), F.first("room").alias("want"), F.count("*").alias("rows"))
    tied = tied.where(F.col("rows") > F.col("want")).drop("rows")
    last = _search(ties.drop("room"), tied, names)
    at_cutoff = ties.join(last.drop("room"), names).where(F.col("v") <= F.col("cutoff")).select((-F.col("v")).alias("id"))
    return below.where(~F.col("tied")).select("id").unionByName(at_cutoff).select(F.col("id").alias(identifier))


def dominant_sources_dropped(deals: DataFrame, cap: int = 12) -> DataFrame:
    """The deals to drop when each source keeps at most ``cap`` rows per batch; rows without a source aren't capped."""
    source = F.lower(F.regexp_replace("source", r"^[\s 　]+|[\s 　]+$", ""))
    return cap_dropped(deals, [F.when(source != "", source), F.col("batch_no")], "score", "log_seq", cap=cap)
