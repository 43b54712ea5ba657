"""Snapshot diffs against brute force."""

import random

from pyspark.sql import functions as F

from gleanery.operators.snapshot_diff import SnapshotStore, catalogue_changes, repriced, snapshot_changes

CATALOGUE = "row_id long, snap_no int, delivery_no int, id string, pricing struct<prompt:string,completion:string>, pair_no int"


def test_merge_against_brute_force(spark, tmp_path):
    """Snapshots kept range-partitioned and sorted, one after another, against sets; a repeated write replaces, old ranges stay as they are."""
    rng = random.Random(5)
    snaps = [{f"k{k:03}": rng.choice([None, 1.0, 2.0]) for k in rng.sample(range(300), 200)} for _ in range(3)]
    store = SnapshotStore(spark, f"file://{tmp_path}/store", "k", ["v"], ranges=5)
    want = set()
    for n, rows in enumerate(snaps):
        df = spark.createDataFrame([(n, k, v, "x") for k, v in rows.items()] + [(n, None, 1.0, "x")], "s int, k string, v double, diff_kind string")
        store.add(df, "s")
        if n == 1:
            store.add(df, "s")
        assert store.numbers() == list(range(n + 1))
        if n:
            old = snaps[n - 1]
            step = {(k, n, "removed", old[k], None) for k in old.keys() - rows.keys()} | {(k, n, "added", None, rows[k]) for k in rows.keys() - old.keys()}
            step |= {(k, n, "changed", old[k], rows[k]) for k in old.keys() & rows.keys() if old[k] != rows[k]}
            value = lambda s: s and s.v
            assert {(r.k, r.snap, r.diff_kind, value(r.old), value(r.new)) for r in store.changes(since=n).collect()} == step
            want |= step
    assert store.changes().count() == len(want)
    kept = spark.read.parquet(f"{tmp_path}/store/snapshots")
    spans = kept.groupBy("part").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(spans) == 5 and all(a.hi < b.lo for a, b in zip(spans, spans[1:]))


def test_catalogue(spark):
    price = lambda p, c="0": (p, c)
    rows = [
        (1, 1, 1, "A/x", price("0.1"), 7),
        (2, 1, 1, "b", price("1"), 7),
        (3, 1, 1, "gone", price("1"), 7),
        (4, 2, 1, "stale", price("9"), 7),  # an earlier delivery does not count
        (5, 2, 2, " a/X ", price("1e-1"), 7),  # the same number, written otherwise
        (6, 2, 2, "b", price(" "), 7),  # became unknown
        (7, 2, 2, "new", price(None, None), 7),
        (8, 2, 2, "new", price(None, None), 7),  # repeated
        (9, 3, 1, "b", price(None), 7),  # still unknown
        (10, 3, 1, "gone", price("1"), 7),  # returns
        (11, 3, 1, None, price("1"), 7),
        (12, 3, 1, "  ", price("1"), 7),
        (13, 5, 1, "b", price("3"), 7),  # no snapshot 4 to compare with
    ]
    changes = catalogue_changes(spark.createDataFrame(rows, CATALOGUE))
    got = {(r.model_id, r.snap_no, r.diff_kind) for r in changes.collect()}
    assert got == {("gone", 2, "removed"), ("b", 2, "changed"), ("new", 2, "added"), ("a/x", 3, "removed"), ("new", 3, "removed"), ("gone", 3, "added")}
    assert [tuple(r) for r in repriced(changes).collect()] == [("b", 2, "prompt", 1.0, None)]


def test_empty(spark):
    changes = catalogue_changes(spark.createDataFrame([], CATALOGUE))
    assert changes.count() == 0 and repriced(changes).count() == 0


def test_many_rows_stream_over_batches(spark):
    n = 30_000
    rows = spark.range(2 * n).selectExpr(f"string(id % {n}) AS k", f"int(1 + id div {n}) AS s", "1 AS d", "id AS t", "double(id % 7) AS v")
    assert snapshot_changes(rows, "k", ["v"], "s", "d", "t").where("diff_kind <> 'changed'").count() == 0
