"""What changed between full snapshots: kept range-partitioned and sorted by key, merged range by range with two pointers."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, IntegerType, StringType, StructField, StructType

from gleanery.session import children, keep, read_text, shared_dir, write_text

#: Rows of a range, about, when the ranges of a store are laid out.
ROWS_PER_RANGE = 500_000
#: Ranges of a store, at least and at most.
FEWEST_RANGES, MOST_RANGES = 8, 10_000

Row = tuple[object, tuple]


def merge(old: Iterator[Row], new: Iterator[Row]) -> Iterator[tuple[object, str, tuple | None, tuple | None]]:
    """Typed changes (key, kind, old values, new values) between two runs of (key, values) sorted by unique keys.

    Two pointers advance: a key met on one side only is ``removed`` or ``added``, one met on both is ``changed`` if a value differs (null
    differs from any value, two nulls are equal). Equal rows give nothing.
    """
    a, b = next(old, None), next(new, None)
    while a is not None or b is not None:
        if b is None or (a is not None and a[0] < b[0]):
            yield a[0], "removed", a[1], None
            a = next(old, None)
        elif a is None or b[0] < a[0]:
            yield b[0], "added", None, b[1]
            b = next(new, None)
        else:
            if a[1] != b[1]:
                yield a[0], "changed", a[1], b[1]
            a, b = next(old, None), next(new, None)


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """A folder's file system as a worker sees it, and the path on it."""
    parts = urlsplit(folder)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else folder
    return fs.FileSystem.from_uri(folder)


def _run(folder: str, key: str, values: list[str]) -> Iterator[Row]:
    """The rows of one range of a snapshot in order of the key, streamed; nothing if it has none."""
    system, path = _opened(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))

    def rows(file: str) -> Iterator[Row]:
        with system.open_input_file(file) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=20_000, columns=[key, *values]):
                columns = [batch.column(c).to_pylist() for c in (key, *values)]
                yield from zip(columns[0], zip(*columns[1:]) if values else ((),) * len(columns[0]))

    yield from heapq.merge(*(rows(f.path) for f in found if f.path.endswith(".parquet")), key=lambda r: r[0])


class SnapshotStore:
    """Snapshots of one table in a folder: ``snap=<n>/part=<r>``, every range ``r`` sorted by key and the same in all snapshots.

    The bounds of the ranges are drawn from the first snapshots and kept, so that a later one is compared by reading the range beside its
    own, without sorting or shuffling anything that is kept already. A snapshot that is written again replaces the one before.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, values: list[str], ranges: int | None = None) -> None:
        self.spark, self.folder, self.key, self.values, self.ranges = spark, folder, key, values, ranges
        self.types: dict[str, DataType] = {}

    def _bounds(self, rows: DataFrame) -> list:
        kept = read_text(self.spark, f"{self.folder}/bounds.json")
        if kept is None:
            keys = rows.select(self.key)
            n = self.ranges or min(MOST_RANGES, max(FEWEST_RANGES, keys.count() // ROWS_PER_RANGE))
            # the least key of every range but the first; one row per range
            parts = keys.distinct().repartitionByRange(n, self.key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(self.key).alias("k"))
            kept = json.dumps(sorted(r.k for r in parts.collect())[1:])
            write_text(self.spark, f"{self.folder}/bounds.json", kept)
        return json.loads(kept)

    def add(self, rows: DataFrame, snapshot: str) -> None:
        """Keeps the snapshots that ``rows`` hold, at most one row per snapshot and key; rows without a key are left out."""
        rows = rows.select(F.col(snapshot).alias("snap"), self.key, *self.values).dropna(subset=["snap", self.key])
        self.types = {c: rows.schema[c].dataType for c in (self.key, *self.values)}
        bounds = self._bounds(rows)
        if not bounds:
            part = F.lit(0)
        else:

            @F.pandas_udf("int")
            def place(s: pd.Series) -> pd.Series:
                return pd.Series(np.searchsorted(np.array(bounds, dtype=s.to_numpy().dtype), s.to_numpy(), side="right").astype("int32"))

            part = place(self.key)
        placed = rows.withColumn("part", part).repartition("snap", "part").sortWithinPartitions("snap", "part", self.key)
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snap", "part").parquet(f"{self.folder}/snapshots")

    def numbers(self) -> list[int]:
        """The snapshots that are kept."""
        names = (p.rsplit("/", 1)[-1] for p in children(self.spark, f"{self.folder}/snapshots"))
        return sorted(int(n[5:]) for n in names if n.startswith("snap="))

    def changes(self, since: int | None = None) -> DataFrame:
        """``key``, ``snap``, ``diff_kind``, ``old`` and ``new`` (structs of the values) of every snapshot against the one numbered before it,
        from snapshot ``since`` on. A snapshot whose predecessor is absent yields nothing."""
        spark, key, values, folder = self.spark, self.key, self.values, f"{self.folder}/snapshots"
        numbers = self.numbers()
        pairs = [n for n in numbers if n - 1 in numbers and (since is None or n >= since)]
        bounds = json.loads(read_text(spark, f"{self.folder}/bounds.json") or "[]")
        if numbers:
            kept = spark.read.parquet(folder).schema
            self.types = {c: kept[c].dataType for c in (key, *values)}
        value = StructType([StructField(v, self.types.get(v, StringType())) for v in values])
        schema = StructType([StructField(key, self.types.get(key, StringType()))]).add("snap", IntegerType()).add("diff_kind", StringType()).add("old", value).add("new", value)
        if not pairs:
            return spark.createDataFrame([], schema)
        arrow = to_arrow_schema(schema)
        # one task a range of each pair; a row is all that is sent to it
        tasks = spark.range(len(pairs) * (len(bounds) + 1), numPartitions=min(len(pairs) * (len(bounds) + 1), 4 * spark.sparkContext.defaultParallelism))
        work = tasks.select(F.element_at(F.array(*map(F.lit, pairs)), F.expr(f"int(id div {len(bounds) + 1}) + 1")).alias("snap"), F.expr(f"int(id % {len(bounds) + 1})").alias("part"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flush(out: list[tuple]) -> pa.RecordBatch:
                named = lambda v: None if v is None else dict(zip(values, v))
                rows = [(k, snap, kind, named(a), named(b)) for k, snap, kind, a, b in out]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

            for batch in batches:
                for snap, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    out = []
                    old, new = (_run(f"{folder}/snap={n}/part={part}", key, values) for n in (snap - 1, snap))
                    for k, kind, a, b in merge(old, new):
                        out.append((k, snap, kind, a, b))
                        if len(out) == 10_000:
                            yield flush(out)
                            out = []
                    if out:
                        yield flush(out)

        return work.mapInArrow(run, schema)


def last_deliveries(df: DataFrame, key: str, values: list[str], snapshot: str, delivery: str, tie: str) -> DataFrame:
    """One row per snapshot and key: of a snapshot delivered several times the last delivery, of repeated rows the one with the highest ``tie``."""
    last = df.where(F.col(snapshot).isNotNull()).groupBy(snapshot).agg(F.max(delivery).alias("_last"))  # one row per snapshot
    rows = df.select(key, snapshot, delivery, tie, *values).dropna(subset=[key])
    rows = rows.join(last, snapshot).where(F.col(delivery).eqNullSafe(F.col("_last")))
    one = rows.groupBy(snapshot, key).agg(F.max_by(F.struct(*values), F.coalesce(F.col(tie).cast("long"), F.lit(-1))).alias("_v"))
    return one.select(key, snapshot, *[F.col("_v")[v].alias(v) for v in values])


def snapshot_changes(df: DataFrame, key: str, values: list[str], snapshot: str, delivery: str, tie: str, folder: str | None = None) -> DataFrame:
    """Changes of every snapshot against the one numbered before it: ``key``, ``snapshot``, ``diff_kind``, ``old``, ``new``.

    Of a snapshot delivered several times only the last delivery counts; of repeated rows of one key the one with the highest ``tie``. A
    snapshot whose predecessor is absent, such as the first, yields nothing. The snapshots are kept in ``folder``, or in the
    shared folder for this run.
    """
    spark = df.sparkSession
    store = SnapshotStore(spark, folder or f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", key, values)
    rows = keep(last_deliveries(df, key, values, snapshot, delivery, tie))
    store.add(rows, snapshot)
    return store.changes().withColumnRenamed("snap", snapshot)


def known_number(text: F.Column) -> F.Column:
    """The number a price string states, however written; null if blank, absent or not a number."""
    return text.try_cast("double") + 0.0  # no negative zero


def catalogue_rows(catalogue: DataFrame) -> DataFrame:
    """The catalogue with ids and prices in one form: ``model_id``, ``snap_no``, ``delivery_no``, ``row_id``, ``prompt``, ``completion``.

    Ids are equal regardless of case and blanks around them. Prices are compared as numbers;
    null and blank prices are unknown. Rows without an id are left out.
    """
    return catalogue.select(
        F.lower(F.trim("id")).alias("model_id"),
        "snap_no",
        "delivery_no",
        "row_id",
        known_number(F.trim(F.col("pricing.prompt"))).alias("prompt"),
        known_number(F.trim(F.col("pricing.completion"))).alias("completion"),
    ).where(F.col("model_id") != "")


def catalogue_changes(catalogue: DataFrame) -> DataFrame:
    """Models added, removed or repriced per weekly snapshot of the catalogue: ``model_id``, ``snap_no``, ``diff_kind``, ``old``, ``new``."""
    return snapshot_changes(catalogue_rows(catalogue), "model_id", ["prompt", "completion"], "snap_no", "delivery_no", "row_id")


def repriced(changes: DataFrame) -> DataFrame:
    """One row per price that differs: ``model_id``, ``snap_no``, ``field``, ``old_price``, ``new_price``."""
    each = F.array(*[F.struct(F.lit(v).alias("field"), F.col("old")[v].alias("old_price"), F.col("new")[v].alias("new_price")) for v in ("prompt", "completion")])
    flat = changes.where("diff_kind = 'changed'").select("model_id", "snap_no", F.inline(each))
    return flat.where(~F.col("old_price").eqNullSafe(F.col("new_price")))
