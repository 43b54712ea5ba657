"""Small keyed state that survives between rounds: a table replaced as a whole, by version."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.history import merge_state
from gleanery.schema import STATE
from gleanery.session import read_text, write_text


class StateTable:
    """Keys with JSON values on any file system that Spark writes to.

    A write makes a new version and then moves the pointer, so a reader never sees half of one. One writer at a time: rounds are serial.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.pointer = spark, path, f"{path}/CURRENT"

    def read(self) -> DataFrame:
        """All rows; a table that was never written is empty, one that cannot be read is an error."""
        version = read_text(self.spark, self.pointer)
        if version is None:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.path}/{version.strip()}")

    def put(self, changed: DataFrame) -> None:
        """Changed keys win over stored ones; retired keys are dropped."""
        version = f"v-{uuid.uuid4().hex}"
        merge_state(self.read(), changed.select("key", "value", F.col("updated_at").cast("timestamp"))).write.parquet(f"{self.path}/{version}")
        write_text(self.spark, self.pointer, version)

    def get(self, key: str) -> str | None:
        """The value of one key."""
        row = self.read().where(F.col("key") == key).select("value").first()
        return row.value if row else None

    def set(self, values: dict[str, str], now: str | None = None) -> None:
        """A few keys at once."""
        rows = [(k, v) for k, v in values.items()]
        self.put(self.spark.createDataFrame(rows, "key string, value string").withColumn("updated_at", F.lit(now).cast("timestamp") if now else F.current_timestamp()))
