"""The log of findings as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.schema import DEAL


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Findings of a log of JSON lines; torn and malformed lines and rows without fingerprint are left out, year 1 is no time."""
    rows = spark.read.schema(DEAL).option("mode", "DROPMALFORMED").json(path).where(F.trim("fingerprint") != "")
    return rows.withColumns({c: F.when(F.year(c) > 1, F.col(c)) for c in ("published_at", "discovered_at")})


def write_log(rows: DataFrame, path: str) -> None:
    """Appends findings to a log of JSON lines."""
    rows.write.mode("append").json(path)
