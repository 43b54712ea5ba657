"""Mixed timestamp formats and zones, normalised through a dictionary of distinct values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gleanery.functions.instants import utc_ms
from gleanery.session import keep, read_or_empty


@F.pandas_udf(LongType())
def _parse(raw: pd.Series, zone: pd.Series) -> pd.Series:
    return pd.Series([utc_ms(r, z) for r, z in zip(raw, zone)], dtype="Int64")


def build_dictionary(rows: DataFrame, path: str | None = None) -> DataFrame:
    """One row ``raw``, ``tz_name``, ``utc_ms`` per distinct pair of ``rows``, each parsed once.

    With ``path`` the dictionary is a table that persists: only pairs it does not hold yet are
    parsed and appended, so a later batch costs its new values alone. Without one it is written to
    the shared folder for this run. ``utc_ms`` is null where the value states no time, so that such
    values aren't parsed again either. Blank and null values never enter.
    """
    spark = rows.sparkSession
    wanted = rows.select("raw", F.coalesce("tz_name", F.lit("UTC")).alias("tz_name")).where(F.trim("raw") != "").distinct()
    if path is None:
        return keep(wanted.withColumn("utc_ms", _parse("raw", "tz_name")))
    schema = "raw string, tz_name string, utc_ms long"
    known = read_or_empty(spark, path, schema)
    wanted = wanted.join(known.select("raw", "tz_name"), ["raw", "tz_name"], "left_anti")
    keep(wanted.withColumn("utc_ms", _parse("raw", "tz_name"))).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def normalise_instants(rows: DataFrame, path: str | None = None) -> DataFrame:
    """``rows`` with ``utc_ms`` for their ``raw`` time on the clock of ``tz_name`` (UTC if null).

    ``utc_ms`` is null where the value states no time, be it null, blank, zero or a word. Repeated
    rows stay repeated; other columns stay as they are.
    """
    rows = rows.drop("utc_ms").withColumn("tz_name", F.coalesce("tz_name", F.lit("UTC")))
    told = build_dictionary(rows, path).where(F.col("utc_ms").isNotNull())
    return rows.join(told, ["raw", "tz_name"], "left")


def publication_instants(rss: DataFrame, hits: DataFrame, catalogue: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """Every stated publication time of the feeds, the hits and the catalogue, as ``rec``, ``rec_id``, ``utc_ms``.

    Sources are matched regardless of case and blanks around; one that the dimension does not
    list is on UTC. With ``path`` the dictionary of values persists there.
    """
    name = F.lower(F.trim("source")).alias("_source")
    zones = sources.select(F.lower(F.trim("name")).alias("_source"), "tz_name").dropDuplicates(["_source"])
    feed = rss.select(
        F.col("item_id").alias("rec_id"),
        name,
        F.inline(
            F.array(
                F.struct(F.lit("rss_pub_date").alias("rec"), F.col("pub_date").alias("raw")),
                F.struct(F.lit("rss_dc_date").alias("rec"), F.col("dc_date").alias("raw")),
            )
        ),
    )
    hn = hits.select(F.col("hit_id").alias("rec_id"), name, F.lit("hn").alias("rec"), F.col("created_at").alias("raw"))
    stated = F.trim("raw") != ""
    # the source dimension has a fixed number of rows
    dated = feed.unionByName(hn).where(stated).join(F.broadcast(zones), "_source", "left").drop("_source")
    models = catalogue.select(
        F.col("row_id").alias("rec_id"), F.lit("catalog").alias("rec"), F.col("created").cast("string").alias("raw"), F.lit("UTC").alias("tz_name")
    ).where(stated)
    known = normalise_instants(dated.unionByName(models), path)
    return known.where(F.col("utc_ms").isNotNull()).select("rec", "rec_id", "utc_ms").distinct()
