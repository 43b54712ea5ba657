"""Every core query runs, and gives the rows of its SQL."""

import datetime
import decimal

import duckdb
import pytest

from gleanery.plans import catalog

TABLES = "region nation orders lineitem events documents deals rss_items hn_hits catalog_snapshots html_segments feed_sources".split()


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, tables, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if name in catalog.ORACLES:
        cur = tables.execute(catalog.ORACLES[name])
        held = [c[0] for c in cur.description]
        assert sorted(held) == names
        assert sorted(repr([plain(r[held.index(c)]) for c in names]) for r in cur.fetchall()) == rows


#: Names that operators use within; rows that are null in every column count for nothing.
CLASHING = "pk cls look raw task capacity state h cell led first w n p id2 folded rec restored chain snap part kept seen source_".split()


def test_nulls_and_clashing_columns(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    for t in TABLES:
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        nulls = spark.range(3).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        df.unionByName(nulls).withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns}).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("p4_found", "p6_found", "catalog_free_diff", "rss_items", "html_segments", "detail_enrich", "snapshot_diff", "score_verdicts", "offer_scan", "near_dup_fold"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() >= catalog.QUERIES[name](spark, sf).count(), name


def test_empty_tables(spark, sf, tmp_path):
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("p4_found", "p4_repriced", "p6_found", "catalog_free_diff", "html_row_date", "search_results", "live_offers", "source_health", "marked_pushed"):
        catalog.QUERIES[name](spark, str(tmp_path)).collect()


def test_all_names_have_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_the_rest_works_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    try:
        import gleanery.llm  # noqa: F401
    except ModuleNotFoundError:
        return
    monkeypatch.setitem(sys.modules, "zstandard", None)
    for m in [m for m in sys.modules if m.startswith("gleanery.llm")]:
        monkeypatch.delitem(sys.modules, m)
    with pytest.raises(ImportError):  # a library that is missing is not taken for an absent part
        importlib.reload(__spark_entry__)
