"""Queries of the general data-preparation operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.snapshot_diff import catalogue_changes, repriced
from gleanery.operators.time_dictionary import publication_instants
from gleanery.session import keep, shared_dir, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_changes(table(spark, sf_dir, "catalog_snapshots")).select("model_id", "snap_no", "diff_kind")


def p4_repriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repriced(catalogue_changes(table(spark, sf_dir, "catalog_snapshots")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publication_instants(*(table(spark, sf_dir, t) for t in ("rss_items", "hn_hits", "catalog_snapshots", "feed_sources")))


def p6_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p6_found`` from two halves of the tables, through a dictionary that persists: the second half parses only what is new."""
    names = {"rss_items": "item_id", "hn_hits": "hit_id", "catalog_snapshots": "row_id"}
    sources, path = table(spark, sf_dir, "feed_sources"), f"{shared_dir(spark)}/times-{uuid.uuid4().hex}"
    # kept apart: two reads of one growing path in one plan would count as the same
    halves = [keep(publication_instants(*(table(spark, sf_dir, t).where(F.col(c) % 2 == n) for t, c in names.items()), sources, path)) for n in (0, 1)]
    return halves[0].unionByName(halves[1])


QUERIES = {"p4_found": p4_found, "p4_repriced": p4_repriced, "p6_found": p6_found, "p6_incremental": p6_incremental}

_SNAPSHOTS = """
WITH last AS (SELECT snap_no, max(delivery_no) AS d FROM catalog_snapshots GROUP BY snap_no),
rows_ AS (
  SELECT lower(trim(c.id)) AS model_id, c.snap_no, c.row_id,
         try_cast(nullif(trim(c.pricing.prompt), '') AS double) AS p, try_cast(nullif(trim(c.pricing.completion), '') AS double) AS q
  FROM catalog_snapshots c JOIN last l ON c.snap_no = l.snap_no AND c.delivery_no = l.d WHERE trim(c.id) <> ''),
one AS (SELECT model_id, snap_no, arg_max(struct_pack(p := p, q := q), row_id) AS v FROM rows_ GROUP BY ALL)"""
ORACLES = {
    "p4_repriced": _SNAPSHOTS + """
SELECT model_id, snap_no, field, old_price, new_price FROM (
  SELECT n.model_id, n.snap_no, unnest([struct_pack(field := 'prompt', old_price := o.v.p, new_price := n.v.p), struct_pack(field := 'completion', old_price := o.v.q, new_price := n.v.q)], recursive := true)
  FROM one n JOIN one o ON n.model_id = o.model_id AND n.snap_no = o.snap_no + 1) WHERE old_price IS DISTINCT FROM new_price""",
    "p4_found": _SNAPSHOTS + """
SELECT coalesce(n.model_id, o.model_id) AS model_id, coalesce(n.snap_no, o.snap_no + 1)::int AS snap_no,
       CASE WHEN o.model_id IS NULL THEN 'added' WHEN n.model_id IS NULL THEN 'removed' ELSE 'changed' END AS diff_kind
FROM (SELECT * FROM one WHERE snap_no - 1 IN (SELECT snap_no FROM last)) n
FULL JOIN (SELECT * FROM one WHERE snap_no + 1 IN (SELECT snap_no FROM last)) o ON n.model_id = o.model_id AND n.snap_no = o.snap_no + 1
WHERE o.model_id IS NULL OR n.model_id IS NULL OR n.v.p IS DISTINCT FROM o.v.p OR n.v.q IS DISTINCT FROM o.v.q""",
}
