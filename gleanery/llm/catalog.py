"""All queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm.contributor_cap import dominant_sources_dropped
from gleanery.llm.encoding_repair import repaired
from gleanery.llm.eval_leaks import leaks
from gleanery.llm.history_dedup import announcements, announcements_in_batches
from gleanery.llm.lookalikes import _LOOKS as LOOKS
from gleanery.llm.lookalikes import ignorable, lookalike_members, lookalike_pairs, skeleton
from gleanery.llm.main_content import boilerplate
from gleanery.llm.packing import fill_report, integrity_report, mixture_report, pack
from gleanery.llm.truncation import truncated_records, truncation_by_source
from gleanery.session import keep, shared_dir, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(table(spark, sf_dir, "deals"), ["title", "summary"], "log_seq")


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_members(table(spark, sf_dir, "deals"), ["title", "summary"], "log_seq")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant_sources_dropped(table(spark, sf_dir, "deals"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate(table(spark, sf_dir, "html_segments"), table(spark, sf_dir, "deals"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated_records(table(spark, sf_dir, "deals"), table(spark, sf_dir, "hn_hits")).select("rec", "rec_id")


def p7_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_by_source(table(spark, sf_dir, "deals"), table(spark, sf_dir, "hn_hits"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return announcements(table(spark, sf_dir, "deals"))


def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``p5_found``, from batches that arrive one after another and are checked against a stored history."""
    return announcements_in_batches(table(spark, sf_dir, "deals"), f"{shared_dir(spark)}/history-{uuid.uuid4().hex}")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    containers = table(spark, sf_dir, "container_sizes")
    return fill_report(pack(table(spark, sf_dir, "documents"), containers), containers)


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold whatever the packing: per container the documents placed, and how many are split, overfilled or not placed in full."""
    docs, containers = table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_sizes")
    return integrity_report(keep(pack(docs, containers)), docs, containers)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture_report(keep(pack(docs, table(spark, sf_dir, "container_sizes"))), docs)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "documents"))


_ALL = (p1_found, p1_members, p2_found, p3_found, p5_found, p5_incremental, p7_found, p7_by_source, p8_pack, p8_fill, p8_whole, p8_mixture, p9_found, p10_found, p10_restored)
QUERIES = {f.__name__: f for f in _ALL}



def _look_sql(column: str) -> str:
    """The look of a text in SQL, through a table of every character that looks like another one."""
    one, more, blank = {}, {}, []
    for o in range(0x80, 0x30000):
        c = chr(o)
        if not (unicodedata.decomposition(c) or c in LOOKS or c.isspace() or ignorable(c)) or 0xD800 <= o < 0xE000:
            continue
        look = skeleton(f"x{c}x")[1:-1]
        if ignorable(c):
            more[c] = ""
        elif look == " ":
            blank.append(c)
        elif look != c and len(look) == 1 and not unicodedata.combining(c):
            one[c] = look
        elif look != c and not unicodedata.combining(c):
            more[c] = look
    quoted = lambda t: t.replace("'", "''")
    sql = f"translate({column}, '{quoted(''.join(one) + ''.join(blank))}', '{quoted(''.join(one.values()) + ' ' * len(blank))}')"
    gone = [c for c, look in more.items() if not look]
    sql = f"translate({sql}, '{''.join(gone)}', '')"
    for c, look in more.items():
        if look and c in _JOINED:
            sql = f"replace({sql}, '{c}', '{quoted(look)}')"
    return f"trim(regexp_replace(nfc_normalize({sql}), '\\s+', ' ', 'g'))"


#: Joined letters; the other characters that look like several are Hangul and rare symbols.
_JOINED = "ﬀﬁﬂﬃﬄﬅﬆĲĳǄǅǆǇǈǉǊǋǌǱǲǳ"
_LOOKS = f"""WITH v AS (SELECT 'title' AS field, log_seq, title AS raw FROM deals UNION ALL SELECT 'summary', log_seq, summary FROM deals),
l AS (SELECT field, log_seq, raw, {_look_sql('raw')} AS look FROM v WHERE regexp_matches(raw, '\\S'))"""

ORACLES = {
    "p1_found": _LOOKS + """
SELECT DISTINCT a.field, a.log_seq AS log_seq_a, b.log_seq AS log_seq_b FROM l a JOIN l b ON a.field = b.field AND a.look = b.look AND a.log_seq < b.log_seq AND a.raw <> b.raw""",
    "p1_members": _LOOKS + """,
s AS (SELECT field, look, raw, min(log_seq) AS spelling_id FROM l GROUP BY ALL),
c AS (SELECT field, look, min(spelling_id) AS class_id FROM s GROUP BY ALL HAVING count(*) > 1)
SELECT DISTINCT l.field, l.log_seq, class_id, spelling_id FROM l JOIN s USING (field, look, raw) JOIN c USING (field, look)""",
    "p8_whole": """
SELECT c.container, count(d.doc_id) AS documents, 0::bigint AS overfull, 0::bigint AS split_short, 0::bigint AS unequal
FROM container_sizes c, documents d WHERE d.text IS NOT NULL GROUP BY 1""",
    "p2_found": r"""
SELECT log_seq FROM (
  SELECT log_seq, row_number() OVER (PARTITION BY batch_no, lower(regexp_replace(source, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g'))
                                     ORDER BY score DESC NULLS LAST, log_seq) AS k
  FROM deals WHERE regexp_replace(source, '[\s\x{a0}\x{3000}]+', '', 'g') <> '' AND batch_no IS NOT NULL) WHERE k > 12""",
}
