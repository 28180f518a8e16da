"""Queries of the training-data operators over the driver's tables, and the SQL twins of some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.llm import components, hidden_duplicates, leakage, personal, tokens, top_items
from glyphgrove.runtime import table

TOP_N = 10


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.col("score").between(0.0, 1.0) & (F.col("post_id") >= 0)
    return top_items.top_items(table(spark, sf_dir, "runs"), ["query_id", "run"], "post_id", "score", TOP_N, valid=valid)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.group_by_shared_values(table(spark, sf_dir, "candidates"), "cand_id", "query_id", ["slt_str", "opt_str"])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "formula_records")


#: The two columns hold each other's values in some records, so they share one field name.
RECORD_FIELDS = {"formula": "value", "visual_id": "value"}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_duplicates.find_copies(_records(spark, sf_dir), "rec_id", RECORD_FIELDS)


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_duplicates.collapse(_records(spark, sf_dir), "rec_id", RECORD_FIELDS)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


#: Consecutive words of an item that make a leak, and rare terms and words apart of a proximity match.
LEAK_WORDS, NEAR_TERMS, NEAR_WORDS = 10, 6, 60


def _leaks(spark: SparkSession, sf_dir: str) -> leakage.LeakIndex:
    return leakage.LeakIndex(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).phrases(LEAK_WORDS).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).near(NEAR_TERMS, NEAR_WORDS).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal(table(spark, sf_dir, "documents")).select("doc_id", "kind", "found").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p5_found, p5_counts, p7_ids, p8_found, p8_near, p9_found, p9_redacted)}

_NORMAL = "replace(lower(upper(regexp_replace(coalesce({}, ''), '[\\x{{0009}}-\\x{{000D}}\\x{{001C}}-\\x{{0020}}\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}.,;:!?''\"$`]', '', 'g'))), 'ß', 'ss')"
_COPIES = f"""
WITH n AS (
  SELECT rec_id, {_NORMAL.format("formula")} AS a, {_NORMAL.format("visual_id")} AS b FROM formula_records
), g AS (
  SELECT rec_id, min(rec_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS kept_id FROM n
)
"""

SQL = {
    "p2_found": f"""
WITH best AS (
  SELECT query_id, run, post_id, max(score) AS score FROM runs
  WHERE score BETWEEN 0 AND 1 AND post_id >= 0 GROUP BY query_id, run, post_id
)
SELECT query_id, run, post_id, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, run ORDER BY score DESC, post_id) AS place FROM best
) WHERE place <= {TOP_N}""",
    "p5_found": _COPIES + "SELECT kept_id, rec_id FROM g WHERE rec_id <> kept_id",
    "p5_counts": _COPIES + "SELECT kept_id, CAST(count(*) AS BIGINT) AS n_copies FROM g GROUP BY kept_id",
    "p4_found": """
WITH RECURSIVE c AS (
  SELECT cand_id, query_id, CASE WHEN slt_str NOT IN ('', 'None') THEN slt_str END AS s,
    CASE WHEN opt_str NOT IN ('', 'None') THEN opt_str END AS o
  FROM candidates WHERE query_id IS NOT NULL
), e AS (
  SELECT cand_id AS a, min(cand_id) OVER (PARTITION BY query_id, s) AS b FROM c WHERE s IS NOT NULL
  UNION SELECT cand_id, min(cand_id) OVER (PARTITION BY query_id, o) FROM c WHERE o IS NOT NULL
), both_ways AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
), label AS (
  SELECT a AS cand_id, min(b) AS group_id FROM reach GROUP BY a
)
SELECT group_id, cand_id FROM label QUALIFY count(*) OVER (PARTITION BY group_id) > 1""",
}
