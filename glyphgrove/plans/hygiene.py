"""Queries on the corpus' own files and records: small files, damaged lines, orphan references."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.operators import orphans, reject_rows, small_files
from glyphgrove.plans import hygiene_sql
from glyphgrove.runtime import checkpoint_dir, durable, table

#: Fixed value: the folder where relative paths of ``doc_list`` start.
CORPUS_ROOT = "/data/tangent"


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_files.plan_packs(small_files.inventory(table(spark, sf_dir, "doc_list"), CORPUS_ROOT))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have a place in a pack; the filter keeps the optimiser from leaving the places out."""
    return _packs(spark, sf_dir).filter("planned_offset >= 0").select(F.col("file_id").alias("doc_id"))


def p1_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(spark, sf_dir).groupBy("folder", "pack").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def p1_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every review with a text becomes a file, in one folder per item; crowded folders are packed and read back.

    ``folder, n_files, n_bytes, n_packs, n_sound`` of each packed folder; ``n_sound`` packs have the right length, no gap
    and no segment with a wrong checksum.
    """
    base = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    item = F.sha2(F.coalesce("item", F.lit("")), 256)
    docs = table(spark, sf_dir, "documents").select(item.alias("folder"), F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("name"), "text")
    listing = durable(small_files.write_members(docs, f"{base}/in", folder="folder", name="name", content="text"))
    root = re.sub(r"\Afile:/+", "/", f"{base}/in")
    number = F.regexp_extract("path", r"(\d+)\.html\z", 1).cast("bigint")
    plan = small_files.plan_packs(small_files.inventory(listing.select(number.alias("doc_id"), F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "n_bytes"), root))
    out = plan.withColumn("pack", F.expr(f"substr(pack, {len(root) + 1})"))
    manifest = durable(small_files.write_packs(out, f"{base}/out"))
    checked = small_files.verify_packs(manifest, f"{base}/out")
    sound = F.col("length_ok") & F.col("gapless") & (F.col("n_bad") == 0)
    return checked.groupBy(F.substring_index(F.substring("pack", 2, 1 << 30), "/", 1).alias("folder")).agg(
        F.sum("n_files").alias("n_files"), F.sum("bytes").alias("n_bytes"), F.count("*").alias("n_packs"), F.sum(sound.cast("bigint")).alias("n_sound")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_rows.rejected(table(spark, sf_dir, "result_lines"))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_rows.strict_load(table(spark, sf_dir, "result_lines"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("runs", "formulas", "qrels", "posts", "visuals")}
    ref = orphans.Reference
    posts = [ref("runs", t["runs"], "post_id", "retrieved_at"), ref("formulas", t["formulas"], "post_id", "added_at")]
    visuals = [ref("formulas", t["formulas"], "visual_id", "added_at"), ref("qrels", t["qrels"], "visual_id", "judged_at")]
    return orphans.orphan_references(posts, t["posts"], "post_id").unionByName(orphans.orphan_references(visuals, t["visuals"], "visual_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).drop("n_references")


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _orphans(spark, sf_dir)
        .groupBy("table_name", "field", "period", "reason")
        .agg(F.count("*").alias("n_ids"), F.sum("n_references").alias("n_references"))
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_packs, p1_written, p3_found, p3_loaded, p6_found, p6_counts)}

_ORPHANS = """
WITH refs AS (
  SELECT 'runs' AS table_name, 'post_id' AS field, post_id AS missing_id, retrieved_at AS seen, 'posts' AS parent FROM runs
  UNION ALL SELECT 'formulas', 'post_id', post_id, added_at, 'posts' FROM formulas
  UNION ALL SELECT 'formulas', 'visual_id', visual_id, added_at, 'visuals' FROM formulas
  UNION ALL SELECT 'qrels', 'visual_id', visual_id, judged_at, 'visuals' FROM qrels
), parents AS (
  SELECT 'posts' AS parent, post_id AS id, loaded_at, deleted_at FROM posts
  UNION ALL SELECT 'visuals', visual_id, loaded_at, deleted_at FROM visuals
), judged AS (
  SELECT table_name, field, missing_id, seen,
    count(p.id) AS n,
    count(*) FILTER (p.loaded_at <= seen AND (p.deleted_at IS NULL OR seen < p.deleted_at)) AS n_there,
    count(*) FILTER (p.loaded_at <= seen) AS n_before
  FROM (SELECT row_number() OVER () AS k, * FROM refs WHERE missing_id >= 0) r
  LEFT JOIN parents p ON p.parent = r.parent AND p.id = r.missing_id
  GROUP BY k, table_name, field, missing_id, seen
), orphans AS (
  SELECT table_name, field, missing_id, strftime(seen, '%Y-%m') AS period,
    CASE WHEN n = 0 THEN 'missing' WHEN n_before = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE n_there = 0 AND (n = 0 OR seen IS NOT NULL)
)
"""

#: Sizes as :func:`p1_written` makes them: without a byte order mark unless first, with a line end, below 8,192 bytes.
_WRITTEN = """
WITH f AS (
  SELECT doc_id, sha256(coalesce(item, '')) AS folder, text, CAST(strlen(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL
), small AS (
  SELECT *, row_number() OVER (PARTITION BY folder ORDER BY CAST(doc_id AS VARCHAR) || '.html') AS r, count(*) OVER (PARTITION BY folder) AS m
  FROM f WHERE n > 0 AND n < 8192
)
SELECT folder, CAST(count(*) AS BIGINT) AS n_files,
  CAST(sum(n + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END - CASE WHEN r > 1 AND starts_with(text, chr(65279)) THEN 3 ELSE 0 END) AS BIGINT) AS n_bytes,
  CAST(1 AS BIGINT) AS n_packs, CAST(1 AS BIGINT) AS n_sound
FROM small WHERE m >= 20 GROUP BY folder"""

_FILES = hygiene_sql.FILES.replace("ROOT", CORPUS_ROOT)

SQL = {
    "p1_found": _FILES + "SELECT doc_id FROM crowded WHERE m >= 20",
    "p1_packs": _FILES + "SELECT folder, folder || '/pack-00000-00000' AS pack, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_bytes FROM crowded WHERE m >= 20 GROUP BY folder",
    "p1_written": _WRITTEN,
    "p3_found": hygiene_sql.LINES + "SELECT line_id, CASE WHEN NOT quotes THEN 'quoting' WHEN NOT columns THEN 'columns' ELSE 'value' END AS reason FROM verdict WHERE NOT (quotes AND columns AND good)",
    "p3_loaded": hygiene_sql.LINES + "SELECT line_id, tag, doc, pos, expression, positions, scores FROM loaded",
    "p6_found": _ORPHANS + "SELECT DISTINCT table_name, field, missing_id, period, reason FROM orphans",
    "p6_counts": _ORPHANS
    + """SELECT table_name, field, period, reason, count(DISTINCT missing_id) AS n_ids, CAST(count(*) AS BIGINT) AS n_references
FROM orphans GROUP BY table_name, field, period, reason""",
}
