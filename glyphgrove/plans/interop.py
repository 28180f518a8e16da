"""Record files, run statistics and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.operators import reject_rows
from glyphgrove.plans import hygiene_sql
from glyphgrove.runtime import checkpoint_dir, table
from glyphgrove.sources import records
from glyphgrove.streaming import search

#: Lines of a split where the table of lines stands for split files.
SPLIT_LINES = 256


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``result_lines`` as :func:`glyphgrove.sources.records.read_lines` gives files."""
    t = table(spark, sf_dir, "result_lines")
    parts = F.split(F.regexp_replace("line", r"\r\z", ""), "\t")
    return t.select(F.col("file_name").alias("file"), F.floor(F.col("line_no") / SPLIT_LINES).alias("split"), F.col("line_no"), parts[0].alias("tag"), F.slice(parts, 2, 1 << 20).alias("fields"), "line_id")


def record_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that each result line belongs to."""
    lines = records.with_context(_lines(spark, sf_dir), "Q", "query_id")
    return lines.filter("tag = 'R'").select("line_id", "query_id")


def record_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed results with their query: strict load joined to the context."""
    context = records.with_context(_lines(spark, sf_dir), "Q", "query_id").select("line_id", "query_id")
    loaded = reject_rows.strict_load(table(spark, sf_dir, "result_lines")).filter("tag = 'R'")
    return loaded.join(context, "line_id").select("line_id", "query_id", "doc", "pos", "expression", "scores")


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run statistics: records and documents by kind of line."""
    return _lines(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("file").alias("n_files"))


def query_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each query from the ``I`` lines, e.g. its times; values that are no numbers are null."""
    lines = records.with_context(_lines(spark, sf_dir), "Q", "query_id").filter("tag = 'I'")
    c = lines.select("file", "query_id", F.get("fields", F.lit(0)).alias("name"), F.get("fields", F.lit(1)).try_cast("double").alias("value"))
    return c.groupBy("query_id", "name").agg(F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("most"))


def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all files merged: numbers of records and documents add up over files, greatest line numbers don't."""
    per_file = _lines(spark, sf_dir).groupBy("file", "tag").agg(F.count("*").alias("n"), F.max("line_no").alias("last"))
    return per_file.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("n_files"), F.max("last").alias("last"))


def slowest_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten queries with the longest time between retrieval and arrival of their results."""
    r = table(spark, sf_dir, "runs").filter("arrived_at IS NOT NULL AND retrieved_at IS NOT NULL")
    delay = F.timestamp_diff("SECOND", "retrieved_at", "arrived_at")
    per = r.groupBy("query_id").agg(F.max(delay).alias("seconds"), F.count("*").alias("n"))
    return per.orderBy(F.desc("seconds"), "query_id").limit(10)


def query_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, posts and results of each query."""
    return table(spark, sf_dir, "runs").groupBy("query_id").agg(F.count("*").alias("n_results"), F.count_distinct("post_id").alias("n_posts"), F.count_distinct("run").alias("n_runs"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregate, over the whole table as one batch."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return search.event_windows(e).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same aggregate as a stream over the table's files, run until they are read."""
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    e = source.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    base = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}"
    out = search.event_windows(e)
    spark.createDataFrame([], out.schema).write.parquet(f"{base}/windows")
    # in this mode a batch holds all windows so far, so that a repeated batch changes nothing
    q = out.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/windows"))
    q.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


QUERIES = {f.__name__: f for f in (record_context, record_queries, record_counts, query_times, merged_statistics, slowest_queries, query_statistics, event_windows, event_stream)}

_WINDOWS = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"""
_CONTEXT = """
WITH c AS (
  SELECT line_id, line, last_value(CASE WHEN line LIKE 'Q' || chr(9) || '%' THEN split_part(rtrim(line, chr(13)), chr(9), 2) END IGNORE NULLS)
    OVER (PARTITION BY file_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS query_id FROM result_lines
)"""

SQL = {
    "record_queries": hygiene_sql.LINES + _CONTEXT.replace("\nWITH", ",", 1) + " SELECT l.line_id, query_id, doc, pos, expression, scores FROM loaded l JOIN c USING (line_id) WHERE tag = 'R'",
    "record_context": _CONTEXT + " SELECT line_id, query_id FROM c WHERE split_part(line, chr(9), 1) = 'R'",
    "record_counts": "SELECT split_part(rtrim(line, chr(13)), chr(9), 1) AS tag, count(*) AS n, count(DISTINCT file_name) AS n_files FROM result_lines GROUP BY 1",
    "query_times": _CONTEXT
    + """, i AS (SELECT query_id, split_part(rtrim(line, chr(13)), chr(9), 2) AS name, TRY_CAST(trim(split_part(rtrim(line, chr(13)), chr(9), 3)) AS DOUBLE) AS value FROM c WHERE split_part(rtrim(line, chr(13)), chr(9), 1) = 'I')
SELECT query_id, name, count(value) AS n, round(sum(value), 6) AS total, max(value) AS most FROM i GROUP BY ALL""",
    "merged_statistics": "SELECT split_part(rtrim(line, chr(13)), chr(9), 1) AS tag, count(*) AS n, count(DISTINCT coalesce(file_name, '-')) AS n_files, max(line_no) AS last FROM result_lines GROUP BY 1",
    "slowest_queries": """SELECT query_id, max(date_sub('second', retrieved_at, arrived_at)) AS seconds, count(*) AS n FROM runs WHERE arrived_at IS NOT NULL AND retrieved_at IS NOT NULL
GROUP BY query_id ORDER BY seconds DESC, query_id LIMIT 10""",
    "query_statistics": "SELECT query_id, count(*) AS n_results, count(DISTINCT post_id) AS n_posts, count(DISTINCT run) AS n_runs FROM runs GROUP BY query_id",
    "event_windows": _WINDOWS,
    "event_stream": _WINDOWS,
}
