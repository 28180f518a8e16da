"""Search and indexing over streams.

A stream of queries meets a stored index batch by batch; a stream of documents appends distinct expressions to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphgrove.operators import retrieve, tuples
from glyphgrove.operators.index import Index, packed_id


def answer_queries(stream: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], k: int = 3, *, wildcards: bool = False, checkpoint: str, **trigger) -> StreamingQuery:
    """Search each micro-batch of ``query_id, expr`` and hand its hits to ``sink(hits, batch)``.

    The index is static; a batch's queries are broadcast below a checked size. A sink that overwrites by batch
    number makes results exactly-once.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        q = retrieve.Queries(df, window=index.window, eob=index.eob)
        sink(retrieve.expand_hits(index, retrieve.search(index, q, k, wildcards=wildcards)), number)
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_postings(stream: DataFrame, path: str, *, window: int = tuples.WINDOW, eob: str = "small", checkpoint: str, **trigger) -> StreamingQuery:
    """Expand a stream of ``doc_id, position, expr`` into postings files as it comes.

    Rows have no event time, so expressions are made distinct within a micro-batch only; :func:`read_appended` gives each
    expression one id across batches. A repeated batch overwrites its own files.
    """

    def batch(df: DataFrame, number: int) -> None:
        ident = packed_id(F.col("doc_id").cast("bigint"), F.col("position").cast("bigint"))
        first = df.filter("expr IS NOT NULL").groupBy("expr").agg(F.min(ident).alias("expr_id"))
        counted = first.select("expr_id", "expr", tuples.tuple_counts(F.col("expr"), window, eob).alias("tuples")).filter("tuples IS NOT NULL")
        counted.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_appended(spark, path: str, *, window: int = tuples.WINDOW, eob: str = "small") -> tuple[DataFrame, DataFrame]:
    """``expressions`` and ``postings`` of the files of :func:`append_postings`; the smallest id of an expression holds."""
    rows = spark.read.parquet(path)
    first = rows.groupBy("expr").agg(F.min("expr_id").alias("expr_id"), F.min_by("tuples", "expr_id").alias("tuples"))
    first = first.withColumn("tc", F.aggregate("tuples", F.lit(0).cast("bigint"), lambda a, t: a + t["cnt"]))
    postings = first.select("expr_id", "tc", F.explode("tuples").alias("t")).select("t.from", "t.to", "t.rel", "expr_id", "t.cnt", "tc")
    return first.select("expr_id", "expr", "tc"), postings


def event_windows(stream: DataFrame, *, at: str = "ts", key: str = "event_type", value: str = "value", late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts and sums of a value per key and window of event time; rows later than ``late`` behind are dropped."""
    w = F.window(at, every)
    return stream.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")
