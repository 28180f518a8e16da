"""Line-tagged record files: reading with context, and writing.

Lines are ``tag TAB fields``. A record belongs to the last query (``Q``) or document (``D``) line before it, wherever
the file was split: each split fills forward alone, and splits hand on their last value, one row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, split, line_no, tag, fields``; ``line_no`` grows within a file, ``fields`` are those after the tag."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    parts = F.split("value", "\t")
    return raw.filter("value <> ''").select("file", "split", "line_no", parts[0].alias("tag"), F.slice(parts, 2, 1 << 20).alias("fields"))


def with_context(lines: DataFrame, tag: str, name: str) -> DataFrame:
    """Adds ``name``: first field of the last line with ``tag`` at or before a line of the same file; null before any."""
    own = F.when(F.col("tag") == tag, F.get("fields", F.lit(0)))
    part = Window.partitionBy("file", "split").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("_own", F.last(own, ignorenulls=True).over(part))
    ends = lines.groupBy("file", "split").agg(F.max_by(own, F.when(own.isNotNull(), F.col("line_no"))).alias("_end"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    return filled.join(carry, ["file", "split"], "left").withColumn(name, F.coalesce("_own", "_carry")).drop("_own", "_carry")


def positions(text: Column) -> Column:
    """Array of integers of ``[1, 2]``."""
    return F.transform(F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, position, expr`` of index files; a repeated document id is read once, with its first file and line."""
    lines = with_context(read_lines(spark, path), "D", "doc_id")
    e = lines.filter((F.col("tag") == "E") & (F.size("fields") == 2)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(positions(F.get("fields", F.lit(1)))).alias("position"), F.get("fields", F.lit(0)).alias("expr"))
    return e.filter("doc_id IS NOT NULL AND position IS NOT NULL").dropDuplicates(["doc_id", "position"])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, doc_id, position, expr, scores, line_no`` of result files; a single score is an array of one."""
    lines = with_context(read_lines(spark, path), "Q", "query_id")
    f = F.col("fields")
    r = lines.filter((F.col("tag") == "R") & (F.size("fields") == 4))
    scores = F.transform(F.split(F.regexp_replace(F.get(f, F.lit(3)), r"[\[\]\s]", ""), ","), lambda x: x.try_cast("double"))
    return r.select("query_id", F.get(f, F.lit(0)).cast("bigint").alias("doc_id"), F.get(f, F.lit(1)).cast("int").alias("position"), F.get(f, F.lit(2)).alias("expr"), scores.alias("scores"), "line_no")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, expr_no, expr, constraint_expr`` of query or result files: each ``E`` with the ``C`` of its query."""
    lines = with_context(read_lines(spark, path), "Q", "query_id")
    e = lines.filter("tag = 'E'").select("query_id", F.get("fields", F.lit(0)).alias("expr"), "line_no")
    e = e.withColumn("expr_no", F.row_number().over(Window.partitionBy("query_id").orderBy("line_no")) - 1).drop("line_no")
    c = lines.filter("tag = 'C'").groupBy("query_id").agg(F.min_by(F.get("fields", F.lit(0)), "line_no").alias("constraint_expr"))
    return e.join(c, "query_id", "left")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, term`` of ``P`` lines."""
    return with_context(read_lines(spark, path), "Q", "query_id").filter("tag = 'P'").select("query_id", F.get("fields", F.lit(0)).alias("term"))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, name, value`` of ``I`` lines."""
    lines = with_context(read_lines(spark, path), "Q", "query_id").filter("tag = 'I'")
    return lines.select("query_id", F.get("fields", F.lit(0)).alias("name"), F.get("fields", F.lit(1)).try_cast("double").alias("value"))


def index_lines(grouped: DataFrame, *, window: int = 4, operator: bool = False) -> DataFrame:
    """``value``: lines of an index file from ``doc_id, expr, positions``; documents are whole, one after another.

    Every partition begins with the settings, so each output file is an index file of its own.
    """
    doc = F.concat_ws("\t", F.lit("D"), "doc_id")
    line = F.concat_ws("\t", F.lit("E"), "expr", F.concat(F.lit("["), F.array_join("positions", ", "), F.lit("]")))
    rows = grouped.repartition("doc_id").select("doc_id", "expr", doc.alias("head"), line.alias("body")).sortWithinPartitions("doc_id", "expr")

    def write(batches):
        import pandas as pd

        last, first = None, True
        for b in batches:
            out = []
            for d, h, t in zip(b["doc_id"], b["head"], b["body"], strict=True):
                if first:
                    out += [f"W\t{window}", f"O\t{int(operator)}"]
                    first = False
                if d != last:
                    out.append(h)
                    last = d
                out.append(t)
            yield pd.DataFrame({"value": out})

    return rows.mapInPandas(write, "value string")


def result_lines(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, value``: per query one text of its ``Q``, ``E``, ``R`` lines in rank order (at most k lines each)."""
    r = F.concat_ws("\t", F.lit("R"), "doc_id", "position", "expr", F.col("score").cast("string"))
    body = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "position", r.alias("t")))).alias("b"))
    head = F.concat(F.lit("Q\t"), F.col("query_id"), F.lit("\nE\t"), F.col("expr"), F.lit("\n"))
    return queries.join(body, "query_id", "left").select("query_id", F.concat(head, F.coalesce(F.array_join(F.transform("b", lambda x: x["t"]), "\n"), F.lit(""))).alias("value"))


def rewrite_window(lines: DataFrame, window: int) -> DataFrame:
    """Lines of an index or query file with another window."""
    return lines.withColumn("value", F.when(F.col("value").startswith("W\t"), F.lit(f"W\t{window}")).otherwise(F.col("value")))


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, item_id, rank, score, run`` of a run file with tabs or blanks."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(p) >= 6).select(F.get(p, F.lit(0)).alias("query_id"), F.get(p, F.lit(2)).alias("item_id"), F.get(p, F.lit(3)).try_cast("int").alias("rank"), F.get(p, F.lit(4)).try_cast("double").alias("score"), F.get(p, F.lit(5)).alias("run"))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, item_id, relevance`` of a judgment file."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(p) >= 4).select(F.get(p, F.lit(0)).alias("query_id"), F.get(p, F.lit(2)).alias("item_id"), F.get(p, F.lit(3)).try_cast("double").alias("relevance"))


def write_trec(run: DataFrame, path: str) -> None:
    """A run as text files, whole queries in rank order."""
    line = F.concat_ws("\t", "query_id", F.lit("1"), "item_id", "rank", F.col("score").cast("string"), "run")
    run.repartition("query_id").sortWithinPartitions("query_id", "rank").select(line.alias("value")).write.mode("overwrite").text(path)


def trec_to_results(run: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``query_id, doc_id, position, expr, score, rank`` of a run whose items are ``document:position``."""
    at = F.split("item_id", ":")
    keyed = run.select("query_id", F.get(at, F.lit(0)).cast("bigint").alias("doc_id"), F.get(at, F.lit(1)).cast("int").alias("position"), "score", "rank")
    return keyed.join(occurrences, ["doc_id", "position"]).select("query_id", "doc_id", "position", "expr", "score", "rank")


def judgments_to_results(judgments: DataFrame, occurrences: DataFrame) -> DataFrame:
    """As :func:`trec_to_results` for judgments: relevance is the score, ranks follow it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item_id")
    return trec_to_results(judgments.withColumn("rank", F.row_number().over(order)).withColumnRenamed("relevance", "score"), occurrences)


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, item_id, score`` of a combined run."""
    p = F.split("value", "\t")
    return spark.read.text(path).filter(F.size(p) >= 3).select(F.get(p, F.lit(0)).alias("query_id"), F.get(p, F.lit(1)).alias("item_id"), F.get(p, F.lit(2)).try_cast("double").alias("score"))


def read_text_results(spark: SparkSession, path: str, docs: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, doc_name, score`` of a text engine's ``M`` lines; names come from ``docs``, else null."""
    lines = with_context(read_lines(spark, path), "Q", "query_id").filter((F.col("tag") == "M") & (F.size("fields") == 2))
    m = lines.select("query_id", F.get("fields", F.lit(0)).try_cast("bigint").alias("doc_id"), F.get("fields", F.lit(1)).try_cast("double").alias("score"))
    named = m.withColumn("doc_name", F.lit(None).cast("string")) if docs is None else m.join(docs.select("doc_id", "doc_name"), "doc_id", "left")
    return named.select("query_id", "doc_id", "doc_name", "score")


def query_lines(queries: DataFrame, keywords: DataFrame, *, k: int = 1000, window: int = 4, operator: bool = False) -> DataFrame:
    """``query_id, value``: per query one text of its settings, ``Q``, ``E`` (in order) and ``P`` lines."""
    e = queries.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("expr_no", "expr"))).alias("_e"))
    p = keywords.groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("_p"))
    lines = lambda tag, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{tag}\t"), x))
    head = F.array(F.lit(f"K\t{k}"), F.lit(f"W\t{window}"), F.lit(f"O\t{int(operator)}"), F.concat(F.lit("Q\t"), F.col("query_id")))
    both = e.join(p, "query_id", "full_outer")
    body = F.concat(head, lines("E", F.transform("_e", lambda x: x["expr"])), lines("P", F.col("_p")))
    return both.select("query_id", F.array_join(body, "\n").alias("value"))
