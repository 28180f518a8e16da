"""The inverted index: distinct expressions, their postings and where they occur."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.operators import tuples
from glyphgrove.runtime import durable


@dataclass
class Index:
    """Three tables.

    * ``expressions(expr_id, expr, tc)``  one row per distinct expression; ``tc`` counts its tuples
    * ``postings(from, to, rel, expr_id, cnt, tc)``  clustered by nothing but the scan; ``tc`` rides along so that
      scores and size bounds need no second join
    * ``occurrences(doc_id, position, expr_id)``

    An index that was just built also has ``rows(expr_id, tc, tuples)``, the postings of an expression in one row.
    """

    expressions: DataFrame
    postings: DataFrame
    occurrences: DataFrame
    window: int
    eob: str
    rows: DataFrame | None = None


def packed_id(doc: Column, position: Column) -> Column:
    """One number for document and position, in their order; raises an error where they don't fit."""
    fits = doc.between(0, (1 << 40) - 1) & position.between(0, (1 << 22) - 1)
    return F.when(fits, F.shiftleft(doc, 22) + position).when(doc.isNotNull() & position.isNotNull(), F.raise_error(F.lit("document or position out of range")).cast("bigint"))


def build(occ: DataFrame, *, doc: str = "doc_id", position: str = "position", expr: str = "expr", window: int = tuples.WINDOW, eob: str = "small", keep: bool = True) -> Index:
    """Index of a table of occurrences.

    Expressions are made distinct before they are expanded, in one shuffle; each expression's tuples are counted
    inside its row, so the postings need none. ``expr_id`` is the order of first occurrence packed into one number
    (document, then position), which makes ties of searches reproducible: documents have ids from 0 below 2^40,
    positions below 2^22, others raise an error. Null expressions and strings that are no trees are left out.
    """
    ident = packed_id(F.col(doc).cast("bigint"), F.col(position).cast("bigint"))
    rows = occ.filter(F.col(expr).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(position).cast("int").alias("position"), F.col(expr).alias("expr"), ident.alias("_at"))
    first = rows.groupBy("expr").agg(F.min("_at").alias("expr_id"))
    counted = first.select("expr_id", "expr", tuples.tuple_counts(F.col("expr"), window, eob).alias("tuples")).filter("tuples IS NOT NULL")
    counted = counted.withColumn("tc", F.aggregate("tuples", F.lit(0).cast("bigint"), lambda a, t: a + t["cnt"]))
    counted = durable(counted) if keep else counted
    postings = counted.select("expr_id", "tc", F.explode("tuples").alias("t")).select("t.from", "t.to", "t.rel", "expr_id", "t.cnt", "tc")
    expressions = counted.select("expr_id", "expr", "tc")
    places = rows.join(expressions.select("expr", "expr_id"), "expr").select("doc_id", "position", "expr_id")
    return Index(expressions, postings, places, window, eob, counted.select("expr_id", "tc", "tuples"))


def write(index: Index, path: str, *, buckets: int = 256) -> None:
    """Store an index as Parquet; postings lie in ranges of tuples and sizes, so row groups can be skipped by both.

    Ranges follow the number of postings: a tuple that a third of all expressions has lies in a third of the files.
    """
    index.expressions.write.mode("overwrite").parquet(f"{path}/expressions")
    order = ("from", "to", "rel", "tc", "expr_id")
    index.postings.repartitionByRange(buckets, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    index.occurrences.write.mode("overwrite").parquet(f"{path}/occurrences")
    spark = index.postings.sparkSession
    spark.createDataFrame([(index.window, index.eob)], "window int, eob string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def read(spark, path: str) -> Index:
    s = spark.read.json(f"{path}/settings").first()
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("expressions", "postings", "occurrences")), s["window"], s["eob"])


def union(a: Index, b: Index) -> Index:
    """Index of two disjoint sets of documents built with the same settings; expressions in both keep the first id."""
    if (a.window, a.eob) != (b.window, b.eob):
        raise ValueError("indexes with different windows or modes")
    ids = b.expressions.select(F.col("expr_id").alias("old"), "expr", "tc").join(a.expressions.select(F.col("expr_id").alias("new"), "expr"), "expr", "left")
    ids = durable(ids)
    fresh = ids.filter("new IS NULL")
    moved = b.occurrences.join(ids.select(F.col("old").alias("expr_id"), "new"), "expr_id").select("doc_id", "position", F.coalesce("new", "expr_id").alias("expr_id"))
    return Index(
        a.expressions.unionByName(fresh.select(F.col("old").alias("expr_id"), "expr", "tc")),
        a.postings.unionByName(b.postings.join(fresh.select(F.col("old").alias("expr_id")), "expr_id", "left_semi")),
        a.occurrences.unionByName(moved),
        a.window,
        a.eob,
    )


def _long(row: DataFrame) -> DataFrame:
    """A table of one row as rows ``metric, value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def statistics(index: Index) -> DataFrame:
    """``metric, value``: documents, occurrences, expressions, distinct tuples, terms, ways, tuples, quartiles of ``tc``."""
    quartile = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY tc)")
    e = index.expressions.agg(
        F.count("*").alias("n_expressions"),
        F.coalesce(F.sum("tc"), F.lit(0)).alias("n_tuples"),
        *[quartile(q).alias(f"tc_q{i}") for i, q in ((1, 0.25), (2, 0.5), (3, 0.75))],
        F.max("tc").alias("tc_max"),
    )
    t = index.postings.groupBy("from", "to", "rel").agg(F.count("*").alias("n"))
    p = t.agg(F.count("*").alias("n_distinct_tuples"), F.count_distinct("rel").alias("n_relations"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_postings"))
    terms = t.select(F.explode(F.array("from", "to")).alias("term")).agg(F.count_distinct("term").alias("n_terms"))
    o = index.occurrences.agg(F.count_distinct("doc_id").alias("n_documents"), F.count("*").alias("n_occurrences"))
    return _long(e).unionByName(_long(p)).unionByName(_long(terms)).unionByName(_long(o))


def distribution(index: Index, bins: int = 20) -> DataFrame:
    """``bin, low, high, n_expressions``: expressions by ``tc`` in equally wide bins between least and greatest."""
    ends = index.expressions.agg(F.min("tc").alias("lo"), F.max("tc").alias("hi")).first()
    lo, hi = (ends["lo"] or 0, ends["hi"] or 0)
    b = F.floor((F.col("tc") - lo) * bins / (hi - lo + 1)).cast("int")
    return index.expressions.groupBy(b.alias("bin")).agg(F.min("tc").alias("low"), F.max("tc").alias("high"), F.count("*").alias("n_expressions"))


def consistency(index: Index) -> DataFrame:
    """``metric, value``: tuples by expressions and by postings; both are equal in a sound index."""
    e = index.expressions.agg(F.coalesce(F.sum("tc"), F.lit(0)).alias("n_tuples"))
    p = index.postings.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_posted"))
    return _long(e).unionByName(_long(p))
