"""First-stage retrieval: multiset Dice between query and candidate tuples, and the k best expressions.

Query tuples are a bounded table (queries are few and formulas short); they are counted and broadcast below a
limit, joined by shuffle beyond it. Postings are the large side and are scanned once; what is shuffled is one
partial sum per (query, expression).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.operators import tuples
from glyphgrove.operators import wildcards as wild
from glyphgrove.operators.index import Index
from glyphgrove.runtime import durable

#: Rows of query tuples up to which they are broadcast.
BROADCAST_ROWS = 500_000


class Queries:
    """Expanded queries: ``tuples(query_id, from, to, rel, cnt)``, of these ``exact(query_id, from, to, rel, qcnt)``, and ``totals(query_id, qtc)``.

    A tuple with a wildcard on one side is a wildcard tuple, with ``cnt`` instances. Tuples with wildcards on both
    sides, and ways that begin with ``?``, are dropped and not counted. Queries that aren't trees are left out.
    """

    def __init__(self, queries: DataFrame, *, ident: str = "query_id", expr: str = "expr", window: int = tuples.WINDOW, eob: str = "small") -> None:
        t = tuples.tuple_table(queries.select(F.col(ident).alias("query_id"), F.col(expr).alias("expr")), ["query_id"], window=window, eob=eob)
        open_from, open_to = F.col("from").startswith("?"), F.col("to").startswith("?")
        t = self.tuples = durable(t.filter(~(open_from & open_to) & ~F.col("rel").startswith("?")))
        self.small = t.count() <= BROADCAST_ROWS
        self.exact = t.filter(~open_from & ~open_to).withColumnRenamed("cnt", "qcnt")
        self.totals = t.groupBy("query_id").agg(F.sum("cnt").alias("qtc"))

    def side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df


def _dice(common: Column, tc: Column, qtc: Column) -> Column:
    return F.lit(2.0) * common / (tc + qtc)


def common_tuples(index: Index, q: Queries) -> DataFrame:
    """``query_id, expr_id, tc, common``: shared tuples of each query with each expression that shares any."""
    met = index.postings.join(q.side(q.exact), ["from", "to", "rel"])
    return met.groupBy("query_id", "expr_id", "tc").agg(F.sum(F.least("cnt", "qcnt")).alias("common"))


def search(index: Index, q: Queries, k: int = 3, *, wildcards: bool = False, least: float = 0.0) -> DataFrame:
    """``query_id, expr_id, score, rank``: the ``k`` best expressions of each query.

    Score: twice the shared tuples by the tuples of both. Ties go to the expression that occurred first. The rank
    filter lets the optimiser prune to ``k`` rows per query before the shuffle. Queries that share no tuple with any
    expression have no rows. ``least`` drops lower scores.
    """
    if wildcards:
        return wild.best_scores(wild.scores(index, q.tuples, k, least, q.side), k)
    common = common_tuples(index, q)
    scored = common.join(q.side(q.totals), "query_id").filter((F.col("common") <= F.col("tc")) & (F.col("common") <= F.col("qtc")))
    scored = scored.select("query_id", "expr_id", _dice(F.col("common"), F.col("tc"), F.col("qtc")).alias("score")).filter(F.col("score").between(least, 1.0))
    return wild.best_scores(scored, k)


def size_bounds(q: Queries, least: float) -> DataFrame:
    """``query_id, low, high``: sizes of expressions that can reach a Dice score of ``least`` with the query.

    A little slack guards exact ties against rounding.
    """
    x = 2.0 / least - 1.0
    return q.totals.select("query_id", F.ceil(F.col("qtc") / x - 1e-9).alias("low"), F.floor(F.col("qtc") * x + 1e-9).alias("high"))


def search_bounded(index: Index, q: Queries, k: int = 3) -> DataFrame:
    """:func:`search` in two passes, with the same result.

    The first pass scores each query by its tuples of lowest frequency only, a lower bound of every score; the k-th
    of these bounds the size of expressions worth looking at, and the second pass reads only their postings.
    """
    df = index.postings.groupBy("from", "to", "rel").agg(F.count("*").alias("df"))
    order = Window.partitionBy("query_id").orderBy("df", "from", "to", "rel")
    rare = df.join(q.side(q.exact), ["from", "to", "rel"]).withColumn("n", F.row_number().over(order)).filter("n <= 8").drop("n", "df")
    some = index.postings.join(q.side(rare), ["from", "to", "rel"]).groupBy("query_id", "expr_id", "tc").agg(F.sum(F.least("cnt", "qcnt")).alias("common"))
    some = some.join(q.side(q.totals), "query_id").withColumn("score", _dice(F.col("common"), F.col("tc"), F.col("qtc")))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"))
    bound = some.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n"))
    bound = q.totals.join(bound.filter(F.col("n") == k), "query_id", "left").withColumn("x", 2.0 / F.col("s") - 1.0)
    bound = durable(bound.select("query_id", F.coalesce(F.col("qtc") / F.col("x") - 1e-9, F.lit(0.0)).alias("low"), F.coalesce(F.col("qtc") * F.col("x") + 1e-9, F.lit(float("inf"))).alias("high")))
    wanted = q.exact.join(bound, "query_id")
    met = index.postings.join(q.side(wanted), ["from", "to", "rel"]).filter(F.col("tc").between(F.col("low"), F.col("high")))
    common = met.groupBy("query_id", "expr_id", "tc").agg(F.sum(F.least("cnt", "qcnt")).alias("common")).join(q.side(q.totals), "query_id")
    scored = common.select("query_id", "expr_id", _dice(F.col("common"), F.col("tc"), F.col("qtc")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "expr_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exact_match(index: Index, queries: DataFrame, *, ident: str = "query_id", expr: str = "expr") -> DataFrame:
    """``query_id, expr_id, score``: expressions equal to the query, with score 1."""
    asked = queries.select(F.col(ident).alias("query_id"), F.col(expr).alias("expr"))
    return index.expressions.join(asked, "expr").select("query_id", "expr_id", F.lit(1.0).alias("score"))


def expand_hits(index: Index, hits: DataFrame) -> DataFrame:
    """Hits with every place of their expressions: ``query_id, doc_id, position, expr, score, rank``."""
    # hits are at most k per query
    return hits.join(index.occurrences, "expr_id").join(index.expressions.select("expr_id", "expr"), "expr_id").select("query_id", "doc_id", "position", "expr", "score", "rank")


def counters(index: Index, q: Queries) -> DataFrame:
    """``query_id, n_postings, n_expressions, n_documents`` that each query's exact tuples touch."""
    met = index.postings.join(q.side(q.exact.select("query_id", "from", "to", "rel")), ["from", "to", "rel"])
    pairs = met.groupBy("query_id", "expr_id").agg(F.count("*").alias("n"))
    docs = pairs.select("query_id", "expr_id").join(index.occurrences.select("expr_id", "doc_id").distinct(), "expr_id").select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_documents"))
    return pairs.groupBy("query_id").agg(F.sum("n").alias("n_postings"), F.count("*").alias("n_expressions")).join(docs, "query_id")
