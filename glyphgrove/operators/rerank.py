"""Second stage: score vectors of query and candidate trees, groups of equal vectors, document ranks.

Alignment is Python, so it runs once per distinct pair of trees, in Arrow batches; everything before and after it
is DataFrame operators.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.align import pairs
from glyphgrove.align.constraints import Constraint, parse_constraint
from glyphgrove.align.matching import Aligner
from glyphgrove.align.scores import METRICS, SCORES
from glyphgrove.operators.ranks import number_rows
from glyphgrove.parse import trees
from glyphgrove.parse.pairs import WINDOW

RESULT = (
    "struct<scores: array<double>, q_exact: array<string>, q_unified: array<string>, q_wild: array<string>,"
    " c_exact: array<string>, c_unified: array<string>, c_wild: array<string>, distance: bigint>"
)


def constraints_of(text: str | None) -> dict[str, Constraint]:
    """Constraints by path from a tree of the query's shape whose tags are constraints; none for null."""
    return {} if not text else {p: parse_constraint(n.tag) for p, n in trees.visit(trees.parse(text))}


def name_distance(unified: list[tuple[str, str, str, str]]) -> int:
    """How far unified variables' names are apart, by code points of their nearest letters."""
    total = 0
    for _, q, _, c in unified:
        if q.startswith("V!") and c.startswith("V!") and len(q) > 2:
            total += sum(min(abs(ord(y) - ord(x)) for x in set(q[2:])) for y in set(c[2:]))
    return total


def score_pair(query: str, candidate: str, metric: int = 12, *, constraint: str | None = None, window: int = WINDOW, eob: str = "small") -> dict | None:
    """Score vector and matched paths of two canonical strings; null if one is no tree, an empty vector for metric -1."""
    try:
        q, c = trees.parse(query), trees.parse(candidate)
        rules = constraints_of(constraint)
    except (ValueError, TypeError):
        return None
    m = METRICS[metric]
    empty = dict.fromkeys(("q_exact", "q_unified", "q_wild", "c_exact", "c_unified", "c_wild"), [])
    if m.pairs is not None:
        r = pairs.match(q, c, window, eob, *m.pairs)
        return empty | {"scores": [r.scores[s] for s in m.scores], "q_exact": r.q_exact, "c_exact": r.c_exact, "q_unified": r.q_unified, "c_unified": r.c_unified, "distance": 0}
    if m.rules is None:
        return empty | {"scores": [], "distance": 0}
    scores, found = Aligner(q, c, m.rules, rules).best(lambda x: [SCORES[s](x) for s in m.scores])
    return {
        "scores": scores,
        "q_exact": sorted(p[0] for p in found.exact),
        "q_unified": sorted(p[0] for p in found.unified),
        "q_wild": sorted(w.q_path for w in found.wilds),
        "c_exact": sorted(p[2] for p in found.exact),
        "c_unified": sorted(p[2] for p in found.unified),
        "c_wild": sorted(p[2] for p in found.wild_nodes),
        "distance": name_distance(found.unified),
    }


def align_column(query: Column, candidate: Column, metric: int = 12, *, constraint: Column | None = None, window: int = WINDOW, eob: str = "small") -> Column:
    """:func:`score_pair` over columns."""

    @F.pandas_udf(RESULT)
    def align(q: pd.Series, c: pd.Series, k: pd.Series) -> pd.DataFrame:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        rows = [score_pair(*x[:2], metric, constraint=x[2], window=window, eob=eob) if x[0] is not None and x[1] is not None else None for x in zip(q, c, k, strict=True)]
        names = [f.split(":")[0].strip() for f in RESULT[7:-1].split(", ")]
        return pd.DataFrame([r or dict.fromkeys(names) for r in rows], columns=names)

    return align(query, candidate, F.lit(None).cast("string") if constraint is None else constraint)


def rerank(hits: DataFrame, queries: DataFrame, metric: int = 12, *, limit: int | None = None, window: int = WINDOW, eob: str = "small", constraint: str | None = None) -> DataFrame:
    """Hits (``query_id, expr, rank`` and more) with ``scores`` and matched paths.

    ``queries`` has ``query_id, expr`` (and a constraint column, if named). ``limit`` keeps the expressions with the
    best ranks of each query. Distinct pairs of trees are aligned once, however often they occur.
    """
    if limit is not None:
        w = Window.partitionBy("query_id").orderBy("rank")
        hits = hits.withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") <= limit).drop("_n")
    extra = [F.col(constraint).alias("_constraint")] if constraint else [F.lit(None).cast("string").alias("_constraint")]
    asked = queries.select("query_id", F.col("expr").alias("_query"), *extra)
    found = hits.join(asked, "query_id")
    # the query stands for its tree: pairs are distinct by query and candidate
    distinct = found.select("_query", "_constraint", "expr").distinct()
    aligned = distinct.select("_query", "_constraint", "expr", align_column(F.col("_query"), F.col("expr"), metric, constraint=F.col("_constraint"), window=window, eob=eob).alias("_m"))
    aligned = aligned.withColumnsRenamed({"_query": "_q2", "_constraint": "_k2", "expr": "_e2"})
    same = F.col("_query").eqNullSafe(F.col("_q2")) & F.col("_constraint").eqNullSafe(F.col("_k2")) & (F.col("expr") == F.col("_e2"))
    return found.join(aligned, same).select(*hits.columns, "_m.*")


def metric_table(hits: DataFrame, queries: DataFrame, metrics: list[int], **options) -> DataFrame:
    """``query_id, expr`` and the first score by each metric as ``m<number>``, for fitting or combining them.

    Each metric is computed once per distinct pair of trees; tables meet by query and expression.
    """
    pairs_only = hits.select("query_id", "expr", "rank").dropDuplicates(["query_id", "expr"])
    out = None
    for m in metrics:
        part = rerank(pairs_only, queries, m, **options).select("query_id", "expr", F.get("scores", F.lit(0)).alias(f"m{m}"))
        out = part if out is None else out.join(part, ["query_id", "expr"])
    return out


def shape(expr: Column) -> Column:
    """Tree string without its tags: the same for trees of the same form."""
    return F.regexp_replace(expr, r"\[[^\[\],]*", "[")


def group_ranks(reranked: DataFrame) -> DataFrame:
    """One row per query and expression with ``group``, ``subgroup``, ``place`` and ``abs_rank``.

    Expressions with the same vector are a group; within it, those of the same form with the same matched places are
    a subgroup, in the order of their first member; a subgroup is ordered by the distance of unified names, then by
    expression. ``abs_rank`` is the number of expressions in better groups. Windows are per query, which bounds them by
    the number of its results.
    """
    one = reranked.dropDuplicates(["query_id", "expr"])
    q = Window.partitionBy("query_id")
    by_score = q.orderBy(F.desc("scores"))
    form = F.md5(F.concat_ws("\x1f", shape(F.col("expr")), *[F.array_join(c, " ") for c in ("c_exact", "c_unified", "c_wild")]))
    one = one.withColumn("group", F.dense_rank().over(by_score)).withColumn("abs_rank", F.rank().over(by_score) - 1).withColumn("_form", form)
    one = one.withColumn("_first", F.min("rank").over(Window.partitionBy("query_id", "group", "_form")))
    one = one.withColumn("subgroup", F.dense_rank().over(q.orderBy("group", "_first", "_form")))
    return one.withColumn("place", F.row_number().over(q.orderBy("subgroup", "distance", "expr"))).drop("_form", "_first")


def document_ranks(reranked: DataFrame) -> DataFrame:
    """``query_id, doc_id, best, total, rank``: documents by their best vector, then by the sum of first scores."""
    d = reranked.groupBy("query_id", "doc_id").agg(F.max("scores").alias("best"), F.sum(F.get("scores", F.lit(0))).alias("total"))
    return number_rows(d, ["query_id"], [F.desc("best"), F.desc("total"), F.asc("doc_id")])


def query_statistics(grouped: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id, n_groups, n_subgroups, n_formulas, n_documents``."""
    g = grouped.groupBy("query_id").agg(F.max("group").alias("n_groups"), F.max("subgroup").alias("n_subgroups"), F.count("*").alias("n_formulas"))
    return g.join(hits.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_documents")), "query_id")
