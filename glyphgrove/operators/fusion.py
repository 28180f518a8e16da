"""Combination of rankings: of the two tree models, of several formulas of a query, of formulas and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.operators.ranks import number_rows
from glyphgrove.runtime import apart

#: Weights of the combined score, cross-validated on a public test collection: constant, layout, operator.
WEIGHTS = (0.2930, 0.0861, -0.1694, 1.8469, 0.9657, -0.0153, -0.3301)
#: Fixed value: the length of a run.
RUN_LENGTH = 1000


def merge_models(layout: DataFrame, operator: DataFrame, *, item: str = "item_id") -> DataFrame:
    """``query_id, item, scores``: both models' vectors side by side, zeros for the missing one.

    Inputs have one row per query and item with an array ``scores`` of three; of repeated rows the greatest vector
    counts.
    """
    side = lambda d, name: d.groupBy("query_id", item).agg(F.max("scores").alias(name))
    none = F.array(*[F.lit(0.0)] * 3)
    both = side(layout, "_l").join(side(operator, "_o"), ["query_id", item], "full_outer")
    return both.select("query_id", item, F.concat(F.coalesce("_l", none), F.coalesce("_o", none)).alias("scores"))


def weighted(scores: Column, weights: Sequence[float] = WEIGHTS) -> Column:
    """Constant plus weighted sum of a vector."""
    terms = [F.coalesce(F.get(scores, F.lit(i)), F.lit(0.0)) * w for i, w in enumerate(weights[1:])]
    total: Column = F.lit(weights[0])
    for t in terms:
        total = total + t
    return total


def ranked(run: DataFrame, *, item: str = "item_id", k: int | None = None, compat: bool = False) -> DataFrame:
    """Adds ``rank`` by descending score, then item. ``compat`` orders scores as texts, as older runs are.

    With ``k`` the group limit prunes before the shuffle; without, runs of any length are numbered over many tasks.
    """
    key = F.col("score").cast("string") if compat else F.col("score")
    if k is None:
        return number_rows(run, ["query_id"], [F.desc(key), F.asc(item)])
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(key), item))).filter(F.col("rank") <= k)


def merge_forms(rows: DataFrame, ident: str, a: str, b: str) -> DataFrame:
    """Adds ``form``: the smallest ``ident`` among rows that share ``a`` or ``b`` with this one (one step, no chains)."""
    first_a = rows.filter(F.col(a).isNotNull()).groupBy(a).agg(F.min(ident).alias("_fa"))
    first_b = rows.filter(F.col(b).isNotNull()).groupBy(b).agg(F.min(ident).alias("_fb"))
    return rows.join(first_a, a, "left").join(first_b, b, "left").withColumn("form", F.least(F.coalesce("_fa", ident), F.coalesce("_fb", ident))).drop("_fa", "_fb")


def combine_metrics(runs: list[DataFrame], names: list[str], *, item: str = "item_id") -> DataFrame:
    """``query_id, item`` and one column of scores for each run; 0 where a run lacks the item."""
    parts = None
    for r, n in zip(runs, names, strict=True):
        part = r.select("query_id", item, F.lit(n).alias("_n"), F.col("score").cast("double").alias("_s"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("query_id", item).pivot("_n", names).agg(F.max("_s")).na.fill(0.0, names)


def min_max(run: DataFrame) -> DataFrame:
    """Scores of a query moved to 0..1; where all are the same they stay as they are."""
    ends = run.groupBy(F.col("query_id").alias("_q")).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    met = run.join(apart(ends, "_q"), F.col("query_id").eqNullSafe(F.col("_q")))
    moved = F.when(F.col("_high") == F.col("_low"), F.col("score")).otherwise((F.col("score") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return met.withColumn("score", moved).drop("_q", "_low", "_high")


def min_max_fusion(a: DataFrame, b: DataFrame, *, item: str = "item_id", k: int = RUN_LENGTH) -> DataFrame:
    """``query_id, item, score, rank``: sum of normalised scores of both runs, for the queries that both have."""
    one = lambda d: min_max(d.groupBy("query_id", item).agg(F.max("score").alias("score")))
    both = a.select("query_id").distinct().join(b.select("query_id").distinct(), "query_id")
    total = one(a).unionByName(one(b)).groupBy("query_id", item).agg(F.sum("score").alias("score")).join(both, "query_id", "left_semi")
    return ranked(total, item=item, k=k)


def best_per_document(scored: DataFrame) -> DataFrame:
    """``query_id, expr_no, doc_id, scores``: each document's best vector for each formula of the query."""
    return scored.groupBy("query_id", "expr_no", "doc_id").agg(F.max("scores").alias("scores"))


def combine_formulas(best: DataFrame, queries: DataFrame, *, by_size: bool = False, n_scores: int = 3) -> DataFrame:
    """``query_id, doc_id, scores``: weighted sum of the vectors of a query's formulas, zeros for missing ones.

    Weights are equal, or shares of the formulas' sizes (their opening brackets). ``queries`` has
    ``query_id, expr_no, expr``.
    """
    w = Window.partitionBy("query_id")
    size = F.length(F.regexp_replace("expr", r"[^\[]", ""))
    weight = size / F.sum(size).over(w) if by_size else F.lit(1.0) / F.count("*").over(w)
    weights = queries.select("query_id", "expr_no", weight.alias("_w"))
    parts = best.join(weights, ["query_id", "expr_no"])
    sums = [F.sum(F.col("_w") * F.get("scores", F.lit(i))).alias(f"_{i}") for i in range(n_scores)]
    total = parts.groupBy("query_id", "doc_id").agg(*sums)
    return total.select("query_id", "doc_id", F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(n_scores)]).alias("scores"))


def dynamic_weights(formulas: DataFrame, keywords: DataFrame) -> DataFrame:
    """``query_id, weight``: the formulas' share among formulas and keywords of each query."""
    f = formulas.groupBy("query_id").agg(F.count("*").alias("_f"))
    k = keywords.groupBy("query_id").agg(F.count("*").alias("_k"))
    both = f.join(k, "query_id", "full_outer").na.fill(0, ["_f", "_k"])
    return both.select("query_id", (F.col("_f") / (F.col("_f") + F.col("_k"))).alias("weight"))


def combine_with_text(math: DataFrame, text: DataFrame, weight: float | DataFrame, *, text_only: bool = False) -> DataFrame:
    """``query_id, doc_id, score, rest, rank``: weighted sum of the first math score and the text score.

    ``weight`` is the share of math in 0..1, or a table of :func:`dynamic_weights`. A document that only one side has
    gets 0 for the other; queries without any text scores count 1 for every document. ``rest`` has the other math scores.
    """
    has_text = text.select("query_id").distinct().withColumn("_has", F.lit(True))
    both = math.join(text.select("query_id", "doc_id", F.col("score").alias("_t")), ["query_id", "doc_id"], "full_outer").join(has_text, "query_id", "left")
    if isinstance(weight, DataFrame):
        both = both.join(weight, "query_id", "left").withColumn("_w", F.coalesce("weight", F.lit(0.0)))
    else:
        both = both.withColumn("_w", F.lit(0.0 if text_only else float(weight)))
    t = F.when(F.col("_has"), F.coalesce("_t", F.lit(0.0))).otherwise(1.0)
    m = F.coalesce(F.get("scores", F.lit(0)), F.lit(0.0))
    out = both.select("query_id", "doc_id", (F.col("_w") * m + (1 - F.col("_w")) * t).alias("score"), F.slice(F.coalesce("scores", F.array(F.lit(0.0))), 2, 99).alias("rest"))
    return number_rows(out, ["query_id"], [F.desc("score"), F.desc("rest"), F.asc("doc_id")])


def padded(run: DataFrame, k: int) -> DataFrame:
    """Exactly ``k`` rows for each query: results are repeated in order, with the lowest score, until there are enough."""
    sizes = run.groupBy(F.col("query_id").alias("_q")).agg(F.count("*").alias("_n"), F.min("score").alias("_low"))
    full = run.join(apart(sizes, "_q"), F.col("query_id").eqNullSafe(F.col("_q"))).drop("_q")
    times = F.explode(F.sequence(F.lit(0), F.floor((F.lit(k) - F.col("rank")) / F.col("_n")).cast("int")))
    again = full.filter(F.col("rank") <= k).withColumn("_turn", times)
    score = F.when(F.col("_turn") == 0, F.col("score")).otherwise(F.col("_low"))
    return again.withColumn("score", score).withColumn("rank", (F.col("rank") + F.col("_turn") * F.col("_n")).cast("int")).drop("_n", "_low", "_turn")
