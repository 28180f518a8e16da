"""Relevance evaluation of runs: judgments, conversions, precision, nDCG, MAP and fitted weights.

A run has ``query_id, item_id, score`` (and ``rank`` where said); judgments have ``query_id, item_id, relevance``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.operators.ranks import number_rows
from glyphgrove.runtime import apart, durable

#: Levels of relevance up to which their summaries are broadcast.
BROADCAST_LEVELS = 10_000

#: Values of graded labels.
GRADES = {"Not-Relevant": 0, "Partially-Relevant": 1, "Relevant": 2}


def sorted_run(run: DataFrame) -> DataFrame:
    """Run with ``rank`` by descending score, then item."""
    return number_rows(run, ["query_id"], [F.desc("score"), F.asc("item_id")])


def aggregate_judgments(raw: DataFrame, *, grade: str | None = None) -> DataFrame:
    """``query_id, item_id, relevance, n_ratings``: twice the mean of an item's ratings (0 to 4).

    Ratings are numbers in ``relevance``, or names in the column ``grade``. Null ratings are left out.
    """
    if grade is None:
        value = F.col("relevance")
    else:
        value = F.coalesce(*[F.when(F.col(grade) == k, F.lit(v)) for k, v in GRADES.items()])
    rated = raw.select("query_id", "item_id", value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    return rated.groupBy("query_id", "item_id").agg((2.0 * F.avg("_v")).alias("relevance"), F.count("*").alias("n_ratings"))


def judged_only(run: DataFrame, judgments: DataFrame) -> DataFrame:
    """First occurrence (best rank) of each judged item, ranked anew."""
    first = run.groupBy("query_id", "item_id").agg(F.max_by("score", F.struct(-F.col("rank"), F.col("score"))).alias("score"), F.min("rank").alias("_r"))
    kept = first.join(judgments.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi")
    return number_rows(kept, ["query_id"], [F.asc("_r"), F.asc("item_id")]).drop("_r")


def _with_relevance(run: DataFrame, judgments: DataFrame) -> DataFrame:
    return run.join(judgments.select("query_id", "item_id", "relevance"), ["query_id", "item_id"], "left")


def precision_at(run: DataFrame, judgments: DataFrame, k: int = 10, least: float = 1.0) -> DataFrame:
    """``query_id, precision, n_missing`` by ``k``, for judged queries of the run; ``n_missing`` counts places of the first
    ``k`` that are empty or not judged."""
    asked = run.select("query_id").distinct().join(judgments.select("query_id").distinct(), "query_id", "left_semi")
    top = _with_relevance(run.filter(F.col("rank") <= k), judgments)
    per = top.groupBy("query_id").agg(F.sum((F.coalesce("relevance", F.lit(-1.0)) >= least).cast("int")).alias("_n"), F.count("relevance").alias("_j"))
    per = asked.join(per, "query_id", "left").na.fill(0, ["_n", "_j"])
    return per.select("query_id", (F.col("_n") / F.lit(float(k))).alias("precision"), (F.lit(k) - F.col("_j")).cast("bigint").alias("n_missing"))


def _gain(relevance: Column, rank: Column) -> Column:
    """The first place counts fully, place n by the logarithm to base 2 of n."""
    return F.when(rank == 1, relevance).otherwise(relevance / F.log2(rank.cast("double")))


def ndcg_at(run: DataFrame, judgments: DataFrame, k: int = 1000) -> DataFrame:
    """``query_id, ndcg`` by ``k``; unjudged places gain nothing, an ideal gain of 0 gives 1."""
    got = _with_relevance(run.filter(F.col("rank") <= k), judgments).groupBy("query_id").agg(F.sum(_gain(F.coalesce("relevance", F.lit(0.0)), F.col("rank"))).alias("_got"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("relevance")))
    ideal = judgments.withColumn("_p", place).filter(F.col("_p") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("relevance"), F.col("_p"))).alias("_ideal"))
    asked = run.select("query_id").distinct().join(ideal, "query_id")
    both = asked.join(got, "query_id", "left").na.fill(0.0, ["_got"])
    return both.select("query_id", F.when(F.col("_ideal") > 0, F.col("_got") / F.col("_ideal")).otherwise(1.0).alias("ndcg"))


def ideal_ranking(judgments: DataFrame) -> DataFrame:
    """The best possible run: judged items by relevance, then item descending."""
    return number_rows(judgments, ["query_id"], [F.desc("relevance"), F.desc("item_id")])


def average_precision(run: DataFrame, judgments: DataFrame, least: float = 2.0) -> DataFrame:
    """``query_id, ap``: mean precision at relevant items of the judged part of a run; queries without any give 0."""
    relevant = judgments.filter(F.col("relevance") >= least).groupBy("query_id").agg(F.count("*").alias("_all"))
    hits = _with_relevance(judged_only(run, judgments), judgments).filter(F.col("relevance") >= least).select("query_id", "rank")
    per = number_rows(hits, ["query_id"], [F.asc("rank")], "_i").groupBy("query_id").agg(F.sum(F.col("_i") / F.col("rank")).alias("_s"))
    return relevant.join(per, "query_id", "left").select("query_id", (F.coalesce("_s", F.lit(0.0)) / F.col("_all")).alias("ap"))


def bpref(run: DataFrame, judgments: DataFrame, least: float = 1.0) -> DataFrame:
    """``query_id, bpref``: how rarely judged irrelevant items stand before relevant ones."""
    n = judgments.groupBy("query_id").agg(F.sum((F.col("relevance") >= least).cast("int")).alias("_r"), F.sum((F.col("relevance") < least).cast("int")).alias("_n"))
    good = _with_relevance(judged_only(run, judgments), judgments).filter(F.col("relevance") >= least).select("query_id", "rank")
    # ranks of the judged part have no gaps, so what isn't good before a place is bad
    r = number_rows(good, ["query_id"], [F.asc("rank")], "_i").withColumn("_b", F.col("rank") - F.col("_i")).join(n, "query_id")
    bound = F.least("_r", "_n")
    part = F.when(bound == 0, 1.0).otherwise(1.0 - F.least("_b", "_r") / bound)
    per = r.groupBy("query_id").agg(F.sum(F.greatest(part, F.lit(0.0))).alias("_s"))
    return n.filter("_r > 0").join(per, "query_id", "left").select("query_id", (F.coalesce("_s", F.lit(0.0)) / F.col("_r")).alias("bpref"))


def by_group(per_query: DataFrame, value: str, groups: DataFrame | None = None) -> DataFrame:
    """``grp, value``: mean over all queries (null group) and, if given, over each group (``query_id, grp``)."""
    if groups is None:
        return per_query.agg(F.avg(value).alias(value)).select(F.lit(None).cast("string").alias("grp"), value)
    joined = per_query.join(groups, "query_id", "left")
    return joined.groupingSets([[F.col("grp")], []], F.col("grp")).agg(F.avg(value).alias(value), F.grouping("grp").alias("_all")).filter("_all = 1 OR grp IS NOT NULL").drop("_all")


def to_trec(hits: DataFrame, run: str, *, best_only: bool = False, k: int | None = None) -> DataFrame:
    """``query_id, item_id, rank, score, run``: score is 1 by the place among the distinct scores.

    ``hits`` has ``query_id, doc_id, position, expr, score, rank``. ``best_only`` keeps of each document the
    occurrences of its first expression. Items are named ``document:position``.
    """
    if best_only:
        first = hits.groupBy(F.col("query_id").alias("_q"), F.col("doc_id").alias("_d")).agg(F.min_by("expr", F.struct("rank", "position")).alias("_first"))
        same = F.col("query_id").eqNullSafe(F.col("_q")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("expr") == F.col("_first"))
        hits = hits.join(apart(first, "_q", "_d"), same, "left_semi")
    out = number_rows(hits, ["query_id"], [F.asc("rank"), F.asc("doc_id"), F.asc("position")], "_place")
    if k is not None:
        out = out.filter(F.col("_place") <= k)
    out = durable(out)
    dense = number_rows(out.select("query_id", "score").distinct(), ["query_id"], [F.desc("score")], "_dense").withColumnsRenamed({"query_id": "_q", "score": "_s"})
    placed = out.join(dense, F.col("query_id").eqNullSafe(F.col("_q")) & F.col("score").eqNullSafe(F.col("_s")))
    return placed.select("query_id", F.concat_ws(":", "doc_id", "position").alias("item_id"), F.col("_place").alias("rank"), (F.lit(1.0) / F.col("_dense")).alias("score"), F.lit(run).alias("run"))


def formulas_to_posts(run: DataFrame, formulas: DataFrame, *, kinds: tuple[str, ...] | None = ("answer",), k: int = 1000) -> DataFrame:
    """``query_id, item_id, score, rank``: posts of the formulas found, by the best score of a post's formulas.

    ``formulas`` has ``formula_id, post_id, post_kind``; ``kinds`` limits the posts.
    """
    use = formulas if kinds is None else formulas.filter(F.col("post_kind").isin(*kinds))
    use = use.filter(F.col("post_id").isNotNull()).select(F.col("formula_id").alias("item_id"), "post_id").distinct()
    posts = run.join(use, "item_id").groupBy("query_id", "post_id").agg(F.max("score").alias("score")).withColumnRenamed("post_id", "item_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return posts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def visual_dedup(run: DataFrame, formulas: DataFrame, visuals: DataFrame, judgments: DataFrame) -> DataFrame:
    """``query_id, item_id, score, rank``: judged visually distinct formulas with their best score.

    A formula (``formula_id, slt_string, latex_string``) has the visual id (``visual_id, slt_string, latex_string``)
    of its layout string or else of its LaTeX. Visuals whose layout string is null or ``None`` are found by LaTeX.
    """
    none = F.col("slt_string").isNull() | (F.col("slt_string") == "None")
    by_slt = visuals.filter(~none).groupBy("slt_string").agg(F.max("visual_id").alias("_vs"))
    by_tex = visuals.filter(none & F.col("latex_string").isNotNull()).groupBy("latex_string").agg(F.max("visual_id").alias("_vt"))
    named = formulas.join(by_slt, "slt_string", "left").join(by_tex, "latex_string", "left").select(F.col("formula_id").alias("item_id"), F.coalesce("_vs", "_vt").alias("_v"))
    named = named.filter(F.col("_v").isNotNull()).distinct()
    best = run.join(named, "item_id").groupBy("query_id", "_v").agg(F.max("score").alias("score")).withColumnRenamed("_v", "item_id")
    return sorted_run(best.join(judgments.select("query_id", "item_id").distinct(), ["query_id", "item_id"], "left_semi"))


def split_related(pairs: DataFrame, *, kind: str = "relation") -> tuple[DataFrame, DataFrame]:
    """Duplicates (relation 2) and merely related pairs."""
    return pairs.filter(F.col(kind) == 2), pairs.filter((F.col(kind) != 2) | F.col(kind).isNull())


def best_per_document(run: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Results that reach the best score of their document, ties kept."""
    top = run.groupBy(F.col("query_id").alias("_q"), F.col(doc).alias("_d")).agg(F.max("score").alias("_top"))
    same = F.col("query_id").eqNullSafe(F.col("_q")) & F.col(doc).eqNullSafe(F.col("_d")) & (F.col("score") == F.col("_top"))
    return run.join(apart(top, "_q", "_d"), same, "left_semi")


def relevance_spread(rows: DataFrame, value: str) -> DataFrame:
    """Five-number summary of a value at each level of relevance; null values are left out.

    Values are numbered over range partitions, so a level with a third of all rows isn't gathered; a quartile is the
    weighted sum of the one or two values next to its place.
    """
    some = rows.select("relevance", F.col(value).cast("double").alias("_v"), F.monotonically_increasing_id().alias("_tie")).filter("_v IS NOT NULL")
    placed = durable(number_rows(some, ["relevance"], [F.asc("_v"), F.asc("_tie")], "_place"))
    ends = placed.groupBy(F.col("relevance").alias("_g")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    near = lambda p: F.sum(F.col("_v") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("_place") - 1 - p * (F.col("n") - 1))))
    met = placed.join(F.broadcast(ends) if ends.count() <= BROADCAST_LEVELS else apart(ends, "_g"), F.col("relevance").eqNullSafe(F.col("_g")))
    return met.groupBy("relevance").agg(F.max("n").alias("n"), F.min("low").alias("low"), near(0.25).alias("q1"), near(0.5).alias("q2"), near(0.75).alias("q3"), F.max("high").alias("high"))


def _moments(features: DataFrame, n: int, vector: str, target: str) -> tuple[DataFrame, list[Column]]:
    """Usable rows, and the sums of products over them that a least-squares fit needs."""
    x = [F.lit(1.0), *[F.get(vector, F.lit(i)) for i in range(n)]]
    rows = features.filter(F.col(target).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) >= n))
    cells = [F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)]
    cells += [F.sum(x[i] * F.col(target)).alias(f"t{i}") for i in range(n + 1)]
    return rows, [*cells, F.sum(F.col(target) * F.col(target)).alias("y"), F.count("*").alias("n")]


def _system(r, n: int):
    """Matrix, right-hand side, sum of squared targets and number of rows of a row of moments."""
    import numpy as np

    a = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n + 1)] for i in range(n + 1)])
    return a, np.array([r[f"t{i}"] or 0.0 for i in range(n + 1)]), r["y"] or 0.0, r["n"]


def fit_weights(features: DataFrame, n: int, *, vector: str = "scores", target: str = "relevance") -> list[float]:
    """Least-squares weights (constant first) of a vector of ``n`` scores, from sums of products only.

    One aggregate of (n + 1)(n + 4) / 2 sums and a few leaves Spark, whatever the number of rows; rows with a null are
    left out. A singular system is solved with the smallest weights.
    """
    import numpy as np

    rows, cells = _moments(features, n, vector, target)
    a, b, _, _ = _system(rows.agg(*cells).first(), n)
    return np.linalg.lstsq(a, b, rcond=None)[0].tolist()


def cross_validate(features: DataFrame, folds: list, n: int, *, fold: str = "fold", vector: str = "scores", target: str = "relevance") -> DataFrame:
    """``fold, n_train, n_test, train_mse, test_mse, weights``: weights fitted without each fold and tested on it.

    Sums of products add up, so one grouped pass serves all folds: a fold's training sums are the total less its own.
    ``folds`` is a handful of names; errors follow from the same sums. Folds without rows have null errors.
    """
    import numpy as np

    rows, cells = _moments(features.filter(F.col(fold).isin(folds)), n, vector, target)
    own = {r["_fold"]: _system(r, n) for r in rows.groupBy(F.col(fold).alias("_fold")).agg(*cells).collect()}
    none = (np.zeros((n + 1, n + 1)), np.zeros(n + 1), 0.0, 0)
    total = [sum(parts) for parts in zip(*(own.values() or [none]), strict=True)]

    def error(w, part) -> float | None:
        a, b, y, m = part
        return None if not m else max(0.0, float(y - 2 * w @ b + w @ a @ w) / m)

    out = []
    for f in folds:
        test = own.get(f, none)
        train = tuple(x - y for x, y in zip(total, test, strict=True))
        w = np.linalg.lstsq(train[0], train[1], rcond=None)[0]
        out.append((str(f), int(train[3]), int(test[3]), error(w, train), error(w, test), w.tolist()))
    return features.sparkSession.createDataFrame(out, "fold string, n_train bigint, n_test bigint, train_mse double, test_mse double, weights array<double>")
