"""Fusion, evaluation and text queries over ``runs``, ``qrels``, ``candidates`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.functions.stem import stem_column
from glyphgrove.operators import evaluate, fusion, rerank, text
from glyphgrove.runtime import table

#: Decimal places of results that are sums of doubles.
PLACES = 9


def _r(c: str) -> Column:
    return F.round(c, PLACES).alias(c)


def _valid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runs").filter(F.col("score").between(0.0, 1.0) & (F.col("post_id") >= 0))


def _run(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Best score of each post in the runs of a kind (``slt``, ``opt``, ``comb``)."""
    r = _valid_runs(spark, sf_dir).filter(F.col("run").startswith(kind + "-"))
    return r.groupBy("query_id", F.col("post_id").alias("item_id")).agg(F.max("score").alias("score"))


def _visual_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined run in terms of visual ids, through the posts' formulas, with ranks."""
    f = table(spark, sf_dir, "formulas").filter("visual_id >= 0 AND post_id >= 0").select("post_id", "visual_id").distinct()
    r = _run(spark, sf_dir, "comb").withColumnRenamed("item_id", "post_id").join(f, "post_id")
    return evaluate.sorted_run(r.groupBy("query_id", F.col("visual_id").alias("item_id")).agg(F.max("score").alias("score")))


def _judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments with half-steps as the mean of an item's ratings."""
    q = table(spark, sf_dir, "qrels").filter("visual_id >= 0").select("query_id", F.col("visual_id").alias("item_id"), "relevance")
    return evaluate.aggregate_judgments(q)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Layout and operator vectors of the candidates that have such a tree."""
    c = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL")
    side = lambda tree, at: c.filter(F.col(tree).startswith("[")).select("query_id", F.col("formula_id").alias("item_id"), F.slice("scores", at, 3).alias("scores"))
    return side("slt_str", 1), side("opt_str", 4)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merge_models(*_vectors(spark, sf_dir))


# -- fusion ---------------------------------------------------------------------------------------------------


def merge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


def weighted_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _merged(spark, sf_dir).select("query_id", "item_id", F.round(fusion.weighted(F.col("scores")), PLACES).alias("score"))
    return fusion.ranked(run)


def combined_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _merged(spark, sf_dir).select("query_id", "item_id", F.round(F.col("scores")[0], 4).alias("score"))
    return fusion.ranked(run, k=10)


def combined_order_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by scores compared as texts; no SQL twin, as engines write small numbers differently."""
    run = _merged(spark, sf_dir).select("query_id", "item_id", F.round(fusion.weighted(F.col("scores")), PLACES).alias("score"))
    return fusion.ranked(run, compat=True)


def merge_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = lambda c: F.when(F.col(c).startswith("["), F.col(c)).alias(c)
    rows = table(spark, sf_dir, "candidates").select("cand_id", tree("slt_str"), tree("opt_str"))
    return fusion.merge_forms(rows, "cand_id", "slt_str", "opt_str").select("cand_id", "form")


def combine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.combine_metrics([_run(spark, sf_dir, k) for k in ("slt", "opt", "comb")], ["slt", "opt", "comb"])


def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _run(spark, sf_dir, "slt"), _run(spark, sf_dir, "opt")
    total = fusion.min_max_fusion(a, b, k=1 << 30).select("query_id", "item_id", _r("score"))
    return fusion.ranked(total, k=fusion.RUN_LENGTH)


def dynamic_weight_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combined runs as math scores and operator runs as text scores, weighted by each query's formulas and words."""
    math = _run(spark, sf_dir, "comb").select("query_id", F.col("item_id").alias("doc_id"), F.array("score").alias("scores"))
    words = _run(spark, sf_dir, "opt").select("query_id", F.col("item_id").alias("doc_id"), "score")
    formulas = table(spark, sf_dir, "candidates").select("query_id", "slt_str").distinct()
    keywords = table(spark, sf_dir, "qrels").select("query_id", "visual_id").distinct()
    out = fusion.combine_with_text(math, text.normalised(words), fusion.dynamic_weights(formulas, keywords))
    return out.select("query_id", "doc_id", _r("score"))


def fixed_weight_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    math = _run(spark, sf_dir, "comb").select("query_id", F.col("item_id").alias("doc_id"), F.array("score").alias("scores"))
    words = _run(spark, sf_dir, "opt").select("query_id", F.col("item_id").alias("doc_id"), "score")
    return fusion.combine_with_text(math, words, 0.75).select("query_id", "doc_id", _r("score"))


def combine_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both trees of a candidate as two formulas of its query, weighted by their sizes."""
    c = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL")
    part = lambda n, at: c.select("query_id", F.lit(n).alias("expr_no"), F.col("formula_id").alias("doc_id"), F.slice("scores", at, 3).alias("scores"))
    best = fusion.best_per_document(part(0, 1).unionByName(part(1, 4)))
    size = lambda tree, n: c.filter(F.col(tree).startswith("[")).groupBy("query_id").agg(F.max(tree).alias("expr")).withColumn("expr_no", F.lit(n))
    out = fusion.combine_formulas(best, size("slt_str", 0).unionByName(size("opt_str", 1)), by_size=True)
    return out.select("query_id", "doc_id", F.transform("scores", lambda s: F.round(s, PLACES)).alias("scores"))


def padded_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = fusion.ranked(_run(spark, sf_dir, "slt"), k=20)
    return fusion.padded(run, 50).select("query_id", "item_id", "score", "rank")


# -- evaluation -----------------------------------------------------------------------------------------------


def qrel_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judgments(spark, sf_dir).select("query_id", "item_id", _r("relevance"), "n_ratings")


def visual_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visual_run(spark, sf_dir)


def prim_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judged_only(_visual_run(spark, sf_dir), _judgments(spark, sf_dir))


def p_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.precision_at(_visual_run(spark, sf_dir), _judgments(spark, sf_dir), 10, 2.0)


def p_at_10_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = p_at_10(spark, sf_dir)
    groups = per.select("query_id", F.substring_index("query_id", ".", 1).alias("grp"))
    return evaluate.by_group(per, "precision", groups).select("grp", _r("precision"))


def ndcg_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _judgments(spark, sf_dir)
    return evaluate.ndcg_at(evaluate.judged_only(_visual_run(spark, sf_dir), j), j).select("query_id", _r("ndcg"))


def map_prime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.average_precision(_visual_run(spark, sf_dir), _judgments(spark, sf_dir)).select("query_id", _r("ap"))


def bpref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bpref(_visual_run(spark, sf_dir), _judgments(spark, sf_dir)).select("query_id", _r("bpref"))


def ideal_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ideal_ranking(_judgments(spark, sf_dir)).select("query_id", "item_id", _r("relevance"), "rank")


def trec_dense_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as hits: documents are formulas, positions candidates."""
    c = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL AND slt_str IS NOT NULL")
    hits = c.select("query_id", F.col("formula_id").alias("doc_id"), F.col("cand_id").alias("position"), F.col("slt_str").alias("expr"), F.col("scores")[0].alias("score"))
    return evaluate.to_trec(fusion.ranked(hits, item="position"), "layout", best_only=True, k=1000)


def formulas_to_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL").select("query_id", F.col("formula_id").alias("item_id"), F.col("scores")[0].alias("score"))
    return evaluate.formulas_to_posts(run, table(spark, sf_dir, "formulas"))


def formulas_to_all_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL").select("query_id", F.col("formula_id").alias("item_id"), F.col("scores")[0].alias("score"))
    return evaluate.formulas_to_posts(run, table(spark, sf_dir, "formulas"), kinds=None, k=1001)


def visual_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL")
    run = c.select("query_id", F.col("formula_id").alias("item_id"), F.col("scores")[0].alias("score"))
    f = table(spark, sf_dir, "formulas")
    tree = table(spark, sf_dir, "visuals").filter("slt_string LIKE '[%'").groupBy("visual_id").agg(F.max("slt_string").alias("slt_string"))
    forms = f.join(tree, "visual_id", "left").select("formula_id", "slt_string", F.col("formula").alias("latex_string"))
    return evaluate.visual_dedup(run, forms, table(spark, sf_dir, "visuals"), _judgments(spark, sf_dir))


def best_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").select("query_id", "cand_id", F.col("formula_id").alias("doc_id"), F.col("scores")[0].alias("score"))
    return evaluate.best_per_document(c)


def relevance_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _visual_run(spark, sf_dir).join(_judgments(spark, sf_dir), ["query_id", "item_id"])
    return evaluate.relevance_spread(r, "score").select("relevance", "n", *[_r(c) for c in ("low", "q1", "q2", "q3", "high")])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "formulas").filter("visual_id >= 0").groupBy(F.col("formula_id").alias("item_id")).agg(F.max("visual_id").alias("visual_id"))
    j = _judgments(spark, sf_dir).select("query_id", F.col("item_id").alias("visual_id"), "relevance")
    x = _merged(spark, sf_dir).join(f, "item_id").join(j, ["query_id", "visual_id"])
    return x.withColumn("fold", F.right("query_id", F.lit(1)))


def regression_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _features(spark, sf_dir)
    folds = [str(i) for i in range(10)]
    out = evaluate.cross_validate(x.persist(), folds, 6)
    x.unpersist()
    return out


def group_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("slt_str LIKE '[%'")
    one = c.groupBy("query_id", F.col("slt_str").alias("expr")).agg(F.max(F.slice("scores", 1, 3)).alias("scores"), F.min("cand_id").cast("int").alias("rank"))
    none = F.array().cast("array<string>")
    r = one.withColumns({"c_exact": none, "c_unified": none, "c_wild": none, "distance": F.lit(0)})
    return rerank.group_ranks(r).select("query_id", "expr", "group", "abs_rank")


def doc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates").filter("formula_id IS NOT NULL")
    r = c.select("query_id", F.col("formula_id").alias("doc_id"), F.transform(F.slice("scores", 1, 3), lambda s: F.round(s, 4)).alias("scores"))
    # sums of four-place decimals, rounded so that their order doesn't depend on the order of summation
    out = rerank.document_ranks(r)
    return out.select("query_id", "doc_id", "best", F.round("total", 6).alias("total"))


# -- text -----------------------------------------------------------------------------------------------------


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.tfidf_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10, query="item_id")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every three words in a row of each item as a phrase, numbered by item and place."""
    words = text.terms(F.col("text"))
    starts = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, 3), " ").alias("phrase"))), lambda p: p["at"] <= F.size(words) - 3)
    p = table(spark, sf_dir, "benchmark").select("item_id", F.explode(starts).alias("p"))
    return p.select((F.col("item_id") * 1000 + F.col("p.at")).alias("query_id"), "p.phrase")


def keyword_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct terms of each item."""
    k = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(text.terms(F.col("text")))).alias("term"))
    return text.keyword_positions(table(spark, sf_dir, "documents"), k)


def phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.phrase_positions(table(spark, sf_dir, "documents"), _phrases(spark, sf_dir))


def stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.explode(text.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return d.select(F.get(stem_column(F.array("term")), F.lit(0)).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        merge_models, weighted_combine, combined_topk, combined_order_compat, merge_forms, combine_metrics, minmax_fusion, dynamic_weight_fusion, fixed_weight_fusion,
        combine_formulas, padded_output, qrel_aggregate, visual_run, prim_filter, p_at_10, p_at_10_groups, ndcg_prime, map_prime, bpref, ideal_ranking,
        trec_dense_score, formulas_to_answers, formulas_to_all_posts, visual_dedup, best_per_doc, relevance_spread, regression_cv, group_rank, doc_rank,
        tfidf_topk, keyword_positions, phrase_positions, stem_terms,
    )
}

# SQL twins ---------------------------------------------------------------------------------------------------


def _run_sql(kind: str) -> str:
    return f"SELECT query_id, post_id AS item_id, max(score) AS score FROM runs WHERE score BETWEEN 0 AND 1 AND post_id >= 0 AND run LIKE '{kind}-%' GROUP BY ALL"


_MERGED = """
WITH l AS (SELECT query_id, formula_id AS item_id, max(scores[1:3]) AS l FROM candidates WHERE slt_str LIKE '[%' AND formula_id IS NOT NULL GROUP BY ALL),
o AS (SELECT query_id, formula_id AS item_id, max(scores[4:6]) AS o FROM candidates WHERE opt_str LIKE '[%' AND formula_id IS NOT NULL GROUP BY ALL),
merged AS (SELECT query_id, item_id, list_concat(coalesce(l, [0.0::DOUBLE, 0.0, 0.0]), coalesce(o, [0.0::DOUBLE, 0.0, 0.0])) AS scores FROM l FULL JOIN o USING (query_id, item_id))
"""
_EVAL = f"""
WITH comb AS ({_run_sql("comb")}), f AS (SELECT DISTINCT post_id, visual_id FROM formulas WHERE visual_id >= 0 AND post_id >= 0),
vr AS (SELECT query_id, visual_id AS item_id, max(score) AS score FROM comb JOIN f ON f.post_id = comb.item_id GROUP BY ALL),
vrun AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM vr),
jud AS (SELECT query_id, visual_id AS item_id, 2.0::DOUBLE * avg(relevance) AS relevance, count(*) AS n_ratings FROM qrels WHERE visual_id >= 0 AND relevance IS NOT NULL GROUP BY ALL),
prim AS (
  SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, item_id) AS INTEGER) AS rank FROM vrun SEMI JOIN jud USING (query_id, item_id)
), graded AS (
  SELECT p.*, relevance FROM prim p JOIN jud USING (query_id, item_id)
)"""
_P10 = """, asked AS (SELECT DISTINCT query_id FROM vrun SEMI JOIN jud USING (query_id)), p10 AS (
  SELECT a.query_id, coalesce(count(*) FILTER (j.relevance >= 2), 0) / 10.0::DOUBLE AS precision, CAST(10 - count(j.relevance) AS BIGINT) AS n_missing
  FROM asked a LEFT JOIN vrun v ON v.query_id = a.query_id AND v.rank <= 10 LEFT JOIN jud j ON j.query_id = v.query_id AND j.item_id = v.item_id GROUP BY a.query_id
)"""
_WEIGHTED = " + ".join([str(fusion.WEIGHTS[0]) + "::DOUBLE", *[f"scores[{i + 1}] * {w}::DOUBLE" for i, w in enumerate(fusion.WEIGHTS[1:])]])
_TERMS = "[lower(w) for w in regexp_extract_all(text, '[A-Za-z0-9]+')]"
_TEXT = f"""
WITH tok AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL)),
item AS (SELECT item_id AS query_id, {_TERMS} AS w FROM benchmark)"""
_TREC = """
WITH h AS (
  SELECT query_id, formula_id AS doc_id, cand_id AS position, slt_str AS expr, scores[1] AS score FROM candidates WHERE formula_id IS NOT NULL AND slt_str IS NOT NULL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank FROM h),
b AS (SELECT *, first_value(expr) OVER (PARTITION BY query_id, doc_id ORDER BY rank, position) AS top FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id, position) AS n FROM b WHERE expr = top)
SELECT query_id, doc_id || ':' || position AS item_id, CAST(n AS INTEGER) AS rank,
  1.0::DOUBLE / dense_rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS score, 'layout' AS run FROM n WHERE n <= 1000"""


def _posts_sql(kinds: str, k: int) -> str:
    return f"""
WITH p AS (
  SELECT c.query_id, f.post_id AS item_id, max(c.scores[1]) AS score FROM candidates c JOIN (SELECT DISTINCT formula_id, post_id FROM formulas WHERE post_id IS NOT NULL {kinds}) f
  USING (formula_id) GROUP BY ALL
) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM p QUALIFY rank <= {k}"""


_TEXT_FUSION = f"""
WITH m AS ({_run_sql("comb")}), o AS ({_run_sql("opt")}), has AS (SELECT DISTINCT query_id, TRUE AS has FROM o)"""
_BOTH = "FROM m FULL JOIN t USING (query_id, item_id) LEFT JOIN has USING (query_id)"

SQL = {
    "merge_models": _MERGED + "SELECT * FROM merged",
    "weighted_combine": _MERGED
    + f"SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT query_id, item_id, round({_WEIGHTED}, {PLACES}) AS score FROM merged)",
    "combined_topk": _MERGED
    + "SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM (SELECT query_id, item_id, round(scores[1], 4) AS score FROM merged) QUALIFY rank <= 10",
    "merge_forms": """
WITH c AS (SELECT cand_id, CASE WHEN slt_str LIKE '[%' THEN slt_str END AS s, CASE WHEN opt_str LIKE '[%' THEN opt_str END AS o FROM candidates)
SELECT cand_id, least(CASE WHEN s IS NULL THEN cand_id ELSE min(cand_id) OVER (PARTITION BY s) END, CASE WHEN o IS NULL THEN cand_id ELSE min(cand_id) OVER (PARTITION BY o) END) AS form FROM c""",
    "combine_metrics": f"""
WITH r AS (SELECT *, 'slt' AS k FROM ({_run_sql("slt")}) UNION ALL SELECT *, 'opt' FROM ({_run_sql("opt")}) UNION ALL SELECT *, 'comb' FROM ({_run_sql("comb")}))
SELECT query_id, item_id, coalesce(max(score) FILTER (k = 'slt'), 0) AS slt, coalesce(max(score) FILTER (k = 'opt'), 0) AS opt, coalesce(max(score) FILTER (k = 'comb'), 0) AS comb FROM r GROUP BY ALL""",
    "minmax_fusion": f"""
WITH a AS ({_run_sql("slt")}), b AS ({_run_sql("opt")}), n AS (
  SELECT query_id, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN score ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM a WINDOW w AS (PARTITION BY query_id)
  UNION ALL
  SELECT query_id, item_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN score ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END FROM b WINDOW w AS (PARTITION BY query_id)
), t AS (SELECT query_id, item_id, round(sum(s), {PLACES}) AS score FROM n WHERE query_id IN (SELECT query_id FROM a) AND query_id IN (SELECT query_id FROM b) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM t QUALIFY rank <= {fusion.RUN_LENGTH}""",
    "dynamic_weight_fusion": _TEXT_FUSION
    + f""", t AS (SELECT query_id, item_id, CASE WHEN max(score) OVER (PARTITION BY query_id) = 0 THEN 0 ELSE score / max(score) OVER (PARTITION BY query_id) END AS t FROM o),
f AS (SELECT query_id, count(*) AS f FROM (SELECT DISTINCT query_id, slt_str FROM candidates) GROUP BY 1), k AS (SELECT query_id, count(*) AS k FROM (SELECT DISTINCT query_id, visual_id FROM qrels) GROUP BY 1),
w AS (SELECT query_id, coalesce(f, 0) / (coalesce(f, 0) + coalesce(k, 0))::DOUBLE AS w FROM f FULL JOIN k USING (query_id))
SELECT query_id, item_id AS doc_id, round(coalesce(w, 0) * coalesce(m.score, 0) + (1 - coalesce(w, 0)) * CASE WHEN has THEN coalesce(t.t, 0) ELSE 1 END, {PLACES}) AS score {_BOTH} LEFT JOIN w USING (query_id)""",
    "fixed_weight_fusion": _TEXT_FUSION
    + f", t AS (SELECT query_id, item_id, score AS t FROM o) SELECT query_id, item_id AS doc_id, round(0.75::DOUBLE * coalesce(m.score, 0) + (1 - 0.75::DOUBLE) * CASE WHEN has THEN coalesce(t.t, 0) ELSE 1 END, {PLACES}) AS score {_BOTH}",
    "combine_formulas": f"""
WITH c AS (SELECT * FROM candidates WHERE formula_id IS NOT NULL), best AS (
  SELECT query_id, 0 AS n, formula_id AS doc_id, max(scores[1:3]) AS s FROM c GROUP BY ALL UNION ALL SELECT query_id, 1, formula_id, max(scores[4:6]) FROM c GROUP BY ALL
), q AS (
  SELECT query_id, 0 AS n, length(regexp_replace(max(slt_str), '[^\\[]', '', 'g')) AS z FROM c WHERE slt_str LIKE '[%' GROUP BY query_id
  UNION ALL SELECT query_id, 1, length(regexp_replace(max(opt_str), '[^\\[]', '', 'g')) FROM c WHERE opt_str LIKE '[%' GROUP BY query_id
), w AS (SELECT query_id, n, z / sum(z) OVER (PARTITION BY query_id) AS w FROM q)
SELECT query_id, doc_id, [round(sum(w * s[1]), {PLACES}), round(sum(w * s[2]), {PLACES}), round(sum(w * s[3]), {PLACES})] AS scores FROM best JOIN w USING (query_id, n) GROUP BY query_id, doc_id""",
    "padded_output": f"""
WITH a AS ({_run_sql("slt")}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM a QUALIFY rank <= 20),
n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, min(score) OVER (PARTITION BY query_id) AS low FROM r)
SELECT query_id, item_id, CASE WHEN k = 0 THEN score ELSE low END AS score, CAST(rank + k * n AS INTEGER) AS rank FROM n, (SELECT unnest(range(50)) AS k) WHERE rank + k * n <= 50""",
    "qrel_aggregate": _EVAL + f"SELECT query_id, item_id, round(relevance, {PLACES}) AS relevance, n_ratings FROM jud",
    "visual_run": _EVAL + "SELECT * FROM vrun",
    "prim_filter": _EVAL + "SELECT * FROM prim",
    "p_at_10": _EVAL + _P10 + "SELECT * FROM p10",
    "p_at_10_groups": _EVAL + _P10 + f"SELECT split_part(query_id, '.', 1) AS grp, round(avg(precision), {PLACES}) AS precision FROM p10 GROUP BY ROLLUP (1)",
    "ndcg_prime": _EVAL
    + f""", got AS (SELECT query_id, sum(CASE WHEN rank = 1 THEN relevance ELSE relevance / log2(rank) END) AS g FROM graded WHERE rank <= 1000 GROUP BY query_id),
ideal AS (SELECT query_id, sum(CASE WHEN p = 1 THEN relevance ELSE relevance / log2(p) END) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) AS p FROM jud) WHERE p <= 1000 GROUP BY query_id)
SELECT query_id, round(CASE WHEN i > 0 THEN g / i ELSE 1 END, {PLACES}) AS ndcg FROM got JOIN ideal USING (query_id)""",
    "map_prime": _EVAL
    + f""", hit AS (SELECT *, sum(CASE WHEN relevance >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM graded),
per AS (SELECT query_id, sum(upto / rank::DOUBLE) FILTER (relevance >= 2) AS s FROM hit GROUP BY query_id),
rel AS (SELECT query_id, count(*) AS n FROM jud WHERE relevance >= 2 GROUP BY query_id)
SELECT query_id, round(coalesce(s, 0) / n, {PLACES}) AS ap FROM rel LEFT JOIN per USING (query_id)""",
    "bpref": _EVAL
    + f""", n AS (SELECT query_id, count(*) FILTER (relevance >= 1) AS r, count(*) FILTER (relevance < 1) AS n FROM jud GROUP BY query_id),
b AS (SELECT *, count(*) FILTER (relevance < 1) OVER (PARTITION BY query_id ORDER BY rank) AS b FROM graded),
per AS (SELECT query_id, sum(CASE WHEN least(r, n) = 0 THEN 1.0::DOUBLE ELSE greatest(1 - least(b, r) / least(r, n)::DOUBLE, 0) END) AS s FROM b JOIN n USING (query_id) WHERE relevance >= 1 GROUP BY query_id)
SELECT query_id, round(coalesce(s, 0) / r, {PLACES}) AS bpref FROM n LEFT JOIN per USING (query_id) WHERE r > 0""",
    "ideal_ranking": _EVAL + f"SELECT query_id, item_id, round(relevance, {PLACES}) AS relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, item_id DESC) AS INTEGER) AS rank FROM jud",
    "trec_dense_score": _TREC,
    "formulas_to_answers": _posts_sql("AND post_kind = 'answer'", 1000),
    "formulas_to_all_posts": _posts_sql("", 1001),
    "visual_dedup": """
WITH jud AS (SELECT DISTINCT query_id, visual_id FROM qrels WHERE visual_id >= 0 AND relevance IS NOT NULL),
tree AS (SELECT visual_id, max(slt_string) AS slt FROM visuals WHERE slt_string LIKE '[%' GROUP BY 1),
bs AS (SELECT slt_string AS slt, max(visual_id) AS vs FROM visuals WHERE slt_string <> 'None' GROUP BY 1),
bt AS (SELECT latex_string AS tex, max(visual_id) AS vt FROM visuals WHERE slt_string IS NULL OR slt_string = 'None' GROUP BY 1),
named AS (SELECT DISTINCT f.formula_id, coalesce(vs, vt) AS v FROM formulas f LEFT JOIN tree USING (visual_id) LEFT JOIN bs USING (slt) LEFT JOIN bt ON bt.tex = f.formula WHERE coalesce(vs, vt) IS NOT NULL),
best AS (SELECT c.query_id, v AS item_id, max(c.scores[1]) AS score FROM candidates c JOIN named USING (formula_id) GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM best SEMI JOIN jud ON jud.query_id = best.query_id AND jud.visual_id = best.item_id""",
    "best_per_doc": """
WITH c AS (SELECT query_id, cand_id, formula_id AS doc_id, scores[1] AS score FROM candidates)
SELECT * FROM c QUALIFY score = max(score) OVER (PARTITION BY query_id, doc_id)""",
    "relevance_spread": _EVAL
    + f"""SELECT relevance, count(score) AS n, round(min(score), {PLACES}) AS low, round(quantile_cont(score, 0.25), {PLACES}) AS q1, round(quantile_cont(score, 0.5), {PLACES}) AS q2,
round(quantile_cont(score, 0.75), {PLACES}) AS q3, round(max(score), {PLACES}) AS high FROM graded GROUP BY relevance""",
    "group_rank": """
WITH c AS (SELECT query_id, slt_str AS expr, max(scores[1:3]) AS s FROM candidates WHERE slt_str LIKE '[%' GROUP BY ALL)
SELECT query_id, expr, CAST(dense_rank() OVER w AS INTEGER) AS "group", CAST(rank() OVER w - 1 AS INTEGER) AS abs_rank FROM c WINDOW w AS (PARTITION BY query_id ORDER BY s DESC)""",
    "doc_rank": """
SELECT query_id, formula_id AS doc_id, max([round(scores[1], 4), round(scores[2], 4), round(scores[3], 4)]) AS best, round(sum(round(scores[1], 4)), 6) AS total
FROM candidates WHERE formula_id IS NOT NULL GROUP BY query_id, formula_id""",
    "tfidf_topk": _TEXT
    + """, q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(w) AS term FROM item) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM tok),
s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + n::DOUBLE / df) * (1 + ln(tf))), 9) AS score FROM q JOIN df USING (term) JOIN tf USING (term), n GROUP BY query_id, doc_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "keyword_positions": _TEXT
    + """SELECT k.query_id, doc_id, term, list(pos::INTEGER ORDER BY pos) AS positions FROM (SELECT query_id, unnest(list_distinct(w)) AS term FROM item) k JOIN tok USING (term) GROUP BY ALL""",
    "phrase_positions": _TEXT
    + """, gram AS (
  SELECT doc_id, pos, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) || ' ' || lead(term, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM tok
), asked AS (
  SELECT query_id * 1000 + i - 1 AS query_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT query_id, w, unnest(range(1, len(w) - 1)) AS i FROM item)
) SELECT query_id, doc_id, CAST(pos AS INTEGER) AS pos FROM asked JOIN gram USING (g)""",
}
