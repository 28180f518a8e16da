"""Indexing and search over the driver's tables: formula strings of ``visuals`` and ``candidates``, texts as chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.operators import documents, rerank, retrieve, text, tuples
from glyphgrove.operators import index as indexing
from glyphgrove.runtime import spread, table

TOP_K = 10
#: Expressions of each query that the second stage aligns.
RERANKED = 1000
#: Formulas that are asked for: those whose id this divides.
ASKED = 100


def _tree_strings(df: DataFrame, ident: str, expr: str) -> DataFrame:
    """``doc_id, position, expr`` of the rows that hold a tree."""
    return df.select(F.col(ident).alias("doc_id"), F.lit(0).alias("position"), F.col(expr).alias("expr")).filter(F.col("expr").startswith("[")).distinct()


def _visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_strings(table(spark, sf_dir, "visuals"), "visual_id", "slt_string")


def _operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_strings(table(spark, sf_dir, "candidates"), "cand_id", "opt_str")


def _chains(spark: SparkSession, sf_dir: str, name: str, ident: str) -> DataFrame:
    words = text.terms(F.col("text"))
    t = spread(table(spark, sf_dir, name).select(ident, "text"), ident).select(F.col(ident).alias("doc_id"), words.alias("words")).filter(F.size("words") > 0)
    return t.select("doc_id", F.lit(0).alias("position"), tuples.chain_tree(F.col("words")).alias("expr"))


def _asked(occ: DataFrame) -> DataFrame:
    return occ.filter(F.col("doc_id") % ASKED == 0).select(F.col("doc_id").alias("query_id"), "expr")


def _tuples(occ: DataFrame, **options) -> DataFrame:
    t = tuples.tuple_table(occ.select("expr").distinct(), [], **options)
    return t.groupBy(F.col("from").alias("from_tag"), F.col("to").alias("to_tag"), "rel").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_exprs"))


def slt_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _visuals(spark, sf_dir).select("expr").distinct().select("expr", F.explode(tuples.nodes_column(F.col("expr"))).alias("n"))
    return nodes.select("expr", "n.path", "n.tag", "n.depth")


def slt_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(_visuals(spark, sf_dir))


def slt_tuples_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _visuals(spark, sf_dir).select("expr").distinct().select("expr", tuples.nodes_column(F.col("expr")).alias("nodes"))
    t = nodes.select("expr", F.explode(tuples.prefix_join(F.col("nodes"))).alias("t")).groupBy("expr", "t").agg(F.count("*").alias("cnt"))
    return t.groupBy(F.col("t.from").alias("from_tag"), F.col("t.to").alias("to_tag"), F.col("t.rel").alias("rel")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n_exprs"))


def opt_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(_operators(spark, sf_dir))


def opt_tuples_all_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(_operators(spark, sf_dir), window=2, eob="all")


def slt_tuples_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(_visuals(spark, sf_dir), window=0, eob="none")


def chain_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tuples(_chains(spark, sf_dir, "documents", "doc_id"))


def count_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _visuals(spark, sf_dir).select("expr").distinct().select("expr", tuples.nodes_column(F.col("expr")).alias("nodes"))
    return nodes.select("expr", F.aggregate("nodes", F.lit(0), lambda a, n: a + F.least(n["depth"], F.lit(4))).cast("bigint").alias("n_pairs"))


def expr_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "formulas").filter("post_id IS NOT NULL AND formula IS NOT NULL")
    occ = f.select(F.col("post_id").alias("doc_id"), F.col("formula_id").alias("position"), F.col("formula").alias("expr")).distinct()
    return documents.grouped_positions(occ)


def element_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.scan_elements(table(spark, sf_dir, "documents"), "p", content="text")


def file_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents.dispatch(table(spark, sf_dir, "doc_list"), name="path")
    return d.groupBy("kind").agg(F.count("*").alias("n"))


def _index(spark: SparkSession, sf_dir: str) -> indexing.Index:
    return indexing.build(_visuals(spark, sf_dir))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.statistics(_index(spark, sf_dir))


def index_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.distribution(_index(spark, sf_dir))


def posting_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.consistency(_index(spark, sf_dir))


def _search(occ: DataFrame, asked: DataFrame, **options) -> tuple[indexing.Index, DataFrame]:
    index = indexing.build(occ)
    return index, retrieve.search(index, retrieve.Queries(asked), TOP_K, **options)


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.shiftright("expr_id", 22).alias("first_doc"), F.round("score", 9).alias("score"), "rank")


def slt_dice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _visuals(spark, sf_dir)
    return _shown(_search(occ, _asked(occ))[1])


def slt_dice_topk_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _visuals(spark, sf_dir)
    return _shown(retrieve.search_bounded(indexing.build(occ), retrieve.Queries(_asked(occ)), TOP_K))


def opt_dice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _operators(spark, sf_dir)
    return _shown(_search(occ, _asked(occ))[1])


def dice_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _chains(spark, sf_dir, "benchmark", "item_id").select(F.col("doc_id").alias("query_id"), "expr")
    return _shown(_search(_chains(spark, sf_dir, "documents", "doc_id"), asked)[1])


def hits_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _visuals(spark, sf_dir)
    index, hits = _search(occ, _asked(occ))
    return retrieve.expand_hits(index, hits).select("query_id", "doc_id", "expr", F.round("score", 9).alias("score"), "rank")


def dice_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _visuals(spark, sf_dir)
    return retrieve.counters(indexing.build(occ), retrieve.Queries(_asked(occ)))


def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _tree_strings(table(spark, sf_dir, "candidates"), "cand_id", "slt_str")
    hits = retrieve.exact_match(indexing.build(occ), _asked(occ))
    return hits.select("query_id", F.shiftright("expr_id", 22).alias("first_doc"), "score")


def wildcard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first variable of each query becomes a wildcard wherever it occurs."""
    occ = _visuals(spark, sf_dir)
    name = F.regexp_extract("expr", r"\[(V![a-z])[\[\],]", 1)
    asked = _asked(occ).withColumn("_v", name).filter("_v <> ''")
    asked = asked.select("query_id", F.replace(F.replace(F.replace("expr", F.concat(F.lit("["), "_v", F.lit("[")), F.lit("[?w[")), F.concat(F.lit("["), "_v", F.lit("]")), F.lit("[?w]")), F.concat(F.lit("["), "_v", F.lit(",")), F.lit("[?w,")).alias("expr"))
    return _shown(_search(occ, asked, wildcards=True)[1])


def _reranked(spark: SparkSession, sf_dir: str, metric: int = 12) -> DataFrame:
    occ = _visuals(spark, sf_dir)
    asked = _asked(occ)
    index = indexing.build(occ)
    hits = retrieve.search(index, retrieve.Queries(asked), RERANKED)
    return rerank.rerank(retrieve.expand_hits(index, hits), asked, metric)


def align_metric12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "doc_id", "expr", F.transform("scores", lambda s: F.round(s, 9)).alias("scores"), "rank")


def align_metric6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, 6).select("query_id", "doc_id", "expr", F.transform("scores", lambda s: F.round(s, 9)).alias("scores"), "rank")


def pair_metric0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir, 0).select("query_id", "doc_id", "expr", F.transform("scores", lambda s: F.round(s, 9)).alias("scores"), "rank")


def opt_align_metric12(spark: SparkSession, sf_dir: str) -> DataFrame:
    occ = _operators(spark, sf_dir)
    asked = _asked(occ)
    index = indexing.build(occ)
    hits = retrieve.search(index, retrieve.Queries(asked), RERANKED)
    r = rerank.rerank(retrieve.expand_hits(index, hits), asked)
    return r.select("query_id", "doc_id", "expr", F.transform("scores", lambda s: F.round(s, 9)).alias("scores"), "rank")


def rerank_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.group_ranks(_reranked(spark, sf_dir)).select("query_id", "expr", "group", "subgroup", "place", "abs_rank")


def rerank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.document_ranks(_reranked(spark, sf_dir)).select("query_id", "doc_id", F.transform("best", lambda s: F.round(s, 9)).alias("best"), F.round("total", 9).alias("total"), "rank")


QUERIES = {
    f.__name__: f
    for f in (
        slt_nodes, slt_tuples, slt_tuples_prefix_join, opt_tuples, opt_tuples_all_ends, slt_tuples_unbounded, chain_tuples, count_pairs,
        expr_positions, element_scan, file_dispatch, index_stats, index_distribution, posting_totals, slt_dice_topk, slt_dice_topk_bounded,
        opt_dice_topk, dice_topk, hits_expanded, dice_counters, exact_match, wildcard_topk, align_metric12, align_metric6, pair_metric0,
        opt_align_metric12, rerank_groups, rerank_documents,
    )
}


# SQL twins: trees are parsed by bracket depth, independently of the Python parser ----------------------------

_SLT = "SELECT DISTINCT visual_id AS doc_id, slt_string AS expr FROM visuals WHERE slt_string LIKE '[%'"
_OPT = "SELECT DISTINCT cand_id AS doc_id, opt_str AS expr FROM candidates WHERE opt_str LIKE '[%'"
_WORDS = "[lower(w) for w in regexp_extract_all(text, '[A-Za-z0-9]+')]"


def _trees(occurrences: str) -> str:
    return f"""
WITH RECURSIVE occ AS ({occurrences}), exprs AS (SELECT DISTINCT expr FROM occ), tok AS (
  SELECT expr, unnest(t) AS t, generate_subscripts(t, 1) AS i
  FROM (SELECT expr, regexp_extract_all(expr, '(?:,[0-9A-Za-z])?\\[[^\\[\\],]*|\\]') AS t FROM exprs)
), dep AS (
  SELECT expr, i, t, sum(CASE WHEN t = ']' THEN -1 ELSE 1 END) OVER (PARTITION BY expr ORDER BY i) AS d FROM tok
), op AS (
  SELECT expr, i, d, regexp_replace(t, '^(,.)?\\[', '') AS tag, CASE WHEN t LIKE ',%' THEN substr(t, 2, 1) ELSE 'n' END AS label FROM dep WHERE t <> ']'
), par AS (
  SELECT a.expr, a.i, a.d, a.tag, a.label, max(b.i) AS p FROM op a LEFT JOIN op b ON a.expr = b.expr AND b.d = a.d - 1 AND b.i < a.i GROUP BY ALL
), node AS (
  SELECT expr, i, d, tag, '' AS path, '' AS cpath FROM par WHERE d = 1
  UNION ALL
  SELECT c.expr, c.i, c.d, c.tag, n.path || c.label, n.cpath || CASE WHEN n.tag LIKE 'U!%' THEN '0' ELSE c.label END
  FROM node n JOIN par c ON c.expr = n.expr AND c.p = n.i AND c.d = n.d + 1
), kind AS (
  SELECT expr, max(length(path)) AS height, bool_or(path = '0') AS operator FROM node GROUP BY expr
)"""


def _pairs(window: int = 4, eob: str = "small") -> str:
    ends = {"small": "k.height <= 1", "all": "TRUE", "none": "FALSE"}[eob]
    far = f"AND length(y.path) - length(x.path) <= {window}" if window else ""
    return f""", pair AS (
  SELECT x.expr, x.tag AS from_tag, y.tag AS to_tag, substr(y.cpath, length(x.path) + 1) AS rel
  FROM node x JOIN node y ON x.expr = y.expr AND starts_with(y.path, x.path) AND length(y.path) > length(x.path) {far}
  WHERE NOT (y.tag LIKE 'E!%' AND y.path LIKE '%w')
  UNION ALL
  SELECT x.expr, x.tag, '0!', CASE WHEN k.operator THEN '0' ELSE 'n' END
  FROM node x JOIN kind k ON k.expr = x.expr
  WHERE {ends} AND x.tag NOT LIKE 'E!%' AND NOT EXISTS (
    SELECT 1 FROM node y WHERE y.expr = x.expr AND y.path = x.path || CASE WHEN k.operator THEN '0' ELSE 'n' END)
), tup AS (
  SELECT expr, from_tag, to_tag, rel, count(*) AS cnt FROM pair GROUP BY ALL
)"""


_CHAIN_TUPLES = f"""
WITH occ AS (
  SELECT doc_id, {_WORDS} AS expr FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[A-Za-z0-9]+')) > 0
), exprs AS (SELECT DISTINCT expr FROM occ), tok AS (
  SELECT expr, unnest(expr) AS tag, generate_subscripts(expr, 1) AS i FROM exprs
), pair AS (
  SELECT x.expr, x.tag AS from_tag, y.tag AS to_tag, repeat('n', CAST(y.i - x.i AS INTEGER)) AS rel FROM tok x JOIN tok y ON x.expr = y.expr AND y.i IN (x.i + 1, x.i + 2, x.i + 3, x.i + 4)
  UNION ALL SELECT expr, tag, '0!', 'n' FROM tok WHERE len(expr) <= 2 AND i = len(expr)
), tup AS (
  SELECT expr, from_tag, to_tag, rel, count(*) AS cnt FROM pair GROUP BY ALL
)"""
_SUMMED = " SELECT from_tag, to_tag, rel, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_exprs FROM tup GROUP BY from_tag, to_tag, rel"

_RANKED = f""", size AS (SELECT expr, sum(cnt) AS tc FROM tup GROUP BY expr),
ident AS (SELECT expr, min(doc_id) AS first_doc FROM occ GROUP BY expr),
common AS (
  SELECT q.query_id, p.expr, sum(least(p.cnt, q.cnt)) AS common FROM qtup q JOIN tup p USING (from_tag, to_tag, rel) GROUP BY ALL
), hit AS (
  SELECT c.query_id, i.first_doc, c.expr, 2.0::DOUBLE * c.common / (s.tc + q.qtc) AS score
  FROM common c JOIN size s USING (expr) JOIN ident i USING (expr) JOIN (SELECT query_id, sum(cnt) AS qtc FROM qtup GROUP BY query_id) q USING (query_id)
), best AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_doc) AS INTEGER) AS rank FROM hit QUALIFY rank <= {TOP_K}
)"""
_ASKED = f", asked AS (SELECT doc_id AS query_id, expr FROM occ WHERE doc_id % {ASKED} = 0), qtup AS (SELECT a.query_id, t.from_tag, t.to_tag, t.rel, t.cnt FROM asked a JOIN tup t USING (expr))"
_SHOWN = " SELECT query_id, first_doc, round(score, 9) AS score, rank FROM best"
_SEARCH_SLT = _trees(_SLT) + _pairs() + _ASKED + _RANKED
_INDEXED = _trees(_SLT) + _pairs() + ", size AS (SELECT expr, sum(cnt) AS tc FROM tup GROUP BY expr)"
_QUERY_CHAINS = f""", qtok AS (
  SELECT item_id AS query_id, unnest(w) AS tag, generate_subscripts(w, 1) AS i, len(w) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)
), qpair AS (
  SELECT x.query_id, x.tag AS from_tag, y.tag AS to_tag, repeat('n', CAST(y.i - x.i AS INTEGER)) AS rel FROM qtok x JOIN qtok y ON x.query_id = y.query_id AND y.i IN (x.i + 1, x.i + 2, x.i + 3, x.i + 4)
  UNION ALL SELECT query_id, tag, '0!', 'n' FROM qtok WHERE n <= 2 AND i = n
), qtup AS (SELECT query_id, from_tag, to_tag, rel, count(*) AS cnt FROM qpair GROUP BY ALL)"""

#: Hits of the second stage, and shared pairs of both trees; trees of one node only have an end of baseline.
_SECOND = _SEARCH_SLT.replace(f"rank <= {TOP_K}", f"rank <= {RERANKED}")
_PLAIN = _pairs(4, "none").replace("pair AS", "pair0 AS").replace("tup AS", "tup0 AS").replace("FROM pair GROUP", "FROM pair0 GROUP")
_ENDED = _pairs(4, "all").replace("pair AS", "pair1 AS").replace("tup AS", "tup1 AS").replace("FROM pair GROUP", "FROM pair1 GROUP")
_PAIR_DICE = """, asked2 AS (
  SELECT query_id, expr, height = 0 AS single FROM asked JOIN kind USING (expr)
), used AS (
  SELECT expr, FALSE AS single, from_tag, to_tag, rel, cnt FROM tup0 UNION ALL SELECT expr, TRUE, from_tag, to_tag, rel, cnt FROM tup1
), n_used AS (SELECT expr, single, sum(cnt) AS n FROM used GROUP BY ALL),
shared AS (
  SELECT b.query_id, b.expr, sum(least(x.cnt, y.cnt)) AS n FROM best b JOIN asked2 a USING (query_id) JOIN used x ON x.expr = a.expr AND x.single = a.single
  JOIN used y ON y.expr = b.expr AND y.single = a.single AND y.from_tag = x.from_tag AND y.to_tag = x.to_tag AND y.rel = x.rel GROUP BY ALL
)
SELECT b.query_id, o.doc_id, b.expr, [round(coalesce(2.0::DOUBLE * s.n / (p.n + r.n), 0), 9)] AS scores, b.rank
FROM best b JOIN occ o USING (expr) JOIN asked2 a USING (query_id) LEFT JOIN shared s ON s.query_id = b.query_id AND s.expr = b.expr
LEFT JOIN n_used p ON p.expr = a.expr AND p.single = a.single LEFT JOIN n_used r ON r.expr = b.expr AND r.single = a.single"""

SQL = {
    "pair_metric0": _SECOND + _PLAIN + _ENDED + _PAIR_DICE,
    "slt_nodes": _trees(_SLT) + " SELECT expr, path, tag, CAST(length(path) AS INTEGER) AS depth FROM node",
    "slt_tuples": _trees(_SLT) + _pairs() + _SUMMED,
    "slt_tuples_prefix_join": _trees(_SLT) + _pairs() + _SUMMED,
    "opt_tuples": _trees(_OPT) + _pairs() + _SUMMED,
    "opt_tuples_all_ends": _trees(_OPT) + _pairs(2, "all") + _SUMMED,
    "slt_tuples_unbounded": _trees(_SLT) + _pairs(0, "none") + _SUMMED,
    "chain_tuples": _CHAIN_TUPLES + _SUMMED,
    "count_pairs": _trees(_SLT) + " SELECT expr, CAST(sum(least(length(path), 4)) AS BIGINT) AS n_pairs FROM node GROUP BY expr",
    "expr_positions": """SELECT doc_id, expr, list(position ORDER BY position) AS positions FROM (
  SELECT DISTINCT post_id AS doc_id, formula_id AS position, formula AS expr FROM formulas WHERE post_id IS NOT NULL AND formula IS NOT NULL
) GROUP BY doc_id, expr""",
    "element_scan": r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, element FROM (
  SELECT doc_id, unnest(e) AS element, generate_subscripts(e, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '(?s)<p(?:\s[^>]*)?>.*?</p>') AS e FROM documents WHERE text IS NOT NULL))""",
    "file_dispatch": r"""SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN e IN ('xhtml', 'mathml', 'mml', 'html') THEN 'markup' WHEN e = 'tex' THEN 'latex' END AS kind
  FROM (SELECT lower(regexp_extract(path, '\.([^./]+)$', 1)) AS e FROM doc_list)) GROUP BY kind""",
    "index_stats": _INDEXED + """ SELECT * FROM (
  SELECT 'n_expressions' AS metric, count(*)::BIGINT AS value FROM size UNION ALL SELECT 'n_tuples', sum(tc)::BIGINT FROM size
  UNION ALL SELECT 'tc_q1', quantile_disc(tc, 0.25)::BIGINT FROM size UNION ALL SELECT 'tc_q2', quantile_disc(tc, 0.5)::BIGINT FROM size
  UNION ALL SELECT 'tc_q3', quantile_disc(tc, 0.75)::BIGINT FROM size UNION ALL SELECT 'tc_max', max(tc)::BIGINT FROM size
  UNION ALL SELECT 'n_distinct_tuples', count(DISTINCT (from_tag, to_tag, rel)) FROM tup UNION ALL SELECT 'n_relations', count(DISTINCT rel) FROM tup
  UNION ALL SELECT 'n_postings', count(*) FROM tup
  UNION ALL SELECT 'n_terms', count(DISTINCT t) FROM (SELECT from_tag AS t FROM tup UNION ALL SELECT to_tag FROM tup)
  UNION ALL SELECT 'n_documents', count(DISTINCT doc_id) FROM occ UNION ALL SELECT 'n_occurrences', count(*) FROM occ)""",
    "index_distribution": _INDEXED + """, ends AS (SELECT min(tc) AS lo, max(tc) AS hi FROM size)
SELECT CAST(floor((tc - lo) * 20 / (hi - lo + 1)) AS INTEGER) AS bin, min(tc)::BIGINT AS low, max(tc)::BIGINT AS high, count(*) AS n_expressions FROM size, ends GROUP BY 1""",
    "posting_totals": _INDEXED + " SELECT 'n_tuples' AS metric, sum(tc)::BIGINT AS value FROM size UNION ALL SELECT 'n_posted', sum(cnt)::BIGINT FROM tup",
    "slt_dice_topk": _SEARCH_SLT + _SHOWN,
    "slt_dice_topk_bounded": _SEARCH_SLT + _SHOWN,
    "opt_dice_topk": _trees(_OPT) + _pairs() + _ASKED + _RANKED + _SHOWN,
    "dice_topk": _CHAIN_TUPLES + _QUERY_CHAINS + _RANKED + _SHOWN,
    "hits_expanded": _SEARCH_SLT + " SELECT query_id, doc_id, expr, round(score, 9) AS score, rank FROM best JOIN occ USING (expr)",
    "dice_counters": _trees(_SLT) + _pairs() + _ASKED + """, met AS (
  SELECT q.query_id, t.expr, count(*) AS n FROM qtup q JOIN tup t USING (from_tag, to_tag, rel) GROUP BY ALL
) SELECT query_id, CAST((SELECT sum(n) FROM met m WHERE m.query_id = x.query_id) AS BIGINT) AS n_postings, count(DISTINCT expr) AS n_expressions, count(DISTINCT doc_id) AS n_documents
FROM met x JOIN occ USING (expr) GROUP BY query_id""",
    "exact_match": f"""WITH occ AS (SELECT cand_id AS doc_id, slt_str AS expr FROM candidates WHERE slt_str LIKE '[%'),
ident AS (SELECT expr, min(doc_id) AS first_doc FROM occ GROUP BY expr)
SELECT doc_id AS query_id, first_doc, 1.0::DOUBLE AS score FROM occ JOIN ident USING (expr) WHERE doc_id % {ASKED} = 0""",
}
