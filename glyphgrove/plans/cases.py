"""Queries over small literal tables of markup, trees and topics, whose results are known beforehand.

The driver's tables hold no markup, so parsing, alignment and scores are shown here: each query computes its rows from the
inputs alone, and its SQL states the rows that the rules of the formats give, worked out by hand, or that were published.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.functions import report
from glyphgrove.functions.stem import stem_column
from glyphgrove.operators import documents, evaluate, fusion, rerank, retrieve
from glyphgrove.operators import index as indexing
from glyphgrove.plans.literals import FAILING, LAYOUT, OPERATOR, PAIRS, PLACES, PUBLISHED_PAIRS, SCANNED, SCORES, STEMS, TOPICS
from glyphgrove.runtime import checkpoint_dir
from glyphgrove.sources import documents as sources

MATH = "<math xmlns='http://www.w3.org/1998/Math/MathML'>{}</math>"


def _docs(spark: SparkSession, contents: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(contents)), "doc_id bigint, content string")


def _parsed(spark: SparkSession, contents: list[str], operator: bool) -> DataFrame:
    return documents.parse_formulas(documents.scan_formulas(_docs(spark, contents)), operator=operator)


def layout_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout trees of presentation markup; empty formulas give no rows."""
    return documents.occurrences(_parsed(spark, [MATH.format(x) for x, _ in LAYOUT], False)).select("doc_id", "position", "expr")


def operator_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator trees of content markup."""
    return documents.occurrences(_parsed(spark, [MATH.format(x) for x, _ in OPERATOR], True)).select("doc_id", "position", "expr")


def parse_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a formula that fails are left out whole; their numbers and those of their formulas that would do."""
    good = MATH.format("<ci>x</ci>")
    parsed = _parsed(spark, [good + MATH.format(x) + good for x in FAILING] + [good], True)
    kept = documents.occurrences(parsed).groupBy("doc_id").agg(F.count("*").alias("n_kept"))
    per = parsed.groupBy("doc_id").agg(F.count("error").alias("n_failed"), F.count("expr").alias("n_parsed"))
    return per.join(kept, "doc_id", "left").select("doc_id", "n_failed", "n_parsed", F.coalesce("n_kept", F.lit(0)).alias("n_kept"))


def formula_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of texts in markup and LaTeX, with the id of the first element."""
    found = documents.scan_formulas(_docs(spark, [t for t, _ in SCANNED]))
    return found.select("doc_id", "position", "formula", documents.formula_id(F.col("formula")).alias("xml_id"))


def index_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuples of the layout trees, straight from markup: scan, parse, occurrences, index."""
    occ = documents.occurrences(_parsed(spark, [MATH.format(x) for x, _ in LAYOUT[:2]], False))
    p = indexing.build(occ, window=2).postings
    return p.select(F.shiftright("expr_id", 22).alias("doc_id"), F.col("from").alias("from_tag"), F.col("to").alias("to_tag"), "rel", F.col("cnt").cast("bigint").alias("cnt"))


def topics_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas and keywords of a topics file, one row each."""
    path = f"{checkpoint_dir(spark)}/topics-{uuid.uuid4().hex}"
    spark.createDataFrame([(TOPICS,)], "value string").coalesce(1).write.text(path)
    formulas, keywords = sources.read_topics(spark, path)
    return formulas.select("query_id", F.concat(F.lit("formula "), "expr_no").alias("part"), F.col("expr").alias("value")).unionByName(
        keywords.select("query_id", F.lit("keyword").alias("part"), F.col("term").alias("value"))
    )


def _hits(spark: SparkSession, pairs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """One query for each pair, with its only hit."""
    rows = [(n, c, q, k) for n, (q, c, k) in enumerate(pairs)]
    t = spark.createDataFrame(rows, "query_id bigint, expr string, query string, rule string")
    hits = t.select("query_id", F.col("query_id").alias("doc_id"), F.lit(0).alias("position"), "expr", F.lit(1.0).alias("score"), F.lit(1).alias("rank"))
    return hits, t.select("query_id", F.col("query").alias("expr"), "rule")


def align_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors of pairs of trees by every metric that the SQL lists for them."""
    hits, queries = _hits(spark, PAIRS)
    out = None
    for metric in sorted({m for _, m, _ in SCORES}):
        wanted = [n for n, m, _ in SCORES if m == metric]
        part = rerank.rerank(hits.filter(F.col("query_id").isin(wanted)), queries, metric, constraint="rule")
        part = part.select("query_id", F.lit(metric).alias("metric"), F.transform("scores", lambda s: F.round(s, 9) + 0.0).alias("scores"))
        out = part if out is None else out.unionByName(part)
    return out


def align_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched places of both trees, by metric 12."""
    r = rerank.rerank(*_hits(spark, PAIRS), 12, constraint="rule")
    return r.select("query_id", *[F.array_join(c, " ").alias(c) for c in ("q_exact", "q_unified", "q_wild", "c_exact", "c_unified", "c_wild")])


def align_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published first- and second-stage scores of one query's candidates."""
    hits, queries = _hits(spark, [(q, c, None) for q, c, _, _ in PUBLISHED_PAIRS])
    first = rerank.rerank(hits, queries, -1).count()
    r = rerank.rerank(hits, queries, 12)
    return r.filter(F.lit(first) == len(PUBLISHED_PAIRS)).select("query_id", F.transform("scores", lambda s: F.round(s, 9)).alias("scores"))


def match_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result pages: how many symbols they show, of query and candidate, and how many of them are coloured."""
    hits, queries = _hits(spark, PAIRS)
    p = report.match_page(rerank.rerank(hits, queries, 12, constraint="rule"), queries)
    times = lambda s: F.expr(f"regexp_count(html, '{s}')").cast("bigint")
    return p.select("query_id", times("<span").alias("n_symbols"), times("background").alias("n_coloured"))


def metrics_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First scores of several metrics side by side."""
    hits, queries = _hits(spark, PAIRS[:2])
    t = rerank.metric_table(hits, queries, [0, 1, 4, 12])
    return t.select("query_id", *[F.round(f"m{m}", 9).alias(f"m{m}") for m in (0, 1, 4, 12)])


def stem_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the examples that the published algorithm gives for its steps."""
    words = spark.createDataFrame([(w,) for w, _ in STEMS], "word string")
    return words.select("word", F.get(stem_column(F.array("word")), F.lit(0)).alias("stem"))


def wildcard_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcard tuples over three expressions."""
    occ = spark.createDataFrame([(0, 0, "[V!a[+[V!b]]]"), (1, 0, "[V!a[-[V!c]]]"), (2, 0, "[V!a[+[V!a]]]")], "doc_id bigint, position int, expr string")
    asked = spark.createDataFrame([(1, "[V!a[+[?w]]]"), (2, "[?w[+[V!b]]]"), (3, "[V!a[+[V!b]]]")], "query_id bigint, expr string")
    hits = retrieve.search(indexing.build(occ), retrieve.Queries(asked), 10, wildcards=True)
    return hits.select("query_id", F.shiftright("expr_id", 22).alias("doc_id"), F.round("score", 9).alias("score"), "rank")


def compat_order_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores ordered as numbers, and as the texts that older runs were ordered by."""
    run = spark.createDataFrame([("q", i, s) for i, s in enumerate((10.0, 9.5, 1.0, 9.5))], "query_id string, item_id int, score double")
    old = fusion.ranked(run, compat=True).select("item_id", F.col("rank").alias("old_rank"))
    return fusion.ranked(run).select("item_id", "rank").join(old, "item_id")


def documents_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their best vector, then by the sum of their first scores."""
    rows = [("q", 1, [0.5, 1.0]), ("q", 1, [0.25, 0.0]), ("q", 2, [0.5, 1.0]), ("q", 2, [0.5, 0.0]), ("q", 3, [0.75, 0.0]), ("q", 4, [0.5, 1.0]), ("q", 4, [0.25, 0.5])]
    return rerank.document_ranks(spark.createDataFrame(rows, "query_id string, doc_id int, scores array<double>")).select("doc_id", "total", "rank")


def regression_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a target that is 1 + 2 x - 3 y exactly, fitted without each fold, and their errors."""
    rows = [(str(i % 3), [float(i % 7), float(i % 5)], 1.0 + 2.0 * (i % 7) - 3.0 * (i % 5)) for i in range(60)]
    x = spark.createDataFrame(rows, "fold string, scores array<double>, relevance double")
    r = evaluate.cross_validate(x, ["0", "1", "2"], 2)
    return r.select("fold", "n_train", "n_test", F.transform("weights", lambda w: F.round(w, 6)).alias("weights"), (F.round("test_mse", 6) + 0.0).alias("test_mse"))


def rerank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal vectors, subgroups of equal form and places in them, for one query over all candidate trees."""
    rows = [(1, n, 0, c, 1.0, n + 1) for n, c in enumerate(["[V!a[+[V!b]]]", "[V!x[+[V!y]]]", "[V!x[+[N!1]]]", "[V!p[+[V!q]]]", "[N!2[+[V!y]]]"])]
    hits = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, position int, expr string, score double, rank int")
    queries = spark.createDataFrame([(1, "[V!x[+[V!y]]]")], "query_id bigint, expr string")
    g = rerank.group_ranks(rerank.rerank(hits, queries, 12))
    return g.select("doc_id", F.col("group").cast("bigint").alias("grp"), F.col("abs_rank").cast("bigint").alias("abs_rank"))


def tree_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphviz texts: their numbers of nodes, edges and coloured nodes."""
    r = rerank.rerank(*_hits(spark, PAIRS), 12, constraint="rule")
    dot = r.select("query_id", report.dot_column(F.col("expr"), F.col("c_exact"), F.col("c_unified"), F.col("c_wild")).alias("d"))
    times = lambda s: F.expr(f"regexp_count(d, '{s}')").cast("bigint")
    return dot.select("query_id", times("label=").alias("n_labels"), times("->").alias("n_edges"), times("fillcolor").alias("n_coloured"))


QUERIES = {f.__name__: f for f in (layout_parse, operator_parse, parse_problems, formula_scan, index_layout, topics_read, align_scores, align_places, align_published, match_pages, metrics_combined, stem_known, wildcard_known, compat_order_known, documents_known, regression_known, rerank_order, tree_pictures)}


def _text(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(f"{v!r}::DOUBLE" for v in x) + "]"
    return str(x)


def _values(columns: str, rows: list[tuple]) -> str:
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    cast = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    return f"SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(_text(x) for x in r) + ")" for r in rows) + f") AS t({names})"


_TREE = "doc_id BIGINT, position INTEGER, expr VARCHAR"
_N_FAILING = len(FAILING)

SQL = {
    "layout_parse": _values(_TREE, [(i, 0, e) for i, (_, e) in enumerate(LAYOUT) if e]),
    "operator_parse": _values(_TREE, [(i, 0, e) for i, (_, e) in enumerate(OPERATOR) if e]),
    "parse_problems": _values("doc_id BIGINT, n_failed BIGINT, n_parsed BIGINT, n_kept BIGINT", [(i, 1, 2, 0) for i in range(_N_FAILING)] + [(_N_FAILING, 0, 1, 1)]),
    "formula_scan": _values("doc_id BIGINT, position INTEGER, formula VARCHAR, xml_id VARCHAR", [(i, p, f, x) for i, (_, found) in enumerate(SCANNED) for p, (f, x) in enumerate(found)]),
    "index_layout": _values(
        "doc_id BIGINT, from_tag VARCHAR, to_tag VARCHAR, rel VARCHAR, cnt BIGINT",
        [
            (0, "O!divide", "V!x", "o", 1), (0, "O!divide", "V!y", "u", 1), (0, "O!divide", "0!", "n", 1), (0, "V!x", "0!", "n", 1), (0, "V!y", "0!", "n", 1),
            (1, "N!2", "V!x", "n", 1), (1, "N!2", "+", "nn", 1), (1, "N!2", "N!3", "na", 1), (1, "V!x", "+", "n", 1), (1, "V!x", "N!3", "nn", 1), (1, "V!x", "N!3", "a", 1), (1, "+", "N!3", "n", 1),
        ],
    ),
    "topics_read": _values(
        "query_id VARCHAR, part VARCHAR, value VARCHAR",
        [("T.1", "formula 0", "[O!divide,o[V!x],u[V!y]]"), ("T.1", "formula 1", "[V!z]"), ("T.1", "keyword", "mean value"), ("T.1", "keyword", "bound"), ("T.2", "formula 0", "[N!1]")],
    ),
    "align_scores": _values("query_id BIGINT, metric INTEGER, scores DOUBLE[]", [(n, m, [round(float(x), 9) for x in s]) for n, m, s in SCORES]),
    "align_places": _values("query_id BIGINT, q_exact VARCHAR, q_unified VARCHAR, q_wild VARCHAR, c_exact VARCHAR, c_unified VARCHAR, c_wild VARCHAR", [(n, *p) for n, p in enumerate(PLACES)]),
    "align_published": _values("query_id BIGINT, scores DOUBLE[]", [(n, [round(x, 9) for x in s]) for n, (_, _, _, s) in enumerate(PUBLISHED_PAIRS)]),
    # a page shows the symbols of both trees; those of the candidate are coloured as in its picture
    "match_pages": _values("query_id BIGINT, n_symbols BIGINT, n_coloured BIGINT", [(0, 6, 2), (1, 6, 3), (2, 13, 8), (3, 8, 2), (4, 6, 3), (5, 6, 1), (6, 6, 3)]),
    "metrics_combined": _values("query_id BIGINT, m0 DOUBLE, m1 DOUBLE, m4 DOUBLE, m12 DOUBLE", [(0, 0.333333333, 0.666666667, 0.571428571, 0.571428571), (1, 0.0, 0.333333333, 1.0, 1.0)]),
    "stem_known": _values("word VARCHAR, stem VARCHAR", STEMS),
    # 3 of 3 tuples twice, 1 of 3; then 3 and 1; then 3 of 3 and 1 of 3
    "wildcard_known": _values("query_id BIGINT, doc_id BIGINT, score DOUBLE, rank INTEGER", [(1, 0, 1.0, 1), (1, 2, 1.0, 2), (1, 1, 0.333333333, 3), (2, 0, 1.0, 1), (2, 2, 0.333333333, 2), (3, 0, 1.0, 1), (3, 2, 0.333333333, 2)]),
    "compat_order_known": _values("item_id INTEGER, rank INTEGER, old_rank INTEGER", [(0, 1, 3), (1, 2, 1), (3, 3, 2), (2, 4, 4)]),
    "documents_known": _values("doc_id INTEGER, total DOUBLE, rank INTEGER", [(3, 0.75, 1), (2, 1.0, 2), (1, 0.75, 3), (4, 0.75, 4)]),
    "regression_known": _values("fold VARCHAR, n_train BIGINT, n_test BIGINT, weights DOUBLE[], test_mse DOUBLE", [(str(f), 40, 20, [1.0, 2.0, -3.0], 0.0) for f in range(3)]),
    # equal; all but the operator unified twice; each side's number left over: the same two symbols match exactly
    "rerank_order": _values("doc_id BIGINT, grp BIGINT, abs_rank BIGINT", [(1, 1, 0), (0, 2, 1), (3, 2, 1), (2, 3, 3), (4, 3, 3)]),
    # a tree has as many labels as nodes and edges, and one edge fewer than nodes
    "tree_pictures": _values("query_id BIGINT, n_labels BIGINT, n_edges BIGINT, n_coloured BIGINT", [(0, 5, 2, 2), (1, 5, 2, 3), (2, 15, 7, 8), (3, 9, 4, 2), (4, 5, 2, 3), (5, 5, 2, 1), (6, 5, 2, 3)]),
}
