"""Files and streams: what is written to the shared folder is read back, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphgrove.operators import documents, evaluate, retrieve, small_files
from glyphgrove.operators import index as indexing
from glyphgrove.plans import cases, ranking, retrieval
from glyphgrove.runtime import checkpoint_dir, table
from glyphgrove.sources import documents as sources
from glyphgrove.sources import records
from glyphgrove.streaming import search


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files of all layout trees, with another window put in, read as occurrences."""
    base = _folder(spark)
    grouped = documents.grouped_positions(retrieval._visuals(spark, sf_dir))
    records.rewrite_window(records.index_lines(grouped, window=3), 2).write.text(base)
    return records.read_index(spark, base)


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined visual run as a run file, read and turned into results of formulas at their places."""
    base = _folder(spark)
    run = ranking._visual_run(spark, sf_dir).withColumns({"item_id": F.concat("item_id", F.lit(":0")), "run": F.lit("comb")})
    records.write_trec(run, base)
    back = records.trec_to_results(records.read_trec(spark, base), retrieval._visuals(spark, sf_dir))
    return back.select("query_id", "doc_id", "expr", "score", "rank")


def judgment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgments as a file with blanks, read and turned into results."""
    base = _folder(spark)
    j = ranking._judgments(spark, sf_dir)
    j.select(F.concat_ws(" ", "query_id", F.lit("0"), F.concat("item_id", F.lit(":0")), F.col("relevance").cast("string")).alias("value")).write.text(base)
    return records.judgments_to_results(records.read_judgments(spark, base), retrieval._visuals(spark, sf_dir)).select("query_id", "doc_id", "expr", F.round("score", 9).alias("score"))


def query_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query files with formulas and keywords, read back; every word of an item is a keyword of the query of its number."""
    base = _folder(spark)
    asked = retrieval._asked(retrieval._visuals(spark, sf_dir)).select(F.col("query_id").cast("string").alias("query_id"), F.lit(0).alias("expr_no"), "expr").dropDuplicates(["query_id", "expr"])
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.explode(F.array_distinct(retrieval.text.terms(F.col("text")))).alias("term"))
    records.query_lines(asked, words).select("value").write.text(base)
    e = records.read_queries(spark, base).select("query_id", F.lit("formula").alias("part"), F.col("expr").alias("value"))
    return e.unionByName(records.read_keywords(spark, base).select("query_id", F.lit("keyword").alias("part"), F.col("term").alias("value")))


RESULT_LINES = "Q\ta\nE\t[V!x]\nC\t[U]\nP\tmean\nR\t7\t2\t[V!x]\t0.5\nR\t8\t0\t[V!y]\t[0.25, 1.0]\nI\tqt\t12.5\nM\t7\t3.5\nQ\tb\nE\t[V!z]\nM\t9\t1.0"


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of lines of a result file."""
    base = _folder(spark)
    spark.createDataFrame([(RESULT_LINES,)], "value string").coalesce(1).write.text(base)
    show = lambda df, part, *c: df.select("query_id", F.lit(part).alias("part"), F.concat_ws("|", *c).alias("value"))
    text = lambda c: F.col(c).cast("string")
    names = spark.createDataFrame([(7, "seven.mml")], "doc_id bigint, doc_name string")
    out = show(records.read_results(spark, base), "R", text("doc_id"), text("position"), "expr", F.array_join(F.transform("scores", lambda s: s.cast("string")), " "))
    out = out.unionByName(show(records.read_queries(spark, base), "E", text("expr_no"), "expr", "constraint_expr"))
    out = out.unionByName(show(records.read_keywords(spark, base), "P", "term")).unionByName(show(records.read_counters(spark, base), "I", "name", text("value")))
    return out.unionByName(show(records.read_text_results(spark, base, names), "M", text("doc_id"), "doc_name", text("score")))


FOLDER = (("a/one.mml", cases.MATH.format("<mi>x</mi>")), ("a/two.tex", "$x$"), ("b/three.txt", "none"), ("b/four.HTML", "<p>" + cases.MATH.format("<mn>1</mn>") + "</p>"))


def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder listed, read and told apart by endings, with the formulas of its documents."""
    base = _folder(spark)
    rows = [(n.split("/")[0], n.split("/")[1], c) for n, c in FOLDER]
    docs = spark.createDataFrame(rows, "folder string, name string, content string")
    small_files.write_members(docs, base, folder="folder", name="name", content="content").write.format("noop").mode("overwrite").save()
    listed = sources.list_folder(spark, base).withColumn("name", F.substring_index("doc_name", "/", -2))
    read = documents.dispatch(sources.read_contents(listed))
    formulas = documents.parse_formulas(documents.scan_formulas(read.filter("kind = 'markup'")), operator=False)
    wanted = sources.names_of(listed, formulas.filter("expr IS NOT NULL").select("doc_id"))
    named = read.join(formulas.select("doc_id", "expr"), "doc_id", "left").join(wanted.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return named.select("doc_id", "name", "ext", "n_bytes", "kind", "expr", F.coalesce("has", F.lit(False)).alias("has_formula"))


def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship search over an index that was stored and read."""
    base = _folder(spark)
    occ = retrieval._visuals(spark, sf_dir)
    indexing.write(indexing.build(occ), base, buckets=8)
    return retrieval._shown(retrieve.search(indexing.read(spark, base), retrieve.Queries(retrieval._asked(occ)), retrieval.TOP_K))


def index_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an index made of two over disjoint documents."""
    occ = retrieval._visuals(spark, sf_dir)
    both = indexing.union(indexing.build(occ.filter("doc_id % 2 = 0")), indexing.build(occ.filter("doc_id % 2 = 1")))
    return indexing.consistency(both)


def stream_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that come as a stream, answered from an index batch by batch."""
    base = _folder(spark)
    occ = retrieval._visuals(spark, sf_dir)
    retrieval._asked(occ).write.parquet(f"{base}/queries")
    stream = spark.readStream.schema("query_id bigint, expr string").parquet(f"{base}/queries")
    answer = lambda hits, n: hits.write.mode("overwrite").parquet(f"{base}/hits/batch={n}")
    search.answer_queries(stream, indexing.build(occ), answer, retrieval.TOP_K, checkpoint=f"{base}/progress").awaitTermination()
    return spark.read.parquet(f"{base}/hits").select("query_id", "doc_id", "expr", F.round("score", 9).alias("score"), "rank")


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come as a stream of several batches, appended to postings files; totals after merging."""
    base = _folder(spark)
    retrieval._visuals(spark, sf_dir).repartition(3).write.parquet(f"{base}/documents")
    stream = spark.readStream.option("maxFilesPerTrigger", 1).schema("doc_id bigint, position int, expr string").parquet(f"{base}/documents")
    search.append_postings(stream, f"{base}/postings", checkpoint=f"{base}/progress").awaitTermination()
    expressions, postings = search.read_appended(spark, f"{base}/postings")
    return indexing.consistency(indexing.Index(expressions, postings, expressions, 4, "small"))


def related_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pairs of which every third is a duplicate: sizes of both parts."""
    pairs = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, 2).when(F.col("event_id") % 3 == 1, 1).alias("relation"))
    same, other = evaluate.split_related(pairs)
    return same.agg(F.count("*").alias("n")).select(F.lit("duplicate").alias("kind"), "n").unionByName(other.agg(F.count("*").alias("n")).select(F.lit("related").alias("kind"), "n"))


QUERIES = {f.__name__: f for f in (index_files, run_files, judgment_files, query_files, result_files, folder_files, stored_search, index_union, stream_search, stream_index, related_split)}

_SLT = retrieval._SLT

SQL = {
    "index_files": f"SELECT doc_id, CAST(0 AS INTEGER) AS position, expr FROM ({_SLT})",
    "run_files": ranking._EVAL + f" SELECT query_id, doc_id, expr, score, rank FROM vrun JOIN ({_SLT}) s ON s.doc_id = vrun.item_id",
    "judgment_files": ranking._EVAL + f" SELECT query_id, doc_id, expr, round(relevance, 9) AS score FROM jud JOIN ({_SLT}) s ON s.doc_id = jud.item_id",
    "query_files": f"""SELECT DISTINCT CAST(doc_id AS VARCHAR) AS query_id, 'formula' AS part, expr AS value FROM ({_SLT}) WHERE doc_id % {retrieval.ASKED} = 0
UNION ALL SELECT CAST(item_id AS VARCHAR), 'keyword', unnest(list_distinct({retrieval._WORDS})) FROM benchmark""",
    "result_files": cases._values(
        "query_id VARCHAR, part VARCHAR, value VARCHAR",
        [
            ("a", "R", "7|2|[V!x]|0.5"), ("a", "R", "8|0|[V!y]|0.25 1.0"), ("a", "E", "0|[V!x]|[U]"), ("b", "E", "0|[V!z]"), ("a", "P", "mean"), ("a", "I", "qt|12.5"),
            ("a", "M", "7|seven.mml|3.5"), ("b", "M", "9|1.0"),
        ],
    ),
    "folder_files": cases._values(
        "doc_id BIGINT, name VARCHAR, ext VARCHAR, n_bytes BIGINT, kind VARCHAR, expr VARCHAR, has_formula BOOLEAN",
        [
            (0, "a/one.mml", "mml", len(FOLDER[0][1]), "markup", "[V!x]", "true"), (1, "a/two.tex", "tex", 3, "latex", None, "false"),
            (2, "b/four.HTML", "html", len(FOLDER[3][1]), "markup", "[N!1]", "true"), (3, "b/three.txt", "txt", 4, None, None, "false"),
        ],
    ),
    "stored_search": retrieval.SQL["slt_dice_topk"],
    "index_union": retrieval.SQL["posting_totals"],
    "stream_search": retrieval.SQL["hits_expanded"],
    "stream_index": retrieval.SQL["posting_totals"],
    "related_split": "SELECT CASE WHEN event_id % 3 = 0 THEN 'duplicate' ELSE 'related' END AS kind, count(*) AS n FROM events GROUP BY 1",
}
