"""Keyword search beside formula search: terms, TF-IDF scores, positions and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.functions.stem import stem_column
from glyphgrove.runtime import apart, durable

#: Rows up to which a side derived from queries is broadcast; counted before, shuffled beyond.
BROADCAST_ROWS = 200_000


def terms(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case; null for null."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.lower(w))


def postings(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", stemmed: bool = False) -> DataFrame:
    """``doc_id, pos, term`` of each term, or of its stem; positions count from 0. No shuffle."""
    words = stem_column(terms(F.col(text))) if stemmed else terms(F.col(text))
    return docs.select(F.col(ident).alias("doc_id"), F.posexplode(words).alias("pos", "term"))


def term_counts(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, term, tf``."""
    return postings(docs, ident=ident, text=text).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tfidf_search(docs: DataFrame, queries: DataFrame, k: int = 10, *, ident: str = "doc_id", text: str = "text", query: str = "query_id", query_text: str = "text") -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` documents with the greatest sum over shared terms of
    query frequency x (1 + ln tf) x ln(1 + N / df), ties to the smaller document.

    Only the queries' terms leave the scan; they are counted, broadcast up to a limit and shuffled beyond. The number of documents counts those with any term.
    """
    q = durable(queries.select(F.col(query).alias("query_id"), F.explode(terms(F.col(query_text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf")))
    small = q.count() <= BROADCAST_ROWS
    side = lambda d: F.broadcast(d) if small else d
    words = postings(docs, ident=ident, text=text)
    total = docs.select(terms(F.col(text)).alias("w")).filter(F.size("w") > 0).count()
    tf = durable(words.join(side(q.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf")))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighted = q.join(side(df), "term").select("query_id", "term", (F.col("qf") * F.log(1 + F.lit(float(total)) / F.col("df"))).alias("w"))
    scored = tf.join(side(weighted), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * (1 + F.log("tf"))).alias("score"))
    # summation order varies between runs, so ties are decided on rounded sums
    scored = scored.withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def normalised(scores: DataFrame) -> DataFrame:
    """Scores divided by the greatest of their query; 0 where that is 0."""
    top = scores.groupBy(F.col("query_id").alias("_q")).agg(F.max("score").alias("_top"))
    met = scores.join(apart(top, "_q"), F.col("query_id").eqNullSafe(F.col("_q")))
    return met.withColumn("score", F.when(F.col("_top") == 0, 0.0).otherwise(F.col("score") / F.col("_top"))).drop("_q", "_top")


def keyword_positions(docs: DataFrame, keywords: DataFrame, *, ident: str = "doc_id", text: str = "text", stemmed: bool = False) -> DataFrame:
    """``query_id, doc_id, term, positions`` of single keywords (``query_id, term``); ``stemmed`` compares stems."""
    asked = keywords.select("query_id", F.get(stem_column(F.array(F.lower("term"))), F.lit(0)).alias("term")) if stemmed else keywords.select("query_id", "term")
    hit = postings(docs, ident=ident, text=text, stemmed=stemmed).join(asked.distinct(), "term")
    return hit.groupBy("query_id", "doc_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _runs(words: Column, n: int) -> Column:
    """All ``n`` words in a row, joined by blanks; there must be as many."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))


def phrase_positions(docs: DataFrame, phrases: DataFrame, *, ident: str = "doc_id", text: str = "text", phrase: str = "phrase") -> DataFrame:
    """``query_id, doc_id, pos``: where the words of a phrase (``query_id, phrase``) follow each other.

    Each place of a text is looked up with as many words from there as a phrase has, one pass for each length of phrase.
    Phrases are counted and broadcast up to a limit; beyond it both sides are shuffled by the words.
    """
    asked = durable(phrases.select("query_id", terms(F.col(phrase)).alias("_w")).filter(F.size("_w") > 0).select("query_id", F.size("_w").alias("_n"), F.array_join("_w", " ").alias("_p")))
    small = asked.count() <= BROADCAST_ROWS
    words = docs.select(F.col(ident).alias("doc_id"), terms(F.col(text)).alias("_t"))
    out = None
    for n in sorted(r["_n"] for r in asked.select("_n").distinct().collect()):  # as many as there are lengths of phrases
        places = words.filter(F.size("_t") >= n).select("doc_id", F.posexplode(_runs(F.col("_t"), n)).alias("pos", "_p"))
        of_length = asked.filter(F.col("_n") == n).select("query_id", "_p")
        met = places.join(F.broadcast(of_length) if small else of_length, "_p").select("query_id", "doc_id", "pos")
        out = met if out is None else out.unionByName(met)
    return out if out is not None else asked.select("query_id", F.lit(None).cast(docs.schema[ident].dataType).alias("doc_id"), F.lit(0).alias("pos")).limit(0)


def formula_positions(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, positions``: places of ``<math`` among the white-space separated tokens."""
    tokens = docs.select(F.col(ident).alias("doc_id"), F.posexplode(F.split(F.col(text), r"[ \t\n\r]+")).alias("pos", "token"))
    return tokens.filter(F.col("token").startswith("<math")).groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
