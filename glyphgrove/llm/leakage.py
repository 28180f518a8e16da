"""Evaluation passages inside training texts, by a positional inverted index.

The index holds a posting (document, position, term) for each training token whose term occurs in any
evaluation item; other tokens can't be part of a match. Every run of ``least`` words of an item is looked up from
its rarest term on: the term's postings, moved by the term's offset in the run, are the places where the run may
begin; these are intersected with the moved postings of the next rarer terms, and the few places left are
compared with the whole run, for which only the postings of their documents are read again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.runtime import durable, spread

_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[­؀-؅؜۝܏࢐࢑࣢᠎​-‏‪-‮⁠-⁯﻿￹-￻\U000110bd\U000110cd\U00013430-\U0001343f\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0001\U000e0020-\U000e007f]")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after compatibility normalisation, without format characters and case."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", unicodedata.normalize("NFKC", text)))
    return _WORD.findall(text.casefold())


def tokenised(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, _words`` of rows with at least one word."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({ident: batch[ident], "_words": [words(t) for t in batch[text]]})

    kind = rows.schema[ident].dataType.simpleString()
    return spread(rows.select(ident, text).filter(F.col(text).isNotNull()), ident).mapInPandas(split, f"{ident} {kind}, _words array<string>").filter(F.size("_words") > 0)


#: Rows up to which a side derived from the evaluation items is broadcast; counted before, shuffled beyond.
BROADCAST_ROWS = 200_000


class LeakIndex:
    """Positional inverted index of a corpus over the terms of a set of evaluation items.

    Documents and items with null or empty texts have no words and never match. Items shorter than ``least``
    words never match. Repeated items and documents each match for themselves; ids must be unique.
    """

    def __init__(self, docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text") -> None:
        split = tokenised(items, item, text).withColumnRenamed(item, "item")
        self.item_terms = durable(split.select("item", F.posexplode("_words").alias("at", "term")))
        terms = self.item_terms.select("term").distinct()
        self.small = self.item_terms.count() <= BROADCAST_ROWS
        postings = tokenised(docs, doc, text).select(F.col(doc).alias("doc"), F.posexplode("_words").alias("pos", "term"))
        self.postings = durable(postings.join(self._side(terms), "term", "left_semi").select("term", "doc", "pos"))
        self.frequency = self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.small else df

    def runs(self, least: int) -> DataFrame:
        """``item, start, ranked`` of each run of ``least`` words; ``ranked`` has (df, offset, term), rarest first.

        Runs with a term that the corpus doesn't have are left out.
        """
        known = durable(self.item_terms.join(self.frequency, "term"))
        starts = known.select("item", "term", "df", "at", F.explode(F.sequence(F.greatest(F.col("at") - (least - 1), F.lit(0)), F.col("at"))).alias("start"))
        ranked = F.sort_array(F.collect_list(F.struct("df", (F.col("at") - F.col("start")).alias("offset"), "term"))).alias("ranked")
        return starts.groupBy("item", "start").agg(ranked).filter(F.size("ranked") == least)

    def _held(self, asked: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows of ``asked`` whose (doc, pos, term) the index holds; of the postings only those that ``wanted`` has are shuffled."""
        some = self.postings.join(wanted, wanted.columns, "left_semi")
        return asked.join(some, ["doc", "pos", "term"], "left_semi")

    def phrases(self, least: int, steps: int = 3) -> DataFrame:
        """``doc, item`` of documents that contain ``least`` consecutive words of the item's text.

        The lists of a run's ``steps`` rarest terms are intersected one after the other, of which only postings of such terms
        are shuffled; the rest of the run is looked up in the documents that are left.
        """
        runs = durable(self.runs(least))
        steps = min(steps, least)
        at = lambda step: runs.select("item", "start", F.col("ranked")[step]["term"].alias("term"), F.col("ranked")[step]["offset"].alias("offset"))
        places = self.postings.join(self._side(at(0)), "term").select("item", "start", "doc", (F.col("pos") - F.col("offset")).alias("begin")).filter("begin >= 0")
        for step in range(1, steps):
            asked = places.join(self._side(at(step)), ["item", "start"]).withColumn("pos", F.col("begin") + F.col("offset"))
            places = self._held(asked, self._side(at(step).select("term").distinct())).select("item", "start", "doc", "begin")
        places = durable(places)
        if least > steps:
            rest = runs.select("item", "start", F.explode(F.slice("ranked", steps + 1, least)).alias("r"))
            rest = rest.select("item", "start", F.col("r.term").alias("term"), F.col("r.offset").alias("offset"))
            asked = places.join(self._side(rest), ["item", "start"]).withColumn("pos", F.col("begin") + F.col("offset"))
            docs = durable(places.select("doc").distinct())
            met = self._held(asked, F.broadcast(docs) if docs.count() <= BROADCAST_ROWS else docs)
            places = met.groupBy("item", "start", "doc", "begin").agg(F.count("*").alias("n")).filter(F.col("n") == least - steps)
        return places.select("doc", "item").distinct()

    def near(self, least: int, most_apart: int, share: float = 0.5) -> DataFrame:
        """``doc, item, n_terms``: documents with many of an item's terms close together, in any order.

        A stretch is any ``most_apart`` + 1 words in a row, wherever it starts. It matches if it has at least ``share``
        of the item's distinct terms, and ``least`` of them, or all of the item's ``least`` rarest terms;
        ``n_terms`` is the greatest number of the item's terms in a matching stretch. Items with fewer than ``least``
        terms never match.

        Of the ``known`` terms of an item that the corpus has, a stretch with ``need`` has ``few`` of the ``known - need
        + few`` rarest. Blocks of a document without those are left out, so common terms are looked up for few items;
        blocks overlap by ``most_apart``, so each stretch is whole in the block where it starts.
        """
        few, block = min(3, least), max(1, 8 * most_apart)
        terms = self.item_terms.select("item", "term").distinct()
        need = terms.groupBy("item").agg(F.greatest(F.lit(least), F.ceil(F.count("*") * share)).alias("need"))
        per_item = Window.partitionBy("item")
        known = terms.join(self.frequency, "term").withColumns({"r": F.row_number().over(per_item.orderBy("df", "term")), "known": F.count("*").over(per_item)})
        cut = F.greatest(F.col("known") - F.col("need") + few, F.lit(least))
        ranked = durable(known.join(need, "item").select("item", "term", "r", "need", cut.alias("cut")))
        blocks = F.sequence(F.floor(F.greatest(F.col("pos") - most_apart, F.lit(0)) / block), F.floor(F.col("pos") / block))
        postings = self.postings.withColumn("block", F.explode(blocks))
        rare = postings.join(self._side(ranked.filter("r <= cut").select("item", "term")), "term").select("doc", "block", "item", "term").distinct()
        likely = rare.groupBy("doc", "block", "item").agg(F.count("*").alias("n")).filter(F.col("n") >= few).drop("n")
        hits = likely.join(self._side(ranked), "item").join(postings, ["doc", "block", "term"])
        ahead = Window.partitionBy("doc", "item", "block").orderBy("pos").rangeBetween(0, most_apart)
        seen = hits.select("doc", "item", "need", F.collect_set("r").over(ahead).alias("seen"))
        match = (F.size("seen") >= F.col("need")) | (F.size(F.filter("seen", lambda r: r <= least)) >= least)
        return seen.filter(match).groupBy("doc", "item").agg(F.max(F.size("seen")).cast("long").alias("n_terms"))
