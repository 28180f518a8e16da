"""The engine as one object: index, search, re-rank, combine, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphgrove.operators import documents, fusion, rerank, retrieve
from glyphgrove.operators import index as indexing
from glyphgrove.parse.pairs import WINDOW


class Engine:
    """Formula search over documents with markup (``doc_id, content``) or over canonical strings."""

    def __init__(self, spark: SparkSession, *, operator: bool = False, window: int = WINDOW, eob: str = "small") -> None:
        self.spark, self.operator, self.window, self.eob = spark, operator, window, eob
        self.index_: indexing.Index | None = None

    def index(self, docs: DataFrame) -> Engine:
        """Index the formulas of ``doc_id, content``."""
        parsed = documents.parse_formulas(documents.scan_formulas(docs), operator=self.operator)
        return self.index_expressions(documents.occurrences(parsed))

    def index_expressions(self, occ: DataFrame) -> Engine:
        """Index ``doc_id, position, expr``."""
        self.index_ = indexing.build(occ, window=self.window, eob=self.eob)
        return self

    def search(self, queries: DataFrame, k: int = 1000, *, wildcards: bool = True) -> DataFrame:
        """``query_id, doc_id, position, expr, score, rank`` of ``query_id, expr``."""
        q = retrieve.Queries(queries, window=self.window, eob=self.eob)
        return retrieve.expand_hits(self.index_, retrieve.search(self.index_, q, k, wildcards=wildcards))

    def rerank(self, hits: DataFrame, queries: DataFrame, metric: int = 12, **options) -> DataFrame:
        return rerank.rerank(hits, queries, metric, window=self.window, eob=self.eob, **options)

    @staticmethod
    def combine(layout: DataFrame, operator: DataFrame, item: str = "item_id") -> DataFrame:
        """Combined run of both models' vectors."""
        both = fusion.merge_models(layout, operator, item=item)
        return fusion.ranked(both.withColumn("score", fusion.weighted(both["scores"])), item=item)
