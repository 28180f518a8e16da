"""From documents to distinct expressions: formula scan, parse, positions, failures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.parse import layout, markup, operators, trees

#: File endings that are read, and the one whose files hold LaTeX only.
MARKUP_ENDINGS, LATEX_ENDING = ("xhtml", "mathml", "mml", "html"), "tex"

PARSED = "position int, expr string, error string"


def dispatch(documents: DataFrame, *, name: str = "doc_name") -> DataFrame:
    """Adds ``kind``: ``markup``, ``latex``, or null for files that can't be read (the problem files)."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./]+)\z", 1))
    return documents.withColumn("kind", F.when(ending.isin(*MARKUP_ENDINGS), "markup").when(ending == LATEX_ENDING, "latex"))


def scan_formulas(documents: DataFrame, *, ident: str = "doc_id", content: str = "content") -> DataFrame:
    """``ident, position, formula``: formulas of each document, counted from 0. No shuffle; only texts with ``math`` in them
    leave the JVM.

    LaTeX formulas of elements of their own class come as ``$...$``. Null contents and contents without formulas give no rows.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, p, f) for i, t in zip(batch[ident], batch[content], strict=True) for p, f in enumerate(markup.formulas(t))]
            yield pd.DataFrame(rows, columns=[ident, "position", "formula"])

    kind = documents.schema[ident].dataType.simpleString()
    likely = documents.select(ident, content).filter(F.contains(content, F.lit("math")))
    return likely.mapInPandas(scan, f"{ident} {kind}, position int, formula string")


def scan_elements(documents: DataFrame, tag: str, *, ident: str = "doc_id", content: str = "content") -> DataFrame:
    """``ident, position, element`` for any tag name; the scan of :func:`scan_formulas` with its name as parameter."""
    found = F.regexp_extract_all(F.col(content), F.lit(rf"(?s)(<{tag}(?:\s[^>]*)?>.*?</{tag}>)"), F.lit(1))
    return documents.select(ident, F.posexplode(found).alias("position", "element"))


def with_converted(scanned: DataFrame, converted: DataFrame) -> DataFrame:
    """LaTeX formulas (``$...$``) replaced by the markup of ``converted`` (``latex, markup``); others stay as they are."""
    tex = F.when(F.col("formula").startswith("$"), F.regexp_replace("formula", r"\A\$+|\$+\z", ""))
    one = converted.groupBy("latex").agg(F.min("markup").alias("_markup"))
    both = scanned.withColumn("_tex", tex).join(one.withColumnRenamed("latex", "_tex"), "_tex", "left")
    return both.withColumn("formula", F.coalesce("_markup", "formula")).drop("_tex", "_markup")


def formula_id(formula: Column) -> Column:
    """The ``id`` attribute of a formula's first element, or null."""
    x = F.regexp_extract(formula, r"<[^>]*?\sid=[\"']([^\"']*)[\"']", 1)
    return F.when(x != "", x)


def parse_formula(formula: str, *, operator: bool) -> str | None:
    """Canonical string of one formula, or null if it is empty; raises ``ValueError``."""
    root = (operators if operator else layout).parse(markup.isolate(formula, content=operator))
    return None if root is None else trees.render(root, operator)


def parse_formulas(scanned: DataFrame, *, operator: bool, ident: str = "doc_id") -> DataFrame:
    """``ident, position, expr, error`` of scanned formulas; exactly one of ``expr`` and ``error`` is set.

    Empty formulas give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, p, f in zip(batch[ident], batch["position"], batch["formula"], strict=True):
                try:
                    expr = parse_formula(f, operator=operator)
                    if expr is not None:
                        rows.append((i, p, expr, None))
                except (ValueError, RecursionError) as e:
                    rows.append((i, p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[ident, "position", "expr", "error"])

    kind = scanned.schema[ident].dataType.simpleString()
    return scanned.select(ident, "position", "formula").mapInPandas(run, f"{ident} {kind}, {PARSED}")


def occurrences(parsed: DataFrame, *, ident: str = "doc_id") -> DataFrame:
    """Occurrences of the documents that were read without an error; one error fails its whole document."""
    failed = parsed.filter(F.col("error").isNotNull()).select(ident).distinct()
    return parsed.filter(F.col("expr").isNotNull()).select(ident, "position", "expr").join(failed, ident, "left_anti")


def problems(parsed: DataFrame, *, ident: str = "doc_id") -> DataFrame:
    """``error, n_formulas, documents``-count of failures by kind."""
    return parsed.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n_formulas"), F.count_distinct(ident).alias("n_documents"))


def grouped_positions(occ: DataFrame, *, ident: str = "doc_id") -> DataFrame:
    """``ident, expr, positions``: each distinct expression of a document with its ordered positions."""
    return occ.groupBy(ident, "expr").agg(F.sort_array(F.collect_list("position")).alias("positions"))
