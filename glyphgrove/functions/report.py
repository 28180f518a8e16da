"""Trees and results as pictures and pages: Graphviz texts and HTML tables, built in columns."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.parse import trees

#: Colours of matched symbols: equal, unified, taken by a wildcard.
COLOURS = ("#8fd694", "#f7d070", "#9ec5f8")


def dot(expr: str, exact: list[str], unified: list[str], wild: list[str]) -> str:
    """Graphviz text of a tree with its matched nodes coloured."""
    colour = {p: c for c, paths in zip(reversed(COLOURS), (wild, unified, exact), strict=True) for p in paths or ()}
    lines = ["digraph tree {", "  node [shape=box];"]
    for path, node in trees.visit(trees.parse(expr)):
        label = node.tag.replace("\\", "\\\\").replace('"', '\\"')
        fill = f', style=filled, fillcolor="{colour[path]}"' if path in colour else ""
        lines.append(f'  "r{path}" [label="{label}"{fill}];')
        lines += [f'  "r{path}" -> "r{path}{k}" [label="{k}"];' for k in node.edges]
    return "\n".join([*lines, "}"])


def dot_column(expr: Column, exact: Column, unified: Column, wild: Column) -> Column:
    """:func:`dot` over columns; null where the string is no tree."""

    @F.pandas_udf("string")
    def draw(e: pd.Series, x: pd.Series, u: pd.Series, w: pd.Series) -> pd.Series:
        def one(t, a, b, c):
            try:
                return None if t is None else dot(t, *[[] if v is None else list(v) for v in (a, b, c)])
            except ValueError:
                return None

        return pd.Series([one(*r) for r in zip(e, x, u, w, strict=True)])

    return draw(expr, exact, unified, wild)


def marked(expr: str, exact: list[str], unified: list[str], wild: list[str]) -> str:
    """HTML of a tree as nested boxes, matched symbols coloured; labels stand before the boxes of side edges."""
    colour = {p: c for c, paths in zip(reversed(COLOURS), (wild, unified, exact), strict=True) for p in paths or ()}
    out: list[str] = []
    todo: list = [("", trees.parse(expr))]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        path, node = item
        style = f' style="background:{colour[path]}"' if path in colour else ""
        out.append(f"<span{style}>{html.escape(node.tag)}</span>")
        for k in reversed(list(node.edges)):
            inner = (path + k, node.edges[k])
            todo += [inner] if k == "n" else ["</sub>", inner, f"<sub><i>{k}</i> "]
    return "".join(out)


def marked_column(expr: Column, exact: Column, unified: Column, wild: Column) -> Column:
    """:func:`marked` over columns; null where the string is no tree."""

    @F.pandas_udf("string")
    def draw(e: pd.Series, x: pd.Series, u: pd.Series, w: pd.Series) -> pd.Series:
        def one(t, *places):
            try:
                return None if t is None else marked(t, *[[] if v is None else list(v) for v in places])
            except ValueError:
                return None

        return pd.Series([one(*r) for r in zip(e, x, u, w, strict=True)])

    return draw(expr, exact, unified, wild)


def match_page(reranked: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """``query_id, html``: the query's tree and its first ``k`` results, matched places of the candidates coloured.

    ``reranked`` is a result of :func:`glyphgrove.operators.rerank.rerank`; ``k`` is the length of a page. Names are escaped.
    """
    tree = F.coalesce(marked_column(F.col("expr"), F.col("c_exact"), F.col("c_unified"), F.col("c_wild")), F.lit(""))
    scores = F.array_join(F.transform("scores", lambda s: F.round(s, 4).cast("string")), " ")
    cell = F.concat(F.lit("<tr><td>"), F.col("rank").cast("string"), F.lit("</td><td>"), tree, F.lit("</td><td>"), scores, F.lit("</td></tr>"))
    rows = reranked.filter(F.col("rank") <= k).select("query_id", "rank", cell.alias("c")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "c"))).alias("r"))
    none = F.array().cast("array<string>")
    asked = queries.select("query_id", marked_column(F.col("expr"), none, none, none).alias("q"))
    body = F.concat(F.lit("<h1>"), F.coalesce("q", F.lit("")), F.lit("</h1><table>"), F.array_join(F.transform("r", lambda x: x["c"]), ""), F.lit("</table>"))
    return asked.join(rows, "query_id").select("query_id", F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))


def page(rows: DataFrame, k: int = 100) -> DataFrame:
    """``query_id, html``: a table of each query's first ``k`` results (``expr, scores, rank``)."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    cell = F.concat(F.lit("<tr><td>"), F.col("rank").cast("string"), F.lit("</td><td>"), esc(F.col("expr")), F.lit("</td><td>"), F.array_join(F.transform("scores", lambda s: F.round(s, 4).cast("string")), " "), F.lit("</td></tr>"))
    per = rows.filter(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", cell.alias("c")))).alias("r"))
    title = html.escape("Results")
    body = F.array_join(F.transform("r", lambda x: x["c"]), "")
    return per.select("query_id", F.concat(F.lit(f"<html><head><title>{title}</title></head><body><table>"), body, F.lit("</table></body></html>")).alias("html"))
