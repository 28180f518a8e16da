"""Strict load of tagged record lines, with everything else kept apart and explained.

1. ``strict_load``   typed fields of the lines that conform, and of no others
2. ``rejected``      raw offsets minus loaded offsets (left anti-join), each with the first reason that applies

Both work on JVM expressions. Quotes are handled by splitting at the quote sign and looking at the pieces,
not by one regular expression, so a line of any length and any number of quotes or tabs is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a record by its tag.
COLUMNS = {"E": 3, "R": 5}

_NUMBER = r"\A *[0-9]{1,18} *\z"
_SCORE = r"\A *[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)? *\z"


def _quotes_ok(parts: Column) -> Column:
    """Pieces at even places lie outside quotes: each begins and ends with a tab, or is a doubled quote's gap.

    The line was put between two tabs before, so that its ends are no special case.
    """
    outside = F.transform(parts, lambda p, i: (i % 2 == 1) | (p == "") | (p.startswith("\t") & p.endswith("\t")))
    return (F.size(parts) % 2 == 1) & F.forall(outside, lambda ok: ok)


def _fields(parts: Column) -> Column:
    """Field values of a well-quoted line between two tabs; tabs inside quotes survive."""

    def piece(p: Column, i: Column) -> Column:
        safe = F.replace(p, F.lit("\x01"), F.lit("\x01a"))
        return F.when(i % 2 == 1, F.replace(safe, F.lit("\t"), F.lit("\x01b"))).when(p == "", F.lit('"')).otherwise(safe)

    whole = F.regexp_replace(F.array_join(F.transform(parts, piece), ""), r"\A\t|\t\z", "")
    return F.transform(F.split(whole, "\t"), lambda f: F.replace(F.replace(f, F.lit("\x01b"), F.lit("\t")), F.lit("\x01a"), F.lit("\x01")))


#: Levels of brackets taken off by replacement; deeper expressions are counted sign by sign.
_LEVELS = 12


def _balanced(expr: Column) -> Column:
    """Begins with a bracket; brackets balance and close for the last time at the end, not before.

    The first and the last bracket belong together if what is between them balances by itself. Inmost pairs are taken off
    level by level; what is left after that and still has an inmost pair is deeper, and is counted through.
    """
    signs = F.regexp_replace(expr, r"[^\[\]]+", "")
    inner = F.substring(signs, F.lit(2), F.length(signs) - 2)
    for _ in range(_LEVELS):
        inner = F.replace(inner, F.lit("[]"), F.lit(""))
    return expr.startswith("[") & expr.endswith("]") & (F.length(expr) > 1) & F.get(F.transform(F.array(inner), lambda x: (x == "") | (F.contains(x, F.lit("[]")) & _counts(x))), F.lit(0))


def _counts(signs: Column) -> Column:
    """Whether a string of brackets balances, sign by sign."""
    depth = F.aggregate(
        F.split(signs, ""),
        F.lit(0),
        lambda d, s: F.when(d < 0, d).otherwise(d + F.when(s == "[", 1).when(s == "]", -1).otherwise(0)).cast("int"),
    )
    return depth == 0


def _list_items(text: Column) -> Column:
    """Items of ``[a, b]`` without the brackets; null if there are no brackets."""
    t = F.trim(text)
    return F.when(t.startswith("[") & t.endswith("]") & (F.length(t) >= 2), F.split(F.substring(t, F.lit(2), F.length(t) - 2), ","))


def _score_ok(text: Column) -> Column:
    return text.rlike(_SCORE) & (F.trim(text).try_cast("double") <= 1.0)


def _tagged(text: Column, tag: str) -> Column:
    return text.isin(tag, f'"{tag}"') | text.startswith(f"{tag}\t") | text.startswith(f'"{tag}"\t')


def parse_lines(lines: DataFrame, *, line: str = "line") -> DataFrame:
    """Adds ``_tag`` (null: not judged), ``_quotes``, ``_fields`` to the rows of ``lines``.

    ``_fields`` comes out of a generator of one row, so that conditions on fields read it and don't split the line anew.
    """
    raw = F.col(line)
    text = F.when(raw.endswith("\r"), F.left(raw, F.length(raw) - 1)).otherwise(raw)
    parts = F.split(F.concat(F.lit("\t"), F.col("_text"), F.lit("\t")), '"')
    fields = F.when(F.col("_plain"), F.split("_text", "\t")).when(F.col("_quotes"), _fields(parts))
    marked = (
        lines.withColumn("_text", text)
        .withColumn("_tag", F.when(_tagged(F.col("_text"), "E"), "E").when(_tagged(F.col("_text"), "R"), "R"))
        .withColumn("_plain", ~F.contains("_text", F.lit('"')))
        .withColumn("_quotes", F.col("_plain") | _quotes_ok(parts))
    )
    return marked.select("*", F.explode(F.array(fields)).alias("_fields"))


def _conforms() -> tuple[Column, Column]:
    f = F.col("_fields")
    n = F.when(F.col("_tag") == "E", COLUMNS["E"]).otherwise(COLUMNS["R"])
    columns = F.size(f) == n
    items = _list_items(F.get(f, F.lit(2)))
    positions = F.size(items) > 0
    positions = positions & F.forall(items, lambda x: x.rlike(_NUMBER))
    scores = _list_items(F.get(f, F.lit(4)))
    score = _score_ok(F.get(f, F.lit(4))) | ((F.size(scores) == 3) & F.forall(scores, _score_ok))
    e = _balanced(F.get(f, F.lit(1))) & F.coalesce(positions, F.lit(False))
    r = F.get(f, F.lit(1)).rlike(_NUMBER) & F.get(f, F.lit(2)).rlike(_NUMBER) & _balanced(F.get(f, F.lit(3))) & F.coalesce(score, F.lit(False))
    return columns, F.when(F.col("_tag") == "E", e).otherwise(r)


def strict_load(lines: DataFrame, *, line: str = "line", ident: str = "line_id") -> DataFrame:
    """Typed rows of the conforming ``E`` and ``R`` lines.

    Columns: ``ident, tag, doc, pos, expression, positions, scores``; what a record doesn't have is null.
    Null lines, lines of other tags and damaged lines are left out. Field numbers have up to 18 digits.
    """
    columns, values = _conforms()
    f = F.col("_fields")
    good = parse_lines(lines.select(ident, line), line=line).filter(F.col("_tag").isNotNull() & F.col("_quotes")).filter(columns & values)
    e = F.col("_tag") == "E"
    number = lambda c: F.trim(c).try_cast("bigint")
    scores = F.coalesce(_list_items(F.get(f, F.lit(4))), F.array(F.get(f, F.lit(4))))
    return good.select(
        ident,
        F.col("_tag").alias("tag"),
        F.when(~e, number(F.get(f, F.lit(1)))).alias("doc"),
        F.when(~e, number(F.get(f, F.lit(2)))).alias("pos"),
        F.when(e, F.get(f, F.lit(1))).otherwise(F.get(f, F.lit(3))).alias("expression"),
        F.when(e, F.transform(_list_items(F.get(f, F.lit(2))), number)).alias("positions"),
        F.when(~e, F.transform(scores, lambda x: F.trim(x).try_cast("double"))).alias("scores"),
    )


def rejected(lines: DataFrame, *, line: str = "line", ident: str = "line_id") -> DataFrame:
    """``ident, reason`` of every judged line that the strict load did not take.

    Reasons, the first that applies: ``quoting``, ``columns``, ``value``. The lines are those whose offset is
    left after the loaded offsets are taken away; ``ident`` must be unique.
    """
    judged = lines.select(ident, line).filter(F.left(line, F.lit(2)).isin("E", "R", "E\t", "R\t", "E\r", "R\r", '"E', '"R'))
    left = judged.join(strict_load(lines, line=line, ident=ident).select(ident), ident, "left_anti")
    columns, _ = _conforms()
    return (
        parse_lines(left, line=line)
        .filter(F.col("_tag").isNotNull())
        .select(ident, F.when(~F.col("_quotes"), "quoting").when(~columns, "columns").otherwise("value").alias("reason"))
    )
