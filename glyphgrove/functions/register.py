"""SQL names for the engine's functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from glyphgrove.functions.stem import stem


def register(spark: SparkSession) -> None:
    """Register ``parse_slt, parse_opt, align_score, stem`` and the table function ``tree_pairs(expr, window)``.

    Parsers give null for what can't be parsed.
    """
    from glyphgrove.operators.documents import parse_formula
    from glyphgrove.operators.rerank import score_pair
    from glyphgrove.parse import pairs, trees

    def quiet(formula: str | None, operator: bool) -> str | None:
        try:
            return None if formula is None else parse_formula(formula, operator=operator)
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def parse_slt(s: pd.Series) -> pd.Series:
        return s.map(lambda x: quiet(x, False))

    @F.pandas_udf("string")
    def parse_opt(s: pd.Series) -> pd.Series:
        return s.map(lambda x: quiet(x, True))

    @F.pandas_udf("array<double>")
    def align_score(q: pd.Series, c: pd.Series) -> pd.Series:
        found = [score_pair(a, b) if a is not None and b is not None else None for a, b in zip(q, c, strict=True)]
        return pd.Series([r and r["scores"] for r in found])

    @F.pandas_udf("string")
    def stem_(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else stem(w))

    for name, f in (("parse_slt", parse_slt), ("parse_opt", parse_opt), ("align_score", align_score), ("stem", stem_)):
        spark.udf.register(name, f)

    @F.udtf(returnType="`from` string, `to` string, rel string, cnt bigint")
    class TreePairs:
        def eval(self, expr: str, window: int):
            try:
                for (a, b, r), n in pairs.expand(trees.parse(expr), window).items():
                    yield Row(a, b, r, n)
            except (ValueError, TypeError):
                return

    spark.udtf.register("tree_pairs", TreePairs)
