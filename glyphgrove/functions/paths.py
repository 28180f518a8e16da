"""Canonical form of file paths that were written in many spellings."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = re.compile(r"^file:(?:[/\\]{2}[^/\\]*)?(?=[/\\])", re.IGNORECASE)


def canonical_path(raw: str | None, root: str) -> str | None:
    """Absolute path with one spelling.

    White space around the path, a ``file:`` scheme, percent escapes, backslashes, doubled separators,
    ``.`` and ``..`` segments and Unicode composition are resolved; letter case is kept. Relative paths
    start at ``root``. Escapes that are no valid UTF-8 stay as written. Null gives null.
    """
    if raw is None:
        return None
    p = _SCHEME.sub("", raw.strip())
    if "%" in p:
        try:
            p = unquote(p, errors="strict")
        except UnicodeDecodeError:
            pass
    p = unicodedata.normalize("NFC", p).strip().replace("\\", "/")
    if not p.startswith("/"):
        p = f"{root}/{p}"
    out: list[str] = []
    for part in p.split("/"):
        if part == "..":
            if out:
                out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


def canonical_path_column(path: Column, root: str) -> Column:
    """:func:`canonical_path` over a column, in Arrow batches (the JVM has no Unicode composition function)."""

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(lambda x: canonical_path(x, root), na_action="ignore")

    return canonical(path)
