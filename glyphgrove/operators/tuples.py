"""Tuples of a tree: every ancestor and descendant within a window, with the way between them.

Two independent generators give the same result: :func:`tuple_counts` walks a tree inside one Arrow batch and
needs no shuffle at all, which is what the index uses; :func:`prefix_join` states the same as a prefix condition on
node arrays in Catalyst's array functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.parse import trees
from glyphgrove.parse.pairs import END, EOB_MODES, WINDOW, expand, expand_chain

NODES = "array<struct<path: string, cpath: string, tag: string, depth: int>>"
TUPLES = "array<struct<from: string, to: string, rel: string, cnt: bigint>>"


def _lists(rows: list[list[tuple] | None], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.Array:
    """Arrow array of lists of structs from rows of tuples, built column by column."""
    flat = [t for r in rows if r for t in r]
    columns = list(zip(*flat, strict=True)) or [()] * len(names)
    values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
    offsets, n = [], 0
    for r in rows:
        offsets.append(None if r is None else n)
        n += len(r) if r else 0
    return pa.ListArray.from_arrays(pa.array([*offsets, n], pa.int32()), values)


_TEXT, _INT, _LONG = pa.string(), pa.int32(), pa.int64()


def nodes_column(expr: Column) -> Column:
    """Node array of a canonical string; null for null and for what isn't one."""

    @F.arrow_udf(NODES)
    def parse(s: pa.Array) -> pa.Array:
        return _lists([_nodes(x) for x in s.to_pylist()], ("path", "cpath", "tag", "depth"), (_TEXT, _TEXT, _TEXT, _INT))

    return parse(expr)


def _nodes(text: str | None) -> list[tuple] | None:
    try:
        return None if text is None else trees.nodes(trees.parse(text))
    except ValueError:
        return None


def _counts(text: str | None, window: int, eob: str) -> list[tuple] | None:
    try:
        found = None if text is None else expand_chain(text, window, eob)
        if found is None and text is not None:
            found = expand(trees.parse(text), window, eob)
    except ValueError:
        return None
    return None if found is None else [(a, b, r, n) for (a, b, r), n in found.items()]


def tuple_counts(expr: Column, window: int = WINDOW, eob: str = "small") -> Column:
    """Distinct tuples of a canonical string with their numbers; null for null and for what isn't one."""
    if eob not in EOB_MODES:
        raise ValueError(eob)

    @F.arrow_udf(TUPLES)
    def count(s: pa.Array) -> pa.Array:
        return _lists([_counts(x, window, eob) for x in s.to_pylist()], ("from", "to", "rel", "cnt"), (_TEXT, _TEXT, _TEXT, _LONG))

    return count(expr)


def prefix_join(nodes: Column, window: int = WINDOW, eob: str = "small") -> Column:
    """Tuples (not yet counted) of a node array, in array functions only."""
    between = lambda x, y: (F.length(y["path"]) - F.length(x["path"])).between(1, window or 1 << 30)
    pair = lambda x, y: F.struct(x["tag"].alias("from"), y["tag"].alias("to"), F.substring(y["cpath"], F.length(x["path"]) + 1, F.length(y["path"])).alias("rel"))
    pairs = F.flatten(
        F.transform(
            nodes,
            lambda x: F.transform(
                F.filter(nodes, lambda y: F.startswith(y["path"], x["path"]) & between(x, y) & ~(y["tag"].startswith("E!") & y["path"].endswith("w"))),
                lambda y: pair(x, y),
            ),
        )
    )
    if eob == "none":
        return pairs
    operator = F.exists(nodes, lambda x: x["path"] == "0")
    down = F.when(operator, "0").otherwise("n")
    leaf = F.filter(nodes, lambda x: ~x["tag"].startswith("E!") & ~F.exists(nodes, lambda y: y["path"] == F.concat(x["path"], down)))
    ends = F.transform(leaf, lambda x: F.struct(x["tag"].alias("from"), F.lit(END).alias("to"), down.alias("rel")))
    if eob == "small":
        ends = F.when(F.array_max(F.transform(nodes, lambda x: x["depth"])) <= 1, ends).otherwise(F.slice(ends, 1, 0))
    return F.concat(pairs, ends)


def chain_tree(words: Column) -> Column:
    """Canonical string of a sequence: each word is the ``next`` of the one before. Escapes are those of tags."""
    safe = F.transform(words, lambda w: F.replace(F.replace(F.replace(F.replace(w, F.lit("?"), F.lit("&quest;")), F.lit(","), F.lit("&comma;")), F.lit("["), F.lit("&lsqb;")), F.lit("]"), F.lit("&rsqb;")))
    return F.concat(F.lit("["), F.array_join(safe, "["), F.repeat(F.lit("]"), F.size(words)))


def tuple_table(expressions: DataFrame, keys: list[str], *, expr: str = "expr", window: int = WINDOW, eob: str = "small") -> DataFrame:
    """``keys, from, to, rel, cnt``: one row per distinct tuple of each row's expression. No shuffle."""
    t = expressions.select(*keys, F.explode(tuple_counts(F.col(expr), window, eob)).alias("_t"))
    return t.select(*keys, "_t.from", "_t.to", "_t.rel", "_t.cnt")


def short_pairs(pairs: DataFrame, longest: int = 200) -> DataFrame:
    """Pairs whose two tags and way have at most ``longest`` characters together."""
    return pairs.filter(F.length("from") + F.length("to") + F.length("rel") <= longest)


def distance_relation(to: Column, rel: Column) -> Column:
    """The way of a layout tuple as ``length.level``: steps above count up, steps below down; ends are ``0.0``.

    Ways with steps over or under a symbol have no level and give null.
    """
    times = lambda signs: F.length(rel) - F.length(F.translate(rel, signs, ""))
    level = (times("ac") - times("bd")).cast("string")
    return F.when(to == END, "0.0").when(rel.rlike(r"\A[acbdnwe]*\z"), F.concat(F.length(rel).cast("string"), F.lit("."), level))
