"""Connected components by seed-tree pruning.

Each round, every vertex learns the smallest id of its neighbourhood and tells it to all its neighbours.
Vertices that are nobody's minimum leave the graph and hang themselves below their smallest neighbour in a
propagation forest; the rest go on with far fewer edges. When no edge is left, the roots of the forest are
the seeds, and their ids flow down it, last round first.

All steps are joins and combinable aggregates on (vertex, vertex) rows: neighbourhoods are never gathered.
A hub's rows may fill a join partition, which adaptive execution splits: both sides of each join are shuffled for
it, and each join is followed by a shuffle on other keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphgrove.runtime import apart, durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex, seed`` for each vertex of at least one edge; ``seed`` is the smallest id of its component.

    Edges are undirected; repeated edges, both directions of one edge and self loops do no harm (a vertex with
    nothing but a self loop is its own component). Edges with a null end are ignored. No edges: no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    graph = durable(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    vertices = graph.select(F.col("u").alias("vertex")).distinct()
    fallen: list[DataFrame] = []
    while not graph.isEmpty():
        least = graph.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = graph.join(apart(least, "u"), "u").select(F.col("v").alias("u"), "m").unionByName(least)
        told = durable(told.distinct())
        view = told.groupBy("u").agg(F.min("m").alias("low"), F.max((F.col("m") == F.col("u")).cast("int")).alias("alive"))
        fallen.append(view.filter("alive = 0").select(F.col("u").alias("vertex"), F.col("low").alias("parent")))
        links = told.join(apart(view.select("u", "low"), "u"), "u").filter("m <> low").select(F.col("m").alias("u"), F.col("low").alias("v"))
        graph = durable(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    if not fallen:
        return vertices.select("vertex", F.col("vertex").alias("seed"))
    known: DataFrame | None = None
    for tree in reversed(fallen):
        if known is None:
            known = tree.select("vertex", F.col("parent").alias("seed"))
            continue
        up = known.select(F.col("vertex").alias("parent"), "seed")
        level = tree.join(apart(up, "parent"), "parent", "left").select("vertex", F.coalesce("seed", "parent").alias("seed"))
        known = durable(known.unionByName(level))
    return vertices.join(known, "vertex", "left").select("vertex", F.coalesce("seed", "vertex").alias("seed"))


def _value_key(scope: Column, value: Column) -> Column:
    """16 bytes that stand for a value within its scope: the first half of SHA-256 over both, the scope's length first."""
    whole = F.concat(F.length(scope).cast("string"), F.lit(":"), scope, value)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 32))


def group_by_shared_values(rows: DataFrame, ident: str, scope: str, keys: list[str], *, no_value: tuple[str, ...] = ("", "None")) -> DataFrame:
    """``group_id, ident`` of rows that share a value of one of ``keys`` within ``scope``, directly or by others.

    ``group_id`` is the smallest ``ident`` of the group; rows linked to nothing don't occur. Values of different
    keys are not compared. Null, empty and the words in ``no_value`` mean no value and link nothing, and a null
    scope links nothing. Rows that agree in scope and all keys are merged first by a combinable aggregate, then
    each shared value becomes a star around its smallest row: as many edges as rows, never all pairs.

    Values are shuffled as cryptographic digests of 128 bits and not as the texts they are: that two of 10^12 values
    share one has a chance below 10^-14.
    """
    text = F.col(scope).cast("string")
    names = [f"_k{i}" for i in range(len(keys))]
    digests = [F.when(~F.col(k).isin(*no_value), _value_key(text, F.col(k).cast("string"))).alias(n) for k, n in zip(keys, names, strict=True)]
    base = rows.filter(F.col(scope).isNotNull()).select(F.col(ident).alias("_id"), *digests)
    base = base.filter(reduce(lambda x, y: x | y, [F.col(k).isNotNull() for k in names]))
    units = durable(base.groupBy(*names).agg(F.min("_id").alias("_u"), F.count("*").alias("_n")))
    stars = None
    for k in names:
        valued = units.filter(F.col(k).isNotNull()).select(k, "_u")
        centre = valued.groupBy(k).agg(F.min("_u").alias("_c"), F.count("*").alias("_m")).filter("_m > 1").drop("_m")
        part = valued.join(apart(centre, k), k).filter("_u <> _c").select(F.col("_u").alias("a"), F.col("_c").alias("b"))
        stars = part if stars is None else stars.unionByName(part)
    label = components(stars).withColumnsRenamed({"vertex": "_u", "seed": "_g"})
    grouped = units.join(label, "_u", "left").filter(F.col("_g").isNotNull() | (F.col("_n") > 1))
    grouped = grouped.select(*[F.col(n).alias(f"_g{n}") for n in names], F.coalesce("_g", "_u").alias("group_id"))
    same = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_g{n}")) for n in names])
    return base.join(apart(grouped, *[f"_g{n}" for n in names]), same).select("group_id", F.col("_id").alias(ident))
