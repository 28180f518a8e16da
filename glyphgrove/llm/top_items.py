"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_items(rows: DataFrame, group: list[str], item: str, score: str, n: int = 10, *, valid: Column | None = None, place: str = "place") -> DataFrame:
    """``group + [item, place]``: the ``n`` items with the highest score of each group, place 1 to ``n``.

    Ties go to the smaller item. An item counts once in a group, with its best score: duplicates are removed
    by a map-side combined maximum keyed by group *and* item, so a huge group is spread over all tasks. The
    rank filter on ``row_number`` then lets the optimiser put its group-limit operator on both sides of the
    shuffle by group: what reaches a group's task is at most ``n`` rows from each map task.

    Null and NaN scores and null items never count; ``valid`` may exclude more. A null in a group column is a
    group of its own. Groups without a valid row don't occur in the result; columns other than those named are
    ignored, so clashing names do no harm.
    """
    usable = F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull()
    if valid is not None:
        usable &= valid
    best = rows.filter(usable).groupBy(*group, item).agg((F.max(score) + F.lit(0.0)).alias("_best"))
    order = Window.partitionBy(*group).orderBy(F.desc("_best"), F.asc(item))
    return best.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= n).select(*group, item, place)
