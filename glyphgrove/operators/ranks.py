"""Row numbers within groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphgrove.runtime import durable


def number_rows(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1, 2, … within each group in the given order, without ever putting a group into one task.

    Rows are range-partitioned by group and order, so a group with a third of all rows lies over a third of the
    partitions; rows are numbered within their partition, and the sizes of a group's earlier partitions are added, one
    row per group and partition. The partitioning is kept in the checkpoint folder, as ranges are sampled anew on every
    run. ``order`` must leave no ties. Null groups are groups; an empty table stays empty.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(df.repartitionByRange(n, *[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = {g: f"_g{i}" for i, g in enumerate(group)}
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size").withColumnsRenamed({**keys, "_part": "_p"})
    local = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(k)) for g, k in keys.items()], F.col("_part") == F.col("_p"))
    return local.join(offsets, same).withColumn(name, (F.col("_n") + F.col("_before")).cast("int")).drop("_part", "_n", "_p", "_before", *keys.values())
