"""References to records that are missing, deleted or not there yet.

The work follows the size of the reference tables once:

* foreign keys are reduced to distinct (source, key), and keys without any parent row fall out in a left
  anti-join; they are joined back to the references for their periods;
* the other references meet one summary row per parent key (first load, earliest load that was never
  deleted), which decides nearly all of them;
* only references between those two times are compared with the key's intervals, in a second left anti-join.

A parent key with very many rows is pre-aggregated before it is shuffled. Both joins are of two plainly shuffled
sides, so adaptive execution splits a hot key in them; what they leave is kept in the checkpoint folder or shuffled
on other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.runtime import apart, durable


@dataclass(frozen=True)
class Reference:
    """Foreign key ``key`` of the table ``child``, used at the time ``at``."""

    name: str
    child: DataFrame
    key: str
    at: str


def _references(refs: list[Reference]) -> DataFrame:
    out = None
    for r in refs:
        part = r.child.select(F.lit(r.name).alias("table_name"), F.lit(r.key).alias("field"), F.col(r.key).cast("bigint").alias("missing_id"), F.col(r.at).alias("at"))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("missing_id") >= 0)


def orphan_references(refs: list[Reference], parent: DataFrame, parent_key: str, *, loaded: str = "loaded_at", deleted: str = "deleted_at") -> DataFrame:
    """``table_name, field, missing_id, period, reason, n_references`` of references without a parent at their time.

    A parent row is there from ``loaded`` (included) until ``deleted`` (excluded; null: for ever). Reasons:
    ``missing`` no parent row at all, ``late`` all rows loaded after the reference, else ``deleted``. Null and
    negative keys refer to nothing. A parent row whose load time is null is never there, but exists. A
    reference without a time can't be judged against intervals: it is an orphan only if its key is missing,
    with a null period. Repeated rows count once each in ``n_references``.
    """
    refers = _references(refs)
    intervals = parent.select(F.col(parent_key).cast("bigint").alias("id"), F.col(loaded).alias("since"), F.col(deleted).alias("until")).filter("id is not null")
    summary = intervals.groupBy("id").agg(
        F.min("since").alias("first_load"),
        F.min(F.when(F.col("until").isNull(), F.col("since"))).alias("kept_from"),
        F.max(F.col("until")).alias("last_end"),
    )
    absent = refers.select(F.col("missing_id").alias("id")).distinct().join(summary.select("id"), "id", "left_anti")
    # one row per key, absent keys included, so that the references are joined back once
    keys = summary.withColumn("there", F.lit(True)).unionByName(absent.withColumn("there", F.lit(False)), allowMissingColumns=True)
    period = F.date_format("at", "yyyy-MM")
    at = F.col("at")
    met = refers.join(apart(keys, "id"), F.col("missing_id") == F.col("id"))
    late = F.col("first_load").isNull() | (at < F.col("first_load"))
    over = F.coalesce(at >= F.col("last_end"), F.lit(True))
    reason = F.when(~F.col("there"), "missing").when(late, "late").when(over, "deleted")
    judged = durable(met.filter(~F.col("there") | (at.isNotNull() & ~F.coalesce(at >= F.col("kept_from"), F.lit(False)))).select("table_name", "field", "missing_id", "at", reason.alias("reason")))
    settled = judged.filter("reason IS NOT NULL").select("table_name", "field", "missing_id", period.alias("period"), "reason")
    open_ = judged.filter("reason IS NULL").select("table_name", "field", "missing_id", "at")
    i = intervals.filter("since is not null and until is not null").distinct().alias("i")
    gap = (
        open_.alias("o")
        .join(i, (F.col("o.missing_id") == F.col("i.id")) & (F.col("o.at") >= F.col("i.since")) & (F.col("o.at") < F.col("i.until")), "left_anti")
        .select("table_name", "field", "missing_id", period.alias("period"), F.lit("deleted").alias("reason"))
    )
    found = settled.unionByName(gap)
    by = ["table_name", "field", "missing_id", "period", "reason"]
    return found.groupBy(*by).agg(F.count("*").alias("n_references"))
