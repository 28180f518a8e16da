"""Looks into the plans that ran: whether adaptive execution split a join with a hot key."""

from contextlib import contextmanager

#: Small thresholds and no broadcasts, so that test tables behave as large ones do.
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    "spark.sql.shuffle.partitions": "8",
}


@contextmanager
def large(spark):
    """Session in which joins are shuffled and skew is looked for; gives a function that counts split joins so far."""
    old = {k: spark.conf.get(k, None) for k in LARGE}
    for k in old:
        spark.conf.set(k, LARGE[k])
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()

    def split() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = store.executionsList()
        plans = [rows.apply(i).physicalPlanDescription().split("Initial Plan")[0] for i in range(began, rows.size())]
        return sum(p.count("skew=true") for p in plans)

    try:
        yield split
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
