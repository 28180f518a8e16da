from datetime import datetime as dt

from glyphgrove.operators import orphans
from tests.skew import large


def day(n):
    return None if n is None else dt(2020, 1 + (n - 1) // 28, 1 + (n - 1) % 28)


PARENT = "id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz, at string"
CHILD = "ref bigint, t timestamp_ntz, missing_id int"


def run(spark, parents, children):
    p = spark.createDataFrame([(i, day(a), day(b), "clash") for i, a, b in parents], PARENT)
    c = spark.createDataFrame([(i, day(t), 0) for i, t in children], CHILD)
    out = orphans.orphan_references([orphans.Reference("c", c, "ref", "t")], p, "id").collect()
    return {(r["missing_id"], r["period"], r["reason"], r["n_references"]) for r in out}


def test_reasons(spark):
    parents = [(1, 5, None), (2, 5, 10), (3, 5, 10), (3, 20, None), (4, 5, 10), (4, 8, 30), (1, 5, None), (7, None, None)]
    children = [(1, 5), (1, 4), (2, 9), (2, 10), (2, 4), (3, 15), (3, 20), (3, 1), (4, 12), (4, 29), (4, 30), (5, 1), (5, 2), (5, 40), (None, 1), (-1, 1), (1, None), (6, None), (7, 3)]
    assert run(spark, parents, children) == {
        (1, "2020-01", "late", 1), (2, "2020-01", "deleted", 1), (2, "2020-01", "late", 1), (3, "2020-01", "deleted", 1), (3, "2020-01", "late", 1),
        (4, "2020-02", "deleted", 1), (5, "2020-01", "missing", 2), (5, "2020-02", "missing", 1), (6, None, "missing", 1), (7, "2020-01", "late", 1),
    }


def test_gap_between_closed_intervals(spark):
    assert run(spark, [(1, 1, 5), (1, 10, 15)], [(1, 4), (1, 7), (1, 12), (1, 20)]) == {(1, "2020-01", "deleted", 2)}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [(1, 1)]) == {(1, "2020-01", "missing", 1)}
    assert run(spark, [(1, 1, None)], []) == set()


def test_hot_key_is_split(spark):
    """A third of all references have one key, which is in the table, deleted, or open between intervals."""
    parents = [(1, 5, None), (2, 1, 5), (2, 10, 15), *[(i, 5, None) for i in range(10, 500)]]
    children = [(3, 1 + i % 60) for i in range(4000)] + [(2, 1 + i % 20) for i in range(4000)] + [(10 + i % 600, 7) for i in range(4000)]
    plain = run(spark, parents, children)
    with large(spark) as split:
        assert run(spark, parents, children) == plain
        assert split() >= 1
