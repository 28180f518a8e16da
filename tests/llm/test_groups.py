"""Top items, components and hidden duplicates against brute force."""

import collections
import math
import random

from pyspark.sql import functions as F

from glyphgrove.llm import components, hidden_duplicates, top_items
from tests.skew import large


def test_top_items(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice(["r", "s"]), rnd.choice([None, -1, *range(40)]), rnd.choice([None, float("nan"), -0.0, 0.0, 0.5, 1.0, 1.5, round(rnd.random(), 1)]), "x") for _ in range(2000)]
    rows += [("hot", "r", i % 300, (i * 7919 % 1000) / 1000, "x") for i in range(5000)]
    df = spark.createDataFrame(rows, "query_id string, run string, post_id bigint, score double, place string")
    got = {tuple(r) for r in top_items.top_items(df, ["query_id", "run"], "post_id", "score", 10, valid=F.col("score").between(0, 1) & (F.col("post_id") >= 0)).collect()}
    best = collections.defaultdict(dict)
    for q, r, p, s, _ in rows:
        if p is not None and p >= 0 and s is not None and not math.isnan(s) and 0 <= s <= 1:
            best[q, r][p] = max(s, best[q, r].get(p, 0))
    want = {(q, r, p, i + 1) for (q, r), d in best.items() for i, (p, s) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:10])}
    assert got == want


def test_group_limit_prunes_on_both_sides(spark):
    df = spark.range(100).selectExpr("id % 3 g", "id i", "rand() s")
    plan = top_items.top_items(df, ["g"], "i", "s", 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_top_items_of_nothing(spark):
    df = spark.createDataFrame([], "g string, i bigint, s double")
    assert top_items.top_items(df, ["g"], "i", "s").count() == 0


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in parent}


def check_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r["vertex"]: r["seed"] for r in components.components(df).collect()} == brute_components([e for e in edges if None not in e])


def test_components_of_random_graphs(spark):
    rnd = random.Random(5)
    for n, m in ((30, 20), (60, 60)):
        check_components(spark, [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)])


def test_components_of_special_graphs(spark):
    chain = list(range(40))
    random.Random(1).shuffle(chain)
    check_components(spark, list(zip(chain, chain[1:], strict=False)) + [(100, i) for i in range(101, 150)] + [(200, 200), (None, 3), (4, None)])
    check_components(spark, [])


CANDIDATES = "cand_id bigint, query_id string, slt_str string, opt_str string, group_id string"


def test_shared_values(spark):
    rnd = random.Random(9)
    tree = lambda k: rnd.choice([None, "", "None", *[f"[{k}{i}]" for i in range(25)]])
    rows = [(i, rnd.choice(["A", "B", None]), tree("s"), rnd.choice([tree("o"), tree("s")]), "clash") for i in range(120)]
    rows += [(1000 + i, "C", "[same]", f"[o{i}]", None) for i in range(50)] + [(2000, "D", "[x]", "[y]", None), (2001, "D", "[y]", "[x]", None), (2002, "D", "[z]", "[z]", None), (2003, "D", "[z]", "[z]", None)]
    edges = []
    for k in (2, 3):
        by = collections.defaultdict(list)
        for r in rows:
            if r[1] is not None and r[k] not in (None, "", "None"):
                by[r[1], r[k]].append(r[0])
        edges += [(v[0], x) for v in by.values() for x in v[1:]]
    df = spark.createDataFrame(rows, CANDIDATES)
    got = {(r["cand_id"], r["group_id"]) for r in components.group_by_shared_values(df, "cand_id", "query_id", ["slt_str", "opt_str"]).collect()}
    assert got == set(brute_components(edges).items())


def test_shared_values_of_nothing(spark):
    df = spark.createDataFrame([], CANDIDATES)
    assert components.group_by_shared_values(df, "cand_id", "query_id", ["slt_str", "opt_str"]).count() == 0


RECORDS = "rec_id bigint, formula string, visual_id string, kept_id string"
FIELDS = {"formula": "value", "visual_id": "value"}


def test_hidden_duplicates(spark):
    rows = [
        (1, "x + Y", "vid.1", "clash"), (2, "X+y.", "VID 1", None), (3, "vid1", "x +　y", None), (4, "x+y", "vid2", None), (5, None, "", None), (6, " ", None, None), (7, "Straße", "a", None),
        (8, "STRASSE", "A", None), (9, "ab", "", None), (10, "a", "b", None), (11, "'$x`+\"y\"!?;:,", "vid.1", None), (12, "ΟΔΟΣ", "q", None), (13, "οδος", "q", None), (14, "x+y", "x+y", None), (15, "x​y", "1", None), (16, "xy", "1", None),
    ]
    df = spark.createDataFrame(rows, RECORDS)
    got = {(r["kept_id"], r["rec_id"]) for r in hidden_duplicates.find_copies(df, "rec_id", FIELDS).collect()}
    assert got == {(1, 2), (1, 3), (1, 11), (5, 6), (7, 8), (12, 13)}
    counts = {r["kept_id"]: r["n_copies"] for r in hidden_duplicates.collapse(df, "rec_id", FIELDS).collect()}
    assert counts == {1: 4, 4: 1, 5: 2, 7: 2, 9: 1, 10: 1, 12: 2, 14: 1, 15: 1, 16: 1}


def test_field_names_matter(spark):
    df = spark.createDataFrame([(1, "a", "b", None), (2, "b", "a", None)], RECORDS)
    assert hidden_duplicates.find_copies(df, "rec_id", {"formula": "f", "visual_id": "v"}).count() == 0
    assert hidden_duplicates.find_copies(df, "rec_id", FIELDS).count() == 1


def test_chance_collisions_join_nothing(spark, monkeypatch):
    monkeypatch.setattr(hidden_duplicates, "fingerprint", lambda fields: [F.lit(1), F.lit(2)])
    df = spark.createDataFrame([(1, "a", "b", None), (2, "c", "d", None), (3, "D", "C", None), (4, "b", "a", None), (5, "c", "d", None)], RECORDS)
    assert {tuple(r) for r in hidden_duplicates.find_copies(df, "rec_id", FIELDS).collect()} == {(1, 4), (2, 3), (2, 5)}


def test_no_records(spark):
    df = spark.createDataFrame([], RECORDS)
    assert hidden_duplicates.find_copies(df, "rec_id", FIELDS).count() == 0 and hidden_duplicates.collapse(df, "rec_id", FIELDS).count() == 0


def test_hot_copies_are_split(spark):
    rows = [(i, "hot", "x", None) for i in range(4000)] + [(4000 + i, f"a{i % 3000}", "y", None) for i in range(8000)]
    df = spark.createDataFrame(rows, RECORDS)
    with large(spark) as split:
        got = {(r["kept_id"], r["rec_id"]) for r in hidden_duplicates.find_copies(df, "rec_id", FIELDS).collect()}
        assert got == {(0, i) for i in range(1, 4000)} | {(4000 + i % 3000, 4000 + i) for i in range(3000, 8000)}
        assert split() >= 2  # records with their fingerprints, records with the kept one


def test_hot_values_and_hubs_are_split(spark):
    """A third of all candidates has one tree, and all but these hang on one hub by trees of their own."""
    rows = [(i, "q", "[hot]", f"[o{i}]", None) for i in range(4000)] + [(4000 + i, "q", f"[s{i % 2000}]", f"[p{i // 4}]", None) for i in range(8000)]
    df = spark.createDataFrame(rows, CANDIDATES)
    edges = [(0, i) for i in range(1, 4000)]
    for key in (lambda i: ("s", i % 2000), lambda i: ("p", i // 4)):
        by = collections.defaultdict(list)
        for i in range(8000):
            by[key(i)].append(4000 + i)
        edges += [(v[0], x) for v in by.values() for x in v[1:]]
    with large(spark) as split:
        got = {(r["cand_id"], r["group_id"]) for r in components.group_by_shared_values(df, "cand_id", "query_id", ["slt_str", "opt_str"]).collect()}
        assert got == set(brute_components(edges).items())
        assert split() >= 1


def test_hub_of_a_graph_is_split(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 5000)] + [(5000 + 2 * i, 5001 + 2 * i) for i in range(5000)], "a bigint, b bigint")
    with large(spark) as split:
        got = {r["vertex"]: r["seed"] for r in components.components(edges).collect()}
        assert got == {i: 0 for i in range(5000)} | {5000 + i: 5000 + i // 2 * 2 for i in range(10000)}
        assert split() >= 1
