"""Search with wildcards: equal to scoring all pairs however its passes are cut, and without a shuffle of pairs."""

import random

import pytest

from glyphgrove.operators import index as indexing
from glyphgrove.operators import retrieve, wildcards
from glyphgrove.parse import trees
from tests.test_engine import brute, random_tree, shown, wild_score


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    return [(d, 0, trees.render(random_tree(rnd))) for d in range(150)] + [(d, 0, f"[V!{x}[+[N!{n}]]]") for d, (x, n) in enumerate(((x, n) for x in "abxy" for n in range(25)), 150)]


@pytest.fixture(scope="module")
def index(spark, corpus):
    return indexing.build(spark.createDataFrame(corpus, "doc_id bigint, position int, expr string"))


@pytest.fixture(scope="module")
def asked(corpus):
    return [(d, e.replace("V!x", "?w").replace("N!1", "?v")) for d, _, e in corpus[::9]]


@pytest.mark.parametrize(("k", "probed", "times", "rows", "stored"), [(1, 1, 1, 1 << 30, False), (4, 1, 1, 40, False), (4, 400, 4, 1 << 30, True), (20, 2, 2, 100, True), (1000, 10, 1, 1 << 30, False)])
def test_every_cut_is_brute_force(spark, corpus, index, asked, monkeypatch, tmp_path, k, probed, times, rows, stored):
    for name, value in (("PROBED", probed), ("PROBED_K", times), ("GROUP_ROWS", rows)):
        monkeypatch.setattr(wildcards, name, value)
    if stored:
        indexing.write(index, str(tmp_path / "i"), buckets=2)
        index = indexing.read(spark, str(tmp_path / "i"))
    q = retrieve.Queries(spark.createDataFrame([*asked, (None, "[V!x]"), (-1, "x"), (-2, "[?w[unseen]]")], "query_id bigint, expr string"))
    q.small = not stored
    assert shown(retrieve.search(index, q, k, wildcards=True)) == brute(corpus, asked, k, wild_score)


def test_least_score(spark, corpus, index, asked):
    q = retrieve.Queries(spark.createDataFrame(asked, "query_id bigint, expr string"))
    for least in (0.3, 0.5, 1.0):
        want = {r for r in brute(corpus, asked, 12, wild_score) if r[2] >= least}
        assert shown(retrieve.search(index, q, 12, wildcards=True, least=least)) == want


def moved(spark):
    """Records that all stages so far wrote for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    gw = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_are_not_moved(spark, monkeypatch):
    """200 queries that share tuples with all of 2,000 expressions are 400,000 pairs, of which each query keeps five."""
    rnd = random.Random(3)
    rows = [(d, 0, f"[V!{rnd.choice('abcdefgh')}[=[N!{d}[V!{rnd.choice('abcdefgh')}[+[V!{rnd.choice('abcdefgh')}]]]]]]") for d in range(2000)]
    index = indexing.build(spark.createDataFrame(rows, "doc_id bigint, position int, expr string").coalesce(2))
    q = retrieve.Queries(spark.createDataFrame([(d, "[?w[" + e.split("[", 2)[2]) for d, _, e in rows[::10]], "query_id bigint, expr string"))
    monkeypatch.setattr(wildcards, "PROBED", 50, raising=False)
    began = moved(spark)
    assert retrieve.search(index, q, 5, wildcards=True).count() == 1000
    assert moved(spark) - began < 60_000
