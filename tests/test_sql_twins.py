"""Every core query against its SQL on the smallest tables; those without SQL against plain Python."""

import collections

import numpy as np
import pytest

from glyphgrove.functions.stem import stem
from glyphgrove.operators import rerank
from glyphgrove.plans import ranking, registry, retrieval
from tests.compare import assert_same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def close(a, b):
    return a == pytest.approx(b, abs=1e-6)


def aligned(metric, kind="slt"):
    """Every hit's vector by scoring its pair alone."""

    def check(spark, data, df):
        occ = retrieval._visuals(spark, data) if kind == "slt" else retrieval._operators(spark, data)
        asked = collections.defaultdict(list)
        for r in retrieval._asked(occ).collect():
            asked[r["query_id"]].append(r["expr"])
        rows = df.collect()
        assert rows and max(r["rank"] for r in rows) > 10
        for r in rows[:: max(1, len(rows) // 400)]:
            assert any(close(r["scores"], rerank.score_pair(q, r["expr"], metric)["scores"]) for q in asked[r["query_id"]])

    return check


def groups(spark, data, df):
    scores = {(r["query_id"], r["expr"]): r["scores"] for r in QUERIES["align_metric12"](spark, data).collect()}
    by = collections.defaultdict(list)
    for r in df.collect():
        by[r["query_id"]].append((scores[r["query_id"], r["expr"]], r))
    assert by
    for rows in by.values():
        vectors = sorted({tuple(s) for s, _ in rows}, reverse=True)
        for s, r in rows:
            assert r["group"] == vectors.index(tuple(s)) + 1 and r["abs_rank"] == sum(tuple(t) > tuple(s) for t, _ in rows)
        assert sorted(r["place"] for _, r in rows) == list(range(1, len(rows) + 1))
        order = [r["subgroup"] for _, r in sorted(rows, key=lambda x: x[1]["place"])]
        assert order == sorted(order)


def document_order(spark, data, df):
    best, total = {}, collections.Counter()
    for r in QUERIES["align_metric12"](spark, data).collect():
        key = r["query_id"], r["doc_id"]
        best[key] = max(best.get(key, []), r["scores"])
        total[key] += r["scores"][0]
    rows = df.collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == best.keys()
    for r in rows:
        key = r["query_id"], r["doc_id"]
        assert close(r["best"], best[key]) and close(r["total"], total[key])
    by = collections.defaultdict(list)
    for r in rows:
        by[r["query_id"]].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        assert all((x["best"], x["total"]) >= (y["best"], y["total"]) for x, y in zip(rs, rs[1:], strict=False))


def text_order(spark, data, df):
    rows = df.selectExpr("query_id", "item_id", "cast(score as string) s", "rank").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["query_id"]].append(r)
    assert len(rows) == ranking._merged(spark, data).count()
    for rs in by.values():
        want = sorted(sorted(rs, key=lambda r: r["item_id"]), key=lambda r: r["s"], reverse=True)
        assert [r["rank"] for r in want] == list(range(1, len(rs) + 1))


def regression(spark, data, df):
    rows = [(r["fold"], r["scores"], r["relevance"]) for r in ranking._features(spark, data).collect()]
    rows = [r for r in rows if r[2] is not None and r[0] in set("0123456789")]
    for r in df.collect():
        part = lambda test, f=r["fold"]: [(x, y) for g, x, y in rows if (g == f) == test]
        train, test = part(False), part(True)
        assert (r["n_train"], r["n_test"]) == (len(train), len(test))
        error = lambda p, w=r["weights"]: np.mean([(np.dot(w, [1, *x]) - y) ** 2 for x, y in p]) if p else None
        a, b = np.array([[1, *x] for x, _ in train]), np.array([y for _, y in train])
        least = np.mean((a @ np.linalg.lstsq(a, b, rcond=None)[0] - b) ** 2)
        assert close(r["train_mse"], error(train)) and close(r["train_mse"], least)
        assert r["test_mse"] is None if not test else close(r["test_mse"], error(test))


def stems(spark, data, df):
    want = collections.Counter()
    for r in spark.read.parquet(f"{data}/documents.parquet").select("text").filter("text IS NOT NULL").collect():
        word = ""
        for c in r["text"] + " ":
            if c.isascii() and c.isalnum():
                word += c.lower()
            elif word:
                want[stem(word)] += 1
                word = ""
    assert {r["stem"]: r["n"] for r in df.collect()} == want


def wildcards(spark, data, df):
    """Scores are right where the wildcards are: a query's own expression takes all of its tuples."""
    rows = df.collect()
    assert rows and all(0 < r["score"] <= 1 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["query_id"]].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r["rank"])
        assert rs[0]["score"] == 1.0 and [r["rank"] for r in rs] == list(range(1, len(rs) + 1))
        assert all((-x["score"], x["first_doc"]) < (-y["score"], y["first_doc"]) for x, y in zip(rs, rs[1:], strict=False))


PLAIN = {
    "align_metric12": aligned(12), "align_metric6": aligned(6), "opt_align_metric12": aligned(12, "opt"), "rerank_groups": groups, "rerank_documents": document_order,
    "combined_order_compat": text_order, "regression_cv": regression, "stem_terms": stems, "wildcard_topk": wildcards,
}


def test_every_query_is_checked():
    assert SQL.keys() <= QUERIES.keys() and PLAIN.keys() | SQL.keys() == QUERIES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(df, duck, SQL[name])
    else:
        PLAIN[name](spark, data, df)
