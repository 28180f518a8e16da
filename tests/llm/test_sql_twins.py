"""Every query of the training-data operators against its SQL on the smallest tables; the others against plain Python."""

import pytest

from glyphgrove.llm import personal, queries
from tests.compare import assert_same
from tests.llm.test_texts import brute_leaks, brute_near


def read(spark, data, name, ident):
    return [tuple(r) for r in spark.read.parquet(f"{data}/{name}.parquet").select(ident, "text").collect()]


def token_ids(spark, data, df):
    """One list for each document, empty for those without text; lists are compared in another test."""
    ids = {r["doc_id"]: r["ids"] for r in df.collect()}
    texts = dict(read(spark, data, "documents", "doc_id"))
    assert ids.keys() == texts.keys() and all(bool(ids[i]) == bool(t) for i, t in texts.items())


def leaks(spark, data, df):
    assert {tuple(r) for r in df.collect()} == brute_leaks(read(spark, data, "documents", "doc_id"), read(spark, data, "benchmark", "item_id"), queries.LEAK_WORDS)


def near(spark, data, df):
    docs, items = read(spark, data, "documents", "doc_id"), read(spark, data, "benchmark", "item_id")
    assert {tuple(r) for r in df.select("doc_id", "item_id", "n_terms").collect()} == brute_near(docs, items, queries.NEAR_TERMS, queries.NEAR_WORDS)


def found(spark, data, df):
    texts = dict(read(spark, data, "documents", "doc_id"))
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
    assert all(kind in personal.KINDS and piece in texts[i] for i, kind, piece in rows)


def redacted(spark, data, df):
    texts = dict(read(spark, data, "documents", "doc_id"))
    out = {r["doc_id"]: r["text"] for r in df.collect()}
    assert out.keys() == texts.keys()
    pieces = {}
    for r in queries.p9_found(spark, data).collect():
        pieces.setdefault(r["doc_id"], []).append(r["found"])
    for i, t in texts.items():
        assert out[i] == t if i not in pieces else not any(p in out[i] for p in pieces[i])


PLAIN = {"p7_ids": token_ids, "p8_found": leaks, "p8_near": near, "p9_found": found, "p9_redacted": redacted}


def test_every_query_is_checked():
    assert queries.SQL.keys() <= queries.QUERIES.keys() and PLAIN.keys() | queries.SQL.keys() == queries.QUERIES.keys()


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        assert_same(df, duck, queries.SQL[name])
    else:
        PLAIN[name](spark, data, df)
