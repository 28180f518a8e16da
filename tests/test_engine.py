"""Index, retrieval, re-ranking, sources and streams on small tables against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphgrove.align.pairs import multiset_dice
from glyphgrove.engine import Engine
from glyphgrove.functions import report
from glyphgrove.functions.register import register
from glyphgrove.operators import documents, evaluate, fusion, ranks, rerank, retrieve, text, tuples
from glyphgrove.operators import index as indexing
from glyphgrove.parse import trees
from glyphgrove.parse.pairs import expand
from glyphgrove.sources import documents as sources
from glyphgrove.sources import records
from glyphgrove.streaming import search


def random_tree(rnd, depth=3):
    t = trees.Tree(rnd.choice(["V!x", "V!y", "N!1", "+", "O!divide", "M!()1x1", "E!"]))
    if depth:
        for k in "naouw":
            if rnd.random() < 0.3:
                t.edges[k] = random_tree(rnd, depth - 1)
    return t


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(11)
    return [(d, p, trees.render(random_tree(rnd))) for d in range(40) for p in range(3)] + [(50, 0, None), (51, 0, "None"), (52, 0, "[V!x]"), (53, 0, "[V!x]")]


@pytest.fixture(scope="module")
def occ(spark, corpus):
    return spark.createDataFrame([(*r, "clash", 1) for r in corpus], "doc_id bigint, position int, expr string, tuples string, tc int")


@pytest.fixture(scope="module")
def index(occ):
    return indexing.build(occ)


def first_seen(corpus):
    out = {}
    for d, p, e in corpus:
        if e and e != "None":
            out[e] = min(out.get(e, 1 << 60), (d << 22) + p)
    return out


def brute(corpus, queries, k, score):
    ids = first_seen(corpus)
    out = set()
    for q, e in queries:
        s = [(-score(e, x), i) for x, i in ids.items() if score(e, x) > 0]
        out |= {(q, i, round(-v, 12), n + 1) for n, (v, i) in enumerate(sorted(s)[:k])}
    return out


def dice(a, b):
    return multiset_dice(expand(trees.parse(a)), expand(trees.parse(b)))


def shown(df):
    return {(r["query_id"], r["expr_id"], round(r["score"], 12), r["rank"]) for r in df.collect()}


def test_search_is_brute_force(spark, corpus, index):
    queries = [(f"q{i}", e) for i, (_, _, e) in enumerate(corpus) if i % 17 == 0 and e] + [("none", "[V!unseen]")]
    df = spark.createDataFrame([*queries, ("null", None), ("bad", "x")], "query_id string, expr string")
    q = retrieve.Queries(df)
    want = brute(corpus, queries, 5, dice)
    assert shown(retrieve.search(index, q, 5)) == want
    assert shown(retrieve.search_bounded(index, q, 5)) == want
    q.small = False
    assert shown(retrieve.search(index, q, 5)) == want


def wild_score(q, c):
    a, b = expand(trees.parse(q)), expand(trees.parse(c))
    kept = {t: n for t, n in a.items() if not (t[0][0] == "?" and t[1][0] == "?")}
    exact = {t: n for t, n in kept.items() if t[0][0] != "?" and t[1][0] != "?"}
    common = sum(min(n, b[t]) for t, n in exact.items())
    rest = Counter({t: n - min(n, exact.get(t, 0)) for t, n in b.items()})
    wild = sorted(((t[0], t[1], t[2], i) for t, n in kept.items() if t not in exact for i in range(n)))
    for f, t, r, _ in wild:
        fits = [x for x, n in rest.items() if n > 0 and x[2] == r and (x[1] == t if f[0] == "?" else x[0] == f)]
        if fits:
            best = min(fits, key=lambda x: (-rest[x], x))
            rest[best] -= 1
            common += 1
    return 2 * common / (sum(b.values()) + sum(kept.values())) if common and common <= min(sum(b.values()), sum(kept.values())) else 0.0


def test_wildcard_search_is_brute_force(spark, corpus, index):
    queries = [(f"q{i}", e.replace("V!x", "?w").replace("N!1", "?v")) for i, (_, _, e) in enumerate(corpus) if i % 13 == 0 and e]
    df = spark.createDataFrame(queries, "query_id string, expr string")
    assert shown(retrieve.search(index, retrieve.Queries(df), 6, wildcards=True)) == brute(corpus, queries, 6, wild_score)


def test_two_generators_agree(spark, corpus):
    rows = [(e,) for *_, e in corpus if e] + [("[U!plus,0[V!x],1[O!SUP,0[V!y],1[N!2]]]",), ("[U!plus,0[V!x],1[V!x]]",)]
    df = spark.createDataFrame(rows, "expr string").distinct()
    for window, eob in ((1, "all"), (2, "small"), (0, "none")):
        a = tuples.tuple_table(df, ["expr"], window=window, eob=eob)
        nodes = df.select("expr", tuples.nodes_column(F.col("expr")).alias("n"))
        b = nodes.select("expr", F.explode(tuples.prefix_join(F.col("n"), window, eob)).alias("t")).groupBy("expr", "t").agg(F.count("*").alias("cnt"))
        assert {tuple(r) for r in a.collect()} == {(r["expr"], *r["t"], r["cnt"]) for r in b.collect()}


def test_index_is_sound(index, corpus):
    m = {r["metric"]: r["value"] for r in indexing.statistics(index).collect()}
    c = {r["metric"]: r["value"] for r in indexing.consistency(index).collect()}
    assert m["n_expressions"] == len(first_seen(corpus)) and c["n_tuples"] == c["n_posted"] == m["n_tuples"]
    assert sum(r["n_expressions"] for r in indexing.distribution(index).collect()) == m["n_expressions"]


def test_index_is_stored_and_joined(spark, occ, index, tmp_path):
    indexing.write(index, str(tmp_path / "i"), buckets=3)
    back = indexing.read(spark, str(tmp_path / "i"))
    assert back.window == 4 and {tuple(r) for r in back.postings.select("from", "to", "rel", "expr_id", "cnt").collect()} == {tuple(r) for r in index.postings.select("from", "to", "rel", "expr_id", "cnt").collect()}
    both = indexing.union(indexing.build(occ.filter("doc_id < 20")), indexing.build(occ.filter("doc_id >= 20")))
    for t in ("expressions", "postings", "occurrences"):
        cols = sorted(getattr(index, t).columns)
        assert Counter(map(tuple, getattr(both, t).select(cols).collect())) == Counter(map(tuple, getattr(index, t).select(cols).collect()))


def test_empty_index(spark, occ):
    i = indexing.build(occ.limit(0))
    q = retrieve.Queries(spark.createDataFrame([("q", "[V!x]")], "query_id string, expr string"))
    assert retrieve.search(i, q).count() == 0 and indexing.statistics(i).count() == 12


def test_rerank_and_groups(spark, corpus, index):
    queries = spark.createDataFrame([("a", corpus[0][2]), ("b", corpus[4][2])], "query_id string, expr string")
    hits = retrieve.expand_hits(index, retrieve.search(index, retrieve.Queries(queries), 8))
    r = rerank.rerank(hits, queries)
    assert r.count() == hits.count()
    want = dict(queries.collect())
    for x in r.collect():
        assert x["scores"] == rerank.score_pair(want[x["query_id"]], x["expr"])["scores"]
    groups = defaultdict(list)
    for g in rerank.group_ranks(r).orderBy("query_id", "place").collect():
        groups[g["query_id"]].append(g)
    for gs in groups.values():
        assert [g["place"] for g in gs] == list(range(1, len(gs) + 1))
        assert [g["scores"] for g in gs] == sorted((g["scores"] for g in gs), reverse=True)
        assert all(g["abs_rank"] == sum(h["scores"] > g["scores"] for h in gs) for g in gs)
    assert rerank.rerank(hits, queries, limit=2).select("query_id", "expr").distinct().count() <= 4
    assert rerank.document_ranks(r).filter("rank = 1").count() == 2
    assert rerank.query_statistics(rerank.group_ranks(r), hits).count() == 2


MML = "<math>{}</math>"


def test_documents_to_search(spark):
    docs = [
        (0, "a.xhtml", f"x {MML.format('<mi>x</mi>')} y {MML.format('<mfrac><mi>x</mi><mi>y</mi></mfrac>')} {MML.format('<mi>x</mi>')}"),
        (1, "b.html", f"{MML.format('<mfrac><mi>x</mi><mi>y</mi></mfrac>')}"), (2, "c.mml", MML.format("<mystery/>") + MML.format("<mi>x</mi>")), (3, "d.xml", None), (4, "e.tex", ""),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, doc_name string, content string")
    kinds = {r["doc_id"]: r["kind"] for r in documents.dispatch(df).collect()}
    assert kinds == {0: "markup", 1: "markup", 2: "markup", 3: None, 4: "latex"}
    parsed = documents.parse_formulas(documents.scan_formulas(df), operator=False)
    assert {tuple(r) for r in documents.occurrences(parsed).collect()} == {(0, 0, "[V!x]"), (0, 1, "[O!divide,o[V!x],u[V!y]]"), (0, 2, "[V!x]"), (1, 0, "[O!divide,o[V!x],u[V!y]]")}
    assert documents.problems(parsed).collect()[0]["n_documents"] == 1
    grouped = {(r["doc_id"], r["expr"]): r["positions"] for r in documents.grouped_positions(documents.occurrences(parsed)).collect()}
    assert grouped[0, "[V!x]"] == [0, 2]
    engine = Engine(spark).index(df)
    q = spark.createDataFrame([("q", "[O!divide,o[V!x],u[?w]]")], "query_id string, expr string")
    hits = engine.search(q, 10)
    assert {(r["doc_id"], r["position"]) for r in hits.filter("rank = 1").collect()} == {(0, 1), (1, 0)}
    assert engine.rerank(hits, q).filter("rank = 1").first()["scores"] == [1.0, 1.0, 1.0]


def test_latex_by_table(spark):
    df = spark.createDataFrame([(0, '<span class="math-container">$x^2$</span> <math><mi>y</mi></math>')], "doc_id bigint, content string")
    scanned = documents.scan_formulas(df)
    assert [r["formula"] for r in scanned.orderBy("position").collect()] == ["$x^2$", "<math><mi>y</mi></math>"]
    table = spark.createDataFrame([("x^2", "<math><msup><mi>x</mi><mn>2</mn></msup></math>")], "latex string, markup string")
    parsed = documents.parse_formulas(documents.with_converted(scanned, table), operator=False)
    assert {r["expr"] for r in parsed.collect()} == {"[V!x,a[N!2]]", "[V!y]"}


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "b.mml").write_text(MML.format("<mi>x</mi>"))
    (tmp_path / "d" / "e" / "a.html").write_text("é")
    files = sources.list_folder(spark, str(tmp_path / "d"))
    got = sources.read_contents(files).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["ext"], r["content"]) for r in got] == [(0, "mml", MML.format("<mi>x</mi>")), (1, "html", "é")]
    (tmp_path / "list").write_text(f"{tmp_path}/d/b.mml\n\n{tmp_path}/none\n")
    assert [r["content"] for r in sources.read_contents(sources.read_list(spark, str(tmp_path / "list"))).orderBy("doc_id").collect()] == [MML.format("<mi>x</mi>"), None]
    (tmp_path / "control").write_text("database\tx\nwindow\t2\nodd\n")
    assert sources.read_control(spark, str(tmp_path / "control")) == {"database": "x", "window": "2"}
    (tmp_path / "t.tsv").write_text("id\ta\tb\tc\td\tformula\n7\t1\t2\t3\t4\t<math><mi>x</mi></math>\n")
    assert sources.read_formula_table(spark, str(tmp_path / "t.tsv")).first()["content"] == "<math><mi>x</mi></math>"


def test_topics(spark, tmp_path):
    page = sources.build_topics([("T.1", ["<math><mi>x</mi></math>", "<math><mn>2</mn></math>"], ["two words"]), ("T.2", [], ["k"])])
    (tmp_path / "topics.xml").write_text(page)
    queries, words = sources.read_topics(spark, str(tmp_path / "topics.xml"))
    assert {tuple(r) for r in queries.collect()} == {("T.1", 0, "[V!x]"), ("T.1", 1, "[N!2]")}
    assert {tuple(r) for r in words.collect()} == {("T.1", "two words"), ("T.2", "k")}


def test_records(spark, occ, index, tmp_path):
    grouped = documents.grouped_positions(occ.filter("expr LIKE '[%'"))
    lines = records.index_lines(grouped)
    records.rewrite_window(lines, 2).coalesce(1).write.text(str(tmp_path / "index"))
    back = records.read_index(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in back.collect()} == {(r["doc_id"], r["position"], r["expr"]) for r in occ.filter("expr LIKE '[%'").collect()}
    assert records.read_lines(spark, str(tmp_path / "index")).filter("tag = 'W'").first()["fields"] == ["2"]
    (tmp_path / "r.tsv").write_text("Q\ta\nE\t[V!x]\nC\t[U]\nP\tword\nR\t1\t0\t[V!x]\t0.5\nR\t2\t0\t[V!y]\t[0.1, 0.2]\nI\tqt\t12\nX\nQ\tb\nE\t[V!y]\nR\t3\t1\t[V!y]\t1\n")
    path = str(tmp_path / "r.tsv")
    assert [(r["query_id"], r["doc_id"], r["scores"]) for r in records.read_results(spark, path).orderBy("doc_id").collect()] == [("a", 1, [0.5]), ("a", 2, [0.1, 0.2]), ("b", 3, [1.0])]
    assert {tuple(r) for r in records.read_queries(spark, path).select("query_id", "expr_no", "expr", "constraint_expr").collect()} == {("a", 0, "[V!x]", "[U]"), ("b", 0, "[V!y]", None)}
    assert records.read_keywords(spark, path).collect() == [("a", "word")] and records.read_counters(spark, path).first()["value"] == 12.0
    q = spark.createDataFrame([("a", "[V!x]"), ("z", "[V!unseen]")], "query_id string, expr string")
    hits = retrieve.expand_hits(index, retrieve.search(index, retrieve.Queries(q), 2))
    texts = {r["query_id"]: r["value"] for r in records.result_lines(hits, q).collect()}
    assert texts["a"].startswith("Q\ta\nE\t[V!x]\nR\t") and "\nR\t52\t0\t[V!x]\t1.0\n" in texts["a"] and texts["z"] == "Q\tz\nE\t[V!unseen]\n"
    trec = evaluate.to_trec(hits, "run")
    records.write_trec(trec, str(tmp_path / "trec"))
    again = records.read_trec(spark, str(tmp_path / "trec"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in trec.collect()}
    assert records.trec_to_results(again, occ.select("doc_id", "position", "expr")).count() == trec.count()


def test_small_record_helpers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("Q\ta\nP\tword\nM\t1\t0.5\nM\t2\tx\n")
    docs = spark.createDataFrame([(1, "one.mml"), (3, "three.mml")], "doc_id bigint, doc_name string")
    assert [tuple(r) for r in records.read_text_results(spark, str(tmp_path / "m.tsv"), docs).orderBy("doc_id").collect()] == [("a", 1, "one.mml", 0.5), ("a", 2, None, None)]
    q = spark.createDataFrame([("a", 1, "[V!y]"), ("a", 0, "[V!x]")], "query_id string, expr_no int, expr string")
    k = spark.createDataFrame([("a", "w"), ("b", "v")], "query_id string, term string")
    texts = {r["query_id"]: r["value"] for r in records.query_lines(q, k).collect()}
    assert texts == {"a": "K\t1000\nW\t4\nO\t0\nQ\ta\nE\t[V!x]\nE\t[V!y]\nP\tw", "b": "K\t1000\nW\t4\nO\t0\nQ\tb\nP\tv"}
    assert [tuple(r) for r in sources.names_of(docs, spark.createDataFrame([(3,), (3,), (9,)], "doc_id bigint")).collect()] == [(3, "three.mml")]
    scanned = spark.createDataFrame([(1, 0, "f"), (1, 1, "g")], "doc_id bigint, position int, formula string")
    assert sources.fetch_formulas(scanned, spark.createDataFrame([(1, 1)], "doc_id bigint, position int")).first()["formula"] == "g"
    t = spark.createDataFrame([("a", "b", "nab"), ("a", "0!", "n"), ("a", "b", "ou")], "`from` string, `to` string, rel string")
    got = t.select(tuples.distance_relation(F.col("to"), F.col("rel")).alias("d")).collect()
    assert [r["d"] for r in got] == ["3.0", "0.0", None] and tuples.short_pairs(t, 4).count() == 2


def test_context_over_splits(spark):
    rows = [("f", i // 3, i, t, [v]) for i, (t, v) in enumerate([("R", "0"), ("Q", "a"), ("R", "1"), ("R", "2"), ("R", "3"), ("R", "4"), ("R", "5"), ("Q", "b"), ("R", "6"), ("R", "7")])]
    df = spark.createDataFrame(rows + [("g", 0, 0, "R", ["9"])], "file string, split bigint, line_no bigint, tag string, fields array<string>")
    got = {r["fields"][0]: r["q"] for r in records.with_context(df, "Q", "q").filter("tag = 'R'").collect()}
    assert got == {"0": None, "1": "a", "2": "a", "3": "a", "4": "a", "5": "a", "6": "b", "7": "b", "9": None}


def test_functions_in_sql(spark):
    register(spark)
    r = spark.sql("SELECT parse_slt('<math><mi>x</mi></math>') a, parse_opt('<math><ci>x</ci></math>') b, parse_slt('x') c, align_score('[V!x]', '[V!x]') d, stem('running') e").first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("[V!x]", "[V!x]", None, [1.0, 1.0, 1.0], "run")
    assert spark.sql("SELECT * FROM tree_pairs('[V!x[V!y]]', 4)").count() == 2


def test_report(spark):
    df = spark.createDataFrame([("q", "[V!x,a[N!2]]", [1.0], 1, [""], [], ["a"])], "query_id string, expr string, scores array<double>, rank int, e array<string>, u array<string>, w array<string>")
    d = df.select(report.dot_column(F.col("expr"), F.col("e"), F.col("u"), F.col("w")).alias("d")).first()["d"]
    assert '"r" -> "ra" [label="a"]' in d and d.count("fillcolor") == 2
    assert "<td>[V!x,a[N!2]]</td><td>1.0</td>" in report.page(df).first()["html"]


def test_query_stream(spark, index, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "1.json").write_text('{"query_id": "a", "expr": "[V!x]"}\n')
    (tmp_path / "q" / "2.json").write_text('{"query_id": "b", "expr": "[N!1]"}\n')
    stream = spark.readStream.schema("query_id string, expr string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "q"))
    got = []
    search.answer_queries(stream, index, lambda df, n: got.extend(df.collect()), 1, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert {r["query_id"] for r in got} == {"a", "b"} and all(r["score"] == 1.0 for r in got if r["query_id"] == "a")
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text('{"doc_id": 1, "position": 0, "expr": "[V!x]"}\n')
    docs = spark.readStream.schema("doc_id bigint, position int, expr string").json(str(tmp_path / "d"))
    search.append_postings(docs, str(tmp_path / "out"), checkpoint=str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["tuples"][0]["to"] == "0!"


def test_fusion_shapes(spark):
    run = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.5)], "query_id string, item_id bigint, score double")
    assert [r["score"] for r in fusion.min_max(run).collect()] == [0.5, 0.5]
    padded = fusion.padded(fusion.ranked(run), 5).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"]) for r in padded] == [(1, 1), (2, 2), (1, 3), (2, 4), (1, 5)]
    assert fusion.min_max_fusion(run, run.limit(0)).count() == 0


def test_rows_are_numbered_over_partitions(spark):
    rnd = random.Random(4)
    rows = [(g, rnd.choice([None, 0.1, 0.5, 0.5]), i) for g in ("hot", "a", None) for i in range(400 if g == "hot" else 5)]
    df = spark.createDataFrame(rows, "query_id string, score double, item_id bigint")
    got = {(r["query_id"], r["item_id"]): r["rank"] for r in ranks.number_rows(df, ["query_id"], [F.desc("score"), F.asc("item_id")]).collect()}
    for g in ("hot", "a", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-(x[1] or -1), x[2]))
        assert [got[g, x[2]] for x in own] == list(range(1, len(own) + 1))
    assert ranks.number_rows(df.limit(0), ["query_id"], [F.asc("item_id")]).count() == 0


def test_evaluation_by_hand(spark):
    run = spark.createDataFrame([("q", f"d{i}", 1.0 - i / 10, i + 1) for i in range(5)], "query_id string, item_id string, score double, rank int")
    qrels = spark.createDataFrame([("q", "d0", 3.0), ("q", "d2", 0.0), ("q", "d3", 4.0), ("q", "zz", 2.0)], "query_id string, item_id string, relevance double")
    p = evaluate.precision_at(run, qrels, 10, 2.0).first()
    assert (p["precision"], p["n_missing"]) == (0.2, 7)
    assert evaluate.average_precision(run, qrels).first()["ap"] == pytest.approx((1 + 2 / 3) / 3)
    import math

    want = (3 + 0 + 4 / math.log2(4)) / (4 + 3 + 2 / math.log2(3))
    assert evaluate.ndcg_at(run, qrels, 10).first()["ndcg"] == pytest.approx(want)
    raw = spark.createDataFrame([("q", "a", "Relevant"), ("q", "a", "Partially-Relevant"), ("q", "b", "Not-Relevant"), ("q", "c", None)], "query_id string, item_id string, label string")
    assert {r["item_id"]: r["relevance"] for r in evaluate.aggregate_judgments(raw, grade="label").collect()} == {"a": 3.0, "b": 0.0}
    dup, rel = evaluate.split_related(spark.createDataFrame([(1, 2), (2, 3), (3, None)], "a int, relation int"))
    assert dup.count() == 1 and rel.count() == 2


def test_fitted_weights(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        x = [rnd.random() for _ in range(3)]
        rows.append((str(i % 4), x, 1 + 2 * x[0] - x[1] + 0.5 * x[2]))
    df = spark.createDataFrame([*rows, ("0", None, 1.0), ("0", [1.0, 2.0, 3.0], None)], "fold string, scores array<double>, relevance double")
    assert evaluate.fit_weights(df, 3) == pytest.approx([1, 2, -1, 0.5])
    cv = evaluate.cross_validate(df.filter("scores IS NOT NULL"), ["0", "1", "2", "3"], 3).collect()
    assert all(r["test_mse"] < 1e-12 for r in cv) and sum(r["n_test"] for r in cv) == 200


def test_texts(spark):
    docs = spark.createDataFrame([(1, "The red fox, the fox!"), (2, "a fox red"), (3, None), (4, ""), (5, "see <math> and <math>x")], "doc_id bigint, text string")
    phrases = spark.createDataFrame([("q", "red fox"), ("p", "the fox")], "query_id string, phrase string")
    assert {tuple(r) for r in text.phrase_positions(docs, phrases).collect()} == {("q", 1, 1), ("p", 1, 3)}
    words = spark.createDataFrame([("q", "fox")], "query_id string, term string")
    assert {(r["doc_id"], tuple(r["positions"])) for r in text.keyword_positions(docs, words).collect()} == {(1, (2, 4)), (2, (1,))}
    assert text.formula_positions(docs).first()["positions"] == [1, 3]
    stems = text.keyword_positions(docs, spark.createDataFrame([("q", "foxes")], "query_id string, term string"), stemmed=True)
    assert {r["doc_id"] for r in stems.collect()} == {1, 2}
    q = spark.createDataFrame([("q", "red fox")], "query_id string, text string")
    assert [r["doc_id"] for r in text.normalised(text.tfidf_search(docs, q)).orderBy("rank").collect()] == [1, 2]
