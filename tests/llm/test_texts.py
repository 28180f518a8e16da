"""Encoding, leaks and personal information against brute force and held-out libraries."""

import os
import random
import unicodedata

import pytest
from pyspark.sql import functions as F
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphgrove.llm import leakage, personal, personal_shapes, tokens
from tests.skew import large


@pytest.fixture(scope="module")
def other():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


SIGNS = "ab'sre Ll1٣é–.<|endoftext|> \n\t\x1c\x85 中🤷🏽‍♀️"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=SIGNS, max_size=120), st.integers(1, 9), st.integers(1, 5))
def test_tree_equals_whole(text, leaf, window):
    e = tokens.Encoder(leaf=leaf, window=window)
    want = e.bpe.encode_ordinary(text)
    assert list(e.encode(text)) == want
    assert e.decode(want) == text


def test_other_library_agrees(other):
    rnd = random.Random(4)
    e = tokens.Encoder(leaf=8, window=2)
    for _ in range(1500):
        t = "".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 50)))
        assert list(e.encode(t)) == other.encode(t, add_special_tokens=False).ids


def test_join_is_associative():
    e = tokens.Encoder(leaf=4, window=1)
    t = "It's 12 o'clock,  isn't   it? <|endoftext|>"
    for i in range(1, len(t) - 1):
        for j in range(i + 1, len(t)):
            a, b, c = (e.encode(x) for x in (t[:i], t[i:j], t[j:]))
            left = e.join(t, 0, j, len(t), e.join(t, 0, i, j, a, b), c)
            right = e.join(t, 0, i, len(t), a, e.join(t, i, j, len(t), b, c))
            assert list(left) == list(right) == list(e.encode(t))


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "1 " * 50_000, "\n" * 9999 + "x"])
def test_long_runs(text):
    e = tokens.Encoder()
    assert list(e.encode(text)) == e.bpe.encode_ordinary(text)


def test_corpus(spark, other):
    docs = spark.createDataFrame([(1, "Hello <|endoftext|> world", "x"), (2, "", "y"), (3, None, None), (4, "é" * 9000, "z")], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()}
    assert got[2] == [] and got[3] == []
    for i, t in ((1, "Hello <|endoftext|> world"), (4, "é" * 9000)):
        assert got[i] == other.encode(t, add_special_tokens=False).ids
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(docs)).collect()}
    assert back[4] == "é" * 9000 and back[3] == ""
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


def test_whole_table_of_ids(spark, data, other):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    assert got == {i: other.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def plain_words(t):
    t = unicodedata.normalize("NFKC", regex.sub(r"\p{Cf}", "", unicodedata.normalize("NFKC", t or "")))
    return regex.findall(r"[\p{L}\p{N}]+", t.casefold())


def brute_leaks(docs, items, least):
    grams = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    found = set()
    for d, t in docs:
        w = plain_words(t)
        for k in range(len(w) - least + 1):
            found |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return found


@pytest.mark.parametrize("sign", ["­", "‍", "﻿", "⁦", "\U000e0041"])
def test_words(sign):
    assert leakage.words(f"Ｆｕｌｌ wi{sign}dth_x² STRASSE straße") == ["full", "width", "x2", "strasse", "strasse"]


def test_leaks(spark):
    rnd = random.Random(8)
    pool = "the a of cat dog sat mat x y z".split()
    items = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for i in range(12)] + [(50, None), (51, ""), (52, "the the the the the the")]
    docs = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    docs += [(100 + i, f"zzz, {(t or '').upper().replace(' ', '_-')}! end") for i, t in items] + [(200, None), (201, ""), (202, "the " * 3000)]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, term string, pos int")
    b = spark.createDataFrame([(*x, "clash") for x in items], "item_id bigint, text string, item string")
    index = leakage.LeakIndex(d, b)
    for least in (1, 2, 5):
        assert {tuple(r) for r in index.phrases(least).collect()} == brute_leaks(docs, items, least)
    assert leakage.LeakIndex(d.limit(0), b).phrases(3).count() == 0
    assert leakage.LeakIndex(d, b.limit(0)).phrases(3).count() == 0


def test_shuffled_sides_give_the_same(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one two three four"), (2, "two three")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "two three four five")], "item_id bigint, text string")
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in leakage.LeakIndex(d, b).phrases(3).collect()} == {(1, 7)}


def test_near(spark):
    d = spark.createDataFrame([(1, "three x x one x two"), (2, "one " + "x " * 50 + "two three"), (3, "one two")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "one two three")], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.LeakIndex(d, b).near(3, 20).collect()] == [(1, 7, 3)]


def brute_near(docs, items, least, apart):
    df = {}
    for _, t in docs:
        for w in plain_words(t):
            df[w] = df.get(w, 0) + 1
    found = {}
    for i, t in items:
        terms = set(plain_words(t))
        rarest = sorted((df[w], w) for w in terms if w in df)[:least]
        for d, text in docs:
            w = plain_words(text)
            for k in range(len(w)):
                seen = terms & set(w[k : k + apart + 1])
                if len(seen) >= max(least, len(terms) / 2) or len(rarest) == least and all(x in seen for _, x in rarest):
                    found[d, i] = max(len(seen), found.get((d, i), 0))
    return {(d, i, n) for (d, i), n in found.items()}


@pytest.mark.parametrize("start", [0, 20, 29, 30, 31, 470, 2850])
def test_near_wherever_it_starts(spark, start):
    d = spark.createDataFrame([(1, "x " * start + "one " + "y " * 44 + "two"), (2, "x " * start + "one " + "y " * 60 + "two"), (3, "one " + "y " * 59 + "two")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "one two")], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.LeakIndex(d, b).near(2, 60).collect()} == {(1, 7, 2), (3, 7, 2)}


def test_near_half_of_an_item(spark):
    d = spark.createDataFrame([(1, "eight seven six five four"), (2, "eight seven six"), (3, "one two three four five six seven eight")], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "one two three four five six seven eight")], "item_id bigint, text string")
    assert {tuple(r) for r in leakage.LeakIndex(d, b).near(4, 60).collect()} == {(1, 7, 5), (3, 7, 8)}


def test_near_against_brute_force(spark):
    rnd = random.Random(12)
    pool = "a b c d e f g h i j k l m n o p q r".split()
    text = lambda least, most: " ".join(rnd.choice(pool) for _ in range(rnd.randint(least, most)))
    items = [(i, text(0, 18) + " absent" * (i % 2)) for i in range(10)] + [(20, None)]
    docs = [(i, text(0, 120)) for i in range(40)] + [(100, None), (101, " ".join(["a", "zzz"] * 200))]
    index = leakage.LeakIndex(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    for least, apart in ((2, 3), (5, 9), (6, 25)):
        assert {tuple(r) for r in index.near(least, apart).collect()} == brute_near(docs, items, least, apart)


def test_leaks_of_whole_table(spark, data):
    from glyphgrove.llm.queries import p8_found

    read = lambda n, i: [tuple(r) for r in spark.read.parquet(f"{data}/{n}.parquet").select(i, "text").collect()]
    assert {tuple(r) for r in p8_found(spark, data).collect()} == brute_leaks(read("documents", "doc_id"), read("benchmark", "item_id"), 10)


GIVEN = "Anna Bruno Clara Dario Elena Fabio Greta Hugo Ines Jonas Karla Lukas Marta Nils Olga Paolo".split()
FAMILY = "Abendrot Birkmann Cordewin Dahlqvist Ellerbrock Falkenhain Grubisic Hartwell".split()


def reviews():
    rnd = random.Random(6)
    name = lambda: f"{rnd.choice(GIVEN)} {rnd.choice(FAMILY)}"
    texts = []
    for i in range(60):
        ssn = f"9{rnd.randint(10, 99)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)}"
        tel = f"({rnd.randint(200, 999)}) 555-01{rnd.randint(10, 99)}"
        texts += [
            f"Dr. {name()} recommended it to me.", f"My name is {name()} and I agree.", f"The clerk, {name()}, came twice.", f"Passport no. {ssn} had to be shown at once.",
            f"They saw that {ssn} had to be shown at once.", f"Spare part {ssn} fits my old lamp.", f"Call me on {tel} after six.", f"Our number {tel} rings after six.", f"I live at {rnd.randint(1, 99)} Mill Street, second floor.",
            f"Write to me.{i}@mail.example.com, please.", "My uncle counted screws around the old lamp.", "The Fenn Scribe 22 is better.", f"Order no. 20-4471-{rnd.randint(1000, 9999)} arrived late.", "Ask @shop or demo@kiosk.",
        ]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def found(spark):
    docs = reviews() + [(9001, None), (9002, ""), (9003, "   "), (9004, "x" * 200_000)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id bigint, text string, kind string")
    return df, dict(docs), [tuple(r) for r in personal.find_personal(df).select("doc_id", "kind", "found", "at").collect()]


def test_personal_information_is_found(found):
    _, docs, rows = found
    by = {k: [r for r in rows if r[1] == k] for k in personal.KINDS}
    assert all(docs[i][at : at + len(f)] == f for i, _, f, at in rows)
    assert len(by["email"]) == 60 and len(by["address"]) == 60
    assert len(by["phone"]) == 120 and len(by["id_number"]) == 120 and len(by["person"]) == 180
    assert not any(docs[i].startswith(("Spare", "Order", "The Fenn", "Ask", "My uncle")) for i, *_ in rows)


def test_redaction(spark, found):
    df, docs, _ = found
    out = {r["doc_id"]: r["text"] for r in personal.redact(df).collect()}
    assert out[1] == "My name is [PERSON] and I agree." and out[3] == "Passport no. [ID_NUMBER] had to be shown at once."
    assert out[9001] is None and out[9002] == "" and out[9003] == "   " and len(out[9004]) == 200_000
    assert out.keys() == docs.keys()


def test_no_personal_information(spark):
    df = spark.createDataFrame([(1, None), (2, "nothing here")], "doc_id bigint, text string")
    assert personal.find_personal(df).count() == 0 and personal.find_personal(df.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1, 10])
def test_names_that_are_words(spark, times):
    texts = [t for _, t in reviews()] * times + ["Dr. Anna Young called again.", "Dr. Mark Ellerbrock called again.", "The box came from Mark Ellerbrock in May."] * 2
    texts += ["A young fox made a mark there.", "They mark each young tree.", "The young ones left one mark."] * 3 * times
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["found"] for r in personal.find_personal(df).filter("kind = 'person'").collect()]
    assert got.count("Anna Young") == 2 and got.count("Mark Ellerbrock") == 4
    assert not any(f.startswith(("The", "They")) for f in got)


def test_whole_names():
    text = "Mara Lena Brannardo, Ana Garcia Lopez Diaz, Bruno Klein"
    pair = lambda found, name=True, **more: {"at": text.index(found), "found": found, "name": name, "reversed": "," in found, "more_given": False, "more_family": False} | more
    pairs = [pair("Lena Brannardo"), pair("Mara Lena", False, more_given=True), pair("Ana Garcia"), pair("Garcia Lopez", False, more_family=True), pair("Lopez Diaz", False, more_family=True), pair("Bruno Klein"), pair("Diaz, Bruno")]
    assert [f for _, f in personal.whole_names(pairs)] == text.split(", ")
    assert personal.whole_names([pair("Mara Lena", False, more_given=True)]) == []
    french = "M. Klein, Bruno"
    assert [f for _, f in personal.whole_names([{**pair("Bruno Klein"), "at": 0, "found": "M. Klein"}, {**pair("Diaz, Bruno"), "at": 3, "found": french[3:]}])] == ["Klein, Bruno"]
    assert personal.whole_names([pair("Mara Lena"), pair("Lena Brannardo", False)]) == [(0, "Mara Lena")]


def test_names_of_several_words(spark):
    texts = [t for _, t in reviews()] + ["It was Clara Marta Hartwell who wrote.", "It was Olga Hartwell Birkmann who wrote.", "My name is Anna Elena Greta Dahlqvist and I agree."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["found"] for r in personal.find_personal(df).filter(f"doc_id >= {len(texts) - 3}").collect()}
    assert found == {"Clara Marta Hartwell", "Olga Hartwell Birkmann", "Anna Elena Greta Dahlqvist"}
    out = {r["doc_id"]: r["text"] for r in personal.redact(df).collect()}
    assert [out[i] for i in range(len(texts) - 3, len(texts))] == ["It was [PERSON] who wrote."] * 2 + ["My name is [PERSON] and I agree."]


def test_overlapping_pieces_are_replaced_whole(spark, monkeypatch):
    pieces = spark.createDataFrame([(1, "person", "ab cd", 0), (1, "address", "cd ef", 3), (1, "phone", "gh", 9)], "doc_id bigint, kind string, found string, at int")
    monkeypatch.setattr(personal, "find_personal", lambda *_: pieces)
    df = spark.createDataFrame([(1, "ab cd ef gh i")], "doc_id bigint, text string")
    assert personal.redact(df).first()["text"] == "[PERSON] [PHONE] i"


def test_other_shapes_are_candidates():
    def seeds(text):
        return [(c.found, c.seed) for c in personal_shapes.candidates(text) if c.pool in ("number", "address")]

    assert seeds("Tel. 555-0134 is new.") == [("555-0134", "phone")]
    assert seeds("My phone: 4567 8901.") == [("4567 8901", "phone")]
    assert seeds("codice fiscale RSSMRA85T10A562S") == [("RSSMRA85T10A562S", "id_number")]
    assert seeds("Order no. AB12CD34 and 555 0134.") == [("AB12CD34", "none"), ("555 0134", None)]
    assert seeds("Tel. 4711 or 12 days, page 1234.") == [("4711", None)]
    assert seeds("Passport no. 969-86-6801, 12 days") == [("969-86-6801", "id_number")]
    assert seeds("au 12 rue des Ormes La livraison") == [("12 rue des Ormes", "address")]
    assert seeds("au 12 rue Victor Hugo, puis") == [("12 rue Victor Hugo", "address")]


@pytest.fixture(scope="module")
def seeded(spark):
    """Candidates of ten thousand reviews; patterns need a corpus."""
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables here")
    return personal.candidates_of(spark.read.parquet(path), "doc_id", "text")


def test_half_of_each_kind_is_learned(seeded):
    found = seeded.join(personal.bootstrap(seeded), "instance").filter(F.col("label").isin(*personal.KINDS))
    share = {r["label"]: r["s"] for r in found.groupBy("label").agg(F.avg((F.coalesce("seed", F.lit("")) != F.col("label")).cast("int")).alias("s")).collect()}
    assert share.keys() == set(personal.KINDS) and min(share.values()) > 0.5


def test_hidden_seeds_are_found_again(seeded):
    """Half of all seeds lose their label: the graph gives it back to nearly all of them, and no other."""
    hidden = F.col("seed").isin(*personal.KINDS) & (F.pmod(F.xxhash64("instance"), F.lit(2)) == 0)
    labels = personal.bootstrap(seeded.withColumn("seed", F.when(~F.coalesce(hidden, F.lit(False)), F.col("seed")))).select("instance", "label")
    again = seeded.filter(hidden).join(labels, "instance").groupBy("seed").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("seed")).cast("int")).alias("right"), F.sum((F.col("label").isin(*personal.KINDS) & (F.col("label") != F.col("seed"))).cast("int")).alias("wrong"))
    for r in again.collect():
        print(r)
        assert r["wrong"] <= 0.02 * r["n"] and r["right"] >= 0.9 * r["n"]


def test_hot_patterns_are_split(spark):
    """All phones have one pattern of context, as common as a third of all instances."""
    rnd = random.Random(4)
    texts = [t for _, t in reviews()] + [f"Call me on ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} after six." for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = {tuple(r) for r in personal.find_personal(df).collect()}
    with large(spark) as split:
        assert {tuple(r) for r in personal.find_personal(df).collect()} == plain
        assert split() >= 1
