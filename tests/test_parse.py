import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphgrove.align.pairs import multiset_dice
from glyphgrove.functions.stem import stem
from glyphgrove.functions.tags import clean, run_length, run_length_inverse
from glyphgrove.operators.documents import parse_formula
from glyphgrove.operators.rerank import score_pair
from glyphgrove.parse import markup, trees
from glyphgrove.parse.pairs import count_pairs, expand, ordered_pairs

M = "<math xmlns='http://www.w3.org/1998/Math/MathML'>{}</math>"


def slt(x):
    return parse_formula(M.format(x), operator=False)


def opt(x):
    return parse_formula(M.format(x), operator=True)


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("<mfrac><mi>x</mi><mi>y</mi></mfrac>", "[O!divide,o[V!x],u[V!y]]"),
        ("<mrow><mn>2</mn><msup><mi>x</mi><mn>3</mn></msup><mo>+</mo><mn>3</mn></mrow>", "[N!2[V!x[+[N!3]],a[N!3]]]"),
        ("<msubsup><mrow/><mi>α</mi><mi>i</mi></msubsup>", "[W!,a[V!i],b[V!α]]"),
        ("<mrow><mo>{</mo><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable><mo>}</mo></mrow>", "[M!{}2x2,w[N!1,e[N!2,e[N!3,e[N!4]]]]]"),
        ("<mrow><mo>(</mo><mn>5</mn><mo>)</mo></mrow>", "[M!()1x1,w[N!5]]"),
        ("<mrow><mi>z</mi><mo>=</mo><mrow><mo>(</mo><mn>5</mn><mo>)</mo></mrow><mo>+</mo><mn>1</mn></mrow>", "[V!z[=[M!()1x1[+[N!1]],w[N!5]]]]"),
        ("<mrow><mo>(</mo><mi>a</mi><mo>,</mo><mi>b</mi><mo>)</mo></mrow>", "[M!()1x2,w[V!a[&comma;],e[V!b]]]"),
        ("<mrow><mo>(</mo><mrow><mi>a</mi><mo>,</mo><mi>b</mi></mrow><mo>)</mo></mrow>", "[M!()1x2,w[V!a[&comma;],e[V!b]]]"),
        ("<mfenced><mi>a</mi><mi>b</mi></mfenced>", "[M!()1x2,w[V!a[&comma;],e[V!b]]]"),
        ("<msub><mo>∑</mo><mi>i</mi></msub>", "[∑,u[V!i]]"),
        ("<msup><msup><mi>x</mi><mi>y</mi></msup><mi>z</mi></msup>", "[M!1x1,a[V!z],w[V!x,a[V!y]]]"),
        ("<msup><mi>x</mi></msup>", "[V!x]"),
        ("<mroot><mi>x</mi><mn>3</mn></mroot>", "[O!root,c[N!3],w[V!x]]"),
        ("<msqrt><mi>x</mi><mo>+</mo><mn>1</mn></msqrt>", "[O!root,w[V!x[+[N!1]]]]"),
        ("<menclose><mi>x</mi></menclose>", "[longdiv,w[V!x]]"),
        ("<mmultiscripts><mi>X</mi><none/><mi>c</mi><mprescripts/><mi>d</mi><none/></mmultiscripts>", "[V!X,a[V!c],d[V!d]]"),
        ("<mrow><mtable><mtr><mtd><mn>1</mn></mtd></mtr><mtr><mtd><mn>2</mn></mtd></mtr></mtable><mtable><mtr><mtd><mn>3</mn></mtd></mtr><mtr><mtd><mn>4</mn></mtd></mtr></mtable></mrow>", "[M!2x2,w[N!1,e[N!3,e[N!2,e[N!4]]]]]"),
        ("<mrow><mi>f</mi><mo>⁡</mo><mws:qvar name='x'/></mrow>", "[V!f[?x]]"),
        ("<mi>a,[?</mi>", "[V!a&comma;&lsqb;&quest;]"),
        ("<semantics><mi>x</mi><annotation-xml encoding='MathML-Content'><ci>x</ci></annotation-xml><annotation encoding='application/x-tex'>x</annotation></semantics>", "[V!x]"),
        ("", None),
    ],
)
def test_layout(x, want):
    assert slt(x) == want


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("<apply><plus/><ci>x</ci><cn>1</cn></apply>", "[U!plus,0[V!x],1[N!1]]"),
        ("<apply><ci>f</ci><ci>x</ci></apply>", "[F!f,0[V!x]]"),
        ("<apply><int/><ci>f</ci></apply>", "[O!int,0[V!f],1[W!],2[W!]]"),
        ("<apply><root/><degree><cn>3</cn></degree><ci>x</ci></apply>", "[O!root,0[V!x],1[N!3]]"),
        ("<apply><csymbol cd='latexml'>square-root</csymbol><ci>x</ci></apply>", "[O!root,0[V!x],1[N!2]]"),
        ("<apply><apply><csymbol cd='ambiguous'>subscript</csymbol><int/><cn>0</cn></apply><ci>f</ci></apply>", "[+!O!int,0[O!SUB,0[O!int],1[N!0]],1[V!f]]"),
        ("<apply><and/><apply><eq/><ci>a</ci><ci>b</ci></apply><apply><lt/><share href='#.cmml'/><ci>c</ci></apply></apply>", "[U!and,0[U!eq,0[V!a],1[V!b]],1[O!lt,0[V!b],1[V!c]]]"),
        ("<matrix><matrixrow><cn>1</cn><cn>2</cn></matrixrow><matrixrow><cn>3</cn></matrixrow></matrix>", "[M!M-2x2,0[M!R!,0[N!1],1[N!2]],1[M!R!,0[N!3],1[E!]]]"),
        ("<interval closure='open-closed'><ci>a</ci><ci>b</ci></interval>", "[O!interval(O-C),0[V!a],1[V!b]]"),
        ("<cerror><csymbol cd='unknown'>a</csymbol><csymbol cd='unknown'>b</csymbol><ci>x</ci></cerror>", "[E!,0[T!ab],1[V!x]]"),
        ("<set><ci>a</ci></set>", "[M!S-1,0[V!a]]"),
        ("<csymbol cd='latexml'>2</csymbol>", "[N!2.0]"),
        ("<semantics><ci>x</ci></semantics>", "[V!x]"),
    ],
)
def test_operator(x, want):
    assert opt(x) == want


def test_many_children():
    wide = "".join(f"<ci>x{i}</ci>" for i in range(100))
    assert opt(f"<apply><plus/>{wide}</apply>").startswith("[U!plus,0[U!plus,0[V!x0]")
    with pytest.raises(ValueError, match="62"):
        opt(f"<apply><minus/>{wide}</apply>")


@pytest.mark.parametrize("x", ["<mystery/>", "<apply/>", "<apply><int/></apply>", "<csymbol cd='latexml'>no-such</csymbol>", "<ci>a</ci><ci>b</ci>", "<interval closure='x'/>"])
def test_errors_are_value_errors(x):
    with pytest.raises(ValueError):
        opt(x)


def test_lenient_markup():
    assert slt("<mi >A</mi>") == "[V!A]"
    assert markup.formulas("a <m:math><m:mi>x</m:mi></m:math> b <span class=\"math-container\">$y^2$</span> <math><mi>z</math>") == ["<m:math><m:mi>x</m:mi></m:math>", "$y^2$", "<math><mi>z</math>"]
    assert parse_formula("<math><mi>z</math>", operator=False) == "[V!z]"
    assert markup.formulas(None) == [] and markup.formulas("<mathx>") == []


TAGS = st.sampled_from(["V!x", "V!y", "N!1", "+", "U!plus", "O!minus", "E!", "?w", "M!()1x1", "W!"])


@st.composite
def tree(draw, operator, depth=3):
    t = trees.Tree(draw(TAGS))
    if depth:
        n = draw(st.integers(0, 3))
        labels = "012"[:n] if operator else draw(st.lists(st.sampled_from("naboucdwe"), max_size=n, unique=True))
        for k in sorted(labels, key="naboucdwe012".index):
            t.edges[k] = draw(tree(operator, depth - 1))
    return t


any_tree = st.booleans().flatmap(tree)


@settings(max_examples=200, deadline=None)
@given(any_tree)
def test_round_trip(t):
    s = trees.render(t, trees.is_operator_tree(t))
    assert trees.render(trees.parse(s), trees.is_operator_tree(t)) == s


@pytest.mark.parametrize("s", ["", "None", "[", "]", "[a]]", "[a][b]", "a[b]", "[a,x[b],x[c]]", "[a,[b]]", "[a]b"])
def test_no_trees(s):
    with pytest.raises(ValueError):
        trees.parse(s)


def test_deep_chain():
    s = "[x" * 50_000 + "]" * 50_000
    t = trees.parse(s)
    assert trees.render(t) == s and trees.height(t) == 49_999 and sum(expand(t).values()) == 4 * 50_000 - 10


@settings(max_examples=150, deadline=None)
@given(any_tree, st.integers(0, 5))
def test_expansion_properties(t, window):
    a = expand(t, window, "none")
    assert multiset_dice(a, a) == (1.0 if a else 0.0)
    if window:
        assert sum(a.values()) <= sum(expand(t, window + 1, "none").values()) <= sum(expand(t, 0, "none").values())
    assert sum(a.values()) <= count_pairs(t, window)


@settings(max_examples=100, deadline=None)
@given(tree(True), st.randoms(use_true_random=False))
def test_order_under_commutative_operators_is_free(t, rnd):
    before = expand(t, 3, "none")
    for _, n in list(trees.visit(t)):
        if n.tag.startswith("U!"):
            kids = n.children()
            rnd.shuffle(kids)
            n.edges = dict(zip(n.edges, kids, strict=True))
    assert expand(t, 3, "none") == before


def test_tuples_of_known_trees():
    f = expand(trees.parse("[O!divide,o[V!x],u[V!y]]"), 2)
    assert set(f) == {("O!divide", "V!x", "o"), ("O!divide", "V!y", "u"), ("O!divide", "0!", "n"), ("V!x", "0!", "n"), ("V!y", "0!", "n")}
    f = expand(trees.parse("[N!2[V!x[+[N!3]],a[N!3]]]"), 2)
    assert sum(f.values()) == 7 and ("N!2", "N!3", "na") in f
    f = expand(trees.parse("[U!plus,0[V!x],1[O!SUP,0[V!y],1[N!2]]]"))
    assert f["U!plus", "O!SUP", "0"] == 1 and f["U!plus", "V!y", "00"] == 1 and f["U!plus", "N!2", "01"] == 1
    assert ("U!plus", "V!y", "10", "") in ordered_pairs(trees.parse("[U!plus,0[V!x],1[O!SUP,0[V!y],1[N!2]]]"), 0, False)


def test_tags():
    assert clean(" a\n?b ") == "a\\n&quest;b" and clean("⁢") == "" and clean(None) == ""
    assert run_length("aaaaab") == "5a1b" and run_length_inverse("5a1b") == "aaaaab"


B1 = "[U!eq,0[U!times,0[V!𝑓],1[V!𝑥]],1[O!divide,0[U!plus,0[O!SUP,0[V!𝑥],1[N!2]],1[V!𝑥],2[V!𝑐]],1[U!plus,0[O!SUP,0[V!𝑥],1[N!2]],1[U!times,0[N!2],1[V!𝑥]],2[V!𝑐]]]]"
PUBLISHED = [
    ("[O!form-seq,0" + B1 + ",1[O!in,0[V!𝑥],1[U!times,0[T!\\\\mathbb],1[V!𝑅]]]]", 0.8125, [1.0, 0.76, 1.0]),
    (B1.replace("1[V!𝑥],2[V!𝑐]],1[U!plus", "1[U!times,0[N!2],1[V!𝑥]]],1[U!plus").replace("2[V!𝑐]", "2[N!2]"), 0.788991, [0.8376963350785339, 0.8, 0.8421052631578947]),
    (B1.replace("1[V!𝑥],2[V!𝑐]],1[U!plus", "1[U!times,0[V!𝑎],1[V!𝑥]],2[V!𝑏]],1[U!plus").replace("2[V!𝑐]", "2[N!3]"), 0.767857, [0.8376963350785339, 0.7619047619047619, 0.8421052631578947]),
]


@pytest.mark.parametrize(("candidate", "dice", "vector"), PUBLISHED)
def test_published_scores(candidate, dice, vector):
    assert round(multiset_dice(expand(trees.parse(B1)), expand(trees.parse(candidate))), 6) == dice
    assert score_pair(B1, candidate)["scores"] == pytest.approx(vector, abs=1e-12)


@pytest.mark.parametrize("metric", range(-1, 13))
@pytest.mark.parametrize("s", ["[V!x]", "[V!x[+[V!y,a[N!2]]]]", B1, "[M!()1x2,w[V!a[&comma;],e[V!b]]]", "[?w]"])
def test_every_metric_scores_a_tree_against_itself(metric, s):
    r = score_pair(s, s, metric)
    if metric in (7, 8, 9, 10, 12, 1) or metric in (4, 5, 6, 11):
        assert r["scores"][0] == pytest.approx(1.0)
    assert score_pair(s, "None", metric) is None


def test_unification():
    r = score_pair("[V!x[+[V!x]]]", "[V!a[+[V!a]]]")
    assert r["scores"] == [1.0, 1.0, 1 / 3] and r["q_unified"] == ["", "nn"] and r["distance"] == 2 * (ord("x") - ord("a"))
    r = score_pair("[V!x[+[V!y]]]", "[V!a[+[V!a]]]")
    assert len(r["q_unified"]) == 1
    assert score_pair("[V!x[+[V!x]]]", "[V!ab[+[V!ab]]]")["q_unified"] == []


def test_constraints():
    q, c = "[N!5[+[V!x]]]", "[N!7[+[V!y]]]"
    assert score_pair(q, c)["q_unified"] == ["", "nn"]
    assert score_pair(q, c, constraint="[E[U[E]]]")["q_unified"] == []
    assert score_pair(q, c, constraint="[U!>=6!<7[U[U]]]")["q_unified"] == ["nn"]
    assert score_pair(q, c, constraint="[U!>6!<=7[U[U]]]")["q_unified"] == ["", "nn"]


def test_wildcards():
    r = score_pair("[V!a[+[?w[=[V!b]]]]]", "[V!a[+[V!c[-[V!d[=[V!b]],a[N!2]]]]]]")
    assert r["q_wild"] == ["nn"] and r["c_wild"] == ["nn", "nnn", "nnnn", "nnnna"] and r["scores"][2] == 1.0
    # operands are paired greedily, and a wildcard at the first place takes the first operand
    r = score_pair("[U!plus,0[?w],1[V!x]]", "[U!plus,0[V!x],1[U!times,0[N!2],1[V!y]]]")
    assert r["c_wild"] == ["0"] and r["scores"] == pytest.approx([4 / 7, 2 / 5, 2 / 3])
    r = score_pair("[U!plus,0[?w],1[V!x]]", "[U!plus,0[U!times,0[N!2],1[V!y]],1[V!x]]")
    assert r["scores"] == [1.0, 1.0, 1.0]
    same = score_pair("[U!eq,0[?w],1[?w]]", "[U!eq,0[U!plus,0[V!x],1[N!1]],1[V!y]]")
    assert len(same["q_wild"]) == 1 and len(same["c_wild"]) == 3


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("conditional", "condit"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"), ("oscillators", "oscil"), ("agreed", "agre"), ("controll", "control"), ("adoption", "adopt"), ("is", "is"), ("probate", "probat"), ("rate", "rate")])
def test_stems(word, want):
    assert stem(word) == want
