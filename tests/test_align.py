"""Pairing of operands, restricted pairs and the formula scan against brute force."""

import itertools
import random
from collections import Counter

import pytest

from glyphgrove.align import pairs
from glyphgrove.align.matching import assignment
from glyphgrove.align.scores import baseline_place
from glyphgrove.operators import documents
from glyphgrove.operators.index import build
from glyphgrove.operators.rerank import score_pair
from glyphgrove.parse import markup, trees
from glyphgrove.parse.pairs import expand, expand_chain


def total(worth, way):
    return sum(worth[i][j] for i, j in enumerate(way))


def test_assignment_against_all_orders():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(0, 5)
        m = rnd.randint(n, 7) if n else 0
        worth = [[rnd.randint(-3, 9) * 10 ** rnd.randint(0, 30) for _ in range(m)] for _ in range(n)]
        got = assignment(worth)
        assert len(set(got)) == n
        assert total(worth, got) == max((total(worth, p) for p in itertools.permutations(range(m), n)), default=0)


def operands(tags):
    return "[U!plus," + ",".join(f"{chr(48 + i) if i < 10 else chr(87 + i)}[{t}]" for i, t in enumerate(tags)) + "]"


@pytest.mark.parametrize("n", [8, 20])
def test_many_operands_in_any_order(n):
    """Every operand has one equal partner; greedy pairing would do as well, so two that compete for one are added."""
    rnd = random.Random(n)
    tags = [f"N!{i}" for i in range(n)]
    other = tags[:]
    rnd.shuffle(other)
    for metric in (4, 11):
        assert score_pair(operands(tags), operands(other), metric)["scores"] == [1.0, 0.0, n + 1.0]


def test_best_order_beats_greedy_pairing():
    """The first operand fits both of the candidate's, the second only the one that a greedy choice gives away."""
    q = "[U!plus,0[O!f,0[V!x],1[V!y],2[N!1]],1[O!f,0[V!x],1[V!y]]]"
    many = lambda tail: "[U!plus,0" + "[O!f,0[V!x],1[V!y],2[N!1]]" + tail + "]"
    rest = "".join(f",{i}[V!z]" for i in range(2, 9))
    c = many(",1[O!f,0[V!x],1[V!y]]" + rest)
    assert score_pair(q, c, 4)["scores"][2] == 8.0 and score_pair(q, c, 12)["scores"][2] == 1.0


def test_restrict_keeps_the_instances_that_share_most():
    rnd = random.Random(7)
    for _ in range(200):
        make = lambda n: [(rnd.choice("ab"), rnd.choice("xyz"), rnd.choice("nu"), str(rnd.randint(0, 3))) for _ in range(n)]
        q, c = make(6), make(12)
        want = []
        for tag in {p[0] for p in c}:
            own = [p for p in q if p[0] == tag]
            most = len({p[3] for p in own})
            gain = {at: sum((Counter(p[1:3] for p in own) & Counter(p[1:3] for p in c if p[0] == tag and p[3] == at)).values()) for at in {p[3] for p in c if p[0] == tag}}
            keep = sorted(gain, key=lambda at: (gain[at], at), reverse=True)[:most]
            want += [p for p in c if p[0] == tag and p[3] in keep]
        assert Counter(pairs.restrict(q, c)) == Counter(want)


def test_places_on_baselines():
    assert baseline_place("nnann", 0, 4) == [-8, -8, 0, 0]
    assert baseline_place("", 2, 4) == [-2, 0, 0, 0]
    assert baseline_place("anbncndne", 1, 4) == [-1, -5, -5, -5]


LONG = "x+" * 2500 + "y"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (None, []), ("", []), ("no formula < 3", []), ("<math>", []), ("<math/>a</math>", []), ("<m:math a='1'>x</m:math> <math\n>y</math>", ["<m:math a='1'>x</m:math>", "<math\n>y</math>"]),
        ("<math><mi>a</mi></MATH></math >z", ["<math><mi>a</mi></MATH></math >"]), ('<span class="math-container">$x<y$</span>', ["$x<y$"]),
        ('<span class="math-container" id="1">$$\\$5$$</span><math>1</math>', ["$\\$5$", "<math>1</math>"]), ('<span class="math-container">none</span>', []), ("<mathematics>1</math>", []),
        (f'<span class="math-container">${LONG}$</span>', [f"${LONG}$"]), (f"<math><mi>{LONG}</mi></math>", [f"<math><mi>{LONG}</mi></math>"]),
    ],
)
def test_formulas_of_a_text(text, found):
    assert markup.formulas(text) == found


def test_scan_is_the_same_in_the_engine(spark):
    rows = [(1, "<math>a</math> <math>b</math>"), (2, None), (3, ""), (4, f'<p class="math-container">${LONG}$</p>')]
    got = {tuple(r) for r in documents.scan_formulas(spark.createDataFrame(rows, "doc_id bigint, content string")).collect()}
    assert got == {(1, 0, "<math>a</math>"), (1, 1, "<math>b</math>"), (4, 0, f"${LONG}$")}


@pytest.mark.parametrize("row", [(1 << 40, 0), (1, 1 << 22), (-1, 0)])
def test_ids_out_of_range_are_an_error(spark, row):
    occ = spark.createDataFrame([(*row, "[V!x]")], "doc_id bigint, position bigint, expr string")
    with pytest.raises(Exception, match="out of range"):
        build(occ)


@pytest.mark.parametrize("window", [0, 1, 4])
@pytest.mark.parametrize("eob", ["small", "all", "none"])
def test_chains_without_trees(window, eob):
    rnd = random.Random(3)
    chains = ["", "[", "[]", "[a]", "[a][b]", "[a[b]]]", "a[b]", "[a[b,c[d]]]", "[U!plus[x]]", "[E!]", "[a[E!]]", "[a[]]"]
    chains += ["[" + "[".join(rnd.choice(["a", "b", "V!x", "E!", "?w"]) for _ in range(n)) + "]" * n for n in range(1, 12)]
    for c in chains:
        got = expand_chain(c, window, eob)
        if got is not None:
            assert got == expand(trees.parse(c), window, eob)
    assert window == 0 or sum(expand_chain(c, window, eob) is not None for c in chains) >= 13
