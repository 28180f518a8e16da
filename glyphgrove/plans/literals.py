"""Inputs of the literal queries and the rows that they must give, worked out by hand from the formats' rules or published."""

from __future__ import annotations

#: Presentation markup inside a ``math`` element, with its layout tree.
LAYOUT = [
    ('<mfrac><mi>x</mi><mi>y</mi></mfrac>', '[O!divide,o[V!x],u[V!y]]'),
    ('<mrow><mn>2</mn><msup><mi>x</mi><mn>3</mn></msup><mo>+</mo><mn>3</mn></mrow>', '[N!2[V!x[+[N!3]],a[N!3]]]'),
    ('<msubsup><mrow/><mi>α</mi><mi>i</mi></msubsup>', '[W!,a[V!i],b[V!α]]'),
    ('<mrow><mo>{</mo><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable><mo>}</mo></mrow>', '[M!{}2x2,w[N!1,e[N!2,e[N!3,e[N!4]]]]]'),
    ('<mrow><mo>(</mo><mn>5</mn><mo>)</mo></mrow>', '[M!()1x1,w[N!5]]'),
    ('<mrow><mi>z</mi><mo>=</mo><mrow><mo>(</mo><mn>5</mn><mo>)</mo></mrow><mo>+</mo><mn>1</mn></mrow>', '[V!z[=[M!()1x1[+[N!1]],w[N!5]]]]'),
    ('<mrow><mo>(</mo><mi>a</mi><mo>,</mo><mi>b</mi><mo>)</mo></mrow>', '[M!()1x2,w[V!a[&comma;],e[V!b]]]'),
    ('<mrow><mo>(</mo><mrow><mi>a</mi><mo>,</mo><mi>b</mi></mrow><mo>)</mo></mrow>', '[M!()1x2,w[V!a[&comma;],e[V!b]]]'),
    ('<mfenced><mi>a</mi><mi>b</mi></mfenced>', '[M!()1x2,w[V!a[&comma;],e[V!b]]]'),
    ('<msub><mo>∑</mo><mi>i</mi></msub>', '[∑,u[V!i]]'),
    ('<msup><msup><mi>x</mi><mi>y</mi></msup><mi>z</mi></msup>', '[M!1x1,a[V!z],w[V!x,a[V!y]]]'),
    ('<msup><mi>x</mi></msup>', '[V!x]'),
    ('<mroot><mi>x</mi><mn>3</mn></mroot>', '[O!root,c[N!3],w[V!x]]'),
    ('<msqrt><mi>x</mi><mo>+</mo><mn>1</mn></msqrt>', '[O!root,w[V!x[+[N!1]]]]'),
    ('<menclose><mi>x</mi></menclose>', '[longdiv,w[V!x]]'),
    ('<mmultiscripts><mi>X</mi><none/><mi>c</mi><mprescripts/><mi>d</mi><none/></mmultiscripts>', '[V!X,a[V!c],d[V!d]]'),
    ('<mrow><mtable><mtr><mtd><mn>1</mn></mtd></mtr><mtr><mtd><mn>2</mn></mtd></mtr></mtable><mtable><mtr><mtd><mn>3</mn></mtd></mtr><mtr><mtd><mn>4</mn></mtd></mtr></mtable></mrow>', '[M!2x2,w[N!1,e[N!3,e[N!2,e[N!4]]]]]'),
    ("<mrow><mi>f</mi><mo>\u2061</mo><mws:qvar name='x'/></mrow>", '[V!f[?x]]'),
    ('<mi>a,[?</mi>', '[V!a&comma;&lsqb;&quest;]'),
    ("<semantics><mi>x</mi><annotation-xml encoding='MathML-Content'><ci>x</ci></annotation-xml><annotation encoding='application/x-tex'>x</annotation></semantics>", '[V!x]'),
    ('', None),
    ('<mstyle><mpadded><mi>x</mi></mpadded></mstyle>', '[V!x]'),
    ('<msub><mi>x</mi><mi>i</mi></msub>', '[V!x,b[V!i]]'),
    ('<msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup>', '[V!x,a[N!2],b[V!i]]'),
    ('<munder><mi>lim</mi><mi>n</mi></munder>', '[V!lim,u[V!n]]'),
    ('<mover><mi>x</mi><mo>¯</mo></mover>', '[V!x,o[¯]]'),
    ('<munderover><mo>∑</mo><mi>i</mi><mi>n</mi></munderover>', '[∑,o[V!n],u[V!i]]'),
    ('<mtable><mtr><mtd><mi>i</mi><mo>=</mo><mn>1</mn></mtd><mtd/></mtr></mtable>', '[M!1x2,w[V!i[=[N!1]],e[W!]]]'),
    ('<mtext>if</mtext>', '[T!if]'),
]

#: Content markup inside a ``math`` element, with its operator tree.
OPERATOR = [
    ('<apply><plus/><ci>x</ci><cn>1</cn></apply>', '[U!plus,0[V!x],1[N!1]]'),
    ('<apply><ci>f</ci><ci>x</ci></apply>', '[F!f,0[V!x]]'),
    ('<apply><int/><ci>f</ci></apply>', '[O!int,0[V!f],1[W!],2[W!]]'),
    ('<apply><root/><degree><cn>3</cn></degree><ci>x</ci></apply>', '[O!root,0[V!x],1[N!3]]'),
    ("<apply><csymbol cd='latexml'>square-root</csymbol><ci>x</ci></apply>", '[O!root,0[V!x],1[N!2]]'),
    ("<apply><apply><csymbol cd='ambiguous'>subscript</csymbol><int/><cn>0</cn></apply><ci>f</ci></apply>", '[+!O!int,0[O!SUB,0[O!int],1[N!0]],1[V!f]]'),
    ("<apply><and/><apply><eq/><ci>a</ci><ci>b</ci></apply><apply><lt/><share href='#.cmml'/><ci>c</ci></apply></apply>", '[U!and,0[U!eq,0[V!a],1[V!b]],1[O!lt,0[V!b],1[V!c]]]'),
    ('<matrix><matrixrow><cn>1</cn><cn>2</cn></matrixrow><matrixrow><cn>3</cn></matrixrow></matrix>', '[M!M-2x2,0[M!R!,0[N!1],1[N!2]],1[M!R!,0[N!3],1[E!]]]'),
    ("<interval closure='open-closed'><ci>a</ci><ci>b</ci></interval>", '[O!interval(O-C),0[V!a],1[V!b]]'),
    ("<cerror><csymbol cd='unknown'>a</csymbol><csymbol cd='unknown'>b</csymbol><ci>x</ci></cerror>", '[E!,0[T!ab],1[V!x]]'),
    ('<set><ci>a</ci></set>', '[M!S-1,0[V!a]]'),
    ("<csymbol cd='latexml'>2</csymbol>", '[N!2.0]'),
    ('<semantics><ci>x</ci></semantics>', '[V!x]'),
    ('<apply><minus/><ci>x</ci></apply>', '[O!minus,0[V!x]]'),
    ('<apply><times/><cn>2</cn><apply><sin/><ci>x</ci></apply></apply>', '[U!times,0[N!2],1[F!sin,0[V!x]]]'),
    ('<vector><ci>a</ci><ci>b</ci></vector>', '[M!V-2,0[V!a],1[V!b]]'),
    ('<list><ci>a</ci><ci>b</ci></list>', '[M!L-2,0[V!a],1[V!b]]'),
    ('<interval><ci>a</ci><ci>b</ci></interval>', '[O!interval(C-C),0[V!a],1[V!b]]'),
    ("<interval closure='closed'><ci>a</ci><ci>b</ci></interval>", '[O!interval(C-C),0[V!a],1[V!b]]'),
]

#: Content markup that is no tree.
FAILING = [
    "<mystery/>",
    "<apply/>",
    "<apply><int/></apply>",
    "<csymbol cd='latexml'>no-such</csymbol>",
    "<ci>a</ci><ci>b</ci>",
    "<interval closure='x'/>",
]

_LONG = "x+" * 400 + "y"
#: Texts with their formulas and the ids of these.
SCANNED = [
    ('a <m:math id="f1"><m:mi>x</m:mi></m:math> b', [('<m:math id="f1"><m:mi>x</m:mi></m:math>', "f1")]),
    ('<span class="math-container">$y^2$</span> and <math><mi>z</math>', [("$y^2$", None), ("<math><mi>z</math>", None)]),
    ("no mathematics", []),
    (f'<span class="math-container">$${_LONG}$$</span>', [(f"${_LONG}$", None)]),
]

TOPICS = (
    "<topics><topic><num>T.1</num><query><formula id='f.0'><math><mfrac><mi>x</mi><mi>y</mi></mfrac></math></formula>"
    "<formula id='f.1'><math><mi>z</mi></math></formula><keyword id='w.0'>mean value</keyword><keyword id='w.1'>bound</keyword></query></topic>"
    "<topic><num>T.2</num><query><formula id='f.0'><math><mn>1</mn></math></formula></query></topic></topics>"
)

#: Query tree, candidate tree, constraints of the query's shape.
PAIRS = [
    ("[V!x[+[V!y]]]", "[V!x[+[N!1]]]", None),
    ("[V!a[+[V!b]]]", "[V!c[+[V!d]]]", None),
    ("[V!a[+[?w[=[V!b]]]]]", "[V!a[+[V!c[-[V!d[=[V!b]],a[N!2]]]]]]", None),
    ("[U!plus,0[?w],1[V!x]]", "[U!plus,0[V!x],1[U!times,0[N!2],1[V!y]]]", None),
    ("[U!plus,0[V!x],1[N!1]]", "[U!plus,0[N!1],1[V!x]]", None),
    ("[N!5[+[V!x]]]", "[N!7[+[V!y]]]", "[E[U[E]]]"),
    ("[N!5[+[V!x]]]", "[N!7[+[V!y]]]", "[U!>6!<=7[U[U]]]"),
]

#: Pair, metric, vector. Of pair 0 two of three symbols and one of two edges are matched, so the first score of most metrics
#: is 2 (2/3) (1/2) / (2/3 + 1/2) = 4/7; of pair 1 all are, two of them by unification.
SCORES = [
    (0, 0, [1 / 3]), (0, 1, [2 / 3]), (0, 2, [1 / 3]), (0, 4, [4 / 7, -1, 2]), (0, 6, [8 / 13, -1, 0, 0, 0, 0, 0]), (0, 7, [2 / 3]), (0, 8, [2 / 3]),
    (0, 9, [0.5, 0, 0, 0, 0]), (0, 10, [0.5, 0, 0, 0, 0]), (0, 11, [4 / 7, -1, 2]), (0, 12, [4 / 7, 2 / 3, 2 / 3]),
    (1, 0, [0]), (1, 1, [1 / 3]), (1, 3, [1 / 3, 0]), (1, 4, [1, 0, 1]), (1, 6, [0.5, 0, 0, -2, 0, 0, 0]), (1, 8, [2 / 3]), (1, 10, [0.625, 0, 0, -2, 0]), (1, 12, [1, 1, 1 / 3]),
    (2, 6, [1, 0, -4, 0, 0, 0, 0]), (2, 12, [1, 1, 1]),
    (3, 4, [1, -2, 3]), (3, 6, [1, 0, -3, 0, 0, 0, 0]), (3, 11, [1, 0, 3]), (3, 12, [4 / 7, 2 / 5, 2 / 3]),
    (4, 4, [1, 0, 3]), (4, 12, [1, 1, 1]),
    (5, 12, [2 / 7, 1 / 3, 1 / 3]), (6, 12, [1, 1, 1 / 3]),
]

#: Matched places of each pair by metric 12, the root being empty: equal, unified and wild ones of the query, then of the candidate.
PLACES = [
    (" n", "", "", " n", "", ""),
    ("n", " nn", "", "n", " nn", ""),
    (" n nnn nnnn", "", "nn", " n nnnnn nnnnnn", "", "nn nnn nnnn nnnna"),
    ("", "", "0", "", "", "0"),
    (" 0 1", "", "", " 0 1", "", ""),
    ("n", "", "", "n", "", ""),
    ("n", " nn", "", "n", " nn", ""),
]

_B1 = "[U!eq,0[U!times,0[V!𝑓],1[V!𝑥]],1[O!divide,0[U!plus,0[O!SUP,0[V!𝑥],1[N!2]],1[V!𝑥],2[V!𝑐]],1[U!plus,0[O!SUP,0[V!𝑥],1[N!2]],1[U!times,0[N!2],1[V!𝑥]],2[V!𝑐]]]]"
#: Query, candidate, published score of the first stage and vector of the second.
PUBLISHED_PAIRS = [
    (_B1, "[O!form-seq,0" + _B1 + ",1[O!in,0[V!𝑥],1[U!times,0[T!\\\\mathbb],1[V!𝑅]]]]", 0.8125, [1.0, 0.76, 1.0]),
    (_B1, _B1.replace("1[V!𝑥],2[V!𝑐]],1[U!plus", "1[U!times,0[N!2],1[V!𝑥]]],1[U!plus").replace("2[V!𝑐]", "2[N!2]"), 0.788991, [0.8376963350785339, 0.8, 0.8421052631578947]),
    (_B1, _B1.replace("1[V!𝑥],2[V!𝑐]],1[U!plus", "1[U!times,0[V!𝑎],1[V!𝑥]],2[V!𝑏]],1[U!plus").replace("2[V!𝑐]", "2[N!3]"), 0.767857, [0.8376963350785339, 0.7619047619047619, 0.8421052631578947]),
]

#: Examples of the published stemming algorithm.
STEMS = [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"),
    ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"),
    ("feudalism", "feudal"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("formalize", "formal"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustable", "adjust"),
    ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
]
