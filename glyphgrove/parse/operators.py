"""Operator trees from Content MathML: applications as nodes, operands as numbered children."""

from __future__ import annotations

from collections.abc import Callable

from glyphgrove.functions.tags import CHILD_LABELS, clean
from glyphgrove.parse.layout import UnknownTag
from glyphgrove.parse.markup import Element
from glyphgrove.parse.trees import Tree, copy

# Elements by the kind of symbol they stand for -------------------------------------------------
FUNCTIONS = (
    "sin cos tan cot sec csc sinh cosh tanh coth sech csch arccos arccot arccsc arcsec arcsin arctan arccosh arccoth"
    " arccsch arcsech arcsinh arctanh abs exp log ln min max ceiling floor arg gcd real imaginary"
).split()
COMMUTATIVE = "approx eq neq equivalent union intersect plus times and or".split()
ORDERED = (
    "lt gt leq geq minus divide subset prsubset notsubset notprsubset in notin forall exists setdiff not implies int sum"
    " partialdiff limit factorial compose root"
).split()
CONSTANTS = "infinity emptyset imaginaryi".split()
MODIFIERS = "degree bvar lowlimit uplimit".split()
#: Names of the converter's symbols that are operators under their own name.
SYMBOLS = frozenset(
    """
    annotated approaches-limit approximately-equals-or-equals approximately-equals-or-image-of assign asymptotically-equals
    because between binomial bottom bra cases complement conditional-set contains continued-fraction contour-integral coproduct
    currency-dollar degree difference-between dimension direct-product direct-sum divides does-not-prove double-integral
    double-intersection double-subset-of double-superset-of double-union equals-or-preceeds equals-or-succeeds evaluated-at
    exclusive-or expectation forces geometrically-equals greater-than-and-not-approximately-equals greater-than-and-not-equals
    greater-than-and-not-equivalent-to greater-than-or-approximately-equals greater-than-or-equals-or-less-than
    greater-than-or-equivalent-to greater-than-or-less-than iff image-of-or-approximately-equals infimum infinity injective-limit
    inner-product kernel ket left-normal-factor-semidirect-product left-semidirect-product less-than-and-not-approximately-equals
    less-than-and-not-equals less-than-and-not-equivalent-to less-than-or-approximately-equals less-than-or-equals-or-greater-than
    less-than-or-greater-than less-than-or-similar-to limit-from limit-infimum limit-supremum maps-to minus-or-plus models
    much-greater-than much-less-than norm not-and not-approximately-equals not-contains not-contains-nor-equals not-divides
    not-equivalent-to not-exists not-forces not-greater-than not-greater-than-nor-equals not-greater-than-or-equals not-less-than
    not-less-than-nor-equals not-less-than-nor-greater-than not-less-than-or-equals not-models not-much-greater-than
    not-much-less-than not-parallel-to not-partial-differential not-perpendicular-to not-precedes not-precedes-nor-equals
    not-proportional-to not-proves not-similar-to not-similar-to-or-equals not-square-image-of-or-equals not-subgroup-of
    not-subgroup-of-nor-equals not-subset-of not-subset-of-nor-equals not-subset-of-or-equals not-succeeds
    not-succeeds-nor-equals not-superset-of not-superset-of-nor-equals not-superset-of-or-equals not-very-much-greater-than
    not-very-much-less-than parallel-to percent perpendicular-to plus-or-minus precedes precedes-and-not-approximately-equals
    precedes-and-not-equals precedes-and-not-equivalent-to precedes-or-approximately-equals precedes-or-equals
    precedes-or-equivalent-to product projective-limit proper-intersection proportional-to proves quadruple-integral
    quantum-operator-product right-normal-factor-semidirect-product right-semidirect-product similar-to similar-to-or-equals
    square-image-of square-image-of-or-equals square-intersection square-original-of square-original-of-or-equals square-union
    succeeds succeeds-and-not-approximately-equals succeeds-and-not-equals succeeds-and-not-equivalent-to
    succeeds-or-approximately-equals succeeds-or-equals succeeds-or-equivalent-to superset-of superset-of-and-not-equals
    superset-of-or-equals supremum symmetric-difference tensor-product therefore top triple-integral very-much-greater-than
    very-much-less-than weierstrass-p
    """.split()
)
#: Names with another tag, by content dictionary.
ALIASES = {
    ("latexml", "absent"): "W!",
    ("latexml", "for-all"): "O!forall",
    ("latexml", "hyperbolic-cotangent"): "F!coth",
    ("latexml", "modulo"): "O!rem",
    ("latexml", "planck-constant-over-2-pi"): "C!hbar",
    ("latexml", "square-root"): "O!root",
    ("ambiguous", "formulae-sequence"): "O!form-seq",
    ("ambiguous", "fragments"): "O!fragments",
    ("ambiguous", "missing-subexpression"): "W!",
    ("ambiguous", "subscript"): "O!SUB",
    ("ambiguous", "superscript"): "O!SUP",
}
CLOSURES = {"open": "O-O", "closed": "C-C", "open-closed": "O-C", "closed-open": "C-O"}
# -------------------------------------------------------------------------------------------------------------

_NAMED = {
    **{t: "F!" + t for t in FUNCTIONS},
    **{t: "U!" + t for t in COMMUTATIVE},
    **{t: "O!" + t for t in ORDERED},
    **{t: "C!" + t for t in CONSTANTS},
    "determinant": "F!det",
}
_MOST = len(CHILD_LABELS)


def _numbered(tag: str, kids: list[Tree]) -> Tree:
    """A node with numbered children; too many are halved under commutative and error nodes."""
    if len(kids) > _MOST:
        if not tag.startswith(("U!", "E!")):
            raise ValueError(f"more than {_MOST} children")
        half = (len(kids) + 1) // 2
        kids = [_numbered(tag, kids[:half]), _numbered(tag, kids[half:])]
    node = Tree(tag)
    node.edges = dict(zip(CHILD_LABELS, kids, strict=False))
    return node


def _leaf(prefix: str) -> Callable[[Element, Tree | None], Tree]:
    def rule(e: Element, _: Tree | None) -> Tree:
        text = clean(e.text)
        return Tree(prefix + text if text else "W!")

    return rule


def _all(e: Element, before: Tree | None = None) -> list[Tree]:
    return [parse(c, before) for c in e.children]


def _apply(e: Element, before: Tree | None) -> Tree:
    if not e.children:
        raise ValueError("application of nothing")
    head = parse(e.children[0], before)
    tag, first = head.tag, []
    if tag.startswith("V!"):
        tag = "F!" + tag[2:]
    if head.edges:  # the operator is itself a tree
        head.tag = tag
        first = [head]
        tag = "+!" + (head.children()[0].tag if tag in ("O!SUB", "O!SUP") else "")
    args: list[Tree] = []
    for c in e.children[1:]:
        # a shared operand stands for the last operand of the conjunct before this one
        args.append(parse(c, args[-1] if tag == "U!and" and args else None) if tag == "U!and" else parse(c, before))
    if tag == "O!int":
        if len(args) != 1:
            raise ValueError("an integral has one operand")
        args = [args[0], Tree("W!"), Tree("W!")]
    elif tag == "O!root":
        degrees = [a for a in args if a.tag == "$!degree"]
        body = [a for a in args if a.tag != "$!degree"]
        if len(body) != 1 or len(degrees) > 1 or any(len(d.edges) != 1 for d in degrees):
            raise ValueError("a root has one operand and at most one degree")
        args = [body[0], degrees[0].children()[0] if degrees else Tree("N!2")]
    return _numbered(tag, first + args)


def _share(e: Element, before: Tree | None) -> Tree:
    if e.attrib.get("href") == "#.cmml" and before is not None and before.edges:
        return copy(before.children()[-1])
    raise UnknownTag("share")


def _collection(kind: str) -> Callable[[Element, Tree | None], Tree]:
    return lambda e, before: _numbered(f"M!{kind}-{len(e.children)}", _all(e, before))


def _matrix(e: Element, before: Tree | None) -> Tree:
    rows = _all(e, before)
    n = max((len(r.edges) for r in rows), default=0)
    full = [_numbered(r.tag, r.children() + [Tree("E!") for _ in range(n - len(r.edges))]) for r in rows]
    return _numbered(f"M!M-{len(rows)}x{n}", full)


def _interval(e: Element, before: Tree | None) -> Tree:
    closure = e.attrib.get("closure", "closed").strip().lower()
    if closure not in CLOSURES:
        raise ValueError(f"closure {closure}")
    return _numbered(f"O!interval({CLOSURES[closure]})", _all(e, before))


def _error(e: Element, before: Tree | None) -> Tree:
    """Unknown symbols that follow each other or a text become one text."""
    kids: list[Tree] = []
    for k in _all(e, before):
        if kids and k.tag.startswith("-!") and kids[-1].tag[:2] in ("-!", "T!"):
            kids[-1].tag = "T!" + kids[-1].tag[2:] + k.tag[2:]
        else:
            kids.append(k)
    return _numbered("E!", kids)


def _symbol(e: Element, _: Tree | None) -> Tree:
    name, source = clean(e.text).lower(), e.attrib.get("cd", "")
    if (source, name) in ALIASES:
        return Tree(ALIASES[source, name])
    if source == "unknown":
        return Tree("-!" + name)
    if source == "latexml":
        if name in SYMBOLS:
            return Tree("O!" + name)
        if name.startswith("delimited-"):
            return Tree("M!D-" + name[11:].replace("[", "&lsqb;").replace("]", "&rsqb;"))
        try:
            return Tree(f"N!{float(name)}")
        except ValueError:
            pass
    raise UnknownTag(f"csymbol:{name}")


def _math(e: Element, before: Tree | None) -> Tree | None:
    if len(e.children) > 1:
        raise ValueError("math element with more than one child")
    return parse(e.children[0], before) if e.children else None


def _wildcard(e: Element, _: Tree | None) -> Tree:
    return Tree("?" + (e.attrib["name"] if "name" in e.attrib else clean(e.text)))


RULES: dict[str, Callable[[Element, Tree | None], Tree | None]] = {
    "math": _math,
    "semantics": lambda e, before: parse(e.children[0], before) if e.children else None,
    "ci": _leaf("V!"),
    "cn": _leaf("N!"),
    "mtext": _leaf("T!"),
    "qvar": _wildcard,
    "cerror": _error,
    "apply": _apply,
    "share": _share,
    "vector": _collection("V"),
    "list": _collection("L"),
    "set": _collection("S"),
    "matrix": _matrix,
    "matrixrow": lambda e, before: _numbered("M!R!", _all(e, before)),
    "interval": _interval,
    "csymbol": _symbol,
    **{m: (lambda tag: lambda e, before: _numbered(tag, _all(e, before)))("$!" + m) for m in MODIFIERS},
}


def parse(e: Element, before: Tree | None = None) -> Tree | None:
    """Operator tree of an element; ``before`` is the conjunct before the one that it is in."""
    if e.tag in _NAMED:
        return Tree(_NAMED[e.tag])
    rule = RULES.get(e.tag)
    if rule is None:
        raise UnknownTag(e.tag)
    return rule(e, before)
