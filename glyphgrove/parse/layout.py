"""Symbol layout trees from Presentation MathML.

One small rule per element, found by its tag. Edges: n next, a above, b below, o over, u under, c and d above
and below before the base, w within, e next element of a matrix.
"""

from __future__ import annotations

from collections.abc import Callable

from glyphgrove.functions.tags import clean, has_type, is_wildcard
from glyphgrove.parse.markup import Element
from glyphgrove.parse.trees import Tree, baseline, cells, chain

# Fences that make a row a group, and those a group's tag may begin with.
OPENING, CLOSING = ("(", "{", "|", "∥", "&lsqb;"), (")", "}", "|", "∥", "&rsqb;")
FENCES = "({|&∥"
_ATTACHED = "naboucd"


class UnknownTag(ValueError):
    """An element without a rule; the whole document counts as failed."""


def _void(t: Tree | None) -> bool:
    return t is None or t.tag in ("W!", "") and not t.edges


def _kids(e: Element) -> list[Tree | None]:
    return [parse(c) for c in e.children]


def _plain_row(kids: list[Tree | None]) -> Tree | None:
    return chain([k for k in kids if not _void(k)])


def _filled(kids: list[Tree | None]) -> list[Tree | None]:
    """Kids of a row whose first place is kept by an empty symbol if it is empty and others follow."""
    return [Tree("W!"), *kids[1:]] if len(kids) > 1 and kids[0] is None else kids


def _escape_fence(text: str) -> str:
    return text.replace("[", "&lsqb;").replace("]", "&rsqb;")


def group(opening: str, inner: list[Tree], closing: str | None, separators: tuple[str, ...]) -> Tree:
    """A fenced row as a matrix with one row; separators end its elements and stay with them."""
    fence = opening + (closing or "")
    if len(inner) == 1 and inner[0].tag.startswith("M!") and inner[0].tag[2:3] not in FENCES and not any(k in inner[0].edges for k in _ATTACHED):
        inner[0].tag = f"M!{fence}{inner[0].tag[2:]}"
        return inner[0]
    if not inner:
        return Tree(f"M!{fence}")
    separates = separators.__contains__
    one_row = len(inner) == 1
    symbols = baseline(inner[0]) if one_row else inner
    if separates(symbols[0].tag):
        symbols = [Tree("W!"), *symbols]
    parts: list[list[Tree]] = [[symbols[0]]]
    n, ended = 1, False
    for s in symbols[1:]:
        if separates(s.tag) and not (one_row and ended):
            n += 1
            parts[-1].append(s)
            ended = True
        elif ended:
            parts.append([s])
            ended = False
        else:
            parts[-1].append(s)
    return _linked(f"M!{fence}1x{n}", [chain(p) for p in parts])


def _linked(tag: str, elements: list[Tree]) -> Tree:
    """A matrix node with its elements in one chain."""
    for a, b in zip(elements, elements[1:], strict=False):
        a.set("e", b)
    return Tree(tag, w=elements[0] if elements else None)


def _merged(a: Tree, b: Tree) -> Tree | None:
    """Two abutting matrices without fences and with as many rows as one; null if they aren't that."""
    (rows, _, left), (rows2, _, right) = a.tag[2:].partition("x"), b.tag[2:].partition("x")
    if not rows.isdecimal() or rows != rows2:
        return None
    x, y = cells(a), cells(b)
    m, n = int(left), int(right)
    for c in (*x, *y):
        c.set("e", None)
    out: list[Tree] = []
    for r in range(int(rows)):
        out += x[r * m : (r + 1) * m] + y[r * n : (r + 1) * n]
    return _linked(f"M!{rows}x{m + n}", out)


def _row(e: Element) -> Tree | None:
    kids = [k for k in _kids(e) if not _void(k)]
    if len(kids) > 2 and kids[0].tag in OPENING and kids[-1].tag in CLOSING:
        return group(kids[0].tag, kids[1:-1], kids[-1].tag, ("&comma;",))
    out: list[Tree] = []
    for k in kids:
        both = _merged(out[-1], k) if out and out[-1].tag.startswith("M!") and k.tag.startswith("M!") and not out[-1].get("n") else None
        if both is not None:
            out[-1] = both
        else:
            out.append(k)
    return chain(out)


def _fenced(e: Element) -> Tree:
    marks = ["&comma;" if s == "," else _escape_fence(s) for s in e.attrib.get("separators", ",").split()]
    row: list[Tree] = []
    for i, k in enumerate(k for k in _kids(e) if not _void(k)):
        if i and marks:
            row.append(Tree(marks[min(i, len(marks)) - 1]))
        row.append(k)
    return group(_escape_fence(e.attrib.get("open", "(")), row, _escape_fence(e.attrib.get("close", ")")), tuple(marks))


def _script(edges: str, bare: str | None) -> Callable[[Element], Tree | None]:
    """Rule of scripts: ``edges`` for symbols with a type, ``bare`` for operators without one.

    A base that already goes on, or has that script, is put into a matrix of its own.
    """

    def rule(e: Element) -> Tree | None:
        kids = _kids(e)
        if len(kids) != len(edges) + 1:
            return _plain_row(kids)
        base = Tree("W!") if _void(kids[0]) else kids[0]
        use = edges if bare is None or is_wildcard(base.tag) or has_type(base.tag) else bare
        if any(k in base.edges for k in "n" + use):
            base = Tree("M!1x1", w=base)
        for k, script in zip(use, kids[1:], strict=True):
            base.set(k, script)
        return base

    return rule


def _pair(tag: str, first: str, second: str) -> Callable[[Element], Tree | None]:
    def rule(e: Element) -> Tree | None:
        kids = _kids(e)
        return Tree(tag, **{first: kids[0], second: kids[1]}) if len(kids) == 2 else _plain_row(kids)

    return rule


def _leaf(prefix: str) -> Callable[[Element], Tree]:
    def rule(e: Element) -> Tree:
        text = clean(e.text)
        return Tree(prefix + text) if text or not prefix else Tree("W!")

    return rule


def _first(e: Element) -> Tree | None:
    return parse(e.children[0]) if e.children else None


def _math(e: Element) -> Tree | None:
    if len(e.children) > 1:
        raise ValueError("math element with more than one child")
    return _first(e)


def _sqrt(e: Element) -> Tree:
    kids = _kids(e)
    return Tree("O!root", w=chain(_filled(kids))) if kids else Tree("W!")


def _enclosed(e: Element) -> Tree:
    return Tree(e.attrib.get("notation", "longdiv"), w=chain(_filled(_kids(e))))


def _cell(e: Element) -> Tree:
    kids = _kids(e)
    return chain([kids[0] or Tree("W!"), *kids[1:]] if kids else [Tree("W!")])


def _table_row(e: Element) -> list[Tree]:
    return [k or Tree("W!") for k in _kids(e)] or [Tree("W!")]


def _table(e: Element) -> Tree:
    rows = [_table_row(c) if c.tag == "mtr" else [parse(c) or Tree("W!")] for c in e.children]
    return _linked(f"M!{len(rows)}x{len(rows[0]) if rows else 0}", [c for r in rows for c in r])


def _multiscripts(e: Element) -> Tree | None:
    """Base, pairs of scripts, and after a mark pairs of scripts before the base; only the last pair may be absent."""
    if not e.children:
        return None
    base = parse(e.children[0])
    base = Tree("W!") if _void(base) else base
    kinds = [c.tag for c in e.children]
    mark = kinds.index("mprescripts") if "mprescripts" in kinds else len(kinds)
    for (low, high), part in (("ba", e.children[1:mark]), ("dc", e.children[mark + 1 :])):
        for edge, scripts in ((low, part[::2]), (high, part[1::2])):
            kids = [parse(c) for c in scripts]
            if kids and _void(kids[-1]):
                kids.pop()
            if kids:
                base.set(edge, chain([k or Tree("W!") for k in kids]))
    return base


def _wildcard(e: Element) -> Tree:
    return Tree("?" + (e.attrib["name"] if "name" in e.attrib else clean(e.text)))


RULES: dict[str, Callable[[Element], Tree | None]] = {
    "math": _math,
    "semantics": _first,
    "mstyle": _first,
    "mrow": _row,
    "mpadded": _row,
    "mfenced": _fenced,
    "menclose": _enclosed,
    "mn": _leaf("N!"),
    "mo": _leaf(""),
    "mi": _leaf("V!"),
    "mtext": _leaf("T!"),
    "msub": _script("b", "u"),
    "msup": _script("a", "o"),
    "msubsup": _script("ba", "uo"),
    "munder": _script("u", None),
    "mover": _script("o", None),
    "munderover": _script("uo", None),
    "msqrt": _sqrt,
    "mroot": _pair("O!root", "w", "c"),
    "mfrac": _pair("O!divide", "o", "u"),
    "mtd": _cell,
    "mtr": lambda e: _linked("", _table_row(e)).get("w"),
    "mtable": _table,
    "mmultiscripts": _multiscripts,
    "qvar": _wildcard,
    "merror": lambda e: Tree("E!" + clean(e.text)),
    **dict.fromkeys(("none", "mphantom", "mspace"), lambda _: Tree("W!")),
}


def parse(e: Element) -> Tree | None:
    """Layout tree of an element; null if there is nothing in it."""
    rule = RULES.get(e.tag)
    if rule is None:
        raise UnknownTag(e.tag)
    return rule(e)
