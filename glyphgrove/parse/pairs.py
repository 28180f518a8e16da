"""Ancestor and descendant pairs of one tree: the engine's tuples, and the pairs of the pair metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

from glyphgrove.functions.tags import run_length
from glyphgrove.parse import trees

#: Windows reach this far unless told otherwise; 0 means any distance.
WINDOW = 4
#: Ends of baselines are tuples of their own for all trees, none, or those with at most one edge downwards.
EOB_MODES = ("small", "all", "none")
END = "0!"


def expand(root: trees.Tree, window: int = WINDOW, eob: str = "small") -> Counter[tuple[str, str, str]]:
    """Multiset of (from, to, way). Children of commutative operators all have the label 0.

    A pair whose lower node is an error reached by the label ``w`` is left out. Ends of baselines count for nodes
    without a ``next`` (a child 0 in operator trees) that are no errors.
    """
    limit = window or 1 << 30
    found: list[tuple[str, str, str]] = []
    operator = trees.is_operator_tree(root)
    down = "0" if operator else "n"
    ends = eob == "all" or eob == "small" and trees.height(root) <= 1
    todo: list[tuple[trees.Tree, list[tuple[str, str]]]] = [(root, [])]
    while todo:
        node, above = todo.pop()
        tag = node.tag
        if ends and down not in node.edges and not tag.startswith("E!"):
            found.append((tag, END, down))
        same = tag.startswith("U!")
        for label, child in node.edges.items():
            step = "0" if same else label
            ways = [(a, way + step) for a, way in above if len(way) < limit]
            ways.append((tag, step))
            name = child.tag
            if not (label == "w" and name.startswith("E!")):
                found += [(a, name, way) for a, way in ways]
            todo.append((child, ways))
    return Counter(found)


def expand_chain(text: str, window: int = WINDOW, eob: str = "small") -> Counter[tuple[str, str, str]] | None:
    """:func:`expand` of a string of symbols that only follow each other, without building its tree; null for others."""
    n = text.count("[")
    if not n or not window or "," in text or "U!" in text or text.count("]") != n or not text.endswith("]" * n):
        return None
    tags = text[1:-n].split("[")
    if not text.startswith("[") or not all(tags):
        return None
    found: Counter[tuple[str, str, str]] = Counter()
    for d in range(1, min(window, n - 1) + 1):
        found.update(zip(tags, tags[d:], repeat("n" * d)))
    if (eob == "all" or eob == "small" and n <= 2) and not tags[-1].startswith("E!"):
        found[tags[-1], END, "n"] += 1
    return found


def count_pairs(root: trees.Tree, window: int) -> int:
    """Number of ancestor pairs within a window (0: any distance), without ends of baselines."""
    return sum(min(len(path), window) if window else len(path) for path, _ in trees.visit(root))


def ordered_pairs(root: trees.Tree, window: int, eob: bool, *, short: bool = False) -> list[tuple[str, str, str, str]]:
    """(from, to, way, location) as the pair metrics use them.

    They differ from the engine's tuples: the first step from a commutative operator keeps its child's label, errors
    are not left out, and ``short`` writes ways and locations of more than five steps by run lengths.
    """
    code = lambda way: run_length(way) if short and len(way) > 5 else way
    operator = trees.is_operator_tree(root)
    order = None if operator else trees.VISIT_ORDER
    limit = window or 1 << 30
    out = []
    for path, node in trees.visit(root, order):
        place = code(path) or ("-" if short else "")
        for label, child in ((k, node.edges[k]) for k in (order or node.edges) if k in node.edges):
            for way, below in _below(child, label, limit, order):
                out.append((node.tag, below.tag, code(way), place))
        if eob and ("0" if operator else "n") not in node.edges:
            out.append((node.tag, END, "0" if operator else "n", place))
    return out


def _below(root: trees.Tree, way: str, limit: int, order: str | None) -> Iterator[tuple[str, trees.Tree]]:
    todo = [(way, root)]
    while todo:
        w, node = todo.pop()
        yield w, node
        if len(w) < limit:
            same = node.tag.startswith("U!")
            labels = [k for k in (order or node.edges) if k in node.edges]
            todo.extend((w + ("0" if same else k), node.edges[k]) for k in reversed(labels))
