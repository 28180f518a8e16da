"""Formula trees, their canonical strings and their node arrays.

One class serves both models: layout trees have edges with names of their own, operator trees number their
children. All functions are iterative, so a chain of a hundred thousand symbols is no deeper for them than one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

#: Edges of layout trees in the order of canonical strings (``n`` first, without its label) and of traversal.
PRINT_ORDER, VISIT_ORDER = "naboucdwe", "aocnbudew"


class Tree:
    """A node with its edges (label -> child)."""

    __slots__ = ("tag", "edges")

    def __init__(self, tag: str, **edges: Tree | None) -> None:
        self.tag = tag
        self.edges: dict[str, Tree] = {k: v for k, v in edges.items() if v is not None}

    def get(self, label: str) -> Tree | None:
        return self.edges.get(label)

    def set(self, label: str, child: Tree | None) -> None:
        if child is None:
            self.edges.pop(label, None)
        else:
            self.edges[label] = child

    def children(self) -> list[Tree]:
        return list(self.edges.values())

    def __repr__(self) -> str:
        return render(self)


class Node(NamedTuple):
    path: str  # edge labels from the root
    cpath: str  # the same, with "0" for children of commutative operators
    tag: str
    depth: int


def render(root: Tree, operator: bool | None = None) -> str:
    """Canonical string. Layout trees print ``next`` first and without a label."""
    out: list[str] = []
    todo: list[str | Tree] = [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append("[" + x.tag)
        todo.append("]")
        if "n" in x.edges and operator is not True or not x.edges or not next(iter(x.edges)).isdigit() and operator is not True:
            order = [k for k in PRINT_ORDER if k in x.edges]
        else:
            order = list(x.edges)
        for k in reversed(order):
            todo.append(x.edges[k])
            if k != "n" or operator:
                todo.append("," + k)
    return "".join(out)


_TOKEN = re.compile(r"(?:,([0-9A-Za-z]))?\[([^\[\],]*)|(\])")


def parse(text: str) -> Tree:
    """Tree of a canonical string; raises ``ValueError`` where the string isn't one."""
    stack: list[Tree] = []
    root: Tree | None = None
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or root is not None and not stack:
            raise ValueError(f"no tree string at {at}: {text[max(0, at - 10) : at + 10]!r}")
        at = m.end()
        if m[3]:
            if not stack:
                raise ValueError("unbalanced brackets")
            stack.pop()
            continue
        node = Tree(m[2])
        if stack:
            label = m[1] or "n"
            if label in stack[-1].edges:
                raise ValueError(f"edge {label} twice")
            stack[-1].edges[label] = node
        elif m[1]:
            raise ValueError("a root has no label")
        else:
            root = node
        stack.append(node)
    if root is None or stack:
        raise ValueError("unbalanced brackets")
    return root


def is_operator_tree(root: Tree) -> bool:
    """Operator trees begin with numbered children; a single node is both."""
    return "0" in root.edges


def visit(root: Tree, order: str | None = None) -> Iterator[tuple[str, Tree]]:
    """(path, node) in pre-order; children in ``order`` or as they stand."""
    todo = [("", root)]
    while todo:
        path, node = todo.pop()
        yield path, node
        labels = [k for k in order if k in node.edges] if order else list(node.edges)
        todo.extend((path + k, node.edges[k]) for k in reversed(labels))


def nodes(root: Tree) -> list[Node]:
    """Node array in pre-order of the canonical string."""
    out = []
    todo = [("", "", root)]
    while todo:
        path, cpath, node = todo.pop()
        out.append(Node(path, cpath, node.tag, len(path)))
        same = node.tag.startswith("U!")
        for k in reversed(node.edges):
            todo.append((path + k, cpath + ("0" if same else k), node.edges[k]))
    return out


def height(root: Tree) -> int:
    """Edges on the longest way down."""
    most, level = -1, [root]
    while level:
        most += 1
        level = [c for n in level for c in n.edges.values()]
    return most


def copy(root: Tree) -> Tree:
    return parse(render(root, is_operator_tree(root)))


def chain(parts: list[Tree | None]) -> Tree | None:
    """Parts linked by ``next``, each behind the end of the one before; absent parts are skipped."""
    first = end = None
    for p in parts:
        if p is None:
            continue
        if end is None:
            first = p
        else:
            end.set("n", p)
        end = last(p)
    return first


def last(root: Tree) -> Tree:
    """End of the baseline that begins at ``root``."""
    while (after := root.get("n")) is not None:
        root = after
    return root


def baseline(root: Tree) -> list[Tree]:
    """Symbols of the baseline, cut from each other."""
    out = []
    node: Tree | None = root
    while node is not None:
        out.append(node)
        node = node.edges.pop("n", None)
    return out


def cells(matrix: Tree) -> list[Tree]:
    """First symbols of a matrix' elements, row by row."""
    out = []
    node = matrix.get("w")
    while node is not None:
        out.append(node)
        node = node.get("e")
    return out
