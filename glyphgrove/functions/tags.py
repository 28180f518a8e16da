"""Node tags and node paths of formula trees.

A tag's first two characters tell its type (``V!`` variable, ``N!`` number, ...); operators of layout trees have
no type, and wildcards begin with ``?``. A path is one character per edge, so its length is the node's depth.
"""

from __future__ import annotations

import re
from itertools import groupby

# Signs that would clash with the syntax of tree strings, and what stands for them.
ESCAPES = {"\t": r"\t", "\n": r"\n", "\r": r"\r", "?": "&quest;", ",": "&comma;", "[": "&lsqb;", "]": "&rsqb;"}
# Function application, invisible times, separator and plus.
INVISIBLE = "\u2061\u2062\u2063\u2064"

_ESCAPING = str.maketrans(ESCAPES)

#: Child labels of operator trees in order; their number bounds the children of a node.
CHILD_LABELS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def clean(text: str | None) -> str:
    """Text of a markup element as part of a tag."""
    tag = (text or "").strip().translate(_ESCAPING)
    return "" if len(tag) == 1 and tag in INVISIBLE else tag


def is_wildcard(tag: str) -> bool:
    return tag.startswith("?")


def is_variable(tag: str) -> bool:
    """Variables and wildcards."""
    return tag.startswith(("V!", "?"))


def has_type(tag: str) -> bool:
    return tag[1:2] == "!"


def run_length(path: str) -> str:
    """``aaaaab`` -> ``5a1b``."""
    return "".join(f"{len(list(run))}{label}" for label, run in groupby(path))


def run_length_inverse(code: str) -> str:
    """``5a1b`` -> ``aaaaab``."""
    return "".join(label * int(n) for n, label in re.findall(r"(\d+)(\D)", code))


def matrix_size(tag: str) -> tuple[int, int]:
    """Rows and columns at the end of a matrix tag, or (-1, -1)."""
    m = re.search(r"(\d+)x(\d+)$", tag)
    return (int(m[1]), int(m[2])) if m else (-1, -1)
