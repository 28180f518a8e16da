"""What a query symbol may be matched with."""

from __future__ import annotations

import math
from dataclasses import dataclass

from glyphgrove.functions.tags import has_type, is_wildcard


@dataclass(frozen=True)
class Constraint:
    """``unifiable`` off: only equal symbols. Numbers may be bounded, wildcards restricted to a type."""

    unifiable: bool = True
    low: float | None = None
    low_open: bool = False
    high: float | None = None
    high_open: bool = False
    kind: str | None = None

    def admits(self, q: str, c: str) -> bool:
        """Whether a candidate's tag may stand for the query's tag."""
        if is_wildcard(q):
            return self.kind is None or has_type(c) and c[0] == self.kind
        if q == c:
            return True
        if not self.unifiable or not has_type(q) or not has_type(c) or q[0] != c[0]:
            return False
        if q[0] in "OU":
            return False
        if q[0] == "V":  # names of one letter stand only for such names
            return len(q) == len(c) or len(q) != 3 and len(c) != 3
        return q[0] != "N" or self._within(c[2:])

    def _within(self, text: str) -> bool:
        try:
            x = float(text.split("!")[0].strip())
        except ValueError:
            return False
        low, high = -math.inf if self.low is None else self.low, math.inf if self.high is None else self.high
        return (x > low if self.low_open else x >= low) and (x < high if self.high_open else x <= high)


DEFAULT = Constraint()


def parse_constraint(text: str) -> Constraint:
    """``E`` exact, ``U`` anything, ``U!>=1!<5`` bounded numbers, else the type that a wildcard is restricted to."""
    if text == "E":
        return Constraint(unifiable=False)
    kind, *bounds = text.split("!")
    if kind != "U":
        return Constraint(kind=kind)
    made: dict[str, object] = {}
    for b in filter(None, bounds):
        side = "low" if b[0] == ">" else "high"
        strict = b[1:2] != "="
        made |= {side: float(b[1 if strict else 2 :]), f"{side}_open": strict}
    return Constraint(**made)
