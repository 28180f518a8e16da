"""Matching of two trees by their ancestor pairs, each used once."""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from dataclasses import dataclass

from glyphgrove.align.scores import harmonic
from glyphgrove.functions.tags import is_variable
from glyphgrove.parse.pairs import ordered_pairs
from glyphgrove.parse.trees import Tree, height

Pair = tuple[str, str, str, str]  # from, to, way, place


@dataclass
class PairMatch:
    scores: dict[str, float]
    q_exact: list[str]
    c_exact: list[str]
    q_unified: list[str]
    c_unified: list[str]


def shared(a: list[Pair], b: list[Pair]) -> list[tuple[Pair, Pair]]:
    """Pairs of both lists with the same terms and way, each used once, in the order of ``b``."""
    waiting: dict[tuple[str, str, str], deque[Pair]] = defaultdict(deque)
    for p in a:
        waiting[p[:3]].append(p)
    return [(waiting[p[:3]].popleft(), p) for p in b if waiting.get(p[:3])]


def _instances(pairs: list[Pair]) -> dict[str, dict[str, Counter]]:
    """For each ancestor tag the places where it stands, with the multiset of ways and terms below each."""
    out: dict[str, dict[str, Counter]] = {}
    for tag, term, way, place in pairs:
        out.setdefault(tag, {}).setdefault(place, Counter())[term, way] += 1
    return out


def restrict(q: list[Pair], c: list[Pair]) -> list[Pair]:
    """Candidate pairs of no more instances of a tag than the query has; those that share most are kept.

    An instance shares what its multiset has in common with all of the query's pairs below that tag; of equals, the
    later place is kept.
    """
    asked = _instances(q)
    kept: set[tuple[str, str]] = set()
    for tag, places in _instances(c).items():
        wanted = sum(asked.get(tag, {}).values(), Counter())
        by_gain = sorted(places, key=lambda at: ((places[at] & wanted).total(), at))
        kept |= {(tag, at) for at in by_gain[len(by_gain) - min(len(by_gain), len(asked.get(tag, ()))) :]}
    return [p for p in c if (p[0], p[3]) in kept]


def unify(q: list[Pair], c: list[Pair]) -> tuple[list[Pair], list[Pair]]:
    """Both lists with variables that behave alike renamed alike; numbers count as one."""

    def abstract(pairs: list[Pair], tag: str) -> list[Pair]:
        name = lambda t: "<U>" if t == tag else "<V>" if is_variable(t) else t
        return [("<U>", name(b), way, at) for a, b, way, at in pairs if a == tag]

    q_vars = {t: abstract(q, t) for t in _instances(q) if is_variable(t)}
    c_vars = {t: abstract(c, t) for t in _instances(c) if is_variable(t)}
    ranked = sorted(((_dice(len(shared(x, y)), len(x), len(y)), a == b, a, b) for a, x in q_vars.items() for b, y in c_vars.items()), reverse=True)
    q_name: dict[str, str] = {}
    c_name: dict[str, str] = {}
    for score, _, a, b in ranked:
        if score > 0 and a not in q_name and b not in c_name:
            q_name[a] = c_name[b] = f"U!{len(q_name)}"

    def renamed(pairs: list[Pair], names: dict[str, str], known: dict) -> list[Pair]:
        name = lambda t: names.get(t, t) if t in known else "N!U" if t.startswith("N!") else t
        return [(name(a), name(b), way, at) for a, b, way, at in pairs]

    return renamed(q, q_name, q_vars), renamed(c, c_name, c_vars)


def _dice(common: int, a: int, b: int) -> float:
    return harmonic(common / a, common / b) if common and a and b else 0.0


def _places(pairs: list[Pair]) -> set[str]:
    return {p[3] for p in pairs} | {p[3] + p[2] for p in pairs}


def match(query: Tree, candidate: Tree, window: int, eob: str, unified: bool, counted: bool, *, compat: bool = False) -> PairMatch:
    """Pair Dice of two trees; ends of baselines follow the query's height in the mode ``small``.

    ``compat`` scores unified pairs by the exact ones, as the engine that this one follows does.
    """
    ends = eob == "all" or eob == "small" and height(query) == 0
    q, c = ordered_pairs(query, window, ends), ordered_pairs(candidate, window, ends)
    exact = shared(q, restrict(q, c) if counted else c)
    q_exact, c_exact = _places([a for a, _ in exact]), _places([b for _, b in exact])
    scores = {"pair_dice": _dice(len(exact), len(q), len(c))}
    q_new: set[str] = set()
    c_new: set[str] = set()
    if unified:
        uq, uc = unify(q, c)
        both = shared(uq, restrict(uq, uc) if counted else uc)
        scores["pair_dice_unified"] = scores["pair_dice"] if compat else _dice(len(both), len(q), len(c))
        q_new, c_new = _places([a for a, _ in both]) - q_exact, _places([b for _, b in both]) - c_exact
    return PairMatch(scores, sorted(q_exact), sorted(c_exact), sorted(q_new), sorted(c_new))


def multiset_dice(a: Counter, b: Counter) -> float:
    """Dice of two multisets; the first stage's score for a single pair of trees."""
    common = sum((a & b).values())
    total = sum(a.values()) + sum(b.values())
    return 2.0 * common / total if total else 0.0
