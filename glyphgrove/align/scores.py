"""Scores of a match, and the metrics made of them."""

from __future__ import annotations

import re
import statistics
from collections.abc import Callable
from dataclasses import dataclass

from glyphgrove.align.matching import Match, Rules

#: Stands for "nowhere" where a match has no place on a baseline.
NOWHERE = -1e9


def harmonic(a: float, b: float) -> float:
    return 2.0 * a * b / (a + b) if a + b > 0 else 0.0


def linked(paths: list[str], window: int) -> int:
    """Pairs of a path and a matched proper prefix of it, at most ``window`` (0: any) steps above."""
    from collections import Counter

    times = Counter(paths)
    total = 0
    for p in paths:
        low = max(0, len(p) - window) if window else 0
        total += sum(p[:n] in times for n in range(low, len(p)))
    return total


def symbol_similarity(m: Match) -> float:
    """Harmonic mean of the recall of symbols and of edges between matched symbols (unified ones included)."""
    paths = m.q_paths(unified=True)
    edges = linked(paths, 1)
    if m.q_size > 1:
        edge_recall = (edges or 0.5) / (m.q_size - 1)
    else:
        edge_recall = 1.0
    return harmonic(len(paths) / m.q_size, edge_recall)


def recall(m: Match, unified: bool = False) -> float:
    return len(m.q_paths(unified=unified)) / m.q_size


def precision(m: Match, unified: bool = True) -> float:
    return len(m.c_paths(unified=unified)) / m.c_size


def node_dice(m: Match, unified: bool = False) -> float:
    return harmonic(recall(m, unified), precision(m, unified))


def wildcard_spread(m: Match) -> float:
    """Negative sample deviation of the sizes of wildcards' subtrees."""
    from collections import Counter

    sizes = list(Counter(p[0] for p in m.wild_nodes).values())
    return -statistics.stdev(sizes) if len(sizes) > 1 else 0.0


def baseline_place(path: str, kind: int, most: int) -> list[float]:
    """Where a path leaves the baselines of the first ``most`` depths: further right is lower, and so is a worse kind."""
    runs = [len(run) for run in re.split("[^n]", path)[:most]]
    return [-(4.0 * n + kind) for n in runs] + [0.0] * (most - len(runs))


def leftmost(m: Match, depth: int, most: int = 4) -> float:
    """How far left on the baseline of that depth the match begins; exact places beat those of wildcards and unified ones."""
    groups = enumerate((m.exact, m.wild_nodes, m.unified))
    best = max((baseline_place(p[2], kind, most) for kind, pairs in groups for p in pairs), default=None)
    return NOWHERE if best is None else best[depth]


def aligned_pairs(m: Match, window: int, unified: bool) -> float:
    """Dice of aligned ancestor pairs, each side with one pair for free (two where unified pairs count as well)."""
    q_total, c_total = m.pairs_in_trees(window)
    kinds = (False, True) if unified else (False,)
    q = sum(linked(m.q_paths(unified=u), window) for u in kinds) + len(kinds)
    c = sum(linked(m.c_paths(unified=u), window) for u in kinds) + len(kinds)
    return harmonic(q / (len(kinds) * (q_total + 1)), c / (len(kinds) * (c_total + 1)))


Score = Callable[[Match], float]

SCORES: dict[str, Score] = {
    "node_dice_ew": lambda m: node_dice(m, False),
    "node_dice_ewu": lambda m: node_dice(m, True),
    "mss": symbol_similarity,
    "mss_recall_dice": lambda m: harmonic(symbol_similarity(m), recall(m)),
    "recall_ew": recall,
    "precision_ewu": precision,
    "q_unmatched_ew": lambda m: 0.0 - (m.q_size - len(m.q_paths(unified=False))),
    "q_unmatched_ewu": lambda m: 0.0 - (m.q_size - len(m.q_paths(unified=True))),
    "c_unmatched_ew": lambda m: 0.0 - (m.c_size - len(m.c_paths(unified=False))),
    "c_unmatched_ewu": lambda m: 0.0 - (m.c_size - len(m.c_paths(unified=True))),
    "q_matched_ew": lambda m: float(len(m.q_paths(unified=False))),
    "q_matched_ewu": lambda m: float(len(m.q_paths(unified=True))),
    "c_matched_ew": lambda m: float(len(m.c_paths(unified=False))),
    "c_matched_ewu": lambda m: float(len(m.c_paths(unified=True))),
    "wild_matched": lambda m: 0.0 - (len(m.wild_nodes)),
    "wild_spread": wildcard_spread,
    "left_1": lambda m: leftmost(m, 0),
    "left_2": lambda m: leftmost(m, 1),
    "left_3": lambda m: leftmost(m, 2),
    "left_4": lambda m: leftmost(m, 3),
    "aligned_ew_1": lambda m: aligned_pairs(m, 1, False),
    "aligned_ewu_1": lambda m: aligned_pairs(m, 1, True),
    "aligned_ew_0": lambda m: aligned_pairs(m, 0, False),
    "aligned_ewu_0": lambda m: aligned_pairs(m, 0, True),
}


@dataclass(frozen=True)
class Metric:
    """Score vector of an alignment (``rules``), or of shared pairs (``pairs``: unify, restrict counts)."""

    scores: tuple[str, ...]
    rules: Rules | None = None
    pairs: tuple[bool, bool] | None = None


_one = Rules(unify=True, subtrees=False, pairing="all", strict="exact")
_whole = Rules(unify=True, subtrees=True, pairing="all", strict="exact")
_plain = Rules(unify=False, subtrees=True, pairing="all", strict="exact")

#: Metrics by their numbers; -1 leaves the order of the first stage.
METRICS: dict[int, Metric] = {
    -1: Metric(()),
    0: Metric(("pair_dice",), pairs=(False, False)),
    1: Metric(("node_dice_ew",), Rules(unify=False, subtrees=False, pairing="all", strict="exact")),
    2: Metric(("pair_dice",), pairs=(False, True)),
    3: Metric(("pair_dice_unified", "pair_dice"), pairs=(True, True)),
    4: Metric(("mss", "c_unmatched_ewu", "q_matched_ew"), _one),
    5: Metric(("mss", "c_unmatched_ewu", "q_matched_ew"), _one),
    6: Metric(("mss_recall_dice", "c_unmatched_ewu", "wild_matched", "left_1", "left_2", "left_3", "wild_spread"), _whole),
    7: Metric(("aligned_ew_1",), _plain),
    8: Metric(("aligned_ewu_1",), _whole),
    9: Metric(("aligned_ew_0", "wild_matched", "wild_spread", "left_1", "left_2"), _plain),
    10: Metric(("aligned_ewu_0", "wild_matched", "wild_spread", "left_1", "left_2"), _whole),
    11: Metric(("mss", "c_unmatched_ewu", "q_matched_ew"), _whole),
    12: Metric(("mss", "precision_ewu", "recall_ew"), Rules()),
}
