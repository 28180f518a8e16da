"""The Porter stemmer, from the algorithm published in 1980 ("An algorithm for suffix stripping")."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what takes their place, per step. Longest suffixes decide.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _forms(word: str) -> str:
    """The word as c and v; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return len(re.findall(r"v+c+", _forms(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _forms(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _forms(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, and the last is none of w, x, y."""
    return len(word) > 2 and _forms(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if measure(stem) > least else word
    return word


def _plural(w: str) -> str:
    for suffix, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if w.endswith(suffix):
            return w[: len(w) - cut]
    return w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[: -len(suffix)]):
            w = w[: -len(suffix)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double(w) and w[-1] not in "lsz":
                return w[:-1]
            return w + "e" if measure(w) == 1 and _short(w) else w
    return w


def _residue(w: str) -> str:
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            fits = measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if fits else w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        m = measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    return w[:-1] if measure(w) > 1 and _double(w) and w.endswith("l") else w


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Stem of a lower-case English word; words of one or two letters stay."""
    if len(word) <= 2:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, STEP_2, 0), STEP_3, 0)
    return _tidy(_residue(w))


def stem_column(words: Column) -> Column:
    """Stems of an array of words, in Arrow batches; null for null."""

    @F.pandas_udf("array<string>")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return stems(words)
