"""Encoding of whole texts with a public byte-level BPE tokenizer by monoid tree reduction.

A text is halved until the pieces are short; pieces are encoded alone and neighbours are joined upwards. A
join looks at a window around the boundary and grows it on either side to the nearest *seam*: a place where
white space follows a character that is none. The tokenizer's splitting rule can take white space only at the
start of a piece or in a run of white space, so it splits at every seam whatever surrounds it: tokens before
the left seam and after the right seam are those of the whole text, and only the window is encoded again. A
window without seams grows to the text's ends. The join is associative with the empty text as its unit, and
decoding concatenates the pieces' bytes up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphgrove.runtime import spread

#: Vocabulary of the queries and the folder of the public tokenizers; a parameter of every function here.
VOCABULARY = "byte_bpe_50k.tiktoken"
FOLDER = "/opt/tokenizers"

#: Characters of a leaf, and of the first window on each side of a join.
LEAF, WINDOW = 4096, 32


@lru_cache(maxsize=4)
def _encoding(folder: str, vocabulary: str):
    """The tokenizer and the byte length of each of its tokens; once per Python worker."""
    import importlib.util

    import tiktoken

    spec = importlib.util.spec_from_file_location("public_tokenizers_at", f"{folder}/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def _white(c: str) -> bool:
    """White space of the tokenizer's rule, which the four separators of ASCII don't belong to."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


class Encoder:
    """Encodes and decodes texts; see the module's docstring."""

    def __init__(self, folder: str = FOLDER, vocabulary: str = VOCABULARY, leaf: int = LEAF, window: int = WINDOW) -> None:
        self.bpe, self.lengths = _encoding(folder, vocabulary)
        self.leaf, self.window = leaf, window

    @staticmethod
    def _seam(text: str, at: int) -> bool:
        return 0 < at < len(text) and _white(text[at]) and not _white(text[at - 1])

    def _left_seam(self, text: str, lo: int, mid: int) -> int:
        """Last seam of ``text`` in (lo, mid), else lo; the window doubles while there is none."""
        reach, done = self.window, mid
        while done > lo:
            start = max(lo, mid - reach)
            for at in range(done - 1, max(start, lo + 1) - 1, -1):
                if self._seam(text, at):
                    return at
            done, reach = start, reach * 2
        return lo

    def _right_seam(self, text: str, mid: int, hi: int) -> int:
        """First seam of ``text`` in (mid, hi), else hi."""
        reach, done = self.window, mid + 1
        while done < hi:
            end = min(hi, mid + reach)
            for at in range(done, end):
                if self._seam(text, at):
                    return at
            done, reach = max(done, end), reach * 2
        return hi

    def _keep(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading tokens make up ``n_bytes`` bytes."""
        ends = np.cumsum(self.lengths[ids])
        at = int(np.searchsorted(ends, n_bytes)) + 1 if n_bytes else 0
        assert not n_bytes or ends[at - 1] == n_bytes, "a seam is no token boundary"
        return at

    def join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Tokens of ``text[lo:hi]`` from those of ``text[lo:mid]`` and ``text[mid:hi]``."""
        if not len(left) or not len(right):
            return right if not len(left) else left
        a, b = self._left_seam(text, lo, mid), self._right_seam(text, mid, hi)
        tail = len(text[a:mid].encode())
        head = len(text[mid:b].encode())
        cut = len(left) - self._keep(left[::-1], tail)
        skip = self._keep(right, head)
        return np.concatenate([left[:cut], np.asarray(self.bpe.encode_ordinary(text[a:b]), dtype=np.int32), right[skip:]])

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of a text; null and empty texts have none."""
        if not text:
            return np.empty(0, dtype=np.int32)
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return np.asarray(self.bpe.encode_ordinary(text[lo:hi]), dtype=np.int32)
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def decode(self, ids) -> str:
        """Text of token ids; halves are decoded to bytes and concatenated."""

        def raw(part: list[int]) -> bytes:
            if len(part) <= self.leaf:
                return self.bpe.decode_bytes(part)
            return raw(part[: len(part) // 2]) + raw(part[len(part) // 2 :])

        return raw([int(i) for i in ids]).decode()


def encode_corpus(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``ident, ids`` of every document, in Arrow batches; a large corpus is not shuffled, a small one is spread over the cores.

    Null and empty texts get an empty list. Strings of special tokens are ordinary text. A text may be as long
    as a row can be: work grows with its length, and memory with its tokens. Extra columns are not read.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = Encoder(folder, vocabulary)
        for batch in batches:
            yield pd.DataFrame({ident: batch[ident], "ids": [e.encode(t) for t in batch[text]]})

    kind = docs.schema[ident].dataType.simpleString()
    return spread(docs.select(ident, text), ident).mapInPandas(encode, f"{ident} {kind}, ids array<int>")


def decode_corpus(encoded: DataFrame, *, ident: str = "doc_id", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``ident, text`` of encoded documents; an empty or null list gives an empty text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        e = Encoder(folder, vocabulary)
        return ids.map(lambda x: "" if x is None else e.decode(x))

    return encoded.select(ident, decode("ids").alias("text"))
