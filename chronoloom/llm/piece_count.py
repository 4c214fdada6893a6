"""Token counts of a sentencepiece BPE model, without ids.

Heap and linked list: the characters of a piece are a doubly linked list, a
heap holds its adjacent pairs by the rank of their merge, the lowest is popped
and merged until no known pair is left.  A text's count is its initial symbols
minus the merges done; a character outside the vocabulary counts as its UTF-8
bytes.

Texts are cut before a space mark that follows another character, which is
exact as no piece of the model holds the mark behind another character (this
is checked when the model is loaded; else texts are counted uncut).

Defined cases: null counts as empty, to no tokens; of pairs with equal ranks
the leftmost is merged first; texts of any length are counted whole (long ones
in parts, where a cut is exact); an empty table gives no rows; further columns
stay whatever their names, one of an output's name is replaced.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PieceCache, text_slices
from .common import with_columns

MARK = "▁"


class PieceCounter:
    """Counts what the model's library would emit, by merges alone."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, int] = {}
        self.single: set[str] = set()
        normal = [
            (-model.get_score(i), i, model.id_to_piece(i))
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        scores = sorted({s for s, _, _ in normal})
        level = {s: k for k, s in enumerate(scores)}  # equal scores share a rank: the leftmost pair goes first
        for score, _, piece in normal:
            self.rank[piece] = level[score]
            if len(piece) == 1:
                self.single.add(piece)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.rank)
        merged = {c for p in self.rank if len(p) > 1 for c in p}
        self.newline_alone = "\n" not in merged
        marks = {c: [self.count(c)] for c in ",." if not self._joins(c)}
        self.cache = PieceCache(self._spaced, self._other, lambda text, spaced: np.array([self.whole(text)]), np.int64, marks=marks)

    def _joins(self, mark: str) -> bool:
        """Whether a piece holds the character right after a letter, so that it can't be cut off there."""
        return any(a.isalpha() and b == mark for p in self.rank for a, b in zip(p, p[1:], strict=False))

    def merges(self, symbols: str) -> int:
        """How many merges the symbols of a piece undergo."""
        rank = self.rank
        n = len(symbols)
        if n < 2:
            return 0
        text = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i : i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            left = text[i]
            j = after[i]
            if not left or j >= n or len(left) + len(text[j]) != size:
                continue  # one of the two has been merged since
            both = left + text[j]
            text[i], text[j] = both, ""
            k = after[i] = after[j]
            done += 1
            if k < n:
                before[k] = i
                r = rank.get(both + text[k])
                if r is not None:
                    heapq.heappush(heap, (r, i, size + len(text[k])))
            h = before[i]
            if h >= 0:
                r = rank.get(text[h] + both)
                if r is not None:
                    heapq.heappush(heap, (r, h, size + len(text[h])))
        return done

    def count(self, symbols: str) -> int:
        if symbols in self.rank and len(symbols) == 1:
            return 1
        single = self.single
        initial = len(symbols)
        for c in symbols:
            if c not in single:
                initial += len(c.encode("utf-8", "surrogatepass")) - 1
        return initial - self.merges(symbols)

    def whole(self, text: str) -> int:
        """A text with white space of any arrangement: parts between a character and a mark behind it."""
        marked = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return self.count(marked)
        return sum(self.count(part) for part in _parts(marked))

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([self.count(MARK + w) for w in words], np.int64), np.ones(len(words), np.int64)

    def _other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces after a newline, or those that start a text and get the mark."""
        return np.array([self.count(p if p[0] == "\n" else MARK + p) for p in pieces], np.int64), np.ones(len(pieces), np.int64)

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; the mark that the model puts before a text makes its first word like any other."""
        column = pc.fill_null(column, "")
        if not (self.cuts and self.newline_alone):
            return np.array([self.whole(t) if t else 0 for t in column.to_pylist()], np.int64)
        marked = pc.match_substring(column, MARK)  # a mark inside a text is like a space
        plain, out, at = pc.if_else(marked, "", column), np.zeros(len(column), np.int64), 0
        for part in text_slices(plain):
            values, ends = self.cache.encode(part)
            out[at : at + len(part)] = np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)
            at += len(part)
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.whole(column[i].as_py())
        return out


def _parts(marked: str):
    start = 0
    at = marked.find(MARK, 1)
    while at >= 0:
        if marked[at - 1] != MARK:
            yield marked[start:at]
            start = at
        at = marked.find(MARK, at + 1)
    yield marked[start:]


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of each whole text."""

    @F.arrow_udf("long")
    def tokens(column: pa.Array) -> pa.Array:
        return pa.array(counter(path).counts(column))

    return with_columns(docs, {out: tokens(F.col(text).cast("string"))})


__all__ = ["PieceCounter", "count_tokens", "counter"]
