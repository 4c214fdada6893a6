"""Cutting texts where no tokenizer merge can cross, and remembering what each piece encodes to.

A text is cut before every space that stands between two characters that are
no white space, and before every newline of that kind.  Both the splitting
pattern of byte-level BPE (a piece never holds a space after its first
character, unless it is all white space) and a vocabulary whose pieces carry
the space mark only at their start make such a cut exact.  A text with any
other arrangement of white space is handed over whole.

Arrow cuts the texts of a slice and numbers their distinct pieces; Python
sees a distinct piece once a slice, and only one that isn't remembered is
encoded.  Values of remembered pieces lie one after another in a pool, from
which numpy gathers those of all texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a cache holds before it drops those used least; bounds a worker's memory, not the result.
CACHE_ENTRIES = 400_000
#: Values in the pool after which it is tidied up.
POOL_VALUES = 1 << 24
#: Longer pieces are not kept.
CACHE_CHARS = 200
#: Texts handed to a cache at once; longer ones are cut where a cut is exact anywhere.
SLICE_BYTES = 5_000_000
SLICE_ROWS = 8192
#: Keys that say nothing of their own, and white space that keys may still hold.
_BLANK = {"", " ", "\n", "\n "}
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: Whether a byte is a letter or may belong to one.
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def safe(key: str) -> bool:
    """Whether a cut on both sides of the piece is certainly exact, from the piece alone."""
    bare = key[:-1] if key[-1:] == " " else key[1:] if key[:1] == "\n" else key
    return bare != "" and bare == bare.strip()


def _ends(keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first byte of each key, the last but one and the last; 0 where there is none."""
    wide = np.int64 if pa.types.is_large_string(keys.type) else np.int32
    at = np.frombuffer(keys.buffers()[1], wide)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
    data = np.append(np.frombuffer(keys.buffers()[2] or b"", np.uint8), np.uint8(0))
    start, end = at[:-1], at[1:]
    none = len(data) - 1
    return tuple(data[np.where(end - start >= least, where, none)] for where, least in ((start, 1), (end - 2, 2), (end - 1, 1)))


def text_slices(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of a text column of a bounded number of rows and, but for single long texts, bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at, n = 0, len(column)
    while at < n:
        before = int(ends[at] - sizes[at])
        end = min(max(int(np.searchsorted(ends, before + SLICE_BYTES, side="right")), at + 1), at + SLICE_ROWS, n)
        yield column.slice(at, end - at)
        at = end


def cut_long(text: str, size: int = SLICE_BYTES) -> list[str]:
    """Parts of about ``size`` characters; each part but the first lost the space before it."""
    parts, at = [], 0
    while len(text) - at > size:
        found = _BETWEEN.search(text, at + size)
        if found is None:
            break
        parts.append(text[at : found.start()])
        at = found.end()
    return [*parts, text[at:]]


class PieceCache:
    """Encodes texts piece by piece; each distinct piece is encoded once while it is remembered.

    ``encode_spaced(words)`` gives the values of words with a space before each,
    ``encode_other(pieces)`` those of pieces that start a text or with a newline,
    both as (flat values, number of each); ``encode_whole(text, spaced)`` serves
    texts that can't be cut (``spaced``: with a space before).  ``marks``: ASCII
    characters that are always cut off when they end a piece after a letter, and
    their values.
    """

    def __init__(self, encode_spaced: Callable, encode_other: Callable, encode_whole: Callable, dtype, marks: dict | None = None, limit: int = CACHE_ENTRIES):
        self.encode_spaced, self.encode_other, self.encode_whole = encode_spaced, encode_other, encode_whole
        self.dtype, self.limit = np.dtype(dtype), limit
        self.pool, self.filled = np.empty(1 << 20, self.dtype), 0
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.used = np.zeros(1 << 16, np.int32)
        self.count = 1  # number 0 is the piece without values
        self.known: dict[str, int] = {}
        self.mark_numbers = {m: self._add(np.asarray(v, self.dtype), np.array([len(v)], np.int64))[0] for m, v in (marks or {}).items()}
        self.fixed = self.count

    def _add(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Puts pieces into the pool; their numbers."""
        need, n = self.filled + len(values), self.count + len(sizes)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.empty(need - self.filled + need // 4, self.dtype)])
        if n > len(self.start):
            more = n - len(self.start) + n // 4
            self.start = np.concatenate([self.start, np.zeros(more, np.int64)])
            self.size = np.concatenate([self.size, np.zeros(more, np.int32)])
            self.used = np.concatenate([self.used, np.zeros(more, np.int32)])
        self.pool[self.filled : need] = values
        self.start[self.count : n] = self.filled + np.cumsum(sizes) - sizes
        self.size[self.count : n] = sizes
        self.used[self.count : n] = 0
        made = np.arange(self.count, n)
        self.filled, self.count = need, n
        return made

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of pieces one after another, and how many each has."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, self.filled) < 1 << 31 else np.int64
        at = np.repeat((self.start[numbers] - (ends - sizes)).astype(kind), sizes)
        at += np.arange(total, dtype=kind)
        return self.pool[at], sizes

    def _shrink(self) -> None:
        """Keeps the half of the pieces that most slices used; the pool holds nothing else afterwards."""
        numbers = np.fromiter(self.known.values(), np.int64, len(self.known))
        uses = self.used[numbers]
        least = max(1, int(np.partition(uses, -(self.limit // 2))[-(self.limit // 2)])) if len(uses) > self.limit // 2 else 0
        keys = [k for k, u in zip(self.known, uses.tolist(), strict=True) if u > least]
        kept = numbers[uses > least]
        values, sizes = self._gather(np.concatenate([np.arange(1, self.fixed), kept]))
        uses = self.used[kept]
        self.pool, self.filled, self.count = np.empty(max(1 << 20, 2 * len(values)), self.dtype), 0, 1
        self._add(values, sizes)
        self.used[self.fixed : self.count] = uses // 2
        self.known = dict(zip(keys, range(self.fixed, self.count), strict=True))

    def encode(self, column: pa.Array, tail=()) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts of a slice one after another, ``tail`` after each, and where each text's end; null is empty."""
        if not len(column):
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        if len(self.known) > self.limit or self.filled > POOL_VALUES:
            self._shrink()
        texts, later = pc.fill_null(column, ""), np.zeros(len(column), bool)
        if len(column) == 1 and column.nbytes > SLICE_BYTES:
            parts = cut_long(texts[0].as_py())
            texts, later = pa.array(parts, pa.large_string()), np.arange(len(parts)) > 0
        n, last_part = len(texts), ~np.append(later[1:], False)
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        ends = pieces.offsets.to_numpy()[1:].astype(np.int64) - pieces.offsets[0].as_py()
        firsts = np.concatenate([[0], ends[:-1]])
        coded = pieces.flatten().dictionary_encode()
        codes, opening = coded.indices.to_numpy(), firsts[~later]
        numbers, unsure = self._numbers(coded.dictionary)
        starts, start_of = np.unique(codes[opening], return_inverse=True)
        heads, odd = self._numbers(pa.array([k + " " for k in coded.dictionary.take(pa.array(starts)).to_pylist()], coded.dictionary.type))
        of, whole = numbers[codes], np.zeros(n, bool)
        of[opening], whole[~later] = heads[start_of], odd[start_of]
        if unsure.any():
            bad = unsure[codes]
            bad[opening] = False
            whole |= np.add.reduceat(bad, firsts, dtype=np.int64) > 0
        kept = self.filled, self.count  # what comes now serves this slice alone
        for i in np.flatnonzero(whole).tolist():
            text = texts[i].as_py()
            of[firsts[i] : ends[i]] = 0
            if text:
                values = self.encode_whole(text, bool(later[i]))
                of[firsts[i]] = self._add(values, np.array([len(values)]))[0]
        if len(tail):
            number = self._add(np.asarray(tail, self.dtype), np.array([len(tail)]))[0]
            of = np.insert(of, ends, np.where(last_part, number, 0))
            ends = ends + np.arange(1, n + 1)
        values, sizes = self._gather(of)
        self.filled, self.count = kept
        return values, np.cumsum(sizes)[ends - 1][last_part]

    def _numbers(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of distinct keys, and which of them a cut isn't sure for."""
        words = keys.to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.known.get, words.tolist(), repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = self._fresh(words[missing], keys.take(pa.array(missing)))
        unsure = found < 0
        found[unsure] = 0
        self.used[found] += 1
        return found, unsure

    def _fresh(self, words: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces not seen before, -1 for those that a cut isn't sure for; the same pieces as objects and in Arrow."""
        known, out = self.known, np.full(len(words), -1, np.int64)
        need = words.tolist()
        sure = np.ones(len(words), bool)
        if not _BLANK.isdisjoint(need) or _OTHER_SPACE.search("".join(need)):
            sure[:] = list(map(safe, need))
        first, before, last = _ends(keys)
        mark_of = np.zeros(256, np.int64)  # 0: no mark
        for m, number in self.mark_numbers.items():
            mark_of[ord(m)] = number
        marked = sure & (mark_of[last] > 0) & _LETTER[before]
        far = np.flatnonzero(marked & (before >= 128))  # letter or not, only the character tells
        marked[far] = [need[i][-2].isalpha() for i in far.tolist()]
        other = (last == ord(" ")) | (first == ord("\n"))
        bases = [k[:-1] for k in words[marked].tolist()]
        more = list(set(bases).difference(known, need))
        made: list[str] = []

        def put(pieces: list[str], numbers: np.ndarray) -> None:
            known.update(zip(pieces, numbers.tolist(), strict=True))
            made.extend(pieces)

        for kind, lines in ((sure & ~marked & ~other, False), (sure & ~marked & other, True)):
            own = words[kind].tolist()
            pieces = own + [k for k in more if (k[0] == "\n") == lines]
            if pieces:
                numbers = self._add(*(self.encode_other([k.removesuffix(" ") for k in pieces]) if lines else self.encode_spaced(pieces)))
                out[kind] = numbers[: len(own)]
                put(pieces, numbers)
        if bases:
            pairs = np.empty((len(bases), 2), np.int64)
            pairs[:, 0] = [known[b] for b in bases]
            pairs[:, 1] = mark_of[last[marked]]
            values, sizes = self._gather(pairs.ravel())
            out[marked] = self._add(values, sizes.reshape(-1, 2).sum(1))
            put(words[marked].tolist(), out[marked])
        if max(map(len, made), default=0) > CACHE_CHARS:
            for k in made:
                if len(k) > CACHE_CHARS:
                    del known[k]
        return out
