"""Canonical length-limited Huffman codes over token ids, in independent blocks.

Code lengths come from package-merge (limit 16 bits); codes of one length are
consecutive in id order, so the lengths alone are the codebook.  A block holds
whole documents: a header, the documents' lengths, a bit offset (64 bits) for every
``STEP`` tokens, and the bit stream.  The checkpoints let one block be decoded
in many lanes at once with a 2**16 table lookup per token.
"""

from __future__ import annotations

import struct

import numpy as np

LIMIT = 16
STEP = 64
MAGIC = b"HTB2"
_HEAD = struct.Struct("<4sIIQ")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 where the count is 0.

    Package-merge: at each level the cheapest packages of two are merged with
    the symbols; a symbol's length is the number of levels at which it is taken.
    """
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.lexsort((used, counts[used]))]
    weight = counts[order]
    n = len(order)
    levels = []  # per level: which entries of the merged list are symbols
    packages = np.empty(0, np.int64)
    for _ in range(limit):
        merged = np.concatenate([weight, packages])
        rank = np.argsort(merged, kind="stable")
        merged = merged[rank]
        levels.append(rank < n)
        half = len(merged) // 2
        packages = merged[: 2 * half].reshape(half, 2).sum(1)
    take = 2 * n - 2
    per_symbol = np.zeros(n, np.int64)
    for is_symbol in reversed(levels):
        symbols = int(is_symbol[:take].sum())
        per_symbol[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = per_symbol
    return lengths


class Codebook:
    """Codes and decoding tables that follow from the lengths."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.uint8)
        self.lengths = lengths
        order = np.flatnonzero(lengths)
        order = order[np.lexsort((order, lengths[order]))]
        ls = lengths[order].astype(np.int64)
        span = np.left_shift(1, LIMIT - ls)
        first = np.concatenate([[0], np.cumsum(span)])  # left-aligned codes
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = (first[:-1] >> (LIMIT - ls)).astype(np.uint32)
        self.symbol = np.zeros(1 << LIMIT, np.uint32)
        self.width = np.ones(1 << LIMIT, np.uint8)
        if len(order):
            self.symbol[: first[-1]] = np.repeat(order, span)
            self.width[: first[-1]] = np.repeat(ls, span)

    def to_bytes(self) -> bytes:
        return self.lengths.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Codebook:
        return cls(np.frombuffer(data, np.uint8))


def encode_block(book: Codebook, ids: np.ndarray, doc_lens: np.ndarray) -> bytes:
    """One block of whole documents; ``ids`` are theirs one after another."""
    n = len(ids)
    width, code = book.lengths[ids], book.codes[ids]
    if not width.all():
        raise ValueError("an id has no code")
    if n % 2:
        width, code = np.append(width, np.uint8(0)), np.append(code, np.uint32(0))
    # two codes at a time, of 32 bits at most; with the bits before them in a word they fit 64
    second = width[1::2]
    code = (code[::2] << second) | code[1::2]
    width = (width[::2] + second).astype(np.int64)
    ends = np.cumsum(width)
    at = ends - width
    total = int(ends[-1]) if n else 0
    word = at >> 5
    value = code.astype(np.uint64) << (64 - width - (at & 31)).astype(np.uint64)
    out = np.zeros(total // 32 + 2, np.uint64)
    if n:
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        rows = word[starts]
        out[rows] += np.add.reduceat(value >> np.uint64(32), starts)
        out[rows + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), starts)
    marks = at[:: STEP // 2].astype("<u8")
    body = out.astype(">u4").tobytes()[: (total + 7) // 8]
    head = _HEAD.pack(MAGIC, len(doc_lens), n, total)
    return b"".join([head, np.asarray(doc_lens, "<u4").tobytes(), marks.tobytes(), body])


def decode_block(book: Codebook, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids (unsigned 32 bits) and the documents' lengths of a block."""
    magic, docs, n, total = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("no block of token ids")
    at = _HEAD.size
    doc_lens = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    lanes = -(-n // STEP)
    pos = np.frombuffer(data, "<u8", lanes, at).astype(np.int64)
    at += 8 * lanes
    raw = np.frombuffer(data, np.uint8, (total + 7) // 8, at)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    out = np.empty((STEP, lanes), np.uint32)
    last = len(window) - 1
    for k in range(STEP):
        if k and k == n - (lanes - 1) * STEP:  # the last lane is done
            pos = pos[:-1]
        peek = (window[np.minimum(pos >> 3, last)] >> (16 - (pos & 7)).astype(np.uint32)) & 0xFFFF
        out[k, : len(pos)] = book.symbol[peek]
        pos = pos + book.width[peek]
    return out.T.reshape(-1)[:n], doc_lens
