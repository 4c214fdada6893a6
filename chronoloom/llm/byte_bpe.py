"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library.

``encode`` adds token ids (and, where asked for, character offsets), ``decode``
turns ids back into bytes and text.  Byte-level vocabularies write every byte
as one printable character; decoding reverses that table, so a token may hold
part of a character: bytes are joined first and only then read as UTF-8.

Defined cases: a null text encodes like an empty one, to no ids; null ids
decode to no bytes; an id outside the vocabulary raises; texts of any length
are encoded whole (long ones in parts, where a cut is exact); an empty table
gives no rows; repeated rows are encoded each; further columns stay whatever
their names, one of an output's name is replaced.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PieceCache, text_slices
from .common import release, with_columns


@lru_cache(maxsize=1)
def byte_characters() -> tuple[str, ...]:
    """The character for each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, spare = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + spare)
            spare += 1
    return tuple(table[b] for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two bytes or more is merged from, in order of rank.

    Merging a token's bytes by the ranks below its own must leave two parts.
    """
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if low >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((parts[0], parts[1]))
    return merges


#: Pieces that go through the library as one text.
RUN = 300


class ByteLevelTokenizer:
    """A tokenizer of the tokenizers library with the bytes of each of its tokens."""

    def __init__(self, library, token_bytes: list[bytes], added: tuple[str, ...] = ()):
        self.library, self.added = library, added
        self.token_bytes = token_bytes
        self.byte_lens = np.array([len(b) for b in token_bytes], np.int64)
        self.dtype = np.dtype("<u2" if len(token_bytes) <= 1 << 16 else "<u4")
        self.cache = PieceCache(self._spaced, self._other, self._whole, self.dtype, marks={m: self._ids(m) for m in ",." if not any(m in t for t in self.added)})

    @classmethod
    def from_json(cls, path: str) -> ByteLevelTokenizer:
        """A tokenizer.json; strings of its added tokens inside a text are found, as is the library's default."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        back = {c: b for b, c in enumerate(byte_characters())}
        size = library.get_vocab_size(with_added_tokens=True)
        added = library.get_added_tokens_decoder()
        of = [added[i].content.encode() if i in added else bytes(back[c] for c in library.id_to_token(i)) for i in range(size)]
        return cls(library, of, tuple(x.content for x in added.values()))

    @classmethod
    def from_ranks(cls, path: str) -> ByteLevelTokenizer:
        """A rank file; no special tokens."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_characters()
        written = lambda token: "".join(chars[b] for b in token)
        model = models.BPE(
            vocab={written(t): r for t, r in ranks.items()},
            merges=[(written(a), written(b)) for a, b in merges_of(ranks)],
            ignore_merges=True,
        )
        library = Tokenizer(model)
        library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            of[rank] = token
        return cls(library, of)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _whole(self, text: str, spaced: bool) -> np.ndarray:
        return self._ids(" " + text if spaced else text)

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words with a space before each, some as one text; their ids part at their bytes."""
        return self._parted([" " + " ".join(words[at : at + RUN]) for at in range(0, len(words), RUN)], b" ")

    def _other(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if all(p[0] == "\n" for p in pieces):
            return self._parted(["".join(pieces[at : at + RUN]) for at in range(0, len(pieces), RUN)], b"\n")
        made = [self._ids(p) for p in pieces]
        return np.concatenate(made), np.array([len(x) for x in made], np.int64)

    def _parted(self, runs: list[str], opening: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs of pieces, and how many each piece has; a piece holds ``opening`` as its first byte alone."""
        ids = np.concatenate([self._ids(run) for run in runs])
        raw = np.frombuffer("".join(runs).encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.append(np.flatnonzero(raw == ord(opening))[1:], len(raw))
        at = np.searchsorted(np.cumsum(self.byte_lens[ids]), ends, side="right")
        return ids, np.diff(at, prepend=0)

    def encode_flat(self, column: pa.Array, end_id: int | None = None, kind=None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (as ``kind``, else ``dtype``), ``end_id`` after each, and where each text's end."""
        parts = [self.cache.encode(part, () if end_id is None else (end_id,)) for part in text_slices(column)]
        if not parts:
            return np.empty(0, kind or self.dtype), np.empty(0, np.int64)
        before = np.cumsum([0] + [len(v) for v, _ in parts])
        ends = np.concatenate([e + b for (_, e), b in zip(parts, before, strict=False)])
        values = np.empty(before[-1], kind or self.dtype)
        for k, at in enumerate(before[:-1].tolist()):  # parts go as they are copied
            values[at : at + len(parts[k][0])] = parts[k][0]
            parts[k] = None
        return values, ends

    def encode_lists(self, column: pa.Array) -> pa.Array:
        """The ids of each text as a list of int; what encoding took besides is given back."""
        values, ends = self.encode_flat(column, kind=np.int32)
        release()
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(values))

    def encode(self, texts: list) -> list[np.ndarray]:
        values, ends = self.encode_flat(pa.array(texts, pa.string()))
        return np.split(values, ends[:-1]) if len(ends) else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Per token the characters [start, end) that it has a byte of; those that tokens share count for each."""
        if not len(ids):
            return np.empty((0, 2), np.int32)
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum(self.byte_lens[ids])
        return np.stack([char[ends - self.byte_lens[ids]], char[ends - 1] + 1], 1).astype(np.int32)


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteLevelTokenizer:
    """One for each Python worker; a rank file by its ending, else a tokenizer.json."""
    return ByteLevelTokenizer.from_ranks(path) if path.endswith(".tiktoken") else ByteLevelTokenizer.from_json(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) and, if named, ``offsets`` (array of [start, end) characters)."""

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        return tokenizer(path).encode_lists(column)

    @F.arrow_udf("array<array<int>>")
    def offsets_of(column: pa.Array, of: pa.Array) -> pa.Array:
        tok = tokenizer(path)
        rows = zip(column.to_pylist(), of.to_pylist(), strict=True)
        return pa.array([tok.offsets(t or "", np.array(i, np.int64)).tolist() for t, i in rows], pa.list_(pa.list_(pa.int32())))

    out = with_columns(docs, {ids: ids_of(F.col(text))})
    return with_columns(out, {offsets: offsets_of(F.col(text), F.col(ids))}) if offsets else out


def decode(encoded: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds ``data`` (binary): the bytes of the ids."""

    @F.arrow_udf("binary")
    def bytes_of(column: pa.Array) -> pa.Array:
        tok = tokenizer(path)
        if not len(column):
            return pa.array([], pa.binary())
        starts = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        made = [tok.decode(values[a:b].tolist()) if ok else b"" for a, b, ok in zip(starts[:-1], starts[1:], valid, strict=True)]
        out = pa.array(made, pa.binary())
        del made
        release()
        return out

    return with_columns(encoded, {data: bytes_of(F.col(ids))})
