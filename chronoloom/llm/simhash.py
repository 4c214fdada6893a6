"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of at most 23 bits.  With three
segments (23 + 23 + 18) and at most three differing bits, at most one segment
differs in two bits or more: two segments differ in at most one bit each.  The
perfect binary Golay code [23,12,7] puts every 23-bit word within three bits of
exactly one codeword, so a segment decodes to a 12-bit index, and for words one
bit apart one of them decodes to a codeword within four bits of the other:
that is its own codeword, or one of the five at distance four that only words
at distance three have.  So a fingerprint is stored under the indices of each
pair of segments and looked up under up to 6 x 6 of them; every pair within
three bits meets, and is verified by its bits.

Equal fingerprints are one node.  Rows of a key are streamed by sorted
partition; within a key only a spanning forest of the verified links goes on,
so a group of near copies yields a number of links in proportion to its size.
A key under which many fingerprints are stored is split into parts.  With four
segments (16 bits each, three of four within one bit) keys are of 36 bits, for
corpora so large that 24-bit keys hold too many fingerprints each; both forms
find every pair.

Defined cases: a null text has no words and the fingerprint zero, like any text
without words; rows of one doc_id are one document; a null doc_id is never the
name of a group that has another and its component_id is the group's; exactly
half of the shingles' bits is no majority; texts of any length are hashed
whole; an empty table gives no rows; further columns stay where rows are
filtered, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, scratch, slices, unique_name
from .components import connected_components

#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
SEED = 42
#: Fingerprints up to which keys of 24 bits hold few each; beyond it keys have 36 bits.
SHORT_KEYS = 50_000_000
#: Stored fingerprints of a key that one task compares; those of a larger key are dealt to parts, and lookups go to each.
PART = 4096
#: Rows of a part that are held at once.
HELD = 200_000


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: the index of its codeword; for each syndrome: 6 error patterns, those of the
    nearest codeword first and then (only where it is three bits away) of the five at distance four, else zero."""
    words = np.arange(1 << 12, dtype=np.int64)
    code = np.zeros_like(words)
    for bit in range(12):
        code ^= np.where(words >> bit & 1, GOLAY << bit, 0)
    syndrome_of = _syndrome
    patterns = np.zeros((1 << 11, 6), np.int64)
    bits = [1 << i for i in range(23)]
    for weight in range(4):
        for chosen in combinations(bits, weight):
            patterns[syndrome_of(np.array([sum(chosen)]))[0], 0] = sum(chosen)
    four = np.array([sum(c) for c in combinations(bits, 4)], np.int64)
    of = syndrome_of(four)
    order = np.argsort(of, kind="stable")
    of, four = of[order], four[order]
    far = np.bitwise_count(patterns[:, 0].astype(np.uint64)) == 3
    for s in np.flatnonzero(far):
        low, high = np.searchsorted(of, [s, s + 1])
        patterns[s, 1 : 1 + high - low] = four[low:high]
    return code, patterns


def _syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder of each 23-bit word by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GOLAY << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def _index_of_code() -> np.ndarray:
    """The data bits of a codeword by its upper 12 bits, which tell codewords apart."""
    code, _ = golay_tables()
    table = np.zeros(1 << 12, np.int64)
    table[code >> 11] = np.arange(1 << 12)
    return table


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per 23-bit word: the indices of its 1 or 6 codewords (n x 6) and which of these count."""
    _, patterns = golay_tables()
    errors = patterns[_syndrome(words)]
    keys = _index_of_code()[(words[:, None] ^ errors) >> 11]
    real = np.zeros(errors.shape, bool)
    real[:, 0] = True
    real[:, 1:] = errors[:, 1:] != 0
    return keys, real


def _segments(fingerprints: np.ndarray, segments: int) -> list[np.ndarray]:
    size = 23 if segments == 3 else 16
    return [(fingerprints >> np.uint64(size * k) & np.uint64((1 << size) - 1)).astype(np.int64) for k in range(segments)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The 64-bit hashes of the text's shingles in order, repeated ones too; a shorter text is one shingle."""
    return np.frombuffer(_digests(text, words), np.uint64)


def _digests(text: str | None, words: int) -> bytes:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return b""
    joined = b" ".join(found)
    digest = xxhash.xxh64_digest
    if len(found) <= words:
        return digest(joined, SEED)
    ends = np.cumsum(np.array(list(map(len, found)), np.int64) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return b"".join([digest(joined[a:b], SEED) for a, b in pairs])


def _fingerprint(text: str | None, words: int) -> int:
    """A bit is one where over half of the shingles' hashes have it."""
    return _majority(np.frombuffer(_digests(text, words), np.uint8).reshape(-1, 8))


def _majority(hashes: np.ndarray) -> int:
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)], axis=1).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text"):
    """The column of fingerprints (long, the 64 bits as they are)."""

    @F.arrow_udf("long")
    def of(column: pa.Array) -> pa.Array:
        made = [_fingerprint(t, words) for t in flatten_slices(column)]
        return pa.array(np.array(made, np.uint64).view(np.int64))

    return of(F.col(text).cast("string"))


def flatten_slices(column):
    for part in slices(column):
        yield from part


def _key_rows(segments: int):
    """Rows (key, fingerprint, stored): where a fingerprint is stored and where it is looked up."""

    def run(batches):
        for batch in batches:
            all_fp = batch.column("fp").to_numpy()
            for at in range(0, len(all_fp), 2000):
                fp = all_fp[at : at + 2000]
                per = [segment_keys(s) for s in _segments(fp.view(np.uint64), segments)]
                for c, chosen in enumerate(combinations(range(segments), segments - 1)):
                    key = np.full((len(fp), 1), c, np.int64)
                    real = np.ones((len(fp), 1), bool)
                    own = np.full(len(fp), c, np.int64)
                    for k in chosen:
                        keys, ok = per[k]
                        key = ((key[:, :, None] << 12) | keys[:, None, :]).reshape(len(fp), -1)
                        real = (real[:, :, None] & ok[:, None, :]).reshape(len(fp), -1)
                        own = (own << 12) | keys[:, 0]
                    which = np.nonzero(real)
                    out_key = np.concatenate([own, key[which]])
                    out_fp = np.concatenate([fp, fp[which[0]]])
                    stored = np.arange(len(out_key)) < len(own)
                    yield pa.RecordBatch.from_arrays([pa.array(out_key), pa.array(out_fp), pa.array(stored)], ["key", "fp", "stored"])

    return run


def _forest(stored: np.ndarray, asked: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of those within ``max_bits`` between the two sides of a key."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links = []
    for s in stored.tolist():
        near = asked[np.bitwise_count((asked ^ np.int64(s)).view(np.uint64)) <= max_bits]
        a = root(s)
        for q in near.tolist():
            b = root(q)
            if a != b:
                parent[b] = a
                links.append((s, q))
    return links


def _own_keys(segments: int):
    """The keys that fingerprints are stored under."""

    def run(batches):
        for batch in _key_rows(segments)(batches):
            stored = batch.column("stored")
            yield pa.RecordBatch.from_arrays([batch.column("key").filter(stored)], ["key"])

    return run


def _links(max_bits: int):
    """Streams over rows sorted by key and part, those stored first; a part's stored rows are all that is held for long."""

    def run(batches):
        rest = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp", "stored")]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            cut = len(last) - int(last.sum())
            rest = [x[cut:] for x in rows]
            yield from _runs([x[:cut] for x in rows], max_bits)
            if len(rest[0]) > HELD:  # lookups of a long run go in pieces
                yield from _runs(rest, max_bits)
                rest = [x[: int(rest[3].sum())] for x in rest]
        if rest is not None:
            yield from _runs(rest, max_bits)

    return run


def _runs(rows: list[np.ndarray], max_bits: int):
    key, part, fp, stored = rows
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
    ends = np.concatenate([starts[1:], [len(key)]])
    kept = np.add.reduceat(stored.astype(np.int64), starts)
    asked = ends - starts - kept
    # a fingerprint is always looked up where it is stored: others must ask too
    busy = np.flatnonzero((kept > 0) & (asked > 1))
    links: set[tuple[int, int]] = set()
    simple = busy[(kept[busy] * asked[busy]) <= 64]
    if len(simple):
        a, b = _small_pairs(starts[simple], kept[simple], asked[simple], fp, stored)
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= max_bits) & (a != b)
        links.update(zip(a[near].tolist(), b[near].tolist(), strict=True))
    for r in busy[(kept[busy] * asked[busy]) > 64]:
        f, s = fp[starts[r] : ends[r]], stored[starts[r] : ends[r]]
        links.update(_forest(np.unique(f[s]), np.unique(f[~s]), max_bits))
    if links:
        a, b = np.array(list(links), np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])


def _small_pairs(starts, kept, asked, fp, stored):
    """All (stored, asked) pairs of short runs, whose stored rows come first."""
    n = kept * asked
    run = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return fp[starts[run] + k // asked[run]], fp[starts[run] + kept[run] + k % asked[run]]


def groups(nodes: DataFrame, max_bits: int = 3, segments: int | None = None) -> DataFrame:
    """``nodes`` (fp): (fp, component) of the fingerprints that have a link; component names its group.

    ``segments`` (3 or 4; both find all pairs) goes by the number of fingerprints where it isn't given.
    """
    if segments is None:
        segments = 3 if nodes.count() <= SHORT_KEYS else 4
    if segments not in (3, 4) or max_bits > 3:
        raise ValueError("3 or 4 segments, up to 3 bits")
    n = partitions(nodes.sparkSession)
    counts = nodes.mapInArrow(_own_keys(segments), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = counts.where(F.col("n") > PART).select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = nodes.mapInArrow(_key_rows(segments), "key long, fp long, stored boolean")
    split = rows.join(materialise(hot, "hot-keys"), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    of = F.when(F.col("stored"), F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    split = split.select("key", F.explode(of).alias("part"), "fp", "stored")
    dealt = split.repartition(n, "key", "part").sortWithinPartitions("key", "part", F.col("stored").desc())
    links = dealt.mapInArrow(_links(max_bits), "a long, b long")
    return connected_components(links).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, segments: int | None = None) -> DataFrame:
    """doc_id, fp (long) and component_id (the smallest doc_id that links reach) for every row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        marked = keep(materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(docs, words).alias("fp")), "fingerprints"))
        nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
        found = groups(nodes.select("fp"), max_bits, segments)
        named = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        labels = keep(materialise(named.select("fp", "component").join(least, "component").select("fp", "component_id"), "fingerprint-labels"))
    return marked.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, max_bits: int = 3) -> DataFrame:
    """``docs`` without the documents that are near copies of one with a smaller doc_id.

    Documents are told apart by doc_id: rows without one stay, and so do rows that repeat the smallest one of their
    group.  ``near_copies.keep_one``, which the pipeline runs, leaves one row of a group whatever its ids.
    """
    found = near_duplicates(docs, words, max_bits)
    name = unique_name(docs, "_gone")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


__all__ = ["fingerprints", "groups", "keep_one", "near_duplicates"]
