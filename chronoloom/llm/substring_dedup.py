"""Removal of repeated word sequences by prefix-partitioned suffix trees.

A suffix starts at every window of ``window`` words.  Suffixes are split by
prefixes of growing length into groups that fit into memory; each group gets
the tree of its suffixes (as the intervals of their longest common prefixes),
whose internal nodes at ``window`` words or deeper are the repeats.

1. A window's prefix is the smallest hash of its sequences of ``PREFIXES[0]``
   words, wherever it stands in the window: equal windows share it, and so do
   most neighbours, whose suffixes travel as one narrow row (a run) instead of
   one each.  Prefixes with a single occurrence hold no repeat; one aggregation
   (minimum and maximum of the occurrence) drops them.
2. The words of the other runs go to the group of their prefix, if that has at
   most ``GROUP`` windows and ``GROUP_BYTES`` bytes.
3. A larger group is split by the next longer prefix: of its runs with the same
   words (by a 128-bit hash) the earliest stays and the others repeat as they
   are, which is an aggregation that no hot passage can overfill; the earliest
   ones are cut into runs of longer prefixes.  The last prefix is the window
   itself: its group is one node, and an aggregation finds the earliest.
4. In a group the suffixes of all runs are sorted and compared with their
   neighbours by prefix doubling over exact words.  Neighbours with
   ``window`` or more words in common form a deep node; of its suffixes all but
   the earliest start a repeated window.

Exact copies of a text are settled beforehand: only the first takes part, the
others lose all words that a window covers.

Defined cases: a null text has no words; texts with fewer words than a window
lose nothing; rows with one doc_id and text are one document and keep the same
words; of equal windows the one of the smallest doc_id, then start, stays; a
null doc_id comes after all others; an empty table gives no rows; a text of any
length is hashed a megabyte at a time, a word of any length is one word;
further columns stay whatever their names, one of an output's name is replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, scratch, slices, unique_names

#: Words of a prefix; groups that are too large go on to the next, and after the last to whole windows.
PREFIXES = (6, 12)
#: Windows and bytes that a group may have to be sorted in memory, and windows that are sorted at once.
GROUP, GROUP_BYTES, SORTED = 20_000, 16_000_000, 60_000
#: Bytes that are hashed at once; a longer word is hashed whole.
CHUNK = 1 << 20
LAST = (1 << 63) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = re.compile(rb"[ \t-\r]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(CHUNK)


def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64, and of its inverse."""
    factor = 0x100000001B3
    inverse = pow(factor, -1, 1 << 64)
    made = []
    for f in (factor, inverse):
        steps = np.full(size, f, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    return tuple(made)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _chunks(data: bytes):
    """Parts of a text of about ``CHUNK`` bytes that end with a word; (first byte, part)."""
    at = 0
    while len(data) - at > CHUNK:
        end, low = at + CHUNK, at + max(CHUNK // 2, CHUNK - 4096)
        while end > low and not _SPACE[data[end - 1]]:
            end -= 1
        if end == low:  # a word of thousands of bytes: on to its end
            found = _BLANK.search(data, at + CHUNK)
            end = found.start() if found else len(data)
        yield at, data[at:end]
        at = end
    yield at, data[at:]


def _chunk_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers() if len(buf) <= CHUNK else _powers_of(len(buf))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD), starts, ends


def words_at(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text's bytes, without making the words, and where it starts and ends."""
    if len(data) <= CHUNK:
        return _chunk_hashes(data) if data else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    parts = [(*_chunk_hashes(part), at) for at, part in _chunks(data)]
    return np.concatenate([h for h, *_ in parts]), np.concatenate([s + at for _, s, _, at in parts]), np.concatenate([e + at for _, _, e, at in parts])


def word_hashes(data: bytes) -> np.ndarray:
    return words_at(data)[0]


def sequence_hashes(words: np.ndarray, prefix: int) -> np.ndarray:
    n = len(words) - prefix + 1
    grams = words[:n].copy()
    for k in range(1, prefix):
        grams = grams * _ODD + words[k : n + k]
    return _mix(grams)


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


def prefix_runs(data: bytes, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one prefix, the smallest hash of their sequences of ``prefix`` words:
    (prefix, first window, windows, whether the prefix is in the text more than once, first byte, last byte)."""
    words, starts_at, ends_at = words_at(data)
    if len(words) < window:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.empty(0, bool), none, none
    grams = sequence_hashes(words, prefix)
    least = _sliding_minimum(grams, window - prefix + 1)
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    key, ordered = least[starts], np.sort(grams)
    again = np.searchsorted(ordered, key, "right") - np.searchsorted(ordered, key) > 1
    many = np.diff(np.concatenate([starts, [len(least)]]))
    return key, starts, many, again, starts_at[starts], ends_at[starts + many + window - 2]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_SEEN = "prefix long, a long, start int, again boolean, n int, size int"


def _occurrences(window: int, prefix: int):
    def run(batches):
        for batch in batches:
            keys, at = batch.column("a").to_numpy(), 0
            for part in slices(batch.column("text")):
                found = [prefix_runs(_bytes(t), window, prefix) for t in part]
                of = np.repeat(keys[at : at + len(part)], [len(f[0]) for f in found])
                at += len(part)
                column = lambda k: np.concatenate([f[k] for f in found])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column(0).view(np.int64)),
                        pa.array(of),
                        pa.array(column(1).astype(np.int32)),
                        pa.array(column(3)),
                        pa.array(column(2).astype(np.int32)),
                        pa.array((column(5) - column(4)).astype(np.int32)),
                    ],
                    [x.split()[0] for x in _SEEN.split(", ")],
                )

    return run


_SEGMENTS = "prefix long, hot boolean, h long, g long, doc long, a long, start int, n int, words binary"
_RUNS = "prefix long, doc long, a long, start int, n int, words binary"
_PLACES = "doc long, a long, start int, n int"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
#: Bytes or rows after which a batch is handed on.
_BATCH_BYTES, _BATCH_ROWS = 8_000_000, 50_000


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def _batches(rows, schema: str):
    """Batches of a bounded size from rows that end with their words."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size > _BATCH_BYTES or len(held) >= _BATCH_ROWS:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _hash128(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data)
    return (d >> 64) - (1 << 63), (d & 2 * LAST + 1) - (1 << 63)


def _plain(data: bytes) -> bytes:
    """Words joined by one space."""
    return b" ".join(data.split())


def _segments(window: int, prefix: int):
    """The words of the runs that may repeat; those of a hot prefix with a hash of their words."""

    def rows_of(batch):
        columns = (batch.column(c) for c in ("text", "doc", "a", "starts", "hot"))
        for text, doc, a, starts, hot in zip(*columns, strict=True):
            data, doc, a = _bytes(text.as_py()), doc.as_py(), a.as_py()
            key, first, many, _, since, until = prefix_runs(data, window, prefix)
            wanted = dict(zip(starts.as_py(), hot.as_py(), strict=True))
            for p, s, n, b, e in zip(key.view(np.int64).tolist(), first.tolist(), many.tolist(), since.tolist(), until.tolist(), strict=True):
                is_hot = wanted.get(s)
                if is_hot is not None:
                    own = _plain(data[b:e])
                    yield p, is_hot, *(_hash128(own) if is_hot else (0, 0)), doc, a, s, n, own

    def run(batches):
        for batch in batches:
            yield from _batches(rows_of(batch), _SEGMENTS)

    return run


def _longer(window: int, prefix: int):
    """Segments cut into the runs of a longer prefix."""

    def rows_of(batch):
        for doc, a, start, data in zip(*(batch.column(c) for c in ("doc", "a", "start", "words")), strict=True):
            data, doc, a, start = data.as_py(), doc.as_py(), a.as_py(), start.as_py()
            key, first, many, _, since, until = prefix_runs(data, window, prefix)
            for p, s, n, b, e in zip(key.view(np.int64).tolist(), first.tolist(), many.tolist(), since.tolist(), until.tolist(), strict=True):
                yield p, doc, a, start + s, n, data[b:e]

    def run(batches):
        for batch in batches:
            yield from _batches(rows_of(batch), _RUNS)

    return run


_WINDOWS = "h long, g long, doc long, a long, start int"


def _windows(window: int):
    """Each window of a segment by a hash of all its words."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, a, start, n, data in zip(*(batch.column(c) for c in ("doc", "a", "start", "n", "words")), strict=True):
                data, doc, a, start = data.as_py(), doc.as_py(), a.as_py(), start.as_py()
                _, since, until = words_at(data)
                for i, (b, e) in enumerate(zip(since[: n.as_py()].tolist(), until[window - 1 :].tolist(), strict=True)):
                    rows.append((*_hash128(data[b:e]), doc, a, start + i))
                    if len(rows) >= _BATCH_ROWS:
                        yield _batch(rows, _WINDOWS)
                        rows = []
            if rows:
                yield _batch(rows, _WINDOWS)

    return run


class SuffixTrees:
    """The suffix trees of several groups of segments, as intervals of longest common prefixes.

    ``of`` names the group of each segment, ``segments`` are its words joined by
    spaces.  Suffixes start at every word; words of different groups are
    different, so that each group has a tree of its own under the root.
    """

    def __init__(self, of: np.ndarray, segments: list[bytes]):
        split = pc.split_pattern(pa.array(segments, pa.large_binary()), b" ")
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        codes = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        self.sizes = np.diff(ends, prepend=0)
        self.segment = np.repeat(np.arange(len(segments)), self.sizes)
        self.place = np.arange(len(codes)) - np.repeat(ends - self.sizes, self.sizes)
        left = self.sizes[self.segment] - self.place  # words from here to the segment's end
        rank = self._dense(np.unique(of, return_inverse=True)[1][self.segment], codes)
        self.levels, span = [(1, rank)], 1
        while 2 * span <= int(self.sizes.max(initial=0)):  # prefix doubling: ranks of twice as many words
            after = np.full(len(rank), -1)
            after[:-span] = rank[span:]
            after[left <= span] = -1  # a suffix that ends comes before those that go on
            rank, span = self._dense(rank, after + 1), 2 * span
            self.levels.append((span, rank))
        self.order = np.argsort(rank, kind="stable")
        self.left = left
        self.common = self._common(self.order[:-1], self.order[1:])

    @staticmethod
    def _dense(high: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.unique(high * (int(low.max(initial=0)) + 1) + low, return_inverse=True)[1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that pairs of suffixes share from their start on."""
        a, b, out, live = a.copy(), b.copy(), np.zeros(len(a), np.int64), np.ones(len(a), bool)
        left_a, left_b = self.left[a].copy(), self.left[b].copy()
        for span, rank in reversed(self.levels):
            fits = live & (left_a >= span) & (left_b >= span)
            at = np.flatnonzero(fits)
            at = at[rank[a[at]] == rank[b[at]]]
            out[at] += span
            for left in (left_a, left_b):
                left[at] -= span
            live[at] = (left_a[at] > 0) & (left_b[at] > 0)
            at = at[live[at]]
            a[at] += span
            b[at] += span
        return out

    def deep_nodes(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The topmost internal nodes of at least ``least`` words: (node, suffix) rows, and each node's depth."""
        deep = self.common >= least
        inside = np.concatenate([deep, [False]]) | np.concatenate([[False], deep]) if len(self.order) else deep
        opens = inside & ~np.concatenate([[False], deep]) if len(self.order) else deep
        node = (np.cumsum(opens) - 1)[inside]
        depth = np.full(int(opens.sum()), LAST)
        np.minimum.at(depth, (np.cumsum(opens) - 1)[:-1][deep], self.common[deep])
        return node, self.order[inside], depth

    def maximal_repeats(self, least: int) -> list[tuple[int, list[int]]]:
        """(words, suffixes) of every topmost deep node that no common word on the left makes longer."""
        node, suffix, depth = self.deep_nodes(least)
        out = []
        for k, words in enumerate(depth.tolist()):
            members = suffix[node == k]
            before = {-1 - int(x) if self.place[x] == 0 else int(self.levels[0][1][x - 1]) for x in members}
            if len(before) > 1:
                out.append((words, sorted(members.tolist())))
        return out


def repeats_of(rows: list[tuple], window: int) -> list[tuple[int, int, int]]:
    """Of groups' segments (group, doc, a, start, n, words): all windows but the earliest of each deep node,
    as (doc, a, first window)."""
    tree = SuffixTrees(np.array([r[0] for r in rows]), [r[5] for r in rows])
    node, suffix, _ = tree.deep_nodes(window)
    if not len(node):
        return []
    doc, a, start = (np.array([r[k] for r in rows], np.int64)[tree.segment[suffix]] for k in (1, 2, 3))
    start = start + tree.place[suffix]
    rank = np.lexsort((a, start, doc, node))
    node, doc, a, start = node[rank], doc[rank], a[rank], start[rank]
    opens = np.concatenate([[True], node[1:] != node[:-1]])
    first = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    later = (doc != doc[first]) | (a != a[first]) | (start != start[first])  # one place may be in two segments
    return list(zip(doc[later].tolist(), a[later].tolist(), start[later].tolist(), strict=True))


def _repeats(window: int):
    """Streams over rows sorted by group; whole groups are sorted together up to a number of windows."""

    def run(batches):
        held: list[tuple] = []
        group: list[tuple] = []
        windows = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("prefix", "doc", "a", "start", "n", "words")), strict=True):
                if group and group[0][0] != row[0]:
                    held, group = held + group, []
                    if windows >= SORTED:
                        found = _stretches(repeats_of(held, window))
                        if found:
                            yield _batch(found, _PLACES)
                        held, windows = [], 0
                group.append(row)
                windows += row[4]
        found = _stretches(repeats_of(held + group, window)) if held or group else []
        if found:
            yield _batch(found, _PLACES)

    return run


def _stretches(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Neighbouring windows of one document as (doc, a, first window, windows)."""
    out: list[tuple[int, int, int, int]] = []
    for doc, a, start in sorted(found):
        if out and out[-1][:2] == (doc, a) and out[-1][2] + out[-1][3] == start:
            out[-1] = (doc, a, out[-1][2], out[-1][3] + 1)
        else:
            out.append((doc, a, start, 1))
    return out


def _earliest(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (h, g, doc, a, start, ...) with ``e``, the earliest of those with the same hash."""
    least = materialise(rows.groupBy("h", "g").agg(F.min(F.struct("doc", "start", "a")).alias("e"), F.count(F.lit(1)).alias("same")), name)
    return rows.join(least, ["h", "g"])


def repeated_windows(docs: DataFrame, window: int = 20, prefixes: tuple[int, ...] = PREFIXES, group: int = GROUP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` (doc, a, b, text): (a, b, first, runs) for every distinct text: its first document, and
    [start, length, ...] of the words of that document that repeated windows cover (null: none)."""
    prefix, *longer = [min(p, window) for p in prefixes]
    place, who = F.xxhash64("a", "start"), F.struct("doc", "start", "a")
    too_large = (F.sum("n") > group) | (F.sum("size") > group_bytes)
    firsts = materialise(docs.groupBy("a", "b").agg(F.min("doc").alias("first")), "first-copies")
    seen = materialise(docs.select("a", "text").mapInArrow(_occurrences(window, prefix), _SEEN), "prefixes")
    several = seen.groupBy("prefix").agg(F.min(place).alias("low"), F.max(place).alias("high"), too_large.alias("hot"), F.max("again").alias("again"))
    several = materialise(several.where((F.col("low") != F.col("high")) | F.col("again")).select("prefix", "hot"), "repeated-prefixes")
    found = seen.select("prefix", "a", "start").join(several, "prefix").groupBy("a").agg(F.collect_set(F.struct("start", "hot")).alias("at"))
    wanted = materialise(firsts.join(found, "a").select("a", "b", "first", F.col("at.start").alias("starts"), F.col("at.hot").alias("hot")), "repeated-places")
    of = wanted.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first", "starts", "hot")
    met = docs.join(of, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("doc") == F.col("first")))
    segments = materialise(met.select("text", "doc", "a", "starts", "hot").mapInArrow(_segments(window, prefix), _SEGMENTS), "segments")
    run = ["prefix", "doc", "a", "start", "n", "words"]
    cold, hot = segments.where("NOT hot").select(*run), segments.where("hot").select("h", "g", "doc", "a", "start", "n", "words")
    gone = []  # windows known to repeat, as stretches
    for step, length in enumerate(longer):
        told = materialise(_earliest(hot, f"equal-segments-{step}").select("doc", "a", "start", "n", (who != F.col("e")).alias("later"), F.when(who == F.col("e"), F.col("words")).alias("words")), f"split-segments-{step}")
        gone.append(told.where("later").select("doc", "a", "start", "n"))
        cut = materialise(told.where("NOT later").select("doc", "a", "start", "words").mapInArrow(_longer(window, length), _RUNS), f"longer-prefixes-{step}")
        sizes = cut.withColumn("size", F.octet_length("words")).groupBy("prefix").agg(too_large.alias("hot"), F.sum("n").alias("windows"))
        met = materialise(cut.join(sizes.where("windows > 1"), "prefix"), f"longer-groups-{step}")
        cold = cold.unionByName(met.where("NOT hot").select(*run))
        hot = met.where("hot").select(F.xxhash64("words").alias("h"), F.xxhash64(F.lit(7), "words").alias("g"), "doc", "a", "start", "n", "words")
    whole = materialise(hot.mapInArrow(_windows(window), _WINDOWS), "whole-windows")
    gone.append(_earliest(whole, "equal-windows").where((F.col("same") > 1) & (who != F.col("e"))).select("doc", "a", "start", F.lit(1).alias("n")))
    dealt = cold.repartition(partitions(docs.sparkSession), "prefix").sortWithinPartitions("prefix")
    places = reduce(DataFrame.unionByName, gone, dealt.mapInArrow(_repeats(window), _PLACES))
    places = places.groupBy("doc", "a").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("at"))
    lost = places.select(F.col("doc").alias("_doc"), F.col("a").alias("_a"), _covered("at", window).alias("runs"))
    return firsts.join(lost, (F.col("a") == F.col("_a")) & (F.col("first") == F.col("_doc")), "left").select("a", "b", "first", "runs")


def _covered(places: str, window: int):
    """Sorted stretches of windows (start, n) as runs of the words they cover."""
    end = lambda s: s["start"] + s["n"] - 1 + window
    first = F.filter(places, lambda s, i: (i == 0) | (s["start"] > end(F.get(places, i - 1))))
    last = F.filter(places, lambda s, i: (i == F.size(places) - 1) | (F.get(places, i + 1)["start"] > end(s)))
    return F.flatten(F.zip_with(first, last, lambda a, b: F.array(a["start"], end(b) - a["start"])))


def _without(text: pa.Array, runs: pa.Array, everything: pa.Array) -> pa.Array:
    out, at = [], 0
    runs, everything = runs.to_pylist(), everything.to_pylist()
    for part in slices(text):
        for t in part:
            words, gone, whole = _bytes(t).split(), runs[at], everything[at]
            at += 1
            if whole:
                kept: list[bytes] = []
            elif gone:
                kept, before = [], 0
                for start, size in zip(gone[::2], gone[1::2], strict=True):
                    kept += words[before:start]
                    before = start + size
                kept += words[before:]
            else:
                kept = words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    fields = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
    return pa.StructArray.from_arrays(fields, ["n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 20, out: str = "kept_words", **how) -> DataFrame:
    """Adds n_words, n_removed and ``out`` (the words that stay, joined by one space) to every row of ``docs``."""
    docs = docs.drop("n_words", "n_removed", *([out] if out not in ("doc_id", "text") else []))
    k, ka, kb, a, b, first, runs, made = unique_names(docs, "k", "ka", "kb", "a", "b", "first", "runs", "made")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({k: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), ka: F.xxhash64(text), kb: F.xxhash64(F.lit(7), text)})
    with scratch(docs.sparkSession) as keep:
        found = repeated_windows(keyed.select(F.col(k).alias("doc"), F.col(ka).alias("a"), F.col(kb).alias("b"), text.alias("text")), window, **how)
        found = keep(materialise(found.select(F.col("a").alias(a), F.col("b").alias(b), F.col("first").alias(first), F.col("runs").alias(runs)), "removed-runs"))
    met = keyed.join(found, (F.col(ka) == F.col(a)) & (F.col(kb) == F.col(b)))
    words = F.expr(f"size(filter(split(coalesce(cast(text AS string), ''), '[ \\\\x09-\\\\x0D]+', {window + 2}), w -> w != ''))")
    without = F.arrow_udf(_without, "struct<n_words:bigint,n_removed:bigint,kept:string>")
    told = met.withColumn(made, without(text, F.col(runs), (F.col(k) > F.col(first)) & (words >= window)))
    told = told.withColumns({"n_words": F.col(made).n_words, "n_removed": F.col(made).n_removed, out: F.col(made).kept})
    return told.drop(k, ka, kb, a, b, first, runs, made)


__all__ = ["SuffixTrees", "prefix_runs", "remove_repeats", "repeated_windows", "repeats_of", "sequence_hashes", "word_hashes", "words_at"]
