"""Benchmark decontamination by a prefix-filtered join of shingles and exact containment.

A window is a run of ``window`` words of a benchmark item (the whole item where
it is shorter), and its tokens are its shingles of ``SHINGLE`` words (of all its
words where it has fewer).  A document contains a window only if it holds all
of its shingles, one after another, so that in an order by rarity (the number
of documents that hold a shingle, counted over all documents) a prefix of one
token is enough:

1. Benchmark and documents are scanned for shingle hashes.  A document's
   shingles pass a bitmap of those of the benchmark, whose size is fixed
   (``BITS``), and are counted.
2. Each window joins by its rarest shingle; one with a shingle that no document
   holds can't occur and is left out.
3. In a second scan the documents' shingles pass a bitmap of these prefix
   tokens, and are joined with them by an equi-join in Spark.  The shingle's
   place in the window fixes the only possible start (positional bound), the
   window must fit into the document (length bound), and the words themselves,
   which a candidate carries with it, are compared.

So there are two scans of the documents whatever the benchmark's size, and
nothing but bitmaps reaches the driver or travels to all executors.  Texts are
told apart by 128 bits of hash: equal ones are looked up once.

Defined cases: null and empty texts have no words and no hits; items without
words or without an id are left out; repeated items and windows count once; an
empty benchmark hits nothing; an empty table gives no rows; rows of one doc_id
are judged each by its text; hits of one document by several items or windows
are united, so ties don't matter; texts of any length are looked at whole;
further columns stay whatever their names, one of an output's name is replaced.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import text_slices
from .common import materialise, scratch, slices, unique_name, unique_names
from .substring_dedup import sequence_hashes, words_at

#: Words of a shingle.
SHINGLE = 5
#: Bits of a bitmap, as a power of two: 16 MB whatever the benchmark's size (a fuller one lets more candidates pass).
BITS = 27
#: Lower-cases A-Z and turns every other ASCII character but digits and letters into a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Whether a byte is part of a word.
_INSIDE = np.array([b != 32 for b in _TABLE])
_HITS = "struct<n_words:bigint,runs:array<int>,full_runs:array<int>,items:array<string>>"
_ROWS = 20_000


def _plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def words_of(text: str | None) -> list[bytes]:
    return _plain(text).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    size = min(window, len(words))
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def count_words(column: pa.Array) -> pa.Array:
    """The number of words of each text, from the bytes of a slice at once; null has none."""
    counts = [np.empty(0, np.int64)]
    for part in text_slices(column):
        part = pc.fill_null(part, "")
        wide = np.int64 if pa.types.is_large_string(part.type) else np.int32
        at = np.frombuffer(part.buffers()[1], wide)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        inside = _INSIDE[np.frombuffer(part.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
        at -= at[0]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        opening = at[:-1][at[:-1] < len(inside)]
        first[opening] = inside[opening]  # a text's first word starts whatever the text before it ends with
        counts.append(np.diff(np.searchsorted(np.flatnonzero(first), at)))
    return pa.array(np.concatenate(counts))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes (as long) of runs of ``width`` words, other ones for each width."""
    if len(words) < width:
        return np.empty(0, np.int64)
    return (sequence_hashes(words, width) ^ np.uint64(width)).view(np.int64)


@lru_cache(maxsize=1)
def _bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _member(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _bitmap(hashes: DataFrame, column: str):
    """The low ``BITS`` bits of a column of hashes as a broadcast bitmap: built by Spark, 4,096 buckets of 4,096 bytes at most."""
    spark = hashes.sparkSession
    low = F.col(column).bitwiseAND((1 << BITS) - 1) + 1  # buckets count from 1, for the values 1 to 32,768
    rows = hashes.select(F.bitmap_bucket_number(low).alias("k"), F.bitmap_bit_position(low).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    made = np.zeros((1 << BITS) >> 3, np.uint8)
    for row in rows.collect():
        made[4096 * (row.k - 1) : 4096 * row.k] = np.frombuffer(bytes(row.bits), np.uint8)
    return spark.sparkContext.broadcast(zlib.compress(made.tobytes(), 1))


_MEMBERS = "item string, window binary"


def _members(window: int):
    """The windows of benchmark items, their words joined by spaces."""

    def run(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column("item_id"), batch.column("text"), strict=True):
                words, item = words_of(text.as_py()), item.as_py()
                size = min(window, len(words))
                for i in range(len(words) - size + 1 if words else 0):
                    items.append(item)
                    texts.append(b" ".join(words[i : i + size]))
                    if len(items) >= _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item", "window"])
                        items, texts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item", "window"])

    return run


_TOKENS = "window binary, size int, width int, at int, h long"


def _tokens(shingle: int):
    """The shingles of each window and their places."""

    def run(batches):
        for batch in batches:
            windows = batch.column("window").to_pylist()
            for low in range(0, len(windows), _ROWS // 10):
                part = windows[low : low + _ROWS // 10]
                hashed = [words_at(w)[0] for w in part]
                sizes = [len(h) for h in hashed]
                found = [shingle_hashes(h, min(shingle, n)) for h, n in zip(hashed, sizes, strict=True)]
                each = [len(f) for f in found]
                rows = [np.repeat(np.array(sizes, np.int32), each), np.repeat(np.minimum(sizes, shingle).astype(np.int32), each), np.concatenate([np.arange(n, dtype=np.int32) for n in each]), np.concatenate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(part, object), each), pa.binary()), *map(pa.array, rows)], ["window", "size", "width", "at", "h"])

    return run


def _holders(bits, widths: list[int]):
    """In how many documents each shingle of the benchmark is: counts of each batch, summed by Spark."""

    def run(batches):
        for batch in batches:
            held = [np.empty(0, np.int64)]
            for part in slices(batch.column("text")):
                for text in part:
                    words = words_at(_plain(text))[0]
                    for width in widths:
                        h = shingle_hashes(words, width)
                        held.append(np.unique(h[_member(_bits(bits.value), h)]))
            found, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


_OCCURRENCES = "a long, b long, total int, place int, h long, first int, words binary"


def _occurrences(bits, widths: list[int], window: int):
    """Where prefix tokens occur, with the words that a window around them may have from word ``first`` on."""

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OCCURRENCES.split(", ")])

    def run(batches):
        for batch in batches:
            rows, at = [], 0
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for part in slices(batch.column("text")):
                for text in part:
                    data = _plain(text)
                    words, since, until = words_at(data)
                    for width in widths:
                        h = shingle_hashes(words, width)
                        places = np.flatnonzero(_member(_bits(bits.value), h))
                        low, high = np.maximum(places + width - window, 0), np.minimum(places + window, len(words))
                        found = zip(places.tolist(), h[places].tolist(), low.tolist(), since[low].tolist(), until[high - 1].tolist(), strict=True)
                        for place, token, first, s, e in found:
                            rows.append((a[at], b[at], len(words), place, token, first, b" ".join(data[s:e].split())))
                            if len(rows) >= _ROWS:
                                yield batch_of(rows)
                                rows = []
                    at += 1
            if rows:
                yield batch_of(rows)

    return run


def merge_runs(runs: list[tuple[int, int]]) -> list[int]:
    """Disjoint [start, length, ...] that cover the same words."""
    out: list[int] = []
    for start, size in sorted(runs):
        if out and start <= out[-2] + out[-1]:
            out[-1] = max(out[-1], start + size - out[-2])
        else:
            out += [start, size]
    return out


def _merged(spans: pa.Array) -> pa.Array:
    return pa.array([merge_runs([(s["start"], s["size"]) for s in of]) for of in spans.to_pylist()], pa.list_(pa.int32()))


def occurring_windows(docs: DataFrame, members: DataFrame, window: int, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (a, b, text) and ``members`` (item, window): (a, b, start, size, window) wherever a window occurs."""
    tokens = materialise(members.select("window").distinct().mapInArrow(_tokens(shingle), _TOKENS), "benchmark-tokens")
    widths = sorted(r.width for r in tokens.select("width").distinct().collect())  # ``shingle`` values at most
    held = docs.select("text").mapInArrow(_holders(_bitmap(tokens, "h"), widths), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    token = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at", "size", "width")
    rarest = tokens.join(held, "h", "left").groupBy("window").agg(F.min(token).alias("t")).where("t.n > 0")
    prefix = materialise(rarest.select("window", "t.h", "t.at", "t.size"), "prefix-tokens")
    found = docs.select("a", "b", "text").mapInArrow(_occurrences(_bitmap(prefix, "h"), widths, window), _OCCURRENCES)
    start, size = F.col("place") - F.col("at"), F.col("size")
    met = found.join(prefix, "h").where((start >= 0) & (start + size <= F.col("total")))
    words = F.slice(F.split(F.col("words").cast("string"), " "), start - F.col("first") + 1, size)
    exact = met.where(F.array_join(words, " ") == F.col("window").cast("string"))
    return exact.select("a", "b", start.alias("start"), "size", "window").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, out: str = "hits") -> DataFrame:
    """Adds ``out``: n_words, runs and full_runs ([start, length, ...] of hit words; by any window, by windows of full
    size) and the ids of the items found."""
    docs = docs.drop(out) if out not in ("doc_id", "text") else docs
    a, b, ka, kb, n_words, found = unique_names(docs, "a", "b", "ka", "kb", "n_words", "found")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        members = materialise(items.distinct().mapInArrow(_members(window), _MEMBERS).distinct(), "benchmark-windows")
        keyed = docs.withColumns({a: F.xxhash64(text), b: F.xxhash64(F.lit(7), text)})
        hits = materialise(occurring_windows(keyed.select(F.col(a).alias("a"), F.col(b).alias("b"), text.alias("text")), members, window), "occurring-windows")
        names = hits.select("a", "b", "window").distinct().join(members, "window").groupBy("a", "b").agg(F.array_sort(F.collect_set("item")).alias("items"))
        span, merged = F.struct("start", "size"), F.arrow_udf(_merged, "array<int>")
        spans = hits.groupBy("a", "b").agg(F.collect_set(span).alias("runs"), F.collect_set(F.when(F.col("size") >= window, span)).alias("full"))
        told = spans.select("a", "b", merged("runs").alias("runs"), merged("full").alias("full_runs")).join(names, ["a", "b"])
        told = keep(materialise(told.select(F.col("a").alias(ka), F.col("b").alias(kb), F.struct("runs", "full_runs", "items").alias(found)), "hits"))
    # counted before the join, so that texts needn't pass it for that
    counted = keyed.withColumn(n_words, F.arrow_udf(count_words, "long")(text))
    none = F.array().cast("array<int>")
    made = F.struct(
        F.col(n_words).alias("n_words"),
        F.coalesce(F.col(found).runs, none).alias("runs"),
        F.coalesce(F.col(found).full_runs, none).alias("full_runs"),
        F.coalesce(F.col(found).items, F.array().cast("array<string>")).alias("items"),
    )
    met = counted.join(told, (F.col(a) == F.col(ka)) & (F.col(b) == F.col(kb)), "left")
    return met.withColumn(out, made.cast(_HITS)).drop(a, b, ka, kb, n_words, found)


def hit_words(runs: str):
    """The number of words in a column of runs."""
    return F.aggregate(F.transform(runs, lambda x, i: F.when(i % 2 == 1, x).otherwise(0)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_hit, n_words, share: int = 20):
    """Whether one word in ``share`` or more is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """``docs`` without those of which one word in ``share`` is hit, or that hold a window of full size anywhere.

    Items shorter than a window only count by their share: a very short one may well be in a clean text.
    """
    name = unique_name(docs, "_hits")
    found = find_hits(docs, benchmark, window, name)
    n_hit = hit_words(f"{name}.runs")
    clean = ~(contaminated(n_hit, F.col(f"{name}.n_words"), share) | (F.size(f"{name}.full_runs") > 0))
    return found.where(clean).select(*[F.col(f"`{c}`") for c in docs.columns])


__all__ = ["contaminated", "find_hits", "hit_words", "keep_clean", "merge_runs", "occurring_windows", "shingle_hashes", "windows_of", "words_of"]
