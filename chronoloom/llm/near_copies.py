"""Near copies by the Jaccard similarity of their shingle sets: candidates by SimHash and Golay-code fuzzy hashing, verified exactly.

A set's fingerprint is a SimHash wider than 64 bits: a bit is one where over half
of the set's shingles have it, in their XXH64 and in mixes of it.  Sets of
similarity 0.8 have a cosine of 8/9 or more, so about 0.15 of their bits differ,
far too many for a radius of three; the fingerprint is therefore cut into
``TABLES`` segments of 23 bits, and each decodes by the Golay code [23,12,7] to its
1 or 6 indices (``simhash.segment_keys``), which are the keys it is stored and
looked up under.  Segments at 0.15 share an index with probability 0.6, so a pair
at 0.8 misses all 14 with probability 2e-6, less above.  Of sets of up to ``SMALL``
shingles (4 in 5 differ in 0.19 of their bits) there are twice as many.  Beyond
``SHORT_KEYS`` rows a key is made of the indices of two segments, so that buckets
stay small, and there are 26 such keys.

Within a bucket members of fitting sizes whose fingerprints (the first ``CHECKED``
words) differ in at most ``MAX_BITS`` bits are neighbours; the groups that
neighbours form go on, one for all buckets that hold the same members.  Only
documents of one group are compared, by their whole sets of shingle hashes (64
bits), never by the fingerprint, so no pair below the limit is linked.  A bucket
with over ``PART`` members is dealt to parts, every pair of parts being a block.

Equal sets are one node (by a 64-bit hash of the set).  Groups come in two
rounds: those whose members the groups of the first ``FIRST`` tables have joined
already are not compared again.  A group's members are dealt to chunks of about
``CHUNK`` shingles and every pair of chunks is a block of its own, so a group may be
of any size; each block yields a spanning forest of its links, never all pairs.

Defined cases: a null text has no words and the empty set, like any text without
words; a text of fewer words than a shingle is one shingle; every row is a
document, whatever its doc_id; further columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, scratch, slices, text_key, unique_names
from .components import connected_components
from .simhash import SEED, segment_keys, shingle_hashes

#: Keys of a fingerprint, by the number of 23-bit segments that each is made of.
TABLES = {1: 14, 2: 26}
FIRST = 2
#: Shingles up to which a set has twice as many tables.
SMALL = 5
#: Rows up to which the index of one segment is a key.
SHORT_KEYS = 50_000_000
#: 64-bit words of a fingerprint that are compared, and how many bits of them, and of the first, may differ.
CHECKED, MAX_BITS, MAX_FIRST = 3, 60, 27
#: Members of a bucket that one block compares with another such part.
PART = 32_768
#: Shingles of a chunk.
CHUNK = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = (1 << np.arange(23)).astype(np.float32)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return np.unique(shingle_hashes(text, words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number's hash (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(shingles: np.ndarray, per: int = 1) -> np.ndarray:
    """The SimHash of a set as bytes: 64 bits by the shingles' hashes, then 64 by each mix of them, cut to whole segments."""
    bits = 23 * per * TABLES[per] * (2 if len(shingles) <= SMALL else 1)
    words = -(-bits // 64)
    total = np.zeros(64 * words, np.int64)
    steps = np.arange(1, words, dtype=np.uint64) * _STEP
    for at in range(0, len(shingles), 255):  # as many as a byte counts
        part = shingles[at : at + 255, None]
        wide = np.concatenate([part, _mixed(part + steps)], axis=1).astype(">u8")
        total += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles))[: -(-bits // 8)]


def golay_keys(prints: np.ndarray, per: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n x bytes): the rows and keys of all buckets that they lie in."""
    n, tables = len(prints), 8 * prints.shape[1] // (23 * per)
    bits = np.unpackbits(prints, axis=1)[:, : 23 * per * tables].reshape(-1, 23)
    indices, real = (x.reshape(n, tables, per, 6) for x in segment_keys((bits @ _POWERS).astype(np.int64)))
    key = np.broadcast_to(np.arange(tables)[None, :, None], (n, tables, 1))
    counts = np.ones_like(key, bool)
    for s in range(per):
        key = ((key[..., None] << 12) | indices[:, :, s, None, :]).reshape(n, tables, -1)
        counts = (counts[..., None] & real[:, :, s, None, :]).reshape(n, tables, -1)
    which = np.nonzero(counts)
    return which[0], key[which]


def _signatures(words: int, per: int):
    """Rows (doc_id, ka, kb, text) to (doc_id, ka, kb, node, n, print)."""

    def run(batches):
        for batch in batches:
            nodes, sizes, prints = [], [], []
            for part in slices(batch.column("text")):
                for text in part:
                    found = shingle_set(text, words)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                    sizes.append(len(found))
                    prints.append(fingerprint(found, per).tobytes())
            columns = [*(batch.column(c) for c in ("doc_id", "ka", "kb")), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ka", "kb", "node", "n", "print"])

    return run


def _some_prints(batches, per: int):
    """Slices of batches, small sets apart, with their fingerprints (n x bytes)."""
    step = 2000 if per == 1 else 200
    for batch in batches:
        small = pc.less_equal(batch.column("n"), SMALL)
        for rows in (batch.filter(small), batch.filter(pc.invert(small))):
            for at in range(0, len(rows), step):
                some = rows.slice(at, step)
                yield some, np.frombuffer(b"".join(some.column("print").to_pylist()), np.uint8).reshape(len(some), -1)


def _key_counts(per: int):
    """Rows (n, print) to (key, members) of a slice."""

    def run(batches):
        for _, prints in _some_prints(batches, per):
            found = np.unique(golay_keys(prints, per)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "members"])

    return run


def _key_rows(per: int):
    """Rows (node, n, print) to (key, node, n, w0, w1, ...): one for each bucket."""

    def run(batches):
        for some, prints in _some_prints(batches, per):
            row, key = golay_keys(prints, per)
            checked = np.ascontiguousarray(prints[:, : 8 * CHECKED]).view(np.int64)
            made = [pa.array(key), pa.array(some.column("node").to_numpy()[row]), pa.array(some.column("n").to_numpy()[row])]
            made += [pa.array(checked[row, w]) for w in range(CHECKED)]
            yield pa.RecordBatch.from_arrays(made, ["key", "node", "n", *_WORDS])

    return run


_WORDS = [f"w{w}" for w in range(CHECKED)]
_BLOCK = ["key", "one", "other", "part", "node", "n", *_WORDS]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of all after the links (a, b)."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up


def neighbours(rows: dict[str, np.ndarray], least: float) -> np.ndarray:
    """Rows of whole blocks, sorted by block and size: the first row of each one's group of neighbours."""
    words = [rows[w] for w in _WORDS]
    m = len(words[0])
    new = np.zeros(m, bool)
    for c in ("key", "one", "other"):
        new[1:] |= rows[c][1:] != rows[c][:-1]
    n = rows["n"].astype(np.int64)
    run = np.cumsum(new, dtype=np.int64) << 32
    ends = np.searchsorted(run + n, run + np.floor(n / least + 1e-9).astype(np.int64), "right")  # sizes that fit
    parent, width = np.arange(m), ends - np.arange(m) - 1

    def join(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        near = sum(np.bitwise_count((w[a] ^ w[b]).view(np.uint64)).astype(np.int64) for w in words) <= MAX_BITS
        near &= (rows["part"][a] != rows["part"][b]) | (rows["one"][a] == rows["other"][a])  # a part's own pairs have a block
        parent = _unite(parent, a[near], b[near])

    few = np.flatnonzero((width > 0) & (width <= 64))
    for at in range(0, len(few), 16_384):
        i = few[at : at + 16_384]
        a = np.repeat(i, width[i])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(width[i]) - width[i], width[i])
        near = np.bitwise_count((words[0][a] ^ words[0][b]).view(np.uint64)) <= MAX_FIRST
        join(a[near], b[near])
    many = np.flatnonzero(width > 64)
    at = 0
    while at < len(many):
        i = many[at : at + max(1, 2_000_000 // int(width[many[at]]))]
        i = i[(i - i[0] == np.arange(len(i))) & (run[i] == run[i[0]])]
        low, high = i[0] + 1, ends[i[-1]]
        near = np.bitwise_count((words[0][i, None] ^ words[0][None, low:high]).view(np.uint64)) <= MAX_FIRST
        a, b = np.nonzero(near)
        a, b = i[a], b + low
        fits = (b > a) & (b < ends[a])
        join(a[fits], b[fits])
        at += len(i)
    return parent


def _close(least: float, per: int):
    """Streams over sorted blocks of bucket members to (key, node, n, first): groups of neighbours, named by what they hold."""

    def out(rows):
        root = neighbours(rows, least)
        grouped = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        if not len(grouped):
            return
        grouped = grouped[np.argsort(root[grouped], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(root[grouped]) != 0]))
        names = np.add.reduceat(_mixed(rows["node"][grouped].view(np.uint64) + _STEP), starts)
        names = np.repeat(names, np.diff(np.append(starts, len(grouped)))).view(np.int64)
        made = [pa.array(names), pa.array(rows["node"][grouped]), pa.array(rows["n"][grouped]), pa.array((rows["key"][grouped] >> (12 * per)) < FIRST)]
        yield pa.RecordBatch.from_arrays(made, ["key", "node", "n", "first"])

    def run(batches):
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch.column(c).to_numpy() for c in _BLOCK}
            same = np.ones(len(batch), bool)
            for c in ("key", "one", "other"):
                same &= rows[c] == rows[c][-1]
            cut = len(same) - int(same.sum())
            if cut or (held and any(held[-1][c][-1] != rows[c][0] for c in ("key", "one", "other"))):
                held.append({c: x[:cut] for c, x in rows.items()})
                yield from out({c: np.concatenate([h[c] for h in held]) for c in _BLOCK})
                held = []
            held.append({c: x[cut:] for c, x in rows.items()})
        if held:
            yield from out({c: np.concatenate([h[c] for h in held]) for c in _BLOCK})

    return run


def _groups(nodes: DataFrame, least: float, per: int) -> DataFrame:
    """``nodes`` (node, n, print): (key, node, n, first) of the groups of neighbours in all buckets."""
    counts = nodes.select("n", "print").mapInArrow(_key_counts(per), "key long, members long").groupBy("key").agg(F.sum("members").alias("members"))
    hot = counts.where(F.col("members") > PART).select("key", F.ceil(F.col("members") / PART).cast("int").alias("parts"))
    rows = nodes.select("node", "n", "print").mapInArrow(_key_rows(per), ", ".join(["key long, node long, n int", *(f"{w} long" for w in _WORDS)]))
    rows = rows.join(materialise(hot, "near-hot"), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumns({"one": F.least("part", "with"), "other": F.greatest("part", "with")}).select(*_BLOCK)
    rows = rows.repartition(partitions(nodes.sparkSession), "key", "one", "other").sortWithinPartitions("key", "one", "other", "n")
    found = rows.mapInArrow(_close(least, per), "key long, node long, n int, first boolean")
    return found.groupBy("key", "node").agg(F.first("n").alias("n"), F.max("first").alias("first"))


def _sets(words: int):
    """Rows (node, text) to (node, set): the shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            made = [shingle_set(t, words).tobytes() for part in slices(batch.column("text")) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.large_binary()).cast(pa.binary())], ["node", "set"])

    return run


def similar(a: int, b: int, common: int | np.ndarray, least: float):
    """Whether sets of ``a`` and ``b`` elements with ``common`` in both reach the limit."""
    return common >= least * (a + b - common) - 1e-9


def forest(names: list[int], labels: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs of ``least`` or more between members whose labels differ."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    links: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    postings = None
    for i in range(len(names) - 1):
        mine = root(labels[i])
        fits = np.minimum(size[i], size[i + 1 :]) >= least * np.maximum(size[i], size[i + 1 :]) - 1e-9
        others = [j for j in (np.flatnonzero(fits) + i + 1).tolist() if root(labels[j]) != mine]
        if not others:
            continue
        if len(others) <= 8:
            common = [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others]
        else:
            if postings is None:
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                postings = flat[order], np.repeat(np.arange(len(sets)), size)[order]
            low, high = (np.searchsorted(postings[0], sets[i], side) for side in ("left", "right"))
            n = high - low
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            common = np.bincount(postings[1][at], minlength=len(sets))[others].tolist()
        for j, c in zip(others, common, strict=True):
            if similar(int(size[i]), int(size[j]), c, least):
                a, b = root(labels[i]), root(labels[j])
                if a != b:
                    parent[b] = a
                    links.append((names[i], names[j]))
    return links


def _verify(least: float):
    """Streams over sorted blocks of (key, one, other, node, label, set)."""

    def out(rows):
        found = forest([r[3] for r in rows], [r[4] for r in rows], [np.frombuffer(r[5], np.uint64) for r in rows], least)
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        here, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "one", "other", "node", "label", "set")), strict=True):
                if row[:3] != here:
                    yield from out(rows)
                    here, rows = row[:3], []
                rows.append(row)
        yield from out(rows)

    return run


def _links(members: DataFrame, labels: DataFrame | None, sets: DataFrame, least: float) -> DataFrame:
    """Verified links of the groups whose members have several labels."""
    label = F.coalesce("component", "node") if labels is not None else F.col("node")
    rows = (members.join(labels, "node", "left") if labels is not None else members).select("key", "node", "n", label.alias("label"))
    open_ = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    open_ = open_.where("l != h").select("key", F.greatest("chunks", F.lit(1)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = rows.join(open_, "key").select("key", "node", "label", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    dealt = dealt.select("key", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("other"), "node", "label").join(sets, "node")
    dealt = dealt.repartition(partitions(members.sparkSession), "key", "one", "other").sortWithinPartitions("key", "one", "other", "node")
    return dealt.select("key", "one", "other", "node", "label", "set").mapInArrow(_verify(least), "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, per: int | None = None) -> DataFrame:
    """doc_id, ka and kb (the text's key) and component (of the rows that links of ``least`` or more reach) for every row.

    ``per`` (1 or 2 segments a key) goes by the number of rows where it isn't given; ``TABLES`` and ``MAX_BITS`` are made for 0.8 and more.
    """
    if per is None:
        per = 1 if docs.count() <= SHORT_KEYS else 2
    key = text_key()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key["a"].alias("ka"), key["b"].alias("kb"), F.col("text").cast("string").alias("text"))
    marked = keyed.mapInArrow(_signatures(words, per), "doc_id long, ka long, kb long, node long, n int, print binary")
    marked = materialise(marked, "near-signatures")
    nodes = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("print").alias("print"), F.min(F.struct("ka", "kb")).alias("text_key"))
    nodes = materialise(nodes, "near-nodes")
    members = materialise(_groups(nodes, least, per), "near-members")
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "text_key.ka", "text_key.kb")
    texts = keyed.select("ka", "kb", "text").join(wanted, ["ka", "kb"]).select("node", "text")
    sets = materialise(texts.mapInArrow(_sets(words), "node long, set binary").dropDuplicates(["node"]), "near-sets")
    links = materialise(_links(members.where("first"), None, sets, least), "near-links")
    labels = materialise(connected_components(links), "near-labels")
    more = materialise(_links(members.where("NOT first"), labels, sets, least), "near-links")
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    return marked.join(labels, "node", "left").select("doc_id", "ka", "kb", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id, a null one only where the group has no other."""
    ids, ka, kb, stays = unique_names(docs, "id", "ka", "kb", "stays")
    with scratch(docs.sparkSession) as keep:
        found = materialise(near_copies(docs.select("doc_id", "text"), words, least), "near-components")
        rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "ka", "kb")
        best = found.groupBy("component").agg(F.min(rank).alias("best"))
        same = F.col("best") == rank
        gone = found.join(best, "component").groupBy("doc_id", "ka", "kb").agg(F.max(same).alias("stays"), F.count(F.lit(1)).alias("rows"))
        gone = gone.where("NOT stays OR rows > 1").select(F.col("doc_id").alias(ids), F.col("ka").alias(ka), F.col("kb").alias(kb), F.col("stays").alias(stays))
        gone = keep(materialise(gone, "near-gone"))
    key = text_key()
    meets = F.col("doc_id").cast("long").eqNullSafe(F.col(ids)) & (key["a"] == F.col(ka)) & (key["b"] == F.col(kb))
    kept = docs.join(gone, meets, "left_anti")
    again = gone.where(F.col(stays))
    if again.isEmpty():
        return kept
    # rows of one doc_id and one text: any of them stands for all
    once = docs.join(again, meets).dropDuplicates([ids, ka, kb]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(once)


__all__ = ["keep_one", "near_copies"]
