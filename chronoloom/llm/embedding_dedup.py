"""Near-duplicate vectors through an inverted multi-index.

Both halves of the unit vectors get a codebook of their own; a vector lies in
the cell of its two nearest codewords, one of the product grid.  A query visits
cells in the order of the summed distances of their codewords (multi-sequence
traversal, a heap over the two sorted lists) and is compared in double
precision with all vectors found there.  How many cells are visited is
calibrated: as many as it takes for ``recall`` of made partners right at the
limit of a bounded sample of queries, and of the links that these have with
other vectors by brute force against all rows.

Equal vectors are one node with a count.  A cell's vectors are dealt to chunks
of ``CHUNK``, and its queries go to every chunk, so a cell may hold any number.
Only counts of links and a spanning forest for each chunk go on, never pairs.
A pair is found if either vector visits the other's cell, and counts for both.

The codebooks are fitted on about ``FIT_ROWS`` vectors (eight for each codeword
of a large table), the cells are calibrated with about ``PROBES`` queries; every
vector is indexed and is a query.  ``recall=1`` finds all links, and
``measured_recall`` tells the share of a result.

Defined cases: a vector that is null, empty, zero, or holds a null or
non-finite component links with nothing; vectors of different lengths don't
link; rows of one vec_id count as vectors each and share a component; a null
vec_id is never the name of a component that has another; a cosine of exactly
the limit links; vectors of any length are compared whole; an empty table gives
no rows; the result has its own columns only, whatever those of the input.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, scratch
from .components import connected_components

FIT_ROWS = 20_000
#: Codewords of a half at most: with about four vectors a cell that is a billion vectors.
WORDS = 1 << 14
PROBES = 512
CHUNK = 4000
#: Made partners of each probe.
PARTNERS = 16
_ROUNDS = 12


def unit(values: list | None) -> np.ndarray | None:
    """The vector at length one; None where it can't link."""
    if not values or None in values:
        return None
    v = np.asarray(values, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(top) or top == 0:
        return None
    v = v / top
    return v / np.linalg.norm(v)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = (x.shape[1] + 1) // 2
    return x[:, :at], x[:, at:]


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (words**2).sum(1)[None, :] - 2 * x @ words.T, 0)


def fit_codebook(x: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds from distinct rows drawn at random."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    words = rows[rng.permutation(len(rows))[:size]]
    for _ in range(_ROUNDS):
        of = np.concatenate([_distances(x[at : at + 2000], words).argmin(1) for at in range(0, len(x), 2000)])
        n = np.bincount(of, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, of, x)
        words = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], words)
    return words


def nearest(d: np.ndarray, count: int) -> np.ndarray:
    """The codewords in order of distance, as far as ``count`` cells can reach."""
    if count >= len(d):
        return np.argsort(d, kind="stable")
    limit = np.partition(d, count - 1)[count - 1]
    near = np.flatnonzero(d <= limit)
    return near[np.argsort(d[near], kind="stable")]


def traversal(d1: np.ndarray, d2: np.ndarray, count: int) -> list[tuple[int, int]]:
    """The ``count`` cells with the least d1[i] + d2[j], nearest first."""
    o1, o2 = nearest(d1, count), nearest(d2, count)
    a, b = d1[o1].tolist(), d2[o2].tolist()
    heap, out = [(a[0] + b[0], 0, 0)], []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append((int(o1[i]), int(o2[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # each row of the grid is opened once
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


class Grid:
    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.books = (first, second)
        self.width = first.shape[1] + second.shape[1]

    @classmethod
    def fit(cls, sample: np.ndarray, size: int) -> Grid:
        return cls(*(fit_codebook(h, size) for h in _halves(sample)))

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(_distances(h, w) for h, w in zip(_halves(x), self.books, strict=True))

    def cells(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return d1.argmin(1).astype(np.int64) * len(self.books[1]) + d2.argmin(1)

    def visits(self, d1: np.ndarray, d2: np.ndarray, count: int) -> list[list[int]]:
        n = len(self.books[1])
        return [[i * n + j for i, j in traversal(a, b, count)] for a, b in zip(d1, d2, strict=True)]


    def all_visits(self, d1: np.ndarray, d2: np.ndarray, reach: tuple[np.ndarray, np.ndarray], limit: float) -> list[list[int]]:
        """The cells that can hold a vector within the squared distance ``limit``: ``reach`` says how far from each
        codeword its vectors are."""
        near = [np.maximum(np.sqrt(d) - r, 0) ** 2 for d, r in zip((d1, d2), reach, strict=True)]
        n = len(self.books[1])
        out = []
        for a, b in zip(*near, strict=True):
            i, j = np.flatnonzero(a <= limit), np.flatnonzero(b <= limit)
            p, q = np.nonzero(a[i][:, None] + b[j][None, :] <= limit)
            out.append((i[p] * n + j[q]).tolist())
        return out


def padded(vectors: list, width: int) -> np.ndarray:
    """Lists, or the bytes of their doubles, as rows of one width."""
    if vectors and isinstance(vectors[0], bytes):
        if all(len(v) == 8 * width for v in vectors):
            return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), width)
        vectors = [np.frombuffer(v, np.float64) for v in vectors]
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _nodes(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Distinct usable vectors at length one: node (two hashes), count, smallest id."""

    @F.arrow_udf("array<double>")
    def at_unit(column: pa.Array) -> pa.Array:
        return pa.array([unit(v) for v in column.to_pylist()], pa.list_(pa.float64()))

    values = F.col(vector).cast("array<double>")
    return vectors.select(
        F.col(id_col).cast("long").alias("id"),
        at_unit(values).alias("unit"),
    ).withColumns({"a": F.xxhash64("unit"), "b": F.xxhash64(F.lit(7), "unit")})


def partners(x: np.ndarray, lengths: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector one at the given cosine to it, in a random direction of its own dimensions."""
    aside = rng.standard_normal(x.shape) * (np.arange(x.shape[1]) < lengths[:, None])
    aside -= (aside * x).sum(1)[:, None] * x
    size = np.linalg.norm(aside, axis=1)[:, None]
    aside = np.where(size > 1e-9, aside / np.maximum(size, 1e-9), 0)  # a vector of one dimension has no other direction
    made = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * aside
    return made / np.linalg.norm(made, axis=1)[:, None]


def _ranks(d1: np.ndarray, d2: np.ndarray, of: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The place of each of ``cells`` in the traversal of the row ``of`` of the distances; the last one among equals."""
    out = np.empty(len(cells), np.int64)
    width = d2.shape[1]
    for at in np.argsort(of, kind="stable").tolist():
        a, b = d1[of[at]], d2[of[at]]
        limit = a[cells[at] // width] + b[cells[at] % width]
        out[at] = np.searchsorted(np.sort(b), limit - a + 1e-12, "right").sum() - 1
    return np.maximum(out, 0)


def _calibrate(nodes: DataFrame, grid: Grid, probes: np.ndarray, least: float, recall: float, lengths: np.ndarray | None = None) -> int:
    """How many cells hold ``recall`` of the links at the limit and of the probes' own.

    Links at the limit are the hardest to find and need not be frequent, so the probes get ``PARTNERS`` made ones each, at
    a cosine of ``least``; either side may visit.  Links that probes really have (not with themselves) can ask for more
    cells, never for fewer: ``recall`` of them, of all and on average over probes.
    """
    d1, d2 = grid.distances(probes)
    rng = np.random.default_rng(5)
    lengths = np.full(len(probes), probes.shape[1]) if lengths is None else lengths
    each = np.arange(len(probes))
    own = grid.cells(d1, d2)
    made = []
    for _ in range(PARTNERS):
        e1, e2 = grid.distances(partners(probes, lengths, least, rng))
        made.append(np.minimum(_ranks(d1, d2, each, grid.cells(e1, e2)), _ranks(e1, e2, each, own)))
    made = np.sort(np.concatenate(made))
    count = int(made[int(np.ceil(recall * len(made))) - 1]) + 1

    def run(batches):
        total: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = padded(batch.column("unit").to_pylist(), grid.width)
            if not len(x):
                continue
            cells = grid.cells(*grid.distances(x))
            p, q = np.nonzero(probes @ x.T >= least)
            other = np.fromiter((not np.array_equal(probes[i], x[j]) for i, j in zip(p.tolist(), q.tolist(), strict=True)), bool, len(p))
            for key in zip(p[other].tolist(), cells[q[other]].tolist(), strict=True):
                total[key] = total.get(key, 0) + 1
        rows = [(p, c, n) for (p, c), n in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["probe", "cell", "n"])

    found = nodes.select("unit").mapInArrow(run, "probe long, cell long, n long").groupBy("probe", "cell").agg(F.sum("n").alias("n")).collect()
    if not found:
        return count
    of, cell, n = (np.array([r[c] for r in found], np.int64) for c in ("probe", "cell", "n"))
    rank = _ranks(d1, d2, of, cell)
    total = np.bincount(of, n, len(probes))
    linked = total > 0
    for limit in np.unique(rank).tolist():
        got = np.bincount(of, n * (rank <= limit), len(probes))
        if got.sum() >= recall * total.sum() and (got[linked] / total[linked]).mean() >= recall:
            return max(count, limit + 1)
    return max(count, int(rank.max()) + 1)


def _reach(nodes: DataFrame, grid: Grid) -> tuple[np.ndarray, np.ndarray]:
    """How far the vectors of each codeword are from it, over all rows: one number for each codeword."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                x = padded(batch.column("unit").slice(at, 2000).to_pylist(), grid.width)
                for k, d in enumerate(grid.distances(x)):
                    word, far = d.argmin(1), np.sqrt(d.min(1))
                    used = np.unique(word)
                    most = np.zeros(d.shape[1])
                    np.maximum.at(most, word, far)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(most[used])], ["book", "word", "far"])

    found = nodes.select("unit").mapInArrow(run, "book int, word int, far double").groupBy("book", "word").agg(F.max("far").alias("far")).collect()
    out = tuple(np.full(len(b), -1e9) for b in grid.books)  # a codeword without vectors is out of reach
    for r in found:
        out[r.book][r.word] = r.far + 1e-9
    return out


_INDEXED = "node long, n long, len int, unit binary, cell int, visits array<int>"


def _index(grid: Grid, count: int, reach=None, limit: float = 0.0):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vectors = part.column("unit").to_pylist()
                x = padded(vectors, grid.width)
                d1, d2 = grid.distances(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("node"),
                        part.column("n"),
                        pa.array([len(v) for v in vectors], pa.int32()),
                        pa.array([np.array(v, np.float64).tobytes() for v in vectors], pa.binary()),
                        pa.array(grid.cells(d1, d2).astype(np.int32)),
                        pa.array(grid.visits(d1, d2, count) if reach is None else grid.all_visits(d1, d2, reach, limit), pa.list_(pa.int32())),
                    ],
                    [c.split()[0] for c in _INDEXED.split(", ")],
                )

    return run


def _search(least: float, width: int):
    """Compares the queries of each (cell, chunk) with its stored vectors; streams over sorted rows."""

    def chunk_links(stored, queries):
        sx, qx = padded([r[5] for r in stored], width), padded([r[5] for r in queries], width)
        sn, slen = np.array([r[3] for r in stored]), np.array([r[4] for r in stored])
        names = np.array([r[2] for r in stored])
        visits = [set(r[7]) for r in stored]
        parent: dict = {}

        def root(k):
            while parent.setdefault(k, k) != k:
                parent[k] = k = parent[parent[k]]
            return k

        back = np.zeros(len(stored), np.int64)
        for lo in range(0, len(queries), 512):
            near = qx[lo : lo + 512] @ sx.T >= least
            for i in np.flatnonzero(near.any(1)).tolist():
                q = queries[lo + i]
                own = np.flatnonzero(near[i] & (slen == q[4]) & (names != q[2]))
                for h, other in zip(own.tolist(), names[own].tolist(), strict=True):
                    a, b = root(q[2]), root(other)
                    if a != b:
                        parent[b] = a
                        yield q[2], 0, other
                    if q[6] not in visits[h]:
                        back[h] += q[3]  # the stored vector doesn't visit this query's cell: it learns of the link here
                if len(own):
                    yield q[2], int(sn[own].sum()), None
        for h in np.flatnonzero(back).tolist():
            yield int(names[h]), int(back[h]), None

    def out(found):
        rows = list(found)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["node", "n", "other"]) if rows else None

    def run(batches):
        here, stored, queries = None, [], []
        columns = ("at", "chunk", "node", "n", "len", "unit", "cell", "visits", "stored")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[:2] != here:
                    if stored and queries and (made := out(chunk_links(stored, queries))):
                        yield made
                    here, stored, queries = row[:2], [], []
                if row[8]:
                    stored.append(row)
                    continue
                queries.append(row)
                if len(queries) >= CHUNK:  # queries of a chunk come after its stored vectors
                    if stored and (made := out(chunk_links(stored, queries))):
                        yield made
                    queries = []
        if stored and queries and (made := out(chunk_links(stored, queries))):
            yield made

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = 0.999, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, n_links (other vectors with a cosine of ``least`` or more that were found) and component_id for every row.

    With a ``recall`` of 1 every cell is visited that can hold a partner, by the distances of its codewords and how far
    their vectors are from these: then all links are found, for more work.
    """
    with scratch(vectors.sparkSession) as keep:
        return _near_vectors(vectors, least, recall, id_col, vector, keep)


def _near_vectors(vectors: DataFrame, least: float, recall: float, id_col: str, vector: str, keep) -> DataFrame:
    spark = vectors.sparkSession
    rows = keep(materialise(_nodes(vectors, id_col, vector), "vectors"))
    usable = rows.where("unit IS NOT NULL")
    nodes = usable.groupBy("a", "b").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")  # numbers that the table holds: no two nodes share one
    total, width = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("w")).first()
    if not total:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    draw = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "a", "b"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, n / total))
    # about four vectors a cell, so that the work of a query stays level as the table grows
    size = int(min(WORDS, max(4, 2 ** round(np.log2(max(1.0, total / 4)) / 2))))
    fit_rows = max(FIT_ROWS, 8 * size)
    sample = padded([r.unit for r in nodes.where(draw(3, fit_rows)).orderBy("a", "b").limit(2 * fit_rows).select("unit").collect()] or [nodes.first().unit], width)
    grid = Grid.fit(sample, size)
    if recall < 1:
        drawn = [r.unit for r in nodes.where(draw(4, PROBES)).orderBy("a", "b").limit(2 * PROBES).select("unit").collect()] or [nodes.first().unit]
        count = _calibrate(nodes, grid, padded(drawn, width), least, recall, np.array(list(map(len, drawn))))
        index = _index(grid, count)
    else:
        index = _index(grid, 0, _reach(nodes, grid), 2 - 2 * least + 1e-9)
    indexed = materialise(nodes.select("node", "n", "unit").mapInArrow(index, _INDEXED), "vector-index")
    cells = materialise(indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "vector-cells")
    stored = indexed.join(cells, "cell").select(
        F.col("cell").alias("at"), F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), "node", "n", "len", "unit", "cell", "visits", F.lit(True).alias("stored")
    )
    asked = indexed.select(F.explode("visits").alias("at"), "node", "n", "len", "unit", "cell")
    asked = asked.join(cells.withColumnRenamed("cell", "at"), "at").select(
        "at", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "node", "n", "len", "unit", "cell", F.lit(None).cast("array<int>").alias("visits"), F.lit(False).alias("stored")
    )
    dealt = stored.unionByName(asked).repartition(partitions(spark), "at", "chunk").sortWithinPartitions("at", "chunk", F.col("stored").desc())
    found = materialise(dealt.mapInArrow(_search(least, width), "node long, n long, other long"), "vector-links")
    labels = connected_components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("others"))
    with_label = nodes.select("a", "b", "node", "least_id", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = with_label.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_node = with_label.join(ids, "component").join(counts, "node", "left")
    per_node = keep(materialise(per_node.select("a", "b", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links")), "vector-labels"))
    met = usable.select("id", "a", "b").join(per_node, ["a", "b"]).select(F.col("id").alias(id_col), "n_links", "component_id")
    alone = rows.where("unit IS NULL").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return met.unionByName(alone)


def measured_recall(vectors: DataFrame, found: DataFrame, least: float = 0.95, probes: int = PROBES, id_col: str = "vec_id", vector: str = "embedding") -> float:
    """The share of links found: those of about ``probes`` vectors with a non-null id, by brute force against all rows."""
    total = vectors.count()
    drawn = vectors.where(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.lit(6), id_col), F.lit(1 << 40)) < int((1 << 40) * min(1.0, probes / max(1, total)))))
    rows = [(r[0], u) for r in drawn.select(id_col, F.col(vector).cast("array<double>")).limit(4 * probes).collect() if (u := unit(r[1])) is not None]
    if not rows:
        return 1.0

    def run(batches):
        count = np.zeros(len(rows), np.int64)
        for batch in batches:
            others = [u for v in batch.column("v").to_pylist() if (u := unit(v)) is not None]
            for size in {len(u) for u in others}:
                x = np.array([u for u in others if len(u) == size])
                for i, (_, u) in enumerate(rows):
                    if len(u) == size:
                        count[i] += int((x @ u >= least).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(count)], ["probe", "n"])

    counted = vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "probe long, n long").groupBy("probe").agg(F.sum("n").alias("n")).collect()
    true = {rows[r.probe][0]: r.n - 1 for r in counted}  # without itself
    ours = {r[0]: r[1] for r in found.where(F.col(id_col).isin(list(true))).groupBy(id_col).agg(F.min("n_links")).collect()}
    every = sum(true.values())
    return sum(min(ours.get(k, 0), n) for k, n in true.items()) / every if every else 1.0


__all__ = ["Grid", "measured_recall", "near_vectors", "traversal", "unit"]
