"""Token ids as Huffman-coded block files in ascending order of documents.

``write_tokens`` encodes every text once, into an intermediate table sorted by
document; counts the ids of all documents; and writes blocks of whole documents
under one canonical code (see ``huffman``).  The result is a folder:

* ``codebook``: one row, the code length of every id (a byte each), id width;
* ``blocks``: Parquet files of rows (part, seq, start, doc_ids, data), ``data``
  being a block that decodes by itself.  Blocks ordered by (part, seq) hold the
  documents in ascending order; ``start`` counts the ids before a block.

``read_tokens`` decodes blocks independently of one another.

Defined cases: a null text is an empty one and still gets the end id; null
doc_ids come first; rows of one doc_id follow one another in any order; a
document is never split, so a block of one long text is as long as that; an
empty table gives no blocks; further columns, whatever their names, are not
stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from .byte_bpe import tokenizer
from .chunks import text_slices
from .common import fresh_dir, partitions, remove_dir, write_table

#: Tokens after which a block is closed at the next document's end.
BLOCK_TOKENS = 1 << 17
_STAGE = "part int, seq long, before long, doc_id long, n long, ids binary"
_BLOCKS = "part int, seq long, start long, doc_ids array<bigint>, data binary"


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values."""
    at = np.append(0, ends) * values.dtype.itemsize
    wide = at[-1] > np.iinfo(np.int32).max
    made = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(ends), [None, pa.py_buffer(at.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
    return made.cast(pa.binary()) if wide else made


def _stage(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """Ids of each document, in order; ``part``, ``seq`` and ``before`` (ids before it in its part) locate it."""
    spark = docs.sparkSession

    def run(batches):
        tok = tokenizer(path)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(len(tok.token_bytes), np.int64)
        for batch in batches:
            names, at = batch.column("doc_id"), 0
            for texts in text_slices(batch.column("text")):
                ids, ends = tok.encode_flat(texts, end_id)
                n = np.diff(ends, prepend=0)
                counts += np.bincount(ids, minlength=len(counts))
                rows = len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, part, np.int32)),
                        pa.array(np.arange(seq, seq + rows, dtype=np.int64)),
                        pa.array(before + ends - n),
                        names.slice(at, rows),
                        pa.array(n),
                        _binary(ids, ends),
                    ],
                    ["part", "seq", "before", "doc_id", "n", "ids"],
                )
                at, seq, before = at + rows, seq + rows, before + len(ids)
        used = np.flatnonzero(counts)  # a row for each id that the part has, in place of a document
        rows = len(used)
        same = lambda value, kind: pa.array(np.full(rows, value, kind))
        yield pa.RecordBatch.from_arrays(
            [same(part, np.int32), same(-1, np.int64), same(0, np.int64), pa.array(used), pa.array(counts[used]), pa.nulls(rows, pa.binary())],
            ["part", "seq", "before", "doc_id", "n", "ids"],
        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(spark)
    # limits from the ids alone: Spark's own range exchange would read all texts for its sample
    limits = rows.select("doc_id").approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n) if n > 1 else []
    inner = np.array(sorted(set(limits)), np.float64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        values = pc.fill_null(pc.cast(ids, pa.float64(), safe=False), -np.inf).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(inner, values, side="right").astype(np.int32))

    return rows.repartitionById(n, place("doc_id")).sortWithinPartitions("doc_id").mapInArrow(run, _STAGE)


def _counts(stage: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents: the parts' counts, summed."""
    out = np.zeros(size, np.int64)  # at most a row for each id of the vocabulary
    for row in stage.where("seq < 0").groupBy("doc_id").agg(F.sum("n").alias("n")).collect():
        out[row.doc_id] = row.n
    return out


def _blocks(stage: DataFrame, lengths: bytes, width: int, base: dict[int, int]) -> DataFrame:
    dtype = np.dtype(f"<u{width}")

    def run(batches):
        book = huffman.Codebook.from_bytes(lengths)
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
        rows: list[tuple] = []  # part, seq, before, doc_id, n of the documents of the open block
        views: list[np.ndarray] = []
        tokens = 0

        def close():
            part, seq, before = rows[0][:3]
            data = huffman.encode_block(book, np.concatenate(views), np.array([r[4] for r in rows], np.int64))
            return {"part": part, "seq": seq, "start": base[part] + before, "doc_ids": [r[3] for r in rows], "data": data}

        for batch in batches:
            ids, done = batch.column("ids"), []
            wide = np.int64 if pa.types.is_large_binary(ids.type) else np.int32
            at = np.frombuffer(ids.buffers()[1], wide)[ids.offset : ids.offset + len(ids) + 1] // dtype.itemsize if len(ids) else [0]
            values = np.frombuffer(ids.buffers()[2] or b"", np.uint8)
            values = values[: len(values) // dtype.itemsize * dtype.itemsize].view(dtype)
            names = ("part", "seq", "before", "doc_id", "n")
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                # a block's documents follow one another without a gap
                if rows and (tokens >= BLOCK_TOKENS or (row[0], row[1]) != (rows[-1][0], rows[-1][1] + 1)):
                    done.append(close())
                    rows, views, tokens = [], [], 0
                rows.append(row)
                views.append(values[at[i] : at[i + 1]])
                tokens += row[4]
            views = [v.copy() for v in views]  # what stays open outlives the batch
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if rows:
            yield pa.RecordBatch.from_pylist([close()], schema)

    return stage.mapInArrow(run, _BLOCKS)


def write_tokens(docs: DataFrame, path: str, out: str, end_id: int | None = None) -> None:
    """Writes the token files of ``docs`` (doc_id, text) into the folder ``out``."""
    spark = docs.sparkSession
    tok = tokenizer(path)
    size, width = len(tok.token_bytes), tok.dtype.itemsize
    at = fresh_dir(spark, "token-ids")
    stage = write_table(_stage(docs, path, end_id), at, codec="zstd")
    lengths = huffman.code_lengths(_counts(stage, size)).tobytes()
    stage = stage.where("seq >= 0")
    base, total = {}, 0
    for row in stage.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each partition
        base[row.part] = total
        total += row.n
    spark.createDataFrame([(bytearray(lengths), width)], "lengths binary, width int").coalesce(1).write.parquet(f"{out}/codebook")
    write_table(_blocks(stage, lengths, width, base), f"{out}/blocks", codec="uncompressed")
    remove_dir(spark, at)


def codebook(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.schema("lengths binary, width int").parquet(f"{folder}/codebook").first().lengths)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a folder: doc_id, start (ids before it), n_tokens, ids (binary, little-endian 32 bits)."""
    lengths = codebook(spark, folder)

    def run(batches):
        book = huffman.Codebook.from_bytes(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                ids, lens = huffman.decode_block(book, batch.column("data")[i].as_py())
                ends = np.cumsum(lens.astype(np.int64))
                starts = ends - lens
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values,
                        pa.array(starts + batch.column("start")[i].as_py()),
                        pa.array(lens.astype(np.int64)),
                        _binary(ids.astype("<u4"), ends),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


__all__ = ["codebook", "read_tokens", "write_tokens"]
