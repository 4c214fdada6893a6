"""Longest-processing-time scheduling of groups onto shards.

Rows of one group (equal texts) stay together.  Groups go, largest first, to
the shard with the least load, which a heap yields.  The driver doesn't see
groups but size classes: a class is an exact size below ``2**EXACT_BITS`` bytes
and a run of sizes within 1/1024 of each other above, so there are fewer than
120,000 classes however large the corpus is.  For a class the driver deals out
its count of groups, one pop of the heap after another while the loads differ
and whole rounds at once when they are level; which group of a class takes
which place follows from its rank in the class.

Ranks and slots come from counts for each (class or shard, hash bucket) and a
rank inside the bucket, so no task sorts more than one bucket's share.

Defined cases: all null texts are one group, of no bytes but ``overhead`` each;
null or repeated doc_ids are rows like others; shards of equal load are taken
in order of their numbers, groups of one class in order of their hashes; a text
of any length counts with all its bytes; an empty table gives no rows; the
result has its own columns only, whatever those of the input are called.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, text_key

EXACT_BITS = 16
MANTISSA_BITS = 10
#: Parts of a class or shard that are ranked by themselves.
BUCKETS = 1024


def size_class(size):
    """The class of a size: itself below 2**16, else where its leading bit is and the ten bits after that."""
    digits = F.bin(size)
    place = F.length(digits)
    coarse = F.conv(F.substring(digits, 1, MANTISSA_BITS + 1), 2, 10).cast("long")
    return F.when(size < (1 << EXACT_BITS), size).otherwise(place.cast("long") * (1 << EXACT_BITS) + coarse)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """Longest first: for each class (class, groups, bytes) the runs (shard, groups) in which its ranks are dealt.

    Each group goes to the least-loaded shard, from the top of a heap.  Of a
    class with more groups than shards, those that bring the shards up to a
    common level are dealt at once: dealt singly they would go the same way.
    """
    loads = [0.0] * shards
    plan: dict[int, list[tuple[int, int]]] = {}
    for cls, groups, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        size, left, runs = total / groups, groups, [0] * shards
        if left > shards and size > 0:
            low, high = min(loads), max(loads) + size * (left / shards + 1)
            for _ in range(80):  # the highest level that the groups suffice for
                level = (low + high) / 2
                low, high = (level, high) if sum(int((level - x) // size) for x in loads if x < level) <= left else (low, level)
            for s, x in enumerate(loads):
                if x < low:
                    runs[s] = int((low - x) // size)
            loads = [x + n * size for x, n in zip(loads, runs, strict=True)]
            left -= sum(runs)
        heap = [(x, s) for s, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            runs[s] += 1
            loads[s] = load + size
        plan[cls] = [(s, n) for s, n in enumerate(runs) if n]
    return plan


def _ranked(df: DataFrame, by: str, bucket, order: list, name: str) -> DataFrame:
    """Adds the gapless rank of each row among those of the same ``by``: counts of buckets first, then ranks inside."""
    spread = df.withColumn("_bucket", bucket)
    counts = spread.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy(by, "_bucket").orderBy(*order)
    ranked = spread.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(counts, [by, "_bucket"]).withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_bucket", "_ahead", "_inside")


def assign(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; the law kept is that of near-equal bytes."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        return _assign(docs, shards, overhead, keep)


def _assign(docs: DataFrame, shards: int, overhead: int, keep) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(text_key()).alias("key"),
    )
    rows = materialise(rows.select("doc_id", "size", "text_crc32", F.col("key.a").alias("ka"), F.col("key.b").alias("kb")), "shard-rows")
    groups = rows.groupBy("ka", "kb").agg(F.sum("size").alias("bytes"))
    groups = groups.withColumn("class", size_class(F.col("bytes")))
    groups = materialise(groups, "shard-groups")
    classes = [(r["class"], r.n, r.total) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total")).collect()]
    plan = schedule(classes, shards)
    dealt = materialise(spark.createDataFrame(_steps(plan)), "shard-plan")
    bucket = F.pmod(F.xxhash64("ka", "kb"), F.lit(BUCKETS)).cast("int")
    ranked = _ranked(groups, "class", bucket, ["ka", "kb"], "rank")
    placed = ranked.join(dealt, "class")  # Spark goes by the table's size: broadcast where that is small, else by class
    run = F.size(F.filter("upto", lambda u: u <= F.col("rank")))
    placed = placed.select("ka", "kb", F.get("shards", run).alias("shard"))
    out = rows.join(placed, ["ka", "kb"]).select("doc_id", "size", "text_crc32", "shard")
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BUCKETS)).cast("int")
    return _ranked(keep(materialise(out, "shard-placed")), "shard", spread, ["doc_id", "text_crc32"], "slot")


def _steps(plan: dict[int, list[tuple[int, int]]]) -> pa.Table:
    """For each class where the ranks end that go to a shard, and that shard: at most one run for each shard."""
    ends = np.cumsum([0] + [len(runs) for runs in plan.values()]).astype(np.int32)
    shards = np.array([s for runs in plan.values() for s, _ in runs], np.int32)
    upto = [np.cumsum([n for _, n in runs]) for runs in plan.values()]
    flat = np.concatenate(upto).astype(np.int64) if upto else np.empty(0, np.int64)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values)) for values in (flat, shards)]
    return pa.table([pa.array(list(plan), pa.int64()), *lists], ["class", "upto", "shards"])
