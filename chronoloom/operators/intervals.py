"""Operators over sets of intervals: coalescing, slices, set algebra, interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..sources.shared import materialise

#: Bytes of the largest input for each partition of ``dealt``.
DEALT_BYTES = 1 << 20


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the rows of a key together, in a number of partitions that follows the bytes of its largest input.

    Adaptive execution merges partitions by their compressed bytes; rows of intervals have few of them, and the sorts
    of one task then take gigabytes.  A number that is asked for stays; what is grouped by more columns, or joined with
    another table of the same input and key, needs no further exchange.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    largest = max((s for s in sizes if s < 1 << 60), default=0)  # beyond: not known
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(1, least, largest // DEALT_BYTES), *keys)


def with_islands(df: DataFrame, keys: list[str], touching: bool = True, name: str = "island", start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Numbers runs of intervals, within ``keys``, that overlap (or, with ``touching``, at least touch) in a chain."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.col(start) > F.col("_reach") if touching else F.col(start) >= F.col("_reach")
    marked = df.withColumn("_reach", reach)
    marked = marked.withColumn("_new", F.when(F.col("_reach").isNull() | fresh, 1).otherwise(0))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.withColumn(name, F.sum("_new").over(running)).drop("_reach", "_new")


def coalesce_intervals(df: DataFrame, keys: list[str], touching: bool = True, aggs: list[Column] | None = None) -> DataFrame:
    """One row for each island of each key, with its hull and further aggregates."""
    numbered = with_islands(df, keys, touching, "_island")
    hull = [F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts")]
    return numbered.groupBy(*keys, "_island").agg(*hull, *(aggs or [])).drop("_island")


def coalesce_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Coalescing in order of (start, end) where a different value in between ends a run."""
    order = Window.partitionBy(*keys).orderBy("start_ts", "end_ts", value)
    turned = df.withColumn("_turn", F.when(F.lag(value).over(order).eqNullSafe(F.col(value)), 0).otherwise(1))
    stretches = turned.withColumn("_stretch", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return coalesce_intervals(stretches.drop("_turn"), [*keys, "_stretch", value]).drop("_stretch")


def boundaries(df: DataFrame, keys: list[str]) -> DataFrame:
    starts = df.select(*keys, F.col("start_ts").alias("at"))
    return starts.union(df.select(*keys, F.col("end_ts").alias("at"))).distinct()


def atomic_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """The slices between neighbouring boundaries, those that no interval covers included."""
    order = Window.partitionBy(*keys).orderBy("at")
    sliced = boundaries(df, keys).withColumn("end_ts", F.lead("at").over(order))
    return sliced.where(F.col("end_ts").isNotNull()).select(*keys, F.col("at").alias("start_ts"), "end_ts")


def segments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Slices between boundaries with ``n``, the intervals active in each, and ``tag_sum``, the sum of their ``tag``.

    ``df`` is (keys, tag, start_ts, end_ts).  Running sums over starts and ends
    take the place of a join of slices with intervals.
    """
    tag = F.col("tag").cast("long")
    mark = lambda at, d, t: F.struct(F.col(at).alias("at"), F.lit(d).alias("d"), t.alias("t"))
    marks = df.select(*keys, F.inline(F.array(mark("start_ts", 1, tag), mark("end_ts", -1, -tag))))
    events = marks.groupBy(*keys, "at").agg(F.sum("d").alias("d"), F.sum("t").alias("t"))
    order = Window.partitionBy(*keys).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = events.select(
        *keys,
        F.col("at").alias("start_ts"),
        F.lead("at").over(order).alias("end_ts"),
        F.sum("d").over(running).alias("n"),
        F.sum("t").over(running).alias("tag_sum"),
    )
    return made.where(F.col("end_ts").isNotNull())


def _two_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The slices of two sets of intervals; ``tag_sum`` tells which are there: 1 the first alone, 2 the second, 3 both."""
    side = lambda df, tag: df.select(*keys, F.lit(tag).alias("tag"), "start_ts", "end_ts")
    both = dealt(side(a, 1).unionByName(side(b, 2)), keys)
    return segments(coalesce_intervals(both, [*keys, "tag"]), keys)


def intersect_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Where both sets of intervals are, coalesced."""
    common = _two_sets(a, b, keys).where("tag_sum = 3")
    return coalesce_intervals(common.select(*keys, "start_ts", "end_ts"), keys)


def subtract_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Where the first set is and the second isn't, coalesced."""
    alone = _two_sets(a, b, keys).where("tag_sum = 1")
    return coalesce_intervals(alone.select(*keys, "start_ts", "end_ts"), keys)


def has_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The keys under which some interval of one set overlaps one of the other: no pairs, a running count."""
    return _two_sets(a, b, keys).where("tag_sum = 3").select(*keys).distinct()


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffix: str = "_r") -> DataFrame:
    """Joins rows of equal ``on`` whose intervals overlap; the right side's other columns get ``suffix``."""
    renamed = right.select(*[F.col(c).alias(c if c in on else c + suffix) for c in right.columns])
    l, r = left.alias("l"), renamed.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    meets = iv.overlaps(iv.interval("l.start_ts", "l.end_ts"), iv.interval(f"r.start_ts{suffix}", f"r.end_ts{suffix}"))
    condition = meets
    for c in same:
        condition = condition & c
    joined = l.join(r, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in renamed.columns if c not in on])


#: Rows of each side that are compared in one tile of an overlap join, about.
TILE_ROWS = 16_384


def bucketed_overlap_join(left: DataFrame, right: DataFrame, width: int, low: int, high: int, suffix: str = "_r") -> DataFrame:
    """An overlap join without a key: both sides are cut into time buckets of ``width`` within [low, high).

    Each pair is made in one bucket only, that of the later start, so nothing
    has to be deduplicated.  Open ends are clipped to [low, high).

    A bucket with many rows is cut into tiles, each a part of its left rows
    against a part of its right ones, so that no task has all its pairs: a row
    goes to one part (by its hash; equal rows share one) and to every part of the
    other side.  The buckets' sizes are counted first.
    """
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high))
    bucket = lambda c: F.floor((c - F.lit(low)) / F.lit(width)).cast("long")

    def cut(df: DataFrame) -> DataFrame:
        inside = df.where((F.col("start_ts") < high) & (F.col("end_ts") > low))
        return inside.withColumn("_bucket", F.explode(F.sequence(bucket(clip("start_ts")), bucket(clip("end_ts") - 1))))

    a, b = cut(left), cut(right)
    size = lambda df, name: df.groupBy("_bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE_ROWS)).cast("int").alias(name))
    parts = materialise(size(a, "_m").join(size(b, "_n"), "_bucket"))  # a row for each bucket
    tiles = parts.agg(F.coalesce(F.sum(F.col("_m") * F.col("_n")), F.lit(0))).first()[0]
    spark = left.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), tiles)
    tile = ["_bucket", "_i", "_j"]

    def tiled(df: DataFrame, own: str, many: str, mine: str, other: str) -> DataFrame:
        placed = df.join(F.broadcast(parts), "_bucket").withColumn(own, F.pmod(F.xxhash64(*df.columns), F.col(mine)).cast("int"))
        spread = placed.withColumn(many, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return spread.select(*df.columns, *tile[1:]).repartition(tasks, *tile)

    met = overlap_join(tiled(a, "_i", "_j", "_m", "_n"), tiled(b, "_j", "_i", "_n", "_m"), tile, suffix=suffix)
    later = F.greatest(clip("start_ts"), clip(f"start_ts{suffix}"))
    return met.where(F.col("_bucket") == bucket(later)).drop(*tile)
