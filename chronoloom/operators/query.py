"""Entity queries: clusters that hold all asked descriptors at the same time, or the conflict between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..sources.records import numbered
from ..sources.shared import local_frame, materialise
from .intervals import bucketed_overlap_join, coalesce_intervals, dealt, segments

#: Stretches of time that matches are dealt to when all are compared.
BUCKETS = 1024


@dataclass
class QueryOutcome:
    """``matches`` (cluster_id, start_ts, end_ts); ``conflict``: the first two clusters that hold at once, if any."""

    matches: DataFrame
    conflict: DataFrame

    def kind(self) -> str:
        return "matches" if self.conflict.isEmpty() else "conflict"


def descriptor_hits(descriptors: DataFrame, assignments: DataFrame, asked: list[tuple[str, str]], start: int, end: int) -> DataFrame:
    """(cluster_id, tag, start_ts, end_ts): for each asked descriptor where a cluster has it, clipped and coalesced."""
    asked = list(dict.fromkeys(asked))
    number = F.lit(None).cast("int")
    wanted = F.lit(False)
    for i, (attr, value) in enumerate(asked):
        is_it = (F.col("attr") == attr) & (F.col("value") == value)
        number, wanted = F.when(is_it, F.lit(i)).otherwise(number), wanted | is_it
    inside = iv.overlaps(iv.interval("start_ts", "end_ts"), iv.interval(start, end))
    hits = descriptors.where(wanted & inside).withColumn("tag", number)
    part = iv.meet(iv.interval("start_ts", "end_ts"), iv.interval(start, end))
    clipped = hits.select("record_id", "tag", part.start.alias("start_ts"), part.end.alias("end_ts"))
    placed = clipped.join(assignments, "record_id").select("cluster_id", "tag", "start_ts", "end_ts")
    return coalesce_intervals(dealt(placed, ["cluster_id"]), ["cluster_id", "tag"])


def cluster_matches(hits: DataFrame, asked: int) -> DataFrame:
    """Where a cluster has all of the descriptors."""
    every = segments(hits, ["cluster_id"]).where(F.col("n") == asked).select("cluster_id", "start_ts", "end_ts")
    return coalesce_intervals(every, ["cluster_id"])


def overlap_conflict(matches: DataFrame, all_overlaps: bool = False) -> DataFrame:
    """(cluster_a, cluster_b, start_ts, end_ts): two matches of different clusters at one time.

    By default only neighbours in order of time are compared and the first pair
    is returned; with ``all_overlaps`` every pair.
    """
    if all_overlaps:
        now = materialise(matches)
        low, high, length = now.agg(F.min("start_ts"), F.max("end_ts"), F.avg(F.col("end_ts") - F.col("start_ts"))).first()
        width = max(1, ((high or 1) - (low or 0)) // BUCKETS, int(length or 1))  # few stretches for each match
        side = now.select("cluster_id", "start_ts", "end_ts")
        met = bucketed_overlap_join(side, side, width, low or 0, high or 1).where("cluster_id < cluster_id_r")
        return met.select(F.col("cluster_id").alias("cluster_a"), F.col("cluster_id_r").alias("cluster_b"), F.greatest("start_ts", "start_ts_r").alias("start_ts"), F.least("end_ts", "end_ts_r").alias("end_ts"))
    # matches of one query, in order of time: each meets the one before it
    placed = materialise(numbered(matches.select("cluster_id", "start_ts", "end_ts"), ["start_ts", "end_ts", "cluster_id"], "n"))
    earlier = placed.select((F.col("n") + 1).alias("n"), *[F.col(c).alias("_" + c) for c in ("cluster_id", "start_ts", "end_ts")])
    before = placed.join(earlier, "n")
    hit = before.where((F.col("_cluster_id") != F.col("cluster_id")) & (F.col("_start_ts") < F.col("end_ts")) & (F.col("start_ts") < F.col("_end_ts")))
    pair = hit.select(F.col("_cluster_id").alias("cluster_a"), F.col("cluster_id").alias("cluster_b"), F.greatest("_start_ts", "start_ts").alias("start_ts"), F.least("_end_ts", "end_ts").alias("end_ts"))
    return pair.orderBy("start_ts", "end_ts", "cluster_a", "cluster_b").limit(1)


def offending_descriptors(hits: DataFrame, conflict: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """(attr, value, start_ts, end_ts): descriptors that both clusters of a conflict have within it, by the first
    stretch of each; all asked ones with the conflict's time where there is none."""
    spark = hits.sparkSession
    names = local_frame(spark, [(i, a, v) for i, (a, v) in enumerate(dict.fromkeys(asked))], "tag int, attr string, value string")
    c = conflict.select("cluster_a", "cluster_b", F.col("start_ts").alias("cs"), F.col("end_ts").alias("ce"))

    def first(side: str, p: str) -> DataFrame:
        met = hits.join(c, hits["cluster_id"] == c[side]).where((F.col("start_ts") < F.col("ce")) & (F.col("cs") < F.col("end_ts")))
        clipped = met.select("tag", F.struct(F.greatest("start_ts", "cs").alias("s"), F.least("end_ts", "ce").alias("e")).alias("i"))
        return clipped.groupBy("tag").agg(F.min("i").alias(p))

    both = first("cluster_a", "x").join(first("cluster_b", "y"), "tag")
    both = both.select("tag", F.greatest("x.s", "y.s").alias("start_ts"), F.least("x.e", "y.e").alias("end_ts")).where("start_ts < end_ts")
    found = names.join(both, "tag").select("attr", "value", "start_ts", "end_ts")
    # a handful of descriptors against one conflict
    rest = names.join(F.broadcast(c), F.lit(True)).select("attr", "value", F.col("cs").alias("start_ts"), F.col("ce").alias("end_ts"))
    none = rest.join(found.limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_anti")
    return found.union(none)


def query_entities(descriptors: DataFrame, assignments: DataFrame, asked: list[tuple[str, str]], start: int, end: int) -> QueryOutcome:
    """Master entities that hold all asked (attr, value) at some time in [start, end)."""
    if not asked:
        empty = assignments.where("false").select("cluster_id", F.lit(0).cast("long").alias("start_ts"), F.lit(0).cast("long").alias("end_ts"))
        return QueryOutcome(empty, overlap_conflict(empty))
    hits = descriptor_hits(descriptors, assignments, asked, start, end)
    matches = cluster_matches(hits, len(set(asked)))
    return QueryOutcome(matches, overlap_conflict(matches))


def render_matches(matches: DataFrame, golden: DataFrame, keys: DataFrame) -> DataFrame:
    """Matches with the cluster's key and its golden record within the match."""
    told = matches.join(keys, "cluster_id", "left")
    g = golden.select(F.col("cluster_id").alias("_c"), "attr", "value", F.col("start_ts").alias("_s"), F.col("end_ts").alias("_e"))
    met = told.join(g, (F.col("cluster_id") == F.col("_c")) & (F.col("_s") < F.col("end_ts")) & (F.col("start_ts") < F.col("_e")), "left")
    clipped = F.when(F.col("_c").isNotNull(), F.struct("attr", "value", F.greatest("start_ts", "_s").alias("start_ts"), F.least("end_ts", "_e").alias("end_ts")))
    return met.groupBy("cluster_id", "start_ts", "end_ts", "cluster_key", "identity_key").agg(F.array_sort(F.collect_list(clipped)).alias("golden"))


def merge_outcomes(outcomes: list[QueryOutcome]) -> QueryOutcome:
    """The answers of several parts as one: any conflict wins, else matches are compared again."""
    matches, conflict = outcomes[0].matches, outcomes[0].conflict
    for o in outcomes[1:]:
        matches, conflict = matches.unionByName(o.matches), conflict.unionByName(o.conflict)
    return QueryOutcome(matches, conflict.unionByName(overlap_conflict(matches)).orderBy("start_ts", "end_ts", "cluster_a", "cluster_b").limit(1))


def entity_stats(records: DataFrame, assignments: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    base = assignments.agg(F.count(F.lit(1)).alias("record_count"), F.countDistinct("cluster_id").alias("cluster_count"))
    base = base.withColumn("merges", F.col("record_count") - F.col("cluster_count"))
    if conflicts is None:
        return base
    n = conflicts.agg(F.count(F.lit(1)).alias("conflict_count"))
    return base.join(n, F.lit(True))  # one row each
