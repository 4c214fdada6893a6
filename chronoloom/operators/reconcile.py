"""Boundaries between shards: what each shard knows of a key, merges across shards and the conflicts that forbid them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .intervals import coalesce_intervals, dealt, segments
from .keys import signature


def perspective_strong_hashes(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, strong: list[str]) -> DataFrame:
    """(cluster_id, strong): for each perspective a hash of all its strong (attribute, value)."""
    said = descriptors.where(F.col("attr").isin(strong or [""])).join(records.select("record_id", "perspective"), "record_id").join(assignments, "record_id")
    pair = F.concat("attr", F.lit("\u0001"), "value")
    each = said.groupBy("cluster_id", "perspective").agg(F.xxhash64(F.array_join(F.array_sort(F.collect_set(pair)), "\u0002")).alias("h"))
    return each.groupBy("cluster_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("perspective", "h")))).alias("strong"))


def boundary_index(rows: DataFrame, assignments: DataFrame, shards: DataFrame, strong: DataFrame, merged_only: bool = False) -> DataFrame:
    """(signature, shard, cluster_id, start_ts, end_ts, strong): the hull of each key's times in a cluster.

    ``rows`` are key rows, ``shards`` (record_id, shard) where records live.
    With ``merged_only`` an entry needs two records that the key brought
    together on its shard, and its hull is that of the times they share: fewer
    entries, but a record alone on its shard is not found there.
    """
    if merged_only:
        return _merged_boundaries(rows, assignments, shards, strong)
    placed = rows.withColumn("signature", F.hex(signature(F.col("entity_type"), F.col("key_values")))).join(assignments, "record_id").join(shards, "record_id")
    spans = placed.groupBy("signature", "shard", "cluster_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return spans.join(strong, "cluster_id", "left").select("signature", "shard", "cluster_id", "start_ts", "end_ts", F.coalesce("strong", F.create_map().cast("map<string,bigint>")).alias("strong"))


def _merged_boundaries(rows: DataFrame, assignments: DataFrame, shards: DataFrame, strong: DataFrame) -> DataFrame:
    key = ["signature", "shard", "cluster_id"]
    placed = rows.withColumn("signature", F.hex(signature(F.col("entity_type"), F.col("key_values")))).join(assignments, "record_id").join(shards, "record_id")
    own = coalesce_intervals(dealt(placed.select(*key, "record_id", "start_ts", "end_ts"), key), [*key, "record_id"])
    shared = segments(own.select(*key, F.lit(0).alias("tag"), "start_ts", "end_ts"), key).where("n >= 2")
    spans = shared.groupBy(*key).agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    return spans.join(strong, "cluster_id", "left").select(*key, "start_ts", "end_ts", F.coalesce("strong", F.create_map().cast("map<string,bigint>")).alias("strong"))


@dataclass
class Reconciliation:
    merges: DataFrame
    conflicts: DataFrame
    pairs: DataFrame

    def summary(self) -> DataFrame:
        return self.pairs.agg(
            F.countDistinct("signature").alias("keys_matched"),
            F.count(F.lit(1)).alias("candidates"),
            F.coalesce(F.count_if("blocked"), F.lit(0)).alias("conflicts_blocked"),
            F.coalesce(F.count_if(~F.col("blocked")), F.lit(0)).alias("merge_candidates"),
        )


def cross_shard_pairs(boundaries: DataFrame, dirty: DataFrame | None = None) -> DataFrame:
    """Pairs of entries of one key on two shards at one time, with whether a shared perspective forbids a merge."""
    if dirty is not None:
        boundaries = boundaries.join(dirty.select("signature").distinct(), "signature", "left_semi")
    x, y = boundaries.alias("x"), boundaries.alias("y")
    on = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.shard") < F.col("y.shard")) & (F.col("x.start_ts") < F.col("y.end_ts")) & (F.col("y.start_ts") < F.col("x.end_ts"))
    differ = lambda p: F.try_element_at("y.strong", p).isNotNull() & (F.try_element_at("y.strong", p) != F.try_element_at("x.strong", p))
    clashing = F.array_sort(F.filter(F.map_keys("x.strong"), differ))
    return x.join(y, on).select(
        F.col("x.signature").alias("signature"),
        F.col("x.shard").alias("shard_a"),
        F.col("x.cluster_id").alias("cluster_a"),
        F.col("y.shard").alias("shard_b"),
        F.col("y.cluster_id").alias("cluster_b"),
        F.greatest("x.start_ts", "y.start_ts").alias("start_ts"),
        F.least("x.end_ts", "y.end_ts").alias("end_ts"),
        clashing.alias("perspectives"),
        (F.size(clashing) > 0).alias("blocked"),
    )


def reconcile(boundaries: DataFrame, dirty: DataFrame | None = None) -> Reconciliation:
    """Merges (primary, secondary), the primary on the lower shard, and conflicts, each once."""
    pairs = cross_shard_pairs(boundaries, dirty)
    merges = pairs.where("NOT blocked AND cluster_a <> cluster_b").select(F.col("cluster_a").alias("primary"), F.col("cluster_b").alias("secondary")).distinct()
    conflicts = pairs.where("blocked").select("signature", "cluster_a", "cluster_b", "start_ts", "end_ts", "perspectives").dropDuplicates(["cluster_a", "cluster_b", "start_ts", "end_ts"])
    return Reconciliation(merges, conflicts, pairs)


def apply_merges(assignments: DataFrame, merges: DataFrame) -> DataFrame:
    """Assignments with merged clusters under the smallest of their ids, however long the chains are."""
    found = connected_components(merges.select(F.col("primary").alias("a"), F.col("secondary").alias("b")))
    moved = found.select(F.col("node").alias("cluster_id"), "component")
    return assignments.join(moved, "cluster_id", "left").select("record_id", F.coalesce("component", "cluster_id").alias("cluster_id"))


def merge_boundaries(boundaries: DataFrame, merges: DataFrame) -> DataFrame:
    """The index after the merges: entries of one cluster are folded, the first strong hash of a perspective stays."""
    found = connected_components(merges.select(F.col("primary").alias("a"), F.col("secondary").alias("b")))
    moved = boundaries.join(found.select(F.col("node").alias("cluster_id"), "component"), "cluster_id", "left").withColumn("cluster_id", F.coalesce("component", "cluster_id"))
    entries = moved.select("signature", "shard", "cluster_id", F.explode_outer("strong").alias("p", "h"), "start_ts", "end_ts")
    first = entries.groupBy("signature", "shard", "cluster_id", "p").agg(F.min("h").alias("h"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
    folded = first.groupBy("signature", "shard", "cluster_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.filter(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda e: e["p"].isNotNull()).alias("e"))
    return folded.select("signature", "shard", "cluster_id", "start_ts", "end_ts", F.map_from_entries("e").alias("strong"))


def overlapping_boundaries(boundaries: DataFrame, signatures: DataFrame, start: int, end: int) -> DataFrame:
    """Entries of the asked keys at some time in [start, end)."""
    return boundaries.where((F.col("start_ts") < end) & (F.col("end_ts") > start)).join(signatures.select("signature").distinct(), "signature", "left_semi")


def conflicts_of_shard(conflicts: DataFrame, boundaries: DataFrame, shard: int) -> DataFrame:
    """The conflicts that touch a shard's clusters, each pair of clusters and time once."""
    mine = boundaries.where(F.col("shard") == shard).select(F.col("cluster_id").alias("_c")).distinct()
    sides = [conflicts.join(mine, F.col(side) == F.col("_c"), "left_semi") for side in ("cluster_a", "cluster_b")]
    return sides[0].unionByName(sides[1]).dropDuplicates(["cluster_a", "cluster_b", "start_ts", "end_ts"])


def dirty_keys(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Signatures whose entries are new or changed."""
    row = ["signature", "shard", "cluster_id", "start_ts", "end_ts"]
    if before is None:
        return after.select("signature").distinct()
    return after.select(*row).exceptAll(before.select(*row)).select("signature").distinct()


@dataclass
class ReconcilePolicy:
    """When a stream reconciles: many dirty keys, old ones, or a quiet stream, but not too often."""

    dirty_limit: int = 1000
    max_age_s: float = 60.0
    quiet_rate: float = 1000.0
    min_gap_s: float = 5.0

    def due(self, dirty: int, oldest_age_s: float, rate: float, since_last_s: float) -> bool:
        if dirty == 0 or since_last_s < self.min_gap_s:
            return False
        return dirty >= self.dirty_limit or oldest_age_s > self.max_age_s or rate < self.quiet_rate
