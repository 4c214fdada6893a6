"""Micro-batches into an engine.

Validity times are data, not event time, so there is no watermark: a late
record is linked like any other.  A batch that Spark replays after a failure is
recognised by its id, which is written with the snapshot in one rename.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..operators.graph import GraphDiff, diff, export_graph
from ..operators.keys import route
from ..operators.reconcile import Reconciliation, ReconcilePolicy
from ..sources.records import IDENTITY, NESTED, flat
from ..sources.shared import materialise


def read_nested_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of nested records as a stream."""
    return spark.readStream.schema(NESTED).option("maxFilesPerTrigger", max_files).parquet(path)


def ingest_stream(engine: Engine, stream: DataFrame, checkpoint: str, after: Callable[[Engine, DataFrame, int], None] | None = None, available_now: bool = True) -> StreamingQuery:
    """Ingests every micro-batch; ``after(engine, batch, batch_id)`` may report on it."""

    def run(batch: DataFrame, batch_id: int) -> None:
        engine.ingest(batch, batch_id=batch_id)
        if after:
            after(engine, batch, batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_conflicts(engine: Engine, batch: DataFrame) -> DataFrame:
    """Observations of the clusters that a batch's records are in."""
    who = batch.select("identity.entity_type", "identity.perspective", "identity.uid")
    ids = engine.records.join(who, ["entity_type", "perspective", "uid"], "left_semi").select("record_id")
    return engine.observations(engine.affected_clusters(ids))


def graph_updates(before: DataFrame, after: DataFrame) -> GraphDiff:
    """What a table of the graph gained and lost between two versions."""
    return diff(before, after, [c for c in ("id", "source", "target") if c in after.columns])


@dataclass
class BatchUpdate:
    """What a batch (of one record or many) did: its records' clusters, the conflicts of these clusters now, and what
    their part of the graph gained and lost."""

    assignments: DataFrame
    conflicts: DataFrame
    nodes: GraphDiff
    same_as: GraphDiff
    conflicts_with: GraphDiff


def _part(engine: Engine, clusters: DataFrame):
    """The graph of some clusters alone, written down."""
    there = engine.assignments.join(clusters, "cluster_id", "left_semi")
    records = engine.records.join(there, "record_id", "left_semi")
    descriptors = engine.descriptors.join(there, "record_id", "left_semi")
    graph = export_graph(records, descriptors, there, engine.ontology, star=True)
    return [materialise(t) for t in (graph.nodes, graph.same_as, graph.conflicts_with)]


def ingest_with_updates(engine: Engine, batch: DataFrame, keep_ids: bool = False, batch_id: int | None = None) -> BatchUpdate:
    """Ingests a batch and tells what changed; only clusters that the batch is in are looked at, before and after."""
    before = materialise(engine.assignments)
    old = (engine.records, engine.descriptors)
    engine.ingest(batch, keep_ids, batch_id)
    who = batch.select(*[f"identity.{c}" for c in IDENTITY])
    ids = engine.records.join(who, IDENTITY, "left_semi").select("record_id")
    now = materialise(engine.assignments.join(ids, "record_id", "left_semi"))
    clusters = now.select("cluster_id").distinct()
    members = engine.assignments.join(clusters, "cluster_id", "left_semi").select("record_id")
    earlier = before.join(before.join(members, "record_id", "left_semi").select("cluster_id").distinct(), "cluster_id", "left_semi")
    graph = export_graph(old[0].join(earlier, "record_id", "left_semi"), old[1].join(earlier, "record_id", "left_semi"), earlier, engine.ontology, star=True)
    after = _part(engine, clusters)
    changes = [graph_updates(b, a) for b, a in zip((graph.nodes, graph.same_as, graph.conflicts_with), after, strict=True)]
    return BatchUpdate(now, engine.observations(clusters), *changes)


def ingest_by_shard(engines: list[Engine], batch: DataFrame, keep_ids: bool = True) -> list[int]:
    """Sends each record to the engine of its shard (by its first complete key); the numbers inserted."""
    records, descriptors = flat(batch)
    placed = materialise(route(records, descriptors, engines[0].ontology, len(engines)))
    dealt = batch.join(placed, F.col("index") == F.col("record_id")).drop("record_id")
    return [e.ingest(dealt.where(F.col("shard") == k).drop("shard"), keep_ids).inserted for k, e in enumerate(engines)]


@dataclass
class ReconcileLoop:
    """Reconciles an engine's shards when the policy says so; ``after`` fits ``ingest_stream``."""

    shards: int
    policy: ReconcilePolicy = field(default_factory=ReconcilePolicy)
    clock: Callable[[], float] = time.monotonic
    seen: DataFrame | None = None
    rounds: int = 0
    _dirty_since: float | None = None
    _last: float = float("-inf")
    _before: float | None = None

    def after(self, engine: Engine, batch: DataFrame, batch_id: int) -> Reconciliation | None:
        now, size = self.clock(), batch.count()
        rate = size / max(now - self._before, 1e-9) if self._before is not None else float("inf")
        self._before = now
        index = materialise(engine.boundary_index(self.shards))
        dirty = materialise(engine.dirty_keys(self.seen, self.shards))
        n = dirty.count()
        if n and self._dirty_since is None:
            self._dirty_since = now
        age = now - self._dirty_since if self._dirty_since is not None else 0.0
        if not self.policy.due(n, age, rate, now - self._last):
            return None
        found = engine.reconcile(index, dirty)
        if not found.merges.isEmpty():
            engine.apply_merges(found.merges)
        self.seen, self._dirty_since, self._last = index, None, now
        self.rounds += 1
        return found
