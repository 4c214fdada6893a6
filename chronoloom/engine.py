"""The engine: an ontology, a store of snapshots, and the operators over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import conflicts as cf
from .operators import graph as gr
from .operators import query as qu
from .operators import reconcile as rc
from .operators.cluster_keys import cluster_keys
from .operators.golden import golden
from .operators.components import led_components
from .operators.intervals import with_islands
from .operators.keys import key_rows, key_text, route
from .operators.linking import LinkOptions, decides_in_order, linker_metrics, merge_counts, resolve
from .plans.ontology import Ontology
from .sources import records as src
from .sources.shared import local_frame, materialise
from .sources.store import SnapshotStore


KEYS = "record_id bigint, k string, start_ts bigint, end_ts bigint"
#: Parts of the assignments after which they are written as one.
ASSIGNMENT_PARTS = 8


@dataclass
class IngestResult:
    assignments: DataFrame
    inserted: int
    version: int


class Engine:
    """Ingests records, links them, and answers queries from the last snapshot."""

    def __init__(self, spark: SparkSession, root: str, ontology: Ontology | None = None, options: LinkOptions | None = None):
        self.spark, self.options = spark, options or LinkOptions()
        self.store = SnapshotStore(spark, root)
        m = self.store.manifest()
        self._told_keys: tuple[int, DataFrame] | None = None
        self.ontology = ontology or (Ontology.from_json(m["ontology"]) if m and m["ontology"] else Ontology())

    # ---- state ----

    def _table(self, name: str, schema: str) -> DataFrame:
        found = self.store.load(name)
        return found if found is not None else local_frame(self.spark, [], schema)

    @property
    def records(self) -> DataFrame:
        return self._table("records", src.RECORDS)

    @property
    def descriptors(self) -> DataFrame:
        return self._table("descriptors", src.DESCRIPTORS)

    @property
    def assignments(self) -> DataFrame:
        """The cluster of each record; of a record in several parts the last version's."""
        found = self.store.load("assignments")
        if found is None:
            return local_frame(self.spark, [], "record_id bigint, cluster_id bigint")
        if len(self.store.parts("assignments")) == 1 or "version" not in found.columns:
            return found.select("record_id", "cluster_id")
        return found.groupBy("record_id").agg(F.max_by("cluster_id", "version").alias("cluster_id"))

    def set_ontology(self, ontology: Ontology) -> None:
        """A new ontology starts from nothing: what was linked under the old one is gone."""
        self.reset()
        self.ontology = ontology

    def reset(self) -> None:
        self.store.reset()

    def checkpoint(self, root: str) -> SnapshotStore:
        return self.store.copy_to(root)

    # ---- ingest ----

    def ingest(self, nested: DataFrame, keep_ids: bool = False, batch_id: int | None = None) -> IngestResult:
        """Adds records (nested form, numbered by ``index``) whose identity is new, and links all that it touches."""
        if batch_id is not None and self.store.committed(batch_id):
            return IngestResult(self.assignments, 0, self.store.version())
        batch, rows = src.flat(nested)
        stored, described = self.records, self.descriptors
        fresh = src.new_records(batch, stored)
        if not keep_ids:
            top = stored.agg(F.max("record_id")).first()[0] or 0
            fresh = src.number_records(fresh.withColumnRenamed("record_id", "_index"), top, "_index")
        else:
            fresh = fresh.withColumn("_index", F.col("record_id"))
        fresh = materialise(fresh)
        added = rows.withColumnRenamed("record_id", "_index").join(fresh.select("_index", "record_id"), "_index").drop("_index").select(*described.columns)
        added = materialise(added)
        fresh = fresh.drop("_index").select(*stored.columns)
        keys = key_rows(fresh, added, self.ontology)
        keys = materialise(keys.select("record_id", key_text(F.col("entity_type"), F.col("key_values")).alias("k"), "start_ts", "end_ts"))
        linked = self._link(fresh, added, keys)
        version = self.store.version() + 1
        linked = linked.select("record_id", "cluster_id", F.lit(version).cast("long").alias("version"))
        whole = {}
        if len(self.store.parts("assignments")) >= ASSIGNMENT_PARTS:  # the parts so far as one
            whole = {"assignments": materialise(self.assignments.join(linked, "record_id", "left_anti").withColumn("version", F.lit(version).cast("long")).unionByName(linked))}
        append = {"records": fresh, "descriptors": added, "keys": keys, **({} if whole else {"assignments": linked})}
        version = self.store.commit(append, whole, batch_id, self.ontology.to_json())
        return IngestResult(self.assignments, fresh.count(), version)

    def _link(self, fresh: DataFrame, added: DataFrame, keys: DataFrame) -> DataFrame:
        """Assignments of the new records and of stored ones whose cluster changes."""
        if self.store.load("assignments") is None:
            return resolve(fresh, added, self.ontology, self.options)
        if decides_in_order(self.ontology, self.options):
            touched = self._reach(keys, fresh.select("record_id"))
            records, descriptors = self.records.unionByName(fresh), self.descriptors.unionByName(added)
            return resolve(records.join(touched, "record_id", "left_semi"), descriptors.join(touched, "record_id", "left_semi"), self.ontology, self.options)
        return self._merge_in(fresh, keys)

    def _merge_in(self, fresh: DataFrame, keys: DataFrame) -> DataFrame:
        """Without decisions clusters only grow: those that a new record's keys overlap are joined, as a graph of
        clusters and new records, and only records of renamed clusters are written again."""
        before = materialise(self.assignments)
        met = self._table("keys", KEYS).join(keys.select("k").distinct(), "k", "left_semi").join(before, "record_id")
        rows = met.select(F.col("cluster_id").alias("node"), "k", "start_ts", "end_ts").unionByName(keys.select(F.col("record_id").alias("node"), "k", "start_ts", "end_ts"))
        chains = with_islands(rows, ["k"], touching=False).withColumn("lead", F.min("node").over(Window.partitionBy("k", "island")))
        parts = materialise(led_components(chains.select(F.col("node").alias("a"), F.col("lead").alias("b"))))
        new = fresh.select("record_id").join(parts, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("component", "record_id").alias("cluster_id"))
        renamed = parts.where("node <> component")
        moved = before.join(renamed, F.col("cluster_id") == F.col("node")).select("record_id", F.col("component").alias("cluster_id"))
        return materialise(new.unionByName(moved))

    def _reach(self, keys: DataFrame, fresh: DataFrame) -> DataFrame:
        """Records that shared key values connect to the new ones, found by widening from these; the rest is untouched."""
        rows = self._table("keys", KEYS).select("record_id", "k").unionByName(keys.select("record_id", "k"))
        found, edge, asked = fresh, fresh, None
        while True:
            values = rows.join(edge, "record_id", "left_semi").select("k").distinct()
            values = materialise(values if asked is None else values.join(asked, "k", "left_anti"))  # values not followed before
            asked = values if asked is None else asked.union(values)
            edge = materialise(rows.join(values, "k", "left_semi").select("record_id").distinct().join(found, "record_id", "left_anti"))
            if edge.isEmpty():
                return found
            found = found.union(edge)

    def affected_clusters(self, record_ids: DataFrame) -> DataFrame:
        return self.assignments.join(record_ids, "record_id", "left_semi").select("cluster_id").distinct()

    def save_conflicts(self) -> int:
        """Stores the summaries of all conflicts with the snapshot."""
        told = cf.summarize(self.observations(), self.records)
        return self.store.commit(replace={"conflicts": told}, ontology=self.ontology.to_json())

    def saved_conflicts(self) -> DataFrame | None:
        """The summaries that were stored last; later ingests leave them as they were."""
        return self.store.load("conflicts")

    def cluster_conflicts(self, cluster_ids: DataFrame) -> DataFrame:
        """Conflict summaries of some clusters alone."""
        return cf.summarize(self.observations(cluster_ids), self.records)

    def move_range(self, other: Engine, start: int, end: int) -> int:
        """Hands a range of record ids to another engine, which links them anew; what it has already stays."""
        return other.import_(self.export(start, end)).inserted

    # ---- answers ----

    def golden(self) -> DataFrame:
        return golden(self.descriptors, self.assignments)

    def cluster_keys(self) -> DataFrame:
        return cluster_keys(self.records, self.descriptors, self.assignments, self.ontology)

    def _keys_now(self) -> DataFrame:
        """Cluster keys of the current version, made once: they are unique among all clusters."""
        version = self.store.version()
        if self._told_keys is None or self._told_keys[0] != version:
            self._told_keys = (version, materialise(self.cluster_keys()))
        return self._told_keys[1]

    def observations(self, target: DataFrame | None = None) -> DataFrame:
        return cf.observations(self.records, self.descriptors, self.assignments, self.ontology, target)

    def conflicts(self, start: int = 0, end: int = 0, attribute: str = "") -> DataFrame:
        return cf.list_conflicts(cf.summarize(self.observations(), self.records), start, end, attribute)

    def query(self, asked: list[tuple[str, str]], start: int, end: int, render: bool = False) -> qu.QueryOutcome:
        outcome = qu.query_entities(self.descriptors, self.assignments, asked, start, end)
        if render:
            matches = materialise(outcome.matches)
            there = self.assignments.join(matches.select("cluster_id").distinct(), "cluster_id", "left_semi")
            outcome.matches = qu.render_matches(matches, golden(self.descriptors, there), self._keys_now())
        return outcome

    def graph(self, star: bool = False) -> gr.KnowledgeGraph:
        return gr.export_graph(self.records, self.descriptors, self.assignments, self.ontology, self.observations(), star)

    def stats(self) -> DataFrame:
        return qu.entity_stats(self.records, self.assignments, self.observations())

    def metrics(self) -> DataFrame:
        return linker_metrics(self.records, self.assignments, merge_counts(self.records, self.descriptors, self.ontology, self.options))

    def id_range(self) -> DataFrame:
        return src.id_bounds(self.records)

    def export(self, start: int = 0, end: int = 0) -> DataFrame:
        """Records of an id range in nested form, for ``import_``."""
        part = src.id_page(self.records, start, end, 0)
        return src.nested(part, self.descriptors.join(part.select("record_id"), "record_id", "left_semi"))

    def import_(self, nested: DataFrame) -> IngestResult:
        return self.ingest(nested, keep_ids=True)

    # ---- shards ----

    def boundary_index(self, shards: int) -> DataFrame:
        placed = route(self.records, self.descriptors, self.ontology, shards)
        strong = rc.perspective_strong_hashes(self.records, self.descriptors, self.assignments, self.ontology.strong_attributes)
        return rc.boundary_index(key_rows(self.records, self.descriptors, self.ontology), self.assignments, placed, strong)

    def dirty_keys(self, before: DataFrame | None, shards: int) -> DataFrame:
        return rc.dirty_keys(before, self.boundary_index(shards))

    def apply_merges(self, merges: DataFrame) -> int:
        """Stores the assignments after merges across shards."""
        moved = rc.apply_merges(self.assignments, merges)
        version = F.lit(self.store.version() + 1).cast("long")
        return self.store.commit(replace={"assignments": materialise(moved.select("record_id", "cluster_id", version.alias("version")))}, ontology=self.ontology.to_json())

    def reconcile(self, boundaries: DataFrame, dirty: DataFrame | None = None) -> rc.Reconciliation:
        return rc.reconcile(boundaries, dirty)
