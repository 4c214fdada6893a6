"""Export of clusters and conflicts as a knowledge graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..plans.ontology import Ontology
from ..sources.shared import local_frame
from .cluster_keys import cluster_keys
from .conflicts import direct_conflicts
from .golden import golden, golden_json


@dataclass
class KnowledgeGraph:
    """nodes (id, node_type, properties), same_as and conflicts_with edges, metadata (name, value)."""

    nodes: DataFrame
    same_as: DataFrame
    conflicts_with: DataFrame
    #: (nodes, same_as): their numbers as sums over clusters, for which neither is made.
    sizes: DataFrame | None = None

    def counts(self) -> DataFrame:
        count = lambda name, f: f.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
        conflicts = count("conflicts_with", self.conflicts_with)
        if self.sizes is None:
            return count("nodes", self.nodes).union(count("same_as", self.same_as)).union(conflicts)
        both = self.sizes.select(F.explode(F.create_map(F.lit("nodes"), "nodes", F.lit("same_as"), "same_as")).alias("part", "n"))
        return both.union(conflicts)

    def metadata(self, version: str = "1.0") -> DataFrame:
        return self.counts().select(F.concat("part", F.lit("_count")).alias("name"), F.col("n").cast("string").alias("value")).union(local_frame(self.nodes.sparkSession, [("version", version)], "name string, value string"))

    def to_jsonl(self, version: str = "1.0") -> DataFrame:
        """One typed JSON line each; write with ``.write.text``."""
        line = lambda kind, df: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
        return line("metadata", self.metadata(version)).union(line("node", self.nodes)).union(line("same_as", self.same_as)).union(line("conflicts_with", self.conflicts_with))


def record_nodes(records: DataFrame) -> DataFrame:
    props = F.create_map(F.lit("entity_type"), F.col("entity_type"), F.lit("perspective"), F.col("perspective"), F.lit("uid"), F.col("uid"))
    return records.select(F.concat(F.lit("record_"), F.col("record_id").cast("string")).alias("id"), F.lit("record").alias("node_type"), props.alias("properties"))


def cluster_nodes(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, ontology: Ontology) -> DataFrame:
    size = assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    told = size.join(golden_json(golden(descriptors, assignments)), "cluster_id", "left").join(cluster_keys(records, descriptors, assignments, ontology), "cluster_id", "left")
    pairs = [("size", F.col("size").cast("string")), ("root_record", F.col("cluster_id").cast("string")), ("golden", F.coalesce("golden", F.lit("[]"))), ("cluster_key", F.col("cluster_key")), ("cluster_key_identity", F.col("identity_key"))]
    props = F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return told.select(F.concat(F.lit("cluster_"), F.col("cluster_id").cast("string")).alias("id"), F.lit("cluster").alias("node_type"), props.alias("properties"))


def same_as_edges(assignments: DataFrame, star: bool = False) -> DataFrame:
    """Edges between the records of a cluster, the smaller id first: all pairs, or with ``star`` those with its first.

    All pairs grow with the square of a cluster's size; ``star`` says the same in proportion to it.
    """
    a = assignments.select("cluster_id", F.col("record_id").alias("source"))
    b = assignments.select(F.col("cluster_id").alias("_c"), F.col("record_id").alias("target"))
    if star:
        edges = assignments.where("record_id <> cluster_id").select(F.col("cluster_id").alias("source"), F.col("record_id").alias("target"))
    else:
        edges = a.join(b, (F.col("cluster_id") == F.col("_c")) & (F.col("source") < F.col("target"))).select("source", "target")
    return edges.select("source", "target", F.lit(iv.NEG_INF).alias("start_ts"), F.lit(iv.POS_INF).alias("end_ts"), F.lit("cluster_member").alias("reason"))


def conflict_edges(direct: DataFrame, indirect: DataFrame | None = None) -> DataFrame:
    """Edges between the records of different values in a conflict slice; of an indirect conflict its first two."""
    exploded = direct.select("cluster_id", "attr", "start_ts", "end_ts", F.posexplode("values").alias("n", "v"))
    each = exploded.select("cluster_id", "attr", "start_ts", "end_ts", "n", F.explode("v.participants").alias("r"))
    x, y = each.alias("x"), each.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("cluster_id", "attr", "start_ts", "end_ts")]
    met = x.join(y, same[0] & same[1] & same[2] & same[3] & (F.col("x.n") < F.col("y.n")) & (F.col("x.r") != F.col("y.r")))
    edges = met.select(F.least("x.r", "y.r").alias("source"), F.greatest("x.r", "y.r").alias("target"), F.col("x.attr").alias("attribute"), F.col("x.start_ts").alias("start_ts"), F.col("x.end_ts").alias("end_ts"), F.lit("direct_conflict").alias("cause"))
    if indirect is not None:
        two = indirect.where(F.size("participants") >= 2).select(F.col("participants")[0].alias("p"), F.col("participants")[1].alias("q"), "attribute", "start_ts", "end_ts", "cause")
        edges = edges.unionByName(two.select(F.least("p", "q").alias("source"), F.greatest("p", "q").alias("target"), "attribute", "start_ts", "end_ts", "cause"))
    return edges.distinct()


def export_graph(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, ontology: Ontology, observed: DataFrame | None = None, star: bool = False) -> KnowledgeGraph:
    nodes = record_nodes(records).unionByName(cluster_nodes(records, descriptors, assignments, ontology))
    indirect = observed.where("obs_type = 'indirect'").select("participants", "attribute", "start_ts", "end_ts", "cause") if observed is not None else None
    clusters = assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("k"))
    pairs = F.col("k") - 1 if star else F.col("k") * (F.col("k") - 1) / 2
    sizes = clusters.agg((F.coalesce(F.sum("k"), F.lit(0)) + F.count(F.lit(1))).cast("long").alias("nodes"), F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("same_as"))
    return KnowledgeGraph(nodes, same_as_edges(assignments, star), conflict_edges(direct_conflicts(descriptors, assignments), indirect), sizes)


@dataclass
class GraphDiff:
    """What a table of the graph gained and lost."""

    added: DataFrame
    removed: DataFrame
    kept: DataFrame


def diff(before: DataFrame, after: DataFrame, keys: list[str]) -> GraphDiff:
    """Rows are told apart by all their columns, maps by their sorted entries."""
    told = lambda df: F.struct(*[F.array_sort(F.map_entries(c)) if t.startswith("map<") else F.col(c) for c, t in df.dtypes])
    named = lambda df: df.withColumn("_row", F.to_json(told(df), {"ignoreNullFields": "false"})).dropDuplicates([*keys, "_row"])
    b, a = named(before), named(after)

    def match(x, y, how):
        condition = x["_row"] == y["_row"]
        for c in keys:
            condition = condition & x[c].eqNullSafe(y[c])
        return x.join(y, condition, how).drop("_row")

    return GraphDiff(match(a, b, "left_anti"), match(b, a, "left_anti"), match(a, b, "left_semi"))


def to_dot(records: DataFrame, assignments: DataFrame, direct: DataFrame, limit: int = 1000) -> str:
    """A drawing in DOT, for graphs of at most ``limit`` records and as many edges; larger ones raise."""
    rows = assignments.join(records, "record_id").orderBy("cluster_id", "record_id").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} records; export the edge tables instead")
    out, last = ["graph clusters {", "  node [shape=box];"], None
    for r in rows:
        if r.cluster_id != last:
            if last is not None:
                out.append("  }")
            out += [f"  subgraph cluster_{r.cluster_id} {{", f'    label="C{r.cluster_id}";']
            last = r.cluster_id
        out.append(f'    R{r.record_id} [label="{r.entity_type}:{r.perspective}:{r.uid}"];')
    if last is not None:
        out.append("  }")
    edges = conflict_edges(direct).select("source", "target", "attribute").distinct().orderBy("source", "target", "attribute")
    drawn = edges.limit(limit + 1).collect()
    if len(drawn) > limit:
        raise ValueError(f"more than {limit} conflicts; export the edge tables instead")
    out += [f'  R{e.source} -- R{e.target} [style=dashed, label="{e.attribute}"];' for e in drawn]
    return "\n".join([*out, "}"]) + "\n"


def text_summary(assignments: DataFrame, observed: DataFrame) -> str:
    a = assignments.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("cluster_id").alias("clusters")).first()
    kinds = {r.kind: r.n for r in observed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}  # a few kinds
    return "\n".join([f"records: {a.records}", f"clusters: {a.clusters}", *(f"{k} conflicts: {n}" for k, n in sorted(kinds.items()))])


__all__ = ["GraphDiff", "KnowledgeGraph", "cluster_nodes", "conflict_edges", "diff", "export_graph", "record_nodes", "same_as_edges", "text_summary", "to_dot"]
