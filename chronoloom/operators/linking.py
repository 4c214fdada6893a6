"""Clustering of records: islands, components, and greedy linking with vetoes.

``islands``     one key, no strong identifier, a record in one island: windows only.
``components``  several keys, no strong identifier: overlap components.
``greedy``      strong identifiers: links are made in record order and may be
                vetoed, so components with two values of a strong attribute in
                one perspective are replayed (pandas), each in one task; a
                component is all that can influence each other, and the others
                never reach Python.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ontology import Ontology
from ..sources.shared import materialise
from .components import label, led_components
from .intervals import coalesce_intervals, dealt, with_islands
from .keys import key_rows, key_text
from ..sources.records import numbered


def key_islands(rows: DataFrame) -> DataFrame:
    """Key rows with ``lead``, the smallest record of those that overlap in a chain under the same key values."""
    keyed = rows.select("record_id", key_text(F.col("entity_type"), F.col("key_values")).alias("k"), "start_ts", "end_ts")
    numbered = with_islands(dealt(keyed, ["k"]), ["k"], touching=False)
    return numbered.withColumn("lead", F.min("record_id").over(Window.partitionBy("k", "island")))


def link_islands(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Clusters where every record is in one island at most; otherwise its smallest lead names it."""
    leads = dealt(key_islands(rows), ["record_id"]).groupBy("record_id").agg(F.min("lead").alias("_lead"))
    return records.select("record_id").join(leads, "record_id", "left").select("record_id", F.coalesce("_lead", "record_id").alias("cluster_id"))


def link_components(records: DataFrame, rows: DataFrame) -> DataFrame:
    """Clusters over all keys: records that overlap under any key, transitively."""
    edges = key_islands(rows).select(F.col("record_id").alias("a"), F.col("lead").alias("b"))
    return label(records, led_components(edges))


def strong_summary(records: DataFrame, descriptors: DataFrame, attrs: list[str], by: DataFrame | None = None) -> DataFrame:
    """Coalesced intervals of strong values: for each record, or with ``by`` (record_id, cluster_id) for each cluster."""
    strong = dealt(descriptors.where(F.col("attr").isin(attrs)), ["record_id"]).join(records.select("record_id", "perspective"), "record_id")
    if by is not None:
        strong = strong.join(by, "record_id")
    key = "cluster_id" if by is not None else "record_id"
    rows = strong.select(key, "perspective", "attr", "value", "start_ts", "end_ts")
    return coalesce_intervals(rows if by is None else dealt(rows, [key]), [key, "perspective", "attr", "value"])


def veto_pairs(summary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) of groups those that may not merge: one perspective, one strong attribute, different values
    at the same time.  ``summary`` is (group, perspective, attr, value, start_ts, end_ts)."""
    x, y = summary.alias("x"), summary.alias("y")
    met = pairs.alias("p").join(x, F.col("p.a") == F.col("x.group")).join(
        y,
        (F.col("p.b") == F.col("y.group"))
        & (F.col("x.perspective") == F.col("y.perspective"))
        & (F.col("x.attr") == F.col("y.attr"))
        & (F.col("x.value") != F.col("y.value"))
        & (F.col("x.start_ts") < F.col("y.end_ts"))
        & (F.col("y.start_ts") < F.col("x.end_ts")),
    )
    return met.select("p.a", "p.b", F.col("x.perspective"), F.col("x.attr"), F.col("x.value").alias("value_a"), F.col("y.value").alias("value_b"), F.greatest("x.start_ts", "y.start_ts").alias("start_ts"), F.least("x.end_ts", "y.end_ts").alias("end_ts"))


#: Key rows that one task replays at a time, about; a component larger than that stays whole.
REPLAY_ROWS = 20_000

# ---- greedy linking -------------------------------------------------------------------------------------------------


@dataclass
class LinkOptions:
    """``stream``: a same-perspective clash closes the key for later records; ``batch``: it only refuses the merge.

    ``guard_check``: a merge is refused where both named records were merged
    before, at overlapping times, for different keys.  ``hot_key_cap``: a key
    with more overlapping clusters than this is closed (None: no limit), and
    with ``defer`` its records are compared once more when all are in.
    """

    mode: str = "stream"
    guard_check: bool = False
    hot_key_cap: int | None = None
    defer: bool = False


@dataclass
class _Cluster:
    """Strong values: (perspective, attribute) -> value -> intervals."""

    values: dict = field(default_factory=dict)

    def add(self, other: _Cluster) -> None:
        for key, by_value in other.values.items():
            mine = self.values.setdefault(key, {})
            for value, spans in by_value.items():
                mine.setdefault(value, []).extend(spans)

    def clashes(self, other: _Cluster, perspective: str | None = None) -> bool:
        for key, mine in self.values.items():
            theirs = other.values.get(key)
            if theirs is None or (perspective is not None and key[0] != perspective):
                continue
            for value, spans in mine.items():
                for value2, spans2 in theirs.items():
                    if value != value2 and any(s < e2 and s2 < e for s, e in spans for s2, e2 in spans2):
                        return True
        return False


class IntervalIndex:
    """Intervals of one key, found by overlap without a scan of all.

    Intervals lie in classes of similar length (by powers of two), each in order of start: those of a class that reach
    into a query start at most the class's greatest length before it, so two bisections bound them.  A class is a list
    of short blocks, so that adding to a long one moves little.
    """

    BLOCK = 512

    def __init__(self):
        self.classes: dict[int, list[list[tuple]]] = {}
        self.size = 0

    def add(self, record: int, start: int, end: int) -> None:
        blocks = self.classes.setdefault((end - start).bit_length(), [[]])
        entry = (start, self.size, end, record)
        self.size += 1
        at = max(0, bisect_right(blocks, entry, key=itemgetter(0)) - 1) if len(blocks) > 1 else 0
        block = blocks[at]
        insort(block, entry)
        if len(block) > self.BLOCK:
            half = len(block) // 2
            blocks[at : at + 1] = [block[:half], block[half:]]

    def overlapping(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """(record, start, end) of the intervals that overlap [start, end), in the order in which they were added."""
        found = []
        for length, blocks in self.classes.items():
            low = start - (1 << length)
            at = max(0, bisect_right(blocks, (low,), key=itemgetter(0)) - 1) if len(blocks) > 1 else 0
            while at < len(blocks) and blocks[at] and blocks[at][0][0] < end:
                block = blocks[at]
                for entry in block[bisect_right(block, (low,)) : bisect_right(block, (end,))]:
                    if entry[2] > start and entry[0] < end:
                        found.append((entry[1], entry[3], entry[0], entry[2]))
                at += 1
        found.sort()
        return [f[1:] for f in found]

    def __iter__(self):
        for blocks in self.classes.values():
            for block in blocks:
                for start, _, end, record in block:
                    yield record, start, end


class Replay:
    """Links records one after another; kept apart from Spark so that it can be tested alone."""

    def __init__(self, options: LinkOptions):
        self.options = options
        self.parent: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.perspective: dict[int, str] = {}
        self.cluster: dict[int, _Cluster] = {}
        self.guards: dict[int, list[tuple[int, int, str]]] = {}
        self.index: dict[str, IntervalIndex] = {}
        self.closed: set[str] = set()
        self.pending: dict[str, list[tuple[int, int, int]]] = {}
        self.log: list[tuple[int, int, str, str, int, int]] = []  # record, candidate, key, outcome, start, end

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def _guarded(self, a: int, b: int) -> bool:
        return any(r != r2 and s < e2 and s2 < e for s, e, r in self.guards.get(a, ()) for s2, e2, r2 in self.guards.get(b, ()))

    def _merge(self, record: int, root: int, span: tuple[int, int], key: str) -> bool:
        a, b = self.find(record), self.find(root)
        if a == b:
            return True
        if self.options.guard_check and self._guarded(record, root):
            return False
        if self.rank.get(a, 0) > self.rank.get(b, 0):
            a, b = b, a
        elif self.rank.get(a, 0) == self.rank.get(b, 0):
            self.rank[b] = self.rank.get(b, 0) + 1
        self.parent[a] = b
        for x in (record, root):
            self.guards.setdefault(x, []).append((*span, key))
        self.cluster[b].add(self.cluster.pop(a))
        return True

    def link(self, record: int, perspective: str, strong: dict, keys: Iterable[tuple[str, str, int, int]]) -> None:
        """``keys``: (key name, key text, start, end) in the order of the ontology."""
        self.parent[record] = record
        self.perspective[record] = perspective
        self.cluster[record] = _Cluster(strong)
        keys = list(keys)
        stream = self.options.mode == "stream"
        for name, text, start, end in keys:
            if text in self.closed:
                if text in self.pending:
                    self.pending[text].append((start, end, record))
                continue
            found: dict[int, tuple[int, int]] = {}
            known = self.index.get(text)
            for other, s, e in known.overlapping(start, end) if known else ():
                found.setdefault(self.find(other), (max(s, start), min(e, end)))
            cap = self.options.hot_key_cap
            if cap is not None and len(found) > cap:
                self.closed.add(text)
                if self.options.defer:
                    self.pending[text] = sorted({(s, e, r) for r, s, e in self.index[text]} | {(start, end, record)})
                continue
            for root in sorted(found):
                mine = self.find(record)
                now = self.find(root)
                if now == mine:
                    continue
                span = found[root]
                a, b = self.cluster[mine], self.cluster[now]
                if stream and self.perspective[root] == perspective and a.clashes(b, perspective):
                    self.closed.add(text)
                    self.log.append((record, root, name, "closed", *span))
                elif a.clashes(b):
                    self.log.append((record, root, name, "vetoed", *span))
                elif self._merge(record, root, span, name):
                    self.log.append((record, root, name, "merged", *span))
                else:
                    self.log.append((record, root, name, "guarded", *span))
        for _, text, start, end in keys:
            self.index.setdefault(text, IntervalIndex()).add(record, start, end)

    def link_deferred(self) -> None:
        """Sweeps over the records of keys that were closed for their size; only those of one perspective are merged,
        as a closed key says nothing across perspectives."""
        for text, members in sorted(self.pending.items()):
            active: list[tuple[int, int, int]] = []
            for start, end, record in sorted(members):
                active = [x for x in active if x[1] > start]
                for s, e, other in active:
                    a, b = self.find(record), self.find(other)
                    if a == b or self.perspective[record] != self.perspective[other]:
                        continue
                    span = (max(s, start), min(e, end))
                    if self.cluster[a].clashes(self.cluster[b]):
                        self.log.append((record, other, "deferred", "vetoed", *span))
                    elif self._merge(record, other, span, "deferred"):
                        self.log.append((record, other, "deferred", "merged", *span))
                active.append((start, end, record))

    def clusters(self) -> dict[int, int]:
        least: dict[int, int] = {}
        for x in self.parent:
            r = self.find(x)
            least[r] = min(least.get(r, x), x)
        return {x: least[self.find(x)] for x in self.parent}


def _replay(rows: pd.DataFrame, strong: pd.DataFrame, options: LinkOptions) -> Replay:
    values: dict[int, dict] = {}
    for r in strong.itertuples(index=False):
        values.setdefault(r.record_id, {}).setdefault((r.perspective, r.attr), {}).setdefault(r.value, []).append((r.start_ts, r.end_ts))
    run = Replay(options)
    columns = ["record_id", "key_order", "start_ts", "end_ts", "k", "key_name", "perspective"]
    ordered = sorted(zip(*(rows[c].tolist() for c in columns), strict=True))
    for record, of in groupby(ordered, key=itemgetter(0)):
        mine = list(of)
        run.link(record, mine[0][6], values.get(record, {}), [(r[5], r[4], r[2], r[3]) for r in mine])
    run.link_deferred()
    return run


def _components(keyed: DataFrame, edges: DataFrame) -> DataFrame:
    """(record_id, component) of the records of ``keyed``."""
    return label(keyed.select("record_id").distinct(), led_components(edges)).withColumnRenamed("cluster_id", "component")


def _overlap_edges(keyed: DataFrame) -> DataFrame:
    lead = with_islands(dealt(keyed, ["k"]), ["k"], touching=False).withColumn("b", F.min("record_id").over(Window.partitionBy("k", "island")))
    return lead.select(F.col("record_id").alias("a"), "b")


def _greedy_input(records: DataFrame, descriptors: DataFrame, ontology: Ontology, options: LinkOptions):
    """Key rows and strong values of components with a decision to take, and the other key rows.

    There is one only where a component has two values of a strong attribute in
    one perspective; else every overlap is a merge, in whatever order.
    """
    rows = key_rows(records, descriptors, ontology).join(records.select("record_id", "perspective"), "record_id")
    keyed = materialise(rows.select("record_id", "perspective", "key_name", "key_order", key_text(F.col("entity_type"), F.col("key_values")).alias("k"), "start_ts", "end_ts"))
    islands = _overlap_edges(keyed)
    if options.mode == "batch":  # decisions depend on records that overlap only
        edges = islands
    else:  # a closed key is closed for all times
        first = keyed.groupBy("k").agg(F.min("record_id").alias("b"))
        edges = keyed.join(first, "k").select(F.col("record_id").alias("a"), "b")
    placed = materialise(_components(keyed, edges))
    strong = materialise(strong_summary(records, descriptors, ontology.strong_attributes or [""]).join(placed, "record_id"))
    if options.guard_check or options.hot_key_cap is not None:  # these look at order everywhere
        contested = placed.groupBy("component").agg(F.min("record_id").alias("x"), F.max("record_id").alias("y")).where("x <> y").select("component")
    else:
        several = strong.groupBy("component", "perspective", "attr").agg(F.min("value").alias("x"), F.max("value").alias("y"))
        contested = several.where("x <> y").select("component").distinct()
    contested = materialise(contested)
    with_component = keyed.join(placed, "record_id")
    replayed = materialise(with_component.join(contested, "component", "left_semi"))
    free = keyed.join(placed.join(contested, "component", "left_anti").select("record_id"), "record_id", "left_semi")
    strong = strong.join(contested, "component", "left_semi")
    # columns of their own on both sides, so that a cogroup can tell them apart
    return replayed, strong.select(*[F.col(c).alias(c) for c in strong.columns]), free


def _replayed(keyed: DataFrame, strong: DataFrame, run, schema: str) -> DataFrame:
    """Replays components, many small ones at a time: those of a bucket together give what each alone would."""
    buckets = max(1, keyed.count() // REPLAY_ROWS)
    bucket = F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("int").alias("bucket")
    rows, values = keyed.select("*", bucket), strong.select("*", bucket)
    return rows.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInPandas(run, schema)


def link_greedy(records: DataFrame, descriptors: DataFrame, ontology: Ontology, options: LinkOptions | None = None) -> DataFrame:
    """Clusters made in record order under the veto of strong identifiers."""
    options = options or LinkOptions()
    replayed, strong, free = _greedy_input(records, descriptors, ontology, options)

    def run(key, rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"record_id": [], "cluster_id": []}, dtype="int64")
        made = _replay(rows, values, options).clusters()
        return pd.DataFrame({"record_id": list(made), "cluster_id": list(made.values())}, dtype="int64")

    made = _replayed(replayed, strong, run, "record_id long, cluster_id long")
    free = materialise(free)
    made = made.unionByName(_components(free, _overlap_edges(free)).withColumnRenamed("component", "cluster_id"))
    linked = made.select("record_id", F.col("cluster_id").alias("_c"))
    return records.select("record_id").join(linked, "record_id", "left").select("record_id", F.coalesce("_c", "record_id").alias("cluster_id"))


_LOG = "record_id long, candidate long, key_name string, outcome string, start_ts long, end_ts long"


def merge_log(records: DataFrame, descriptors: DataFrame, ontology: Ontology, options: LinkOptions | None = None) -> DataFrame:
    """What greedy linking decided: (record_id, candidate, key_name, outcome, start_ts, end_ts).

    Components without a decision to take are replayed as well: which records a merge names depends on their order.
    """
    options = options or LinkOptions()
    replayed, strong, free = _greedy_input(records, descriptors, ontology, options)
    free = free.join(_components(free, _overlap_edges(free)), "record_id").select(*replayed.columns)

    def run(key, rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        log = _replay(rows, values, options).log if not rows.empty else []
        return pd.DataFrame(log, columns=[c.split()[0] for c in _LOG.split(", ")])

    return _replayed(replayed, strong, run, _LOG).unionByName(_replayed(materialise(free), strong.where("false"), run, _LOG))


def merge_counts(records: DataFrame, descriptors: DataFrame, ontology: Ontology, options: LinkOptions | None = None) -> DataFrame:
    """(outcome, key_name, n) of the decisions that were refused: only components with one are replayed."""
    options = options or LinkOptions()
    replayed, strong, _ = _greedy_input(records, descriptors, ontology, options)

    def run(key, rows: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        log = _replay(rows, values, options).log if not rows.empty else []
        return pd.DataFrame([(x[3], x[2]) for x in log if x[3] != "merged"], columns=["outcome", "key_name"])

    return _replayed(replayed, strong, run, "outcome string, key_name string").groupBy("outcome", "key_name").agg(F.count(F.lit(1)).alias("n"))


def decides_in_order(ontology: Ontology, options: LinkOptions) -> bool:
    """Whether a merge can be refused, so that the order of records matters."""
    return bool(ontology.strong_identifiers) or options.guard_check or options.hot_key_cap is not None


def resolve(records: DataFrame, descriptors: DataFrame, ontology: Ontology, options: LinkOptions | None = None) -> DataFrame:
    """Assignments by the cheapest form that gives what greedy linking would."""
    options = options or LinkOptions()
    if decides_in_order(ontology, options):
        return link_greedy(records, descriptors, ontology, options)
    return link_components(records, key_rows(records, descriptors, ontology))


def linker_metrics(records: DataFrame, assignments: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """Counters of a linking: records, clusters, merges and, with a log or the counts of one, refused merges."""
    base = assignments.agg(F.count(F.lit(1)).alias("records"), F.countDistinct("cluster_id").alias("clusters"))
    base = base.withColumn("merges", F.col("records") - F.col("clusters"))
    if log is None:
        return base
    each = F.col("n") if "n" in log.columns else F.lit(1)
    refused = log.agg(F.coalesce(F.sum(F.when(F.col("outcome") != "merged", each)), F.lit(0)).cast("long").alias("refused"), F.countDistinct(F.when(F.col("outcome") == "closed", F.col("key_name"))).alias("closed_keys"))
    return base.crossJoin(refused)  # one row each


def dense_cluster_numbers(assignments: DataFrame) -> DataFrame:
    """cluster_id -> number from 0 in order of ids, for callers that want small numbers: ranges, counts, then ranks inside."""
    ids = assignments.select("cluster_id").distinct()
    return numbered(ids, ["cluster_id"], "number").select("cluster_id", "number")


def first_strong_clash(records: DataFrame, descriptors: DataFrame, ontology: Ontology, pairs: DataFrame) -> DataFrame:
    """For ``pairs`` (a, b): by the first strong value of each, ``resolvable`` where the perspectives' weights differ,
    ``unresolvable`` within one perspective, else ``none``; equal or disjoint values don't clash."""
    position = F.col("position") if "position" in descriptors.columns else F.struct("start_ts", "end_ts", "value")
    strong = descriptors.where(F.col("attr").isin(ontology.strong_attributes))
    first = strong.groupBy("record_id", "attr").agg(F.min_by(F.struct("value", "start_ts", "end_ts"), position).alias("d"))
    weights = ontology.weights_frame(records.sparkSession)
    who = records.select("record_id", "perspective").join(weights, "perspective", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    side = first.join(who, "record_id")
    x, y = side.alias("x"), side.alias("y")
    met = pairs.alias("p").join(x, F.col("p.a") == F.col("x.record_id")).join(y, (F.col("p.b") == F.col("y.record_id")) & (F.col("x.attr") == F.col("y.attr")))
    clash = (F.col("x.d.value") != F.col("y.d.value")) & (F.col("x.d.start_ts") < F.col("y.d.end_ts")) & (F.col("y.d.start_ts") < F.col("x.d.end_ts"))
    kind = F.when(F.col("x.weight") != F.col("y.weight"), "resolvable").when(F.col("x.perspective") == F.col("y.perspective"), "unresolvable").otherwise("none")
    return met.where(clash).select("p.a", "p.b", F.col("x.attr").alias("attr"), kind.alias("resolution"))


def split_unresolvable(assignments: DataFrame, clashes: DataFrame) -> DataFrame:
    """Dissolves clusters with an unresolvable clash into single records; for callers that ask for it."""
    bad = clashes.where("resolution = 'unresolvable'").select(F.col("a").alias("record_id")).join(assignments, "record_id").select("cluster_id").distinct().withColumn("_bad", F.lit(True))
    met = assignments.join(bad, "cluster_id", "left")
    return met.select("record_id", F.when(F.col("_bad"), F.col("record_id")).otherwise(F.col("cluster_id")).alias("cluster_id"))
