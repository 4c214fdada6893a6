"""Conflict detection: direct, within records, indirect, and violated constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..plans.ontology import ConstraintKind, Ontology
from ..sources.shared import local_frame
from .golden import cluster_values
from .intervals import coalesce_intervals, dealt, segments, with_islands


def _participants(column: str = "record_id") -> Column:
    return F.array_sort(F.collect_set(column))


def value_islands(values: DataFrame, keys: list[str]) -> DataFrame:
    """Each value's strictly overlapping intervals as one, with the records that take part."""
    numbered = with_islands(values, [*keys, "value"], touching=False)
    return numbered.groupBy(*keys, "value", "island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), _participants().alias("participants")).drop("island")


def conflict_slices(values: DataFrame, keys: list[str]) -> DataFrame:
    """Slices in which two values or more are active: (keys, start_ts, end_ts, values)."""
    islands = value_islands(dealt(values, keys), keys)
    contested = segments(islands.withColumn("tag", F.lit(0)), keys).where("n >= 2").select(*keys, "start_ts", "end_ts")
    x, y = contested.alias("x"), islands.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col("y.start_ts") <= F.col("x.start_ts"), F.col("y.end_ts") >= F.col("x.end_ts")]
    met = x.join(y, reduce(lambda a, b: a & b, on))
    grouped = met.groupBy(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.start_ts").alias("start_ts"), F.col("x.end_ts").alias("end_ts"))
    return grouped.agg(F.array_sort(F.collect_list(F.struct(F.col("y.value").alias("value"), F.col("y.participants").alias("participants")))).alias("values"))


def direct_conflicts(descriptors: DataFrame, assignments: DataFrame, merge_adjacent: bool = False) -> DataFrame:
    """Two values of one attribute at once within a cluster, cut at every boundary; or with neighbours merged that
    hold the same values and records."""
    found = conflict_slices(cluster_values(descriptors, assignments), ["cluster_id", "attr"])
    return _merge_neighbours(found, ["cluster_id", "attr"]) if merge_adjacent else found


def _merge_neighbours(slices: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("start_ts", "end_ts")
    same = F.lag("end_ts").over(order).eqNullSafe(F.col("start_ts")) & F.lag(F.col("values").cast("string")).over(order).eqNullSafe(F.col("values").cast("string"))
    marked = slices.withColumn("_new", F.when(same, 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.first("values").alias("values")).drop("_run")


def intra_record_conflicts(descriptors: DataFrame, ontology: Ontology, only: DataFrame | None = None) -> DataFrame:
    """The same within one record, for strong attributes; ``only`` (record_id) restricts it."""
    values = descriptors.where(F.col("attr").isin(ontology.strong_attributes or [""])).select("record_id", "attr", "value", "start_ts", "end_ts")
    if only is not None:
        values = values.join(only.select("record_id").distinct(), "record_id", "left_semi")
    return conflict_slices(values.withColumn("of", F.col("record_id")), ["of", "attr"]).withColumnRenamed("of", "record_id")


def first_records(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("cluster_id").agg(F.min("record_id").alias("record_id"))


def _first_key_values(descriptors: DataFrame, assignments: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """For each cluster the first value of each key attribute in its first record; missing attributes are skipped."""
    position = F.col("position") if "position" in descriptors.columns else F.struct("start_ts", "end_ts", "value")
    number = F.create_map(*[x for i, a in enumerate(attributes) for x in (F.lit(a), F.lit(i))])
    usable = descriptors.where(F.col("attr").isin(list(attributes)) & (F.col("end_ts") > 0))
    first = usable.join(first_records(assignments), "record_id").groupBy("cluster_id", "attr").agg(F.min_by("value", position).alias("value"))
    listed = first.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(number[F.col("attr")].alias("n"), "attr", "value"))).alias("kv"))
    return listed.select("cluster_id", F.transform("kv", lambda x: F.concat(x["attr"], F.lit("="), x["value"])).alias("parts"))


def indirect_conflicts(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, ontology: Ontology, target: DataFrame | None = None) -> DataFrame:
    """Clusters that share a key but were kept apart although they come from different perspectives and have no kind of
    strong attribute in common: (cluster_id, key_name, key_text, start_ts, end_ts, status).

    A cluster is represented by its first record, and keys with attributes
    missing still match.  ``target`` (cluster_id) restricts the result, whose
    status is then ``suppressed_merge``.
    """
    strong = list(dict.fromkeys([*ontology.strong_attributes, *ontology.constraint_attributes]))
    attrs = descriptors.where(F.col("attr").isin(strong or [""])).groupBy("record_id").agg(F.array_sort(F.collect_set("attr")).alias("attrs"))
    # perspectives and sets of attributes occur in few combinations, so clusters are compared by those
    shapes = assignments.join(records.select("record_id", "perspective"), "record_id").join(attrs, "record_id").select("cluster_id", "perspective", "attrs").distinct()
    out = []
    for key in ontology.identity_keys:
        listed = _first_key_values(descriptors, assignments, key.attributes).select("cluster_id", F.array_join("parts", "\u0002").alias("key_text"))
        kinds = listed.join(shapes, "cluster_id").groupBy("key_text", "perspective", "attrs").agg(F.min("cluster_id").alias("c1"), F.max("cluster_id").alias("c2"))
        x, y = kinds.alias("x"), kinds.alias("y")
        apart = (
            (F.col("x.key_text") == F.col("y.key_text"))
            & (F.col("x.perspective") < F.col("y.perspective"))
            & ~F.arrays_overlap("x.attrs", "y.attrs")
            & ~((F.col("x.c1") == F.col("x.c2")) & (F.col("y.c1") == F.col("y.c2")) & (F.col("x.c1") == F.col("y.c1")))
        )
        flagged = x.join(y, apart).select(F.col("x.key_text").alias("key_text")).distinct()
        hits = listed.join(flagged, "key_text").withColumn("key_name", F.lit(key.name))
        spans = (
            cluster_values(descriptors, assignments)
            .where(F.col("attr").isin(list(key.attributes)))
            .withColumn("part", F.concat("attr", F.lit("="), "value"))
            .join(hits.select("cluster_id", F.explode(F.split("key_text", "\u0002")).alias("part")).distinct(), ["cluster_id", "part"])
            .groupBy("cluster_id")
            .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
        )
        joined = hits.join(spans, "cluster_id", "left")
        out.append(joined.select("cluster_id", "key_name", "key_text", F.coalesce("start_ts", F.lit(0)).cast("long").alias("start_ts"), F.coalesce("end_ts", F.lit(1)).cast("long").alias("end_ts")))
    if not out:
        return local_frame(records.sparkSession, [], "cluster_id long, key_name string, key_text string, start_ts long, end_ts long, status string")
    made = reduce(DataFrame.unionByName, out)
    if target is None:
        return made.withColumn("status", F.lit("auto_resolved"))
    return made.join(target.select("cluster_id").distinct(), "cluster_id", "left_semi").withColumn("status", F.lit("suppressed_merge"))


def unique_in_cluster(descriptors: DataFrame, assignments: DataFrame, attribute: str, name: str) -> DataFrame:
    """Two values of a unique attribute at once within a cluster, with all holders of either."""
    values = dealt(cluster_values(descriptors.where(F.col("attr") == attribute), assignments), ["cluster_id"])
    holders = values.groupBy("cluster_id", "value").agg(_participants().alias("holders"))
    merged = coalesce_intervals(values.select("cluster_id", "value", "start_ts", "end_ts"), ["cluster_id", "value"])
    x, y = merged.alias("x"), merged.alias("y")
    on = (F.col("x.cluster_id") == F.col("y.cluster_id")) & (F.col("x.value") < F.col("y.value")) & (F.col("x.start_ts") < F.col("y.end_ts")) & (F.col("y.start_ts") < F.col("x.end_ts"))
    pairs = x.join(y, on).select(
        F.col("x.cluster_id").alias("cluster_id"), F.col("x.value").alias("value_a"), F.col("y.value").alias("value_b"), F.greatest("x.start_ts", "y.start_ts").alias("start_ts"), F.least("x.end_ts", "y.end_ts").alias("end_ts")
    )
    parts = coalesce_intervals(pairs, ["cluster_id", "value_a", "value_b"])
    a = holders.select("cluster_id", F.col("value").alias("value_a"), F.col("holders").alias("ha"))
    b = holders.select("cluster_id", F.col("value").alias("value_b"), F.col("holders").alias("hb"))
    met = parts.join(a, ["cluster_id", "value_a"]).join(b, ["cluster_id", "value_b"])
    return met.select("cluster_id", F.lit(name).alias("constraint"), F.lit(attribute).alias("attr"), "value_a", "value_b", "start_ts", "end_ts", F.array_sort(F.array_union("ha", "hb")).alias("participants"))


def unique_across_clusters(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, attribute: str, name: str) -> DataFrame:
    """The same unique value at once in two clusters of one perspective: a row for each pair of records."""
    values = cluster_values(descriptors.where(F.col("attr") == attribute), assignments).join(records.select("record_id", "perspective"), "record_id")
    x, y = values.alias("x"), values.alias("y")
    on = (
        (F.col("x.perspective") == F.col("y.perspective"))
        & (F.col("x.value") == F.col("y.value"))
        & (F.col("x.record_id") < F.col("y.record_id"))
        & (F.col("x.cluster_id") != F.col("y.cluster_id"))
        & (F.col("x.start_ts") < F.col("y.end_ts"))
        & (F.col("y.start_ts") < F.col("x.end_ts"))
    )
    return x.join(y, on).select(
        F.lit(name).alias("constraint"),
        F.lit(attribute).alias("attr"),
        F.col("x.perspective").alias("perspective"),
        F.col("x.value").alias("value"),
        F.col("x.record_id").alias("record_a"),
        F.col("y.record_id").alias("record_b"),
        F.greatest("x.start_ts", "y.start_ts").alias("start_ts"),
        F.least("x.end_ts", "y.end_ts").alias("end_ts"),
    )


_OBSERVATION = ["obs_type", "kind", "attribute", "start_ts", "end_ts", "participants", "cause", "status", "cluster_id"]


def observations(records: DataFrame, descriptors: DataFrame, assignments: DataFrame, ontology: Ontology, target: DataFrame | None = None, scoped: bool = False) -> DataFrame:
    """All conflicts as one table; ``target`` (cluster_id) restricts it to those clusters.

    ``scoped``: constraints within a perspective compare values of one
    perspective only; by default they act like plain unique ones inside a cluster.
    """
    here = assignments if target is None else assignments.join(target.select("cluster_id").distinct(), "cluster_id", "left_semi")
    text = lambda c: F.lit(c).cast("string")
    everyone = F.array_sort(F.array_distinct(F.flatten(F.transform("values", lambda v: v["participants"]))))
    direct = direct_conflicts(descriptors, here).select(text("direct").alias("obs_type"), text("direct").alias("kind"), F.col("attr").alias("attribute"), "start_ts", "end_ts", everyone.alias("participants"), text(None).alias("cause"), text(None).alias("status"), "cluster_id")
    inner = intra_record_conflicts(descriptors, ontology, here).join(here, "record_id")
    intra = inner.select(text("direct").alias("obs_type"), text("direct").alias("kind"), F.col("attr").alias("attribute"), "start_ts", "end_ts", F.array("record_id").alias("participants"), text(None).alias("cause"), text(None).alias("status"), "cluster_id")
    members = assignments.groupBy("cluster_id").agg(_participants().alias("participants"))
    apart = indirect_conflicts(records, descriptors, assignments, ontology, target).join(members, "cluster_id")
    indirect = apart.select(text("indirect").alias("obs_type"), text("indirect").alias("kind"), text(None).alias("attribute"), "start_ts", "end_ts", "participants", text("strong_id_conflict").alias("cause"), "status", "cluster_id")
    found = [direct, intra, indirect]
    violation = lambda df, who, cluster: df.select(text("indirect").alias("obs_type"), text("constraint_violation").alias("kind"), F.col("attr").alias("attribute"), "start_ts", "end_ts", who.alias("participants"), F.col("constraint").alias("cause"), text("violation").alias("status"), cluster.alias("cluster_id"))
    for c in ontology.constraints:
        if scoped and c.kind == ConstraintKind.UNIQUE_WITHIN_PERSPECTIVE:
            # a cluster's records of each perspective by themselves
            own = here.join(records.select("record_id", "perspective"), "record_id").select("record_id", F.struct("cluster_id", "perspective").alias("cluster_id"))
            found.append(violation(unique_in_cluster(descriptors, own, c.attribute, c.name), F.col("participants"), F.col("cluster_id")["cluster_id"]))
        else:
            found.append(violation(unique_in_cluster(descriptors, here, c.attribute, c.name), F.col("participants"), F.col("cluster_id")))
        if target is None and c.kind == ConstraintKind.UNIQUE:
            across = unique_across_clusters(records, descriptors, assignments, c.attribute, c.name)
            found.append(violation(across, F.array("record_a", "record_b"), F.lit(None).cast("long")))
    return reduce(DataFrame.unionByName, found).select(*_OBSERVATION)


def summarize(observed: DataFrame, records: DataFrame) -> DataFrame:
    """Observations with records as sorted (perspective, uid), equal rows once."""
    names = records.select("record_id", F.struct("perspective", "uid").alias("ref"))
    key = ["kind", "attribute", "start_ts", "end_ts", "cause", "participants"]  # whole columns: a hash could join two
    rows = observed.select(*key).distinct()
    met = rows.withColumn("record_id", F.explode("participants")).join(names, "record_id")
    listed = met.groupBy(*key).agg(F.array_sort(F.collect_set("ref")).alias("records"))
    return listed.drop("participants").distinct()


def evidence(observed: DataFrame) -> DataFrame:
    """``observed`` with ``evidence``, a sentence on each observation."""
    who = F.array_join(F.transform("participants", lambda p: p.cast("string")), ", ")
    when = F.concat(F.lit(" in ["), F.col("start_ts").cast("string"), F.lit(", "), F.col("end_ts").cast("string"), F.lit(")"))
    text = (
        F.when(F.col("kind") == "direct", F.concat(F.lit("different values of "), F.col("attribute"), F.lit(" at one time")))
        .when(F.col("kind") == "constraint_violation", F.concat(F.lit("constraint "), F.col("cause"), F.lit(" on "), F.col("attribute"), F.lit(" is violated")))
        .otherwise(F.concat(F.lit("records of one key were kept apart ("), F.coalesce("cause", F.lit("")), F.lit(")")))
    )
    return observed.withColumn("evidence", F.concat(text, when, F.lit(" by records "), who))


def list_conflicts(summaries: DataFrame, start: int = 0, end: int = 0, attribute: str = "") -> DataFrame:
    """Summaries, filtered by time where ``end > start`` and by attribute where one is given, in order."""
    out = summaries
    if end > start:
        out = out.where(iv.overlaps(iv.interval("start_ts", "end_ts"), iv.interval(start, end)))
    if attribute:
        out = out.where(F.col("attribute") == attribute)
    return out.orderBy("kind", "attribute", "start_ts", "end_ts", "cause", F.col("records").cast("string"))


def boundary_ratio(values: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct boundaries over twice the intervals, for each key: below one half, slices are the cheaper form."""
    marks = values.select(*keys, F.explode(F.array("start_ts", "end_ts")).alias("at"))
    counted = marks.groupBy(*keys).agg(F.countDistinct("at").alias("unique_boundaries"), F.count(F.lit(1)).alias("boundaries"))
    return counted.withColumn("algorithm", F.when(F.col("unique_boundaries") / F.col("boundaries") < 0.5, "atomic").otherwise("sweep"))
