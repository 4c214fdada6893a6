"""Key extraction, signatures and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ontology import ConstraintKind, IdentityKey, Ontology
from ..sources.shared import local_frame
from .intervals import coalesce_intervals, dealt


def value_intervals(descriptors: DataFrame, attrs: list[str], limit: int | None = None) -> DataFrame:
    """Each value's coalesced intervals within its record, at most ``limit`` of an attribute, the longest."""
    rows = descriptors.where(F.col("attr").isin(attrs)).select("record_id", "attr", "value", "start_ts", "end_ts")
    merged = coalesce_intervals(dealt(rows, ["record_id"]), ["record_id", "attr", "value"])  # by record alone: what follows needs no other exchange
    if limit is None:
        return merged
    length = F.try_subtract(F.col("end_ts"), F.col("start_ts"))  # NULL: beyond 64 bits, the longest
    best = Window.partitionBy("record_id", "attr").orderBy(length.desc_nulls_first(), "start_ts", "value")
    return merged.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n")


def key_rows_of(records: DataFrame, values: DataFrame, key: IdentityKey) -> DataFrame:
    """Rows of one key: the combinations of its attributes' values that hold at the same time."""

    def side(k: int, attr: str) -> DataFrame:
        of = values.where(F.col("attr") == attr)
        return of.select("record_id", F.struct("attr", "value").alias(f"v{k}"), F.col("start_ts").alias(f"s{k}"), F.col("end_ts").alias(f"e{k}"))

    sides = [side(k, a) for k, a in enumerate(key.attributes)]
    joined = reduce(lambda a, b: a.join(b, "record_id"), sides)
    names = range(len(sides))
    start = F.greatest(*[F.col(f"s{k}") for k in names]) if len(sides) > 1 else F.col("s0")
    end = F.least(*[F.col(f"e{k}") for k in names]) if len(sides) > 1 else F.col("e0")
    made = joined.select("record_id", F.lit(key.name).alias("key_name"), F.array(*[F.col(f"v{k}") for k in names]).alias("key_values"), start.alias("start_ts"), end.alias("end_ts"))
    return made.where("start_ts < end_ts").join(records.select("record_id", "entity_type"), "record_id")


def key_rows(records: DataFrame, descriptors: DataFrame, ontology: Ontology) -> DataFrame:
    """All keys' rows; a record without one of a key's attributes has none for it."""
    attrs = sorted({a for k in ontology.identity_keys for a in k.attributes})
    values = value_intervals(descriptors, attrs, ontology.key_intervals)
    rows = [key_rows_of(records, values, k).withColumn("key_order", F.lit(i)) for i, k in enumerate(ontology.identity_keys)]
    if not rows:
        spark = records.sparkSession
        return local_frame(spark, [], "record_id long, key_name string, key_values array<struct<attr:string,value:string>>, start_ts long, end_ts long, entity_type string, key_order int")
    return reduce(DataFrame.unionByName, rows)


def key_text(entity_type: Column, key_values: Column) -> Column:
    """The key's identity as one string; the key's name is no part of it."""
    parts = F.transform(key_values, lambda v: F.concat(v["attr"], F.lit("\u0001"), v["value"]))
    return F.concat(entity_type, F.lit("\u0002"), F.array_join(parts, "\u0002"))


def signature(entity_type: Column, key_values: Column) -> Column:
    """32 bytes that are the same on every shard."""
    return F.unhex(F.sha2(key_text(entity_type, key_values), 256))


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of records with the same key values at the same time."""
    keyed = rows.select("record_id", key_text(F.col("entity_type"), F.col("key_values")).alias("k"), "start_ts", "end_ts")
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.k") == F.col("b.k")) & (F.col("a.record_id") < F.col("b.record_id")) & (F.col("a.start_ts") < F.col("b.end_ts")) & (F.col("b.start_ts") < F.col("a.end_ts"))
    start, end = F.greatest("a.start_ts", "b.start_ts"), F.least("a.end_ts", "b.end_ts")
    return a.join(b, on).select(F.col("a.record_id").alias("record_a"), F.col("b.record_id").alias("record_b"), F.col("a.k").alias("k"), start.alias("start_ts"), end.alias("end_ts"))


def route_by_time(records: DataFrame, descriptors: DataFrame, ontology: Ontology, shards: int) -> DataFrame:
    """(record_id, shard): by the record's longest key row (of equals the first key, then the earliest start); records
    without a key by their identity."""
    rows = key_rows(records, descriptors, ontology)
    length = F.try_subtract(F.col("end_ts"), F.col("start_ts"))
    text = key_text(F.col("entity_type"), F.col("key_values"))
    order = F.struct(length.isNotNull().alias("bounded"), (-F.coalesce(length, F.lit(0))).alias("length"), "key_order", "start_ts", text.alias("k"))
    longest = rows.groupBy("record_id").agg(F.min(order).alias("o")).select("record_id", F.concat(F.lit("k\u0002"), F.col("o.k")).alias("_k"))
    placed = records.join(longest, "record_id", "left")
    name = F.coalesce("_k", F.concat_ws("\u0002", F.lit("i"), "entity_type", "perspective", "uid"))
    return placed.select("record_id", F.pmod(F.xxhash64(name), F.lit(shards)).cast("int").alias("shard"))


def route(records: DataFrame, descriptors: DataFrame, ontology: Ontology, shards: int) -> DataFrame:
    """(record_id, shard): by the first complete key, else the first constraint's attribute, else the identity.

    Values that a record lists first count; equal keys always share a shard.
    """
    position = F.col("position") if "position" in descriptors.columns else F.struct("start_ts", "end_ts", "value")
    attrs = sorted({a for k in ontology.identity_keys for a in k.attributes} | set(ontology.constraint_attributes))
    first = descriptors.where(F.col("attr").isin(attrs)).groupBy("record_id").pivot("attr", attrs or ["-"]).agg(F.min_by("value", position))
    wide = records.join(first, "record_id", "left")
    options = []
    for key in ontology.identity_keys:
        cols = [F.concat(F.lit(a + "="), F.col(f"`{a}`")) for a in key.attributes]
        options.append(F.concat(F.lit("k\u0002"), F.col("entity_type"), *[F.concat(F.lit("\u0002"), c) for c in cols]))
    for c in ontology.constraints:
        scope = F.concat(F.lit("\u0002"), F.col("perspective")) if c.kind == ConstraintKind.UNIQUE_WITHIN_PERSPECTIVE else F.lit("")
        options.append(F.concat(F.lit("c\u0002" + c.attribute + "="), F.col(f"`{c.attribute}`"), scope))
    options.append(F.concat_ws("\u0002", F.lit("i"), "entity_type", "perspective", "uid"))
    return wide.select("record_id", F.pmod(F.xxhash64(F.coalesce(*options)), F.lit(shards)).cast("int").alias("shard"))
