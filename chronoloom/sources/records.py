"""Building the canonical tables from nested or wide inputs, and scans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval as iv
from .shared import materialise

NESTED = (
    "index bigint, identity struct<entity_type:string,perspective:string,uid:string>, "
    "descriptors array<struct<attr:string,value:string,start:bigint,end:bigint>>"
)
RECORDS = "record_id bigint, entity_type string, perspective string, uid string"
DESCRIPTORS = "record_id bigint, attr string, value string, start_ts bigint, end_ts bigint, position int"
IDENTITY = ["entity_type", "perspective", "uid"]


def invalid_records(nested: DataFrame) -> DataFrame:
    """Rows without a full identity, or with a descriptor that doesn't start before its end."""
    missing = F.coalesce(F.col("identity.entity_type"), F.lit("")) == ""
    missing = missing | (F.coalesce(F.col("identity.perspective"), F.lit("")) == "") | (F.coalesce(F.col("identity.uid"), F.lit("")) == "")
    backwards = F.exists(F.coalesce("descriptors", F.array()), lambda d: d["start"] >= d["end"])
    return nested.where(F.col("identity").isNull() | missing | F.coalesce(backwards, F.lit(False)))


def flat(nested: DataFrame, record_id: Column | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``records`` and ``descriptors`` of nested rows; wrong rows raise, or are left out unless ``strict``."""
    wrong = F.exists(F.coalesce("descriptors", F.array()), lambda d: d["start"] >= d["end"]) | F.col("identity").isNull()
    for part in IDENTITY:
        wrong = wrong | (F.coalesce(F.col(f"identity.{part}"), F.lit("")) == "")
    if strict:
        checked = nested.withColumn("identity", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("invalid record: no full identity, or an interval that doesn't start before its end")).cast("struct<entity_type:string,perspective:string,uid:string>")).otherwise(F.col("identity")))
    else:
        checked = nested.where(~F.coalesce(wrong, F.lit(False)))
    named = checked.withColumn("record_id", F.col("index") if record_id is None else record_id)
    records = named.select("record_id", "identity.entity_type", "identity.perspective", "identity.uid")
    rows = named.select("record_id", F.posexplode("descriptors").alias("position", "d"))
    return records, rows.select("record_id", "d.attr", "d.value", F.col("d.start").alias("start_ts"), F.col("d.end").alias("end_ts"), "position")


def nested(records: DataFrame, descriptors: DataFrame) -> DataFrame:
    """The nested form of the canonical tables."""
    order = F.col("position") if "position" in descriptors.columns else F.struct("attr", "start_ts", "end_ts", "value")
    row = F.struct(order.alias("o"), F.struct("attr", "value", F.col("start_ts").alias("start"), F.col("end_ts").alias("end")).alias("d"))
    listed = descriptors.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"]).alias("descriptors"))
    joined = records.join(listed, "record_id", "left")
    empty = F.array().cast("array<struct<attr:string,value:string,start:bigint,end:bigint>>")
    return joined.select(F.col("record_id").alias("index"), F.struct(*IDENTITY).alias("identity"), F.coalesce("descriptors", empty).alias("descriptors"))


def from_wide(df: DataFrame, record_id: Column, entity_type: Column, perspective: Column, uid: Column, attributes: dict[str, Column], start: Column, end: Column) -> tuple[DataFrame, DataFrame]:
    """A table with a column for each attribute; NULLs are no descriptors, all share the row's interval."""
    base = df.select(record_id.alias("record_id"), entity_type.alias("entity_type"), perspective.alias("perspective"), uid.cast("string").alias("uid"), start.alias("start_ts"), end.alias("end_ts"), *[c.cast("string").alias(f"_{a}") for a, c in attributes.items()])
    listed = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(f"_{a}").alias("value"), F.lit(i).alias("position")) for i, a in enumerate(attributes)])
    rows = base.select("record_id", "start_ts", "end_ts", F.explode(listed).alias("d")).where("d.value IS NOT NULL AND start_ts < end_ts")
    return base.select("record_id", *IDENTITY), rows.select("record_id", "d.attr", "d.value", "start_ts", "end_ts", "d.position")


def first_of_identity(records: DataFrame, order: str = "record_id") -> DataFrame:
    """One record for each identity: the first; later ones are dropped whole."""
    first = records.groupBy(*IDENTITY).agg(F.min_by(F.struct(*records.columns), order).alias("r"))
    return first.select("r.*")


def new_records(batch: DataFrame, stored: DataFrame, order: str = "record_id") -> DataFrame:
    """Of a batch the records whose identity isn't stored, each identity once."""
    return first_of_identity(batch, order).join(stored.select(*IDENTITY), IDENTITY, "left_anti")


def insert_if_absent(batch: DataFrame, stored: DataFrame, order: str = "record_id") -> DataFrame:
    """(index, record_id, inserted) for every batch row: the stored or the first record of its identity."""
    known = stored.select(*IDENTITY, F.col("record_id").alias("_known"))
    first = batch.groupBy(*IDENTITY).agg(F.min(order).alias("_first"))
    met = batch.join(first, IDENTITY).join(known, IDENTITY, "left")
    inserted = F.col("_known").isNull() & (F.col(order) == F.col("_first"))
    return met.select(F.col(order).alias("index"), F.coalesce("_known", "_first").alias("record_id"), inserted.alias("inserted"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``name``: 0, 1, 2, ... in the order of the columns ``order``.

    Rows are ranged by these; each range's count gives the next one its start,
    so no task sorts all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))  # a row for each range
    inside = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(starts, "_part").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_start")


def number_records(batch: DataFrame, after: int, order: str) -> DataFrame:
    """record_id from ``after`` + 1 on in the order of ingest, gapless."""
    return numbered(batch, [order], "_number").withColumn("record_id", F.col("_number") + F.lit(after + 1)).drop("_number")


# ---- scans ----------------------------------------------------------------------------------------------------------


def by_identity(records: DataFrame, entity_type: str, perspective: str, uid: str) -> DataFrame:
    return records.where((F.col("entity_type") == entity_type) & (F.col("perspective") == perspective) & (F.col("uid") == uid))


def by_ids(records: DataFrame, ids: list[int]) -> DataFrame:
    """The records of a few ids; a filter that reaches the scan."""
    return records.where(F.col("record_id").isin(ids))


def by_entity_type(records: DataFrame, entity_type: str) -> DataFrame:
    return records.where(F.col("entity_type") == entity_type)


def by_perspective(records: DataFrame, perspective: str) -> DataFrame:
    return records.where(F.col("perspective") == perspective)


def with_attribute(records: DataFrame, descriptors: DataFrame, attr: str) -> DataFrame:
    return records.join(descriptors.where(F.col("attr") == attr).select("record_id"), "record_id", "left_semi")


def in_interval(records: DataFrame, descriptors: DataFrame, start: int, end: int) -> DataFrame:
    """Records with a descriptor at some time in [start, end)."""
    hit = descriptors.where((F.col("start_ts") < end) & (F.col("end_ts") > start)).select("record_id")
    return records.join(hit, "record_id", "left_semi")


def value_in_interval(descriptors: DataFrame, attr: str, value: str, start: int, end: int) -> DataFrame:
    """(record_id, start_ts, end_ts): the times of a value, clipped."""
    hit = descriptors.where((F.col("attr") == attr) & (F.col("value") == value) & (F.col("start_ts") < end) & (F.col("end_ts") > start))
    part = iv.meet(iv.interval("start_ts", "end_ts"), iv.interval(start, end))
    return hit.select("record_id", part.start.alias("start_ts"), part.end.alias("end_ts"))


def for_attribute(descriptors: DataFrame, attr: str) -> DataFrame:
    return descriptors.where(F.col("attr") == attr)


def descriptors_in_interval(descriptors: DataFrame, start: int, end: int) -> DataFrame:
    return descriptors.where((F.col("start_ts") < end) & (F.col("end_ts") > start))


def value_index(descriptors: DataFrame) -> DataFrame:
    """(attr, value, records): all pairs with the number of records and descriptors they have."""
    return descriptors.groupBy("attr", "value").agg(F.countDistinct("record_id").alias("records"), F.count(F.lit(1)).alias("descriptors"))


def distinct_intervals(descriptors: DataFrame) -> DataFrame:
    return descriptors.select("start_ts", "end_ts").distinct()


def record_spans(descriptors: DataFrame) -> DataFrame:
    """(record_id, start_ts, end_ts, n): the hull and number of each record's intervals."""
    return descriptors.groupBy("record_id").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))


def id_page(records: DataFrame, start: int, end: int = 0, limit: int = 1000) -> DataFrame:
    """Records with ids in [start, end) in order, ``limit`` at most; ``end`` 0 is no end, ``limit`` 0 no limit."""
    if end and start >= end:
        raise ValueError("start must be below end")
    rows = records.where(F.col("record_id") >= start)
    if end:
        rows = rows.where(F.col("record_id") < end)
    rows = rows.orderBy("record_id")
    return rows.limit(limit) if limit else rows


def export_page(records: DataFrame, start: int, end: int = 0, limit: int = 1000) -> tuple[DataFrame, bool, int]:
    """A page, whether more follow, and where the next one starts (0: none)."""
    rows = id_page(records, start, end, limit + 1)
    ids = [r.record_id for r in rows.select("record_id").orderBy(F.desc("record_id")).limit(2).collect()]
    more = rows.count() > limit
    page = rows.orderBy("record_id").limit(limit)
    return page, more, (ids[1] + 1 if more else 0)


def id_bounds(records: DataFrame) -> DataFrame:
    return records.agg(F.min("record_id").alias("min_id"), F.max("record_id").alias("max_id"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 0).alias("empty"))
