"""Golden records: what each cluster's attributes say without contradiction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval as iv
from .intervals import coalesce_intervals, dealt, segments


def cluster_values(descriptors: DataFrame, assignments: DataFrame) -> DataFrame:
    return dealt(descriptors, ["record_id"]).join(assignments, "record_id").select("cluster_id", "record_id", "attr", "value", "start_ts", "end_ts")


def golden(descriptors: DataFrame, assignments: DataFrame) -> DataFrame:
    """(cluster_id, attr, value, start_ts, end_ts): the times at which a value is the only one of its attribute."""
    keys = ["cluster_id", "attr"]
    merged = coalesce_intervals(dealt(cluster_values(descriptors, assignments).drop("record_id"), keys), [*keys, "value"])
    tagged = merged.withColumn("tag", F.dense_rank().over(Window.partitionBy(*keys).orderBy("value")))
    alone = segments(tagged, keys).where("n = 1").withColumnRenamed("tag_sum", "tag")
    whole = coalesce_intervals(alone.select(*keys, "tag", "start_ts", "end_ts"), [*keys, "tag"])
    names = tagged.select(*keys, "tag", "value").distinct()
    return whole.join(names, [*keys, "tag"]).select(*keys, "value", "start_ts", "end_ts")


def golden_at(golden_rows: DataFrame, instant: int) -> DataFrame:
    return golden_rows.where(iv.contains(iv.interval("start_ts", "end_ts"), F.lit(instant)))


def golden_within(golden_rows: DataFrame, start: int, end: int) -> DataFrame:
    """Clipped to [start, end)."""
    part = iv.meet(iv.interval("start_ts", "end_ts"), iv.interval(start, end))
    return golden_rows.withColumns({"_s": part.start, "_e": part.end}).where("_s < _e").withColumns({"start_ts": F.col("_s"), "end_ts": F.col("_e")}).drop("_s", "_e")


def golden_json(golden_rows: DataFrame) -> DataFrame:
    """(cluster_id, golden): a JSON list sorted by attribute, value and start."""
    row = F.struct("attr", "value", "start_ts", "end_ts")
    return golden_rows.groupBy("cluster_id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("golden"))
