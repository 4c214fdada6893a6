"""Crosswalks: which canonical entity a source's id stands for, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..plans.ontology import Ontology


def by_perspective(crosswalks: DataFrame, perspective: str) -> DataFrame:
    return crosswalks.where(F.col("perspective") == perspective)


def by_canonical_id(crosswalks: DataFrame, canonical_id: str) -> DataFrame:
    return crosswalks.where(F.col("canonical_id") == canonical_id)


def latest(crosswalks: DataFrame, order: str) -> DataFrame:
    """For each (perspective, uid) the entry that was added last."""
    last = Window.partitionBy("perspective", "uid").orderBy(F.desc(order), "canonical_id")
    return crosswalks.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def overlapping(crosswalks: DataFrame, start: int, end: int) -> DataFrame:
    return crosswalks.where(iv.overlaps(iv.interval("start_ts", "end_ts"), iv.interval(start, end)))


def active_at(crosswalks: DataFrame, at: int) -> DataFrame:
    """The entries that hold at an instant."""
    return crosswalks.where(iv.contains(iv.interval("start_ts", "end_ts"), F.lit(at)))


def resolve_records(records: DataFrame, crosswalks: DataFrame) -> DataFrame:
    """(record_id, canonical_id, start_ts, end_ts) of records that a crosswalk knows."""
    return records.join(crosswalks, ["perspective", "uid"]).select("record_id", "canonical_id", "start_ts", "end_ts")


def perspective_order(records: DataFrame, ontology: Ontology) -> DataFrame:
    """(perspective, weight, precedence): heavier perspectives come first; unknown ones weigh nothing."""
    weights = ontology.weights_frame(records.sparkSession)
    known = records.select("perspective").distinct().join(weights, "perspective", "left").select("perspective", F.coalesce("weight", F.lit(0)).alias("weight"))
    return known.withColumn("precedence", F.row_number().over(Window.orderBy(F.desc("weight"), "perspective")).cast("long"))  # a row for each source


def authoritative_perspectives(permanent: DataFrame, weights: DataFrame) -> DataFrame:
    """(attr, perspective): of the perspectives that own an attribute the heaviest, if it weighs anything."""
    owned = permanent.join(weights, "perspective").where("weight > 0")
    best = Window.partitionBy("attr").orderBy(F.desc("weight"), "perspective")
    return owned.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("attr", "perspective")
