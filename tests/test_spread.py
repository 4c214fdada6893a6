"""Work is dealt to tasks by the input's size."""

from pyspark.sql import functions as F

from chronoloom.operators import cluster_keys as ck
from chronoloom.operators import conflicts as cf
from chronoloom.operators import golden as go
from chronoloom.operators import intervals as ops
from chronoloom.operators import keys as ky
from chronoloom.operators import reconcile as rc
from chronoloom.plans.ontology import Ontology


def on_disk(spark, tmp_path, df, name="t"):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def spans(spark, tmp_path, rows=4000, keys=500):
    at = (F.col("id") * 7919 % 1000).alias("start_ts")
    return on_disk(spark, tmp_path, spark.range(rows).select((F.col("id") % keys).alias("k"), F.col("id").alias("record_id"), at, (at + 5 + F.col("id") % 11).alias("end_ts")))


def test_interval_sets_follow_their_input(spark, tmp_path, monkeypatch):
    t = spans(spark, tmp_path)
    a, b = t.where("record_id % 2 = 0"), t.where("record_id % 2 = 1")
    before = {op: sorted(map(tuple, op(a, b, ["k"]).collect())) for op in (ops.intersect_sets, ops.subtract_sets, ops.has_overlap)}
    monkeypatch.setattr(ops, "DEALT_BYTES", 1000, raising=False)
    for op, rows in before.items():
        made = op(a, b, ["k"])
        assert sorted(map(tuple, made.collect())) == rows
        assert made.rdd.getNumPartitions() > 10  # 2 by the session


def test_one_bucket_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(ops, "TILE_ROWS", 10, raising=False)
    a = spark.range(0, 60, 1, 1).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("start_ts"), F.lit(5).cast("long").alias("end_ts"))
    b = spark.range(0, 40, 1, 1).select(F.col("id").alias("b"), F.lit(2).cast("long").alias("start_ts"), F.lit(9).cast("long").alias("end_ts"))
    met = ops.bucketed_overlap_join(a, b, 100, 0, 100).select("a", "b_r", F.spark_partition_id().alias("p"))
    rows = met.collect()
    assert sorted((r.a, r.b_r) for r in rows) == [(x, y) for x in range(60) for y in range(40)]
    tasks = [r.p for r in rows]
    assert max(tasks.count(p) for p in set(tasks)) < len(rows) / 3


KEYS = Ontology().add_identity_key("k", "k", "x")


def mastered(spark, tmp_path):
    """Records, descriptors with attributes k and x, and clusters of the records with one k."""
    t = spans(spark, tmp_path)
    said = [t.select("record_id", F.lit(a).alias("attr"), v.cast("string").alias("value"), "start_ts", "end_ts") for a, v in (("k", F.col("k")), ("x", F.col("record_id") % 3))]
    records = t.select("record_id", F.lit("t").alias("entity_type"), F.lit("p").alias("perspective"), F.col("record_id").cast("string").alias("uid"))
    return records, said[0].unionByName(said[1]), t.select("record_id", F.col("k").alias("cluster_id"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_rows_and_conflicts_follow_their_input(spark, tmp_path, monkeypatch):
    records, descriptors, assignments = mastered(spark, tmp_path)
    monkeypatch.setattr(ops, "DEALT_BYTES", 1000, raising=False)
    for made in (ky.key_rows(records, descriptors, KEYS), cf.direct_conflicts(descriptors, assignments)):
        assert made.rdd.getNumPartitions() > 10  # 2 by the session


def test_golden_and_boundaries_are_dealt_by_number(spark, tmp_path):
    records, descriptors, assignments = mastered(spark, tmp_path)
    assert "REPARTITION_BY_NUM" in plan(go.golden(descriptors, assignments))
    rows = ky.key_rows(records, descriptors, KEYS)
    strong = rc.perspective_strong_hashes(records, descriptors, assignments, ["x"])
    shards = records.select("record_id", F.lit(0).alias("shard"))
    own = rows.select("record_id", "entity_type", "key_values", "start_ts", "end_ts")
    assert "REPARTITION_BY_NUM" in plan(rc.boundary_index(on_disk(spark, tmp_path, own, "rows"), assignments, shards, strong, merged_only=True))


def test_cluster_keys_of_one_type_meet_in_no_task(spark, tmp_path):
    records, descriptors, assignments = mastered(spark, tmp_path)
    lines = plan(ck.cluster_keys(records, descriptors, assignments, KEYS)).split("\n")
    assert not [x for x in lines if "Join [entity_type" in x]
