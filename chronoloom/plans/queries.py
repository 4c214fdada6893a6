"""Every registered query of the engine with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import interval as iv
from ..functions import tokens as tk
from ..operators import cluster_keys as ck
from ..operators import conflicts as cf
from ..operators import crosswalk as cw
from ..operators import golden as go
from ..operators import graph as gr
from ..operators import intervals as ops
from ..operators import keys as ky
from ..operators import linking as ln
from ..operators import query as qu
from ..operators import reconcile as rc
from ..sources import records as src
from ..sources.shared import local_frame, shared_dir
from . import views as vw
from .ontology import ConstraintKind, Ontology
from .views import DAY, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def _ord(spark: SparkSession, sf_dir: str):
    """Orders with their clusters by customer, which windows alone give."""
    records, descriptors = vw.orders(spark, sf_dir)
    return records, descriptors, ln.link_islands(records, ky.key_rows(records, descriptors, vw.PLAIN_ORDERS))


def _joined(values, item):
    return F.array_join(F.transform(values, item), ",")


# ---- interval algebra ----

_PAIRS = """
p AS (SELECT o_orderkey, s AS s1, s + 15552000 AS e1, s + (o_custkey % 13 - 6) * 2592000 AS s2,
             s + (o_custkey % 13 - 6) * 2592000 + (o_orderkey % 7 + 1) * 2592000 AS e2 FROM t_ord)
"""


def _pairs(spark, sf_dir) -> DataFrame:
    s = iv.epoch_seconds(F.col("o_orderdate"))
    low = s + (F.col("o_custkey") % 13 - 6) * 30 * DAY
    return vw.table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s1"), (s + 180 * DAY).alias("e1"), low.alias("s2"), (low + (F.col("o_orderkey") % 7 + 1) * 30 * DAY).alias("e2"))


@register(_PAIRS.strip() + """
SELECT o_orderkey,
  CASE WHEN e1 < s2 THEN 'precedes' WHEN e2 < s1 THEN 'preceded_by' WHEN e1 = s2 THEN 'meets' WHEN e2 = s1 THEN 'met_by'
       WHEN s1 = s2 AND e1 = e2 THEN 'equals' WHEN s1 = s2 AND e1 < e2 THEN 'starts' WHEN s1 = s2 THEN 'started_by'
       WHEN e1 = e2 AND s1 < s2 THEN 'finishes' WHEN e1 = e2 THEN 'finished_by'
       WHEN s1 > s2 AND e1 < e2 THEN 'during' WHEN s1 < s2 AND e1 > e2 THEN 'contains'
       WHEN s1 < s2 THEN 'overlaps' ELSE 'overlapped_by' END AS relation FROM p""")
def allen_relation(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", iv.allen_relation(iv.interval("s1", "e1"), iv.interval("s2", "e2")).alias("relation"))


@register(_PAIRS.strip() + """
SELECT o_orderkey, s1 < e2 AND s2 < e1 AS overlaps, e1 = s2 OR e2 = s1 AS adjacent, s1 <= s2 AND e1 >= e2 AS encloses,
  CASE WHEN s1 < e2 AND s2 < e1 THEN greatest(s1, s2) END AS meet_start, CASE WHEN s1 < e2 AND s2 < e1 THEN least(e1, e2) END AS meet_end,
  CASE WHEN s1 <= e2 AND s2 <= e1 THEN least(s1, s2) END AS union_start, CASE WHEN s1 <= e2 AND s2 <= e1 THEN greatest(e1, e2) END AS union_end,
  greatest(least(e1, e2) - greatest(s1, s2), 0) AS overlap_duration FROM p""")
def interval_set_operations(spark, sf_dir):
    a, b = iv.interval("s1", "e1"), iv.interval("s2", "e2")
    both, hull = iv.intersect(a, b), iv.union(a, b)
    return _pairs(spark, sf_dir).select(
        "o_orderkey", iv.overlaps(a, b).alias("overlaps"), iv.adjacent(a, b).alias("adjacent"), iv.encloses(a, b).alias("encloses"),
        both["start_ts"].alias("meet_start"), both["end_ts"].alias("meet_end"), hull["start_ts"].alias("union_start"), hull["end_ts"].alias("union_end"),
        iv.overlap_duration(a, b).alias("overlap_duration"),
    )


@register(_PAIRS.strip() + """
SELECT o_orderkey, s1 AS start_ts, least(e1, s2) AS end_ts FROM p WHERE s1 < e2 AND s2 < e1 AND s1 < s2
UNION ALL SELECT o_orderkey, greatest(s1, e2), e1 FROM p WHERE s1 < e2 AND s2 < e1 AND e2 < e1
UNION ALL SELECT o_orderkey, s1, e1 FROM p WHERE NOT (s1 < e2 AND s2 < e1)""")
def interval_difference(spark, sf_dir):
    pieces = F.explode(iv.difference(iv.interval("s1", "e1"), iv.interval("s2", "e2"))).alias("d")
    return _pairs(spark, sf_dir).select("o_orderkey", pieces).select("o_orderkey", "d.start_ts", "d.end_ts")


@register("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN NULL ELSE 15552000 END AS duration,
  CASE WHEN o_orderkey % 3 = 2 THEN 15552000 ELSE 0 END AS duration_or_zero,
  CASE WHEN o_orderkey % 3 = 0 THEN '(-∞' ELSE '[' || s END || ', ' || CASE WHEN o_orderkey % 3 = 1 THEN '+∞' ELSE CAST(s + 15552000 AS VARCHAR) END || ')' AS shown,
  (o_orderkey % 3 = 0 OR s <= 900000000) AND (o_orderkey % 3 = 1 OR 900000000 < s + 15552000) AS holds FROM t_ord""")
def interval_properties(spark, sf_dir):
    s, k = iv.epoch_seconds(F.col("o_orderdate")), F.col("o_orderkey") % 3
    i = iv.closed_with(F.when(k != 0, s), F.when(k != 1, s + 180 * DAY))
    return vw.table(spark, sf_dir, "orders").select("o_orderkey", iv.duration(i).alias("duration"), iv.duration_or_zero(i).alias("duration_or_zero"), iv.display(i).alias("shown"), iv.contains(i, F.lit(900_000_000)).alias("holds"))


_ISLANDS = """
st AS (SELECT o_custkey, o_orderstatus, s AS start_ts, s + 15552000 AS end_ts FROM t_ord),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY {k} ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st {w}),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts {op} reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
"""


def _statuses(spark, sf_dir) -> DataFrame:
    s = iv.epoch_seconds(F.col("o_orderdate"))
    return vw.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", s.alias("start_ts"), (s + 180 * DAY).alias("end_ts"))


@register(_ISLANDS.format(k="o_custkey, o_orderstatus", op=">", w="").strip() + """
SELECT o_custkey, o_orderstatus, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM g GROUP BY o_custkey, o_orderstatus, island""")
def coalesce_same_value(spark, sf_dir):
    return ops.coalesce_intervals(_statuses(spark, sf_dir), ["o_custkey", "o_orderstatus"])


@register(_ISLANDS.format(k="o_custkey", op=">=", w="").strip() + """
SELECT o_custkey, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM g GROUP BY o_custkey, island""")
def coalesce_strict(spark, sf_dir):
    return ops.coalesce_intervals(_statuses(spark, sf_dir), ["o_custkey"], touching=False, aggs=[F.count(F.lit(1)).alias("n")])


@register("""
st AS (SELECT o_custkey, o_orderstatus, s AS start_ts, s + 15552000 AS end_ts FROM t_ord),
t AS (SELECT *, CASE WHEN lag(o_orderstatus) OVER w = o_orderstatus THEN 0 ELSE 1 END AS turn FROM st WINDOW w AS (PARTITION BY o_custkey ORDER BY start_ts, end_ts, o_orderstatus)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY o_custkey ORDER BY start_ts, end_ts, o_orderstatus ROWS UNBOUNDED PRECEDING) AS stretch FROM t),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY o_custkey, stretch ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey, stretch ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, o_orderstatus, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM g GROUP BY o_custkey, stretch, island, o_orderstatus""")
def coalesce_runs(spark, sf_dir):
    return ops.coalesce_runs(_statuses(spark, sf_dir), ["o_custkey"], "o_orderstatus")


@register("""
b AS (SELECT DISTINCT o_custkey, unnest([s, s + 15552000]) AS pt FROM t_ord),
l AS (SELECT o_custkey, pt AS start_ts, lead(pt) OVER (PARTITION BY o_custkey ORDER BY pt) AS end_ts FROM b)
SELECT * FROM l WHERE end_ts IS NOT NULL""")
def atomic_intervals(spark, sf_dir):
    return ops.atomic_intervals(_statuses(spark, sf_dir), ["o_custkey"])


_SETS = """
st AS (SELECT DISTINCT o_custkey, o_orderstatus, s AS start_ts, s + 15552000 AS end_ts FROM t_ord),
b AS (SELECT DISTINCT o_custkey, unnest([start_ts, end_ts]) AS pt FROM st),
l AS (SELECT o_custkey, pt AS s, lead(pt) OVER (PARTITION BY o_custkey ORDER BY pt) AS e FROM b),
c AS (SELECT l.o_custkey, l.s, l.e, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o FROM l JOIN st ON l.o_custkey = st.o_custkey AND start_ts <= l.s AND end_ts >= l.e GROUP BY ALL),
m AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c WHERE {cond}),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT o_custkey, min(s) AS start_ts, max(e) AS end_ts FROM g GROUP BY o_custkey, island"""


@register(_SETS.format(cond="f AND o"))
def interval_sets_intersect(spark, sf_dir):
    st = _statuses(spark, sf_dir)
    return ops.intersect_sets(st.where("o_orderstatus = 'F'"), st.where("o_orderstatus = 'O'"), ["o_custkey"])


@register(_SETS.format(cond="f AND NOT o"))
def interval_sets_subtract(spark, sf_dir):
    st = _statuses(spark, sf_dir)
    return ops.subtract_sets(st.where("o_orderstatus = 'F'"), st.where("o_orderstatus = 'O'"), ["o_custkey"])


@register("SELECT DISTINCT a.o_custkey FROM t_ord a JOIN t_ord b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' AND a.s < b.s + 15552000 AND b.s < a.s + 15552000")
def interval_sets_overlap(spark, sf_dir):
    st = _statuses(spark, sf_dir)
    return ops.has_overlap(st.where("o_orderstatus = 'F'"), st.where("o_orderstatus = 'O'"), ["o_custkey"])


@register("""
SELECT a.c_custkey AS a, b.s_suppkey AS b FROM (SELECT c_custkey, c_custkey % 997 AS s, c_custkey % 997 + 3 AS e FROM customer) a
JOIN (SELECT s_suppkey, s_suppkey * 7 % 997 AS s, s_suppkey * 7 % 997 + 1 + s_suppkey % 40 AS e FROM supplier) b ON a.s < b.e AND b.s < a.e""")
def interval_join(spark, sf_dir):
    s = F.col("c_custkey") % 997
    a = vw.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), s.alias("start_ts"), (s + 3).alias("end_ts"))
    t = F.col("s_suppkey") * 7 % 997
    b = vw.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), t.alias("start_ts"), (t + 1 + F.col("s_suppkey") % 40).alias("end_ts"))
    return ops.bucketed_overlap_join(a, b, 10, 0, 1100).select("a", F.col("b_r").alias("b"))


@register("SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds, epoch_us(ts) AS micros, epoch_us(ts) // 1000000 - 19800 AS utc FROM events")
def instants(spark, sf_dir):
    s = iv.epoch_seconds(F.col("ts"))
    return vw.table(spark, sf_dir, "events").select("event_id", s.alias("seconds"), iv.epoch_micros(F.col("ts")).alias("micros"), iv.shift_to_utc(s, F.lit(19_800)).alias("utc"))


# ---- sources and scans ----

_IDENT = "e AS (SELECT event_id AS record_id, event_type AS entity_type, 'src' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS perspective, CAST(user_id AS VARCHAR) AS uid FROM events)\n"


def _by_user(spark, sf_dir) -> DataFrame:
    source = F.concat(F.lit("src"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    return vw.table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("entity_type"), source.alias("perspective"), F.col("user_id").cast("string").alias("uid"))


@register(_IDENT + "SELECT min(record_id) AS record_id, entity_type, perspective, uid FROM e GROUP BY entity_type, perspective, uid")
def dedup_by_identity(spark, sf_dir):
    return src.first_of_identity(_by_user(spark, sf_dir))


@register(_IDENT + """SELECT b.record_id AS index, coalesce(s.r, b.r) AS record_id, s.r IS NULL AND b.record_id = b.r AS inserted
FROM (SELECT *, min(record_id) OVER (PARTITION BY entity_type, perspective, uid) AS r FROM e WHERE record_id % 2 = 1) b
LEFT JOIN (SELECT entity_type, perspective, uid, min(record_id) AS r FROM e WHERE record_id % 2 = 0 GROUP BY ALL) s USING (entity_type, perspective, uid)""")
def add_if_absent(spark, sf_dir):
    e = _by_user(spark, sf_dir)
    return src.insert_if_absent(e.where("record_id % 2 = 1"), src.first_of_identity(e.where("record_id % 2 = 0")))


@register("SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 100 AS record_id FROM (SELECT o_orderkey, o_orderdate FROM orders)")
def number_records(spark, sf_dir):
    rows = vw.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").withColumn("o", F.struct("o_orderdate", "o_orderkey"))
    return src.number_records(rows, 100, "o").drop("o")


@register("SELECT record_id, entity_type, perspective, uid FROM r_ord WHERE perspective = '2-HIGH'")
def records_by_perspective(spark, sf_dir):
    return src.by_perspective(vw.orders(spark, sf_dir)[0], "2-HIGH")


@register("SELECT r.* FROM r_li r WHERE entity_type = 'line'")
def records_by_entity_type(spark, sf_dir):
    return src.by_entity_type(vw.lines(spark, sf_dir)[0], "line")


@register("SELECT * FROM r_doc WHERE record_id IN (SELECT record_id FROM d_doc WHERE attr = 'lang')")
def records_with_attribute(spark, sf_dir):
    return src.with_attribute(*vw.texts(spark, sf_dir), "lang")


@register("SELECT * FROM r_ord WHERE record_id IN (SELECT record_id FROM d_ord WHERE start_ts < 900000000 AND end_ts > 890000000)")
def records_in_interval(spark, sf_dir):
    return src.in_interval(*vw.orders(spark, sf_dir), 890_000_000, 900_000_000)


@register("SELECT record_id, greatest(start_ts, 890000000) AS start_ts, least(end_ts, 900000000) AS end_ts FROM d_ord WHERE attr = 'status' AND value = 'F' AND start_ts < 900000000 AND end_ts > 890000000")
def value_in_interval(spark, sf_dir):
    return src.value_in_interval(vw.orders(spark, sf_dir)[1], "status", "F", 890_000_000, 900_000_000)


@register("SELECT record_id, attr, value, start_ts, end_ts FROM d_ord WHERE attr = 'status' AND start_ts < 900000000 AND end_ts > 890000000")
def descriptors_in_interval(spark, sf_dir):
    rows = src.descriptors_in_interval(src.for_attribute(vw.orders(spark, sf_dir)[1], "status"), 890_000_000, 900_000_000)
    return rows.drop("position")


@register("SELECT attr, value, count(DISTINCT record_id) AS records, count(*) AS descriptors FROM d_doc GROUP BY attr, value")
def value_index(spark, sf_dir):
    return src.value_index(vw.texts(spark, sf_dir)[1])


@register("SELECT DISTINCT start_ts, end_ts FROM d_ord")
def distinct_intervals(spark, sf_dir):
    return src.distinct_intervals(vw.orders(spark, sf_dir)[1])


@register("SELECT record_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n FROM d_doc GROUP BY record_id")
def record_spans(spark, sf_dir):
    return src.record_spans(vw.texts(spark, sf_dir)[1])


@register("SELECT * FROM r_ord WHERE record_id >= 100 AND record_id < 5000 ORDER BY record_id LIMIT 500")
def id_range_page(spark, sf_dir):
    return src.id_page(vw.orders(spark, sf_dir)[0], 100, 5000, 500)


@register("SELECT min(record_id) AS min_id, max(record_id) AS max_id, count(*) AS n, count(*) = 0 AS empty FROM r_ord")
def id_bounds(spark, sf_dir):
    return src.id_bounds(vw.orders(spark, sf_dir)[0])


@register("SELECT record_id AS index, entity_type || ':' || perspective || ':' || uid AS identity, (SELECT string_agg(attr || '=' || value || '@' || start_ts || ':' || end_ts, ',' ORDER BY attr) FROM d_ord d WHERE d.record_id = r.record_id) AS descriptors FROM r_ord r")
def export_nested(spark, sf_dir):
    rows = src.nested(*vw.orders(spark, sf_dir))
    one = lambda d: F.concat(d["attr"], F.lit("="), d["value"], F.lit("@"), d["start"].cast("string"), F.lit(":"), d["end"].cast("string"))
    back = src.nested(*src.flat(rows))
    i = F.col("identity")
    return back.select("index", tk.display_identity(i["entity_type"], i["perspective"], i["uid"]).alias("identity"), F.array_join(F.transform("descriptors", one), ",").alias("descriptors"))


@register("""
pg AS (SELECT record_id FROM r_ord WHERE record_id >= 100 ORDER BY record_id LIMIT 50), c AS (SELECT count(*) > 50 AS more FROM r_ord WHERE record_id >= 100)
SELECT record_id, more AS has_more, CASE WHEN more THEN (SELECT max(record_id) + 1 FROM pg) ELSE 0 END AS next_id FROM pg, c""")
def export_page(spark, sf_dir):
    page, more, after = src.export_page(vw.orders(spark, sf_dir)[0], 100, 0, 50)
    return page.select("record_id", F.lit(more).alias("has_more"), F.lit(after).cast("long").alias("next_id"))


@register("SELECT record_id, perspective, uid FROM r_ord WHERE record_id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def records_by_id(spark, sf_dir):
    return src.by_ids(vw.orders(spark, sf_dir)[0], [1, 2, 3, 5, 8, 13, 21, 34, 55, 89]).select("record_id", "perspective", "uid")


# ---- keys and linking ----


@register("SELECT record_id, 'cust=' || value AS k, start_ts, end_ts FROM d_ord WHERE attr = 'cust'")
def key_rows_single(spark, sf_dir):
    rows = ky.key_rows(*vw.orders(spark, sf_dir), vw.PLAIN_ORDERS)
    return rows.select("record_id", _joined("key_values", lambda v: F.concat(v["attr"], F.lit("="), v["value"])).alias("k"), "start_ts", "end_ts")


@register("SELECT record_id, 'part=' || l_partkey || ',supp=' || l_suppkey AS k, s AS start_ts, s + 31536000 AS end_ts FROM t_li")
def key_rows_composite(spark, sf_dir):
    rows = ky.key_rows(*vw.lines(spark, sf_dir), vw.LINES)
    return rows.select("record_id", _joined("key_values", lambda v: F.concat(v["attr"], F.lit("="), v["value"])).alias("k"), "start_ts", "end_ts")


@register("SELECT record_id, upper(sha256('order' || chr(2) || 'cust' || chr(1) || value)) AS signature FROM d_ord WHERE attr = 'cust'")
def key_signatures(spark, sf_dir):
    rows = ky.key_rows(*vw.orders(spark, sf_dir), vw.PLAIN_ORDERS)
    return rows.select("record_id", F.hex(ky.signature(F.col("entity_type"), F.col("key_values"))).alias("signature"))


@register("SELECT a.record_id AS record_a, b.record_id AS record_b, greatest(a.start_ts, b.start_ts) AS start_ts, least(a.end_ts, b.end_ts) AS end_ts FROM k_ord a JOIN k_ord b ON a.k = b.k AND a.record_id < b.record_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts")
def candidate_pairs(spark, sf_dir):
    return ky.candidate_pairs(ky.key_rows(*vw.orders(spark, sf_dir), vw.PLAIN_ORDERS)).drop("k")


@register("SELECT value AS cust, 1 AS shards FROM d_ord WHERE attr = 'cust' GROUP BY value")
def routing_by_key(spark, sf_dir):
    records, descriptors = vw.orders(spark, sf_dir)
    placed = ky.route(records, descriptors, vw.PLAIN_ORDERS, 16)
    met = descriptors.where("attr = 'cust'").join(placed, "record_id")
    return met.groupBy(F.col("value").alias("cust")).agg(F.countDistinct("shard").alias("shards"))


@register("SELECT record_id, cluster_id FROM a_ord")
def island_clusters(spark, sf_dir):
    return _ord(spark, sf_dir)[2]


@register("""
kk AS (SELECT record_id, 'h' || value AS k, start_ts, end_ts FROM d_doc WHERE attr = 'hash'
       UNION ALL SELECT a.record_id, 's' || a.value || '/' || b.value, a.start_ts, a.end_ts FROM d_doc a JOIN d_doc b USING (record_id) WHERE a.attr = 'source' AND b.attr = 'chars'),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY k ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kk),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM m),
edge AS (SELECT DISTINCT a.record_id AS a, b.record_id AS b FROM g a JOIN g b ON a.k = b.k AND a.island = b.island),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT r.record_id, coalesce((SELECT min(b) FROM reach WHERE a = r.record_id), r.record_id) AS cluster_id FROM r_doc r""")
def component_clusters(spark, sf_dir):
    records, descriptors = vw.texts(spark, sf_dir)
    return ln.link_components(records, ky.key_rows(records, descriptors, vw.TEXTS))


@register("""
st AS (SELECT v.cluster_id, r.perspective, v.attr, v.value, v.start_ts, v.end_ts FROM v_ord v JOIN r_ord r USING (record_id) WHERE attr = 'status'),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY cluster_id, perspective, value ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, perspective, value ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT cluster_id, perspective, attr, value, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM g GROUP BY cluster_id, perspective, attr, value, island""")
def strong_summary(spark, sf_dir):
    records, descriptors, assignments = _ord(spark, sf_dir)
    return ln.strong_summary(records, descriptors, ["status"], assignments)


@register("""
SELECT a.record_id AS a, b.record_id AS b, r.perspective, x.value AS value_a, y.value AS value_b, greatest(x.start_ts, y.start_ts) AS start_ts, least(x.end_ts, y.end_ts) AS end_ts
FROM k_ord a JOIN k_ord b ON a.k = b.k AND a.record_id < b.record_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts
JOIN r_ord r ON r.record_id = a.record_id JOIN r_ord q ON q.record_id = b.record_id AND q.perspective = r.perspective
JOIN d_ord x ON x.record_id = a.record_id AND x.attr = 'status' JOIN d_ord y ON y.record_id = b.record_id AND y.attr = 'status' AND y.value <> x.value""")
def veto_pairs(spark, sf_dir):
    records, descriptors = vw.orders(spark, sf_dir)
    pairs = ky.candidate_pairs(ky.key_rows(records, descriptors, vw.PLAIN_ORDERS)).select(F.col("record_a").alias("a"), F.col("record_b").alias("b"))
    summary = ln.strong_summary(records, descriptors, ["status"]).withColumnRenamed("record_id", "group")
    return ln.veto_pairs(summary, pairs).drop("attr")


@register("""
w AS (SELECT * FROM (VALUES ('1-URGENT', 50), ('2-HIGH', 40), ('3-MEDIUM', 30)) t(perspective, weight))
SELECT a.record_id AS a, b.record_id AS b, CASE WHEN coalesce(wa.weight, 0) <> coalesce(wb.weight, 0) THEN 'resolvable' WHEN r.perspective = q.perspective THEN 'unresolvable' ELSE 'none' END AS resolution
FROM k_ord a JOIN k_ord b ON a.k = b.k AND a.record_id < b.record_id AND a.start_ts < b.end_ts AND b.start_ts < a.end_ts
JOIN r_ord r ON r.record_id = a.record_id JOIN r_ord q ON q.record_id = b.record_id LEFT JOIN w wa ON wa.perspective = r.perspective LEFT JOIN w wb ON wb.perspective = q.perspective
JOIN d_ord x ON x.record_id = a.record_id AND x.attr = 'status' JOIN d_ord y ON y.record_id = b.record_id AND y.attr = 'status' AND y.value <> x.value""")
def strong_id_resolution(spark, sf_dir):
    records, descriptors = vw.orders(spark, sf_dir)
    pairs = ky.candidate_pairs(ky.key_rows(records, descriptors, vw.PLAIN_ORDERS)).select(F.col("record_a").alias("a"), F.col("record_b").alias("b"))
    return ln.first_strong_clash(records, descriptors, vw.ORDERS, pairs).drop("attr")


#: A replay in record order as a recursion: ``z`` (comp, record_id, persp, val, s, e) holds the records of each key; a step takes the
#: next pending cluster of the record at hand, or goes on to the next record and lists the clusters that overlap it.
_REPLAY = """
zc AS (SELECT comp, count(*) AS n, list(record_id ORDER BY record_id) AS ids, list(persp ORDER BY record_id) AS ps, list(val ORDER BY record_id) AS vs, list(s ORDER BY record_id) AS ss, list(e ORDER BY record_id) AS es FROM z GROUP BY comp HAVING count(*) > 1),
zr AS (
  SELECT comp, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(c BIGINT, s BIGINT, e BIGINT)[]) AS pend, range(1, n + 1) AS root, list_transform(range(n), lambda x: CAST(0 AS BIGINT)) AS rank, false AS closed,
    CAST(NULL AS BIGINT) AS rec, CAST(NULL AS BIGINT) AS cand, CAST(NULL AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS ls, CAST(NULL AS BIGINT) AS le FROM zc
  UNION ALL
  SELECT comp, CASE WHEN turn THEN i + 1 ELSE i END,
    CASE WHEN NOT turn THEN pend[2:] WHEN closed OR i >= n THEN CAST([] AS STRUCT(c BIGINT, s BIGINT, e BIGINT)[])
         ELSE list_transform(list_sort(list_distinct(list_transform(near, lambda j: root[j]))), lambda q: {{'c': q, 's': greatest(ss[list_filter(near, lambda j: root[j] = q)[1]], ss[i + 1]), 'e': least(es[list_filter(near, lambda j: root[j] = q)[1]], es[i + 1])}}) END,
    CASE WHEN told = 'merged' THEN list_transform(root, lambda x: CASE WHEN x = low THEN high ELSE x END) ELSE root END,
    CASE WHEN told = 'merged' AND rank[mine] = rank[now] THEN list_transform(range(1, n + 1), lambda x: rank[x] + CASE WHEN x = high THEN 1 ELSE 0 END) ELSE rank END,
    closed OR coalesce(told = 'closed', false),
    CASE WHEN told IS NOT NULL THEN ids[i] END, CASE WHEN told IS NOT NULL THEN ids[pend[1].c] END, told, CASE WHEN told IS NOT NULL THEN pend[1].s END, CASE WHEN told IS NOT NULL THEN pend[1].e END
  FROM (SELECT *, CASE WHEN rank[mine] > rank[now] THEN now ELSE mine END AS low, CASE WHEN rank[mine] > rank[now] THEN mine ELSE now END AS high,
      CASE WHEN turn OR mine = now THEN NULL WHEN {stream} AND ps[pend[1].c] = ps[i] AND list_contains(clash, ps[i]) THEN 'closed' WHEN len(clash) > 0 THEN 'vetoed' ELSE 'merged' END AS told
    FROM (SELECT *, list_filter(range(1, i + 1), lambda j: turn AND ss[j] < es[i + 1] AND ss[i + 1] < es[j]) AS near,
        CASE WHEN turn OR mine = now THEN CAST([] AS VARCHAR[]) ELSE list_transform(list_filter(range(1, n + 1), lambda x: root[x] = mine AND len(list_filter(range(1, n + 1), lambda y: root[y] = now AND ps[x] = ps[y] AND vs[x] <> vs[y] AND ss[x] < es[y] AND ss[y] < es[x])) > 0), lambda x: ps[x]) END AS clash
      FROM (SELECT zr.*, n, ids, ps, vs, ss, es, len(pend) = 0 AS turn, root[i] AS mine, root[pend[1].c] AS now FROM zr JOIN zc USING (comp) WHERE i <= n)))),
zl AS (SELECT comp, unnest(ids) AS record_id, unnest(root) AS root FROM zr JOIN zc USING (comp) WHERE i > n),
zd AS (SELECT record_id, min(record_id) OVER (PARTITION BY comp, root) AS cluster_id FROM zl)
"""
_REPLAY_ORDERS = "z AS (SELECT CAST(o_custkey AS VARCHAR) AS comp, o_orderkey AS record_id, o_orderpriority AS persp, o_orderstatus AS val, s, s + 15552000 AS e FROM t_ord),\n" + _REPLAY.strip().format(stream="true")
_REPLAY_LINES = "z AS (SELECT l_partkey || '-' || l_suppkey AS comp, record_id, l_linestatus AS persp, l_returnflag AS val, s, s + 31536000 AS e FROM t_li),\n" + _REPLAY.strip().format(stream="false")


@register(_REPLAY_ORDERS + "\nSELECT record_id, coalesce(zd.cluster_id, record_id) AS cluster_id FROM r_ord LEFT JOIN zd USING (record_id)")
def greedy_clusters_stream(spark, sf_dir):
    return ln.link_greedy(*vw.orders(spark, sf_dir), vw.ORDERS, ln.LinkOptions("stream"))


@register(_REPLAY_LINES + "\nSELECT record_id, coalesce(zd.cluster_id, record_id) AS cluster_id FROM t_li LEFT JOIN zd USING (record_id)")
def greedy_clusters_batch(spark, sf_dir):
    return ln.link_greedy(*vw.lines(spark, sf_dir), vw.LINES, ln.LinkOptions("batch"))


@register(_REPLAY_ORDERS + "\nSELECT rec AS record_id, cand AS candidate, 'by_customer' AS key_name, outcome, ls AS start_ts, le AS end_ts FROM zr WHERE outcome IS NOT NULL")
def greedy_merge_log(spark, sf_dir):
    return ln.merge_log(*vw.orders(spark, sf_dir), vw.ORDERS)


@register("SELECT cluster_id, dense_rank() OVER (ORDER BY cluster_id) - 1 AS number FROM (SELECT DISTINCT cluster_id FROM a_ord)")
def cluster_numbers(spark, sf_dir):
    return ln.dense_cluster_numbers(_ord(spark, sf_dir)[2])


# ---- conflicts ----

_SLICES = """
vm AS (SELECT *, max(end_ts) OVER (PARTITION BY {k}, value ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {v}),
vg AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY {k}, value ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM vm),
vi AS (SELECT {k}, value, min(start_ts) AS s, max(end_ts) AS e, list_sort(list_distinct(list(record_id))) AS who FROM vg GROUP BY {k}, value, island),
vb AS (SELECT DISTINCT {k}, unnest([s, e]) AS pt FROM vi),
vl AS (SELECT {k}, pt AS s, lead(pt) OVER (PARTITION BY {k} ORDER BY pt) AS e FROM vb),
vc AS (SELECT {k}, l.s AS start_ts, l.e AS end_ts, string_agg(value || ':' || array_to_string(who, '+'), ',' ORDER BY value) AS "values", count(*) AS n
       FROM vl l JOIN vi i USING ({k}) WHERE i.s <= l.s AND i.e >= l.e GROUP BY {k}, l.s, l.e HAVING count(*) > 1)
"""


def _shown(values: str = "values"):
    return _joined(values, lambda v: F.concat(v["value"], F.lit(":"), F.array_join(v["participants"].cast("array<string>"), "+")))


@register(_SLICES.format(k="cluster_id, attr", v="v_ord").strip() + '\nSELECT cluster_id, attr, start_ts, end_ts, "values" FROM vc')
def direct_conflicts(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    return cf.direct_conflicts(descriptors, assignments).select("cluster_id", "attr", "start_ts", "end_ts", _shown().alias("values"))


@register(_SLICES.format(k="cluster_id, attr", v="v_ord").strip() + """,
cm AS (SELECT *, CASE WHEN lag(end_ts) OVER w = start_ts AND lag("values") OVER w = "values" THEN 0 ELSE 1 END AS fresh FROM vc WINDOW w AS (PARTITION BY cluster_id, attr ORDER BY start_ts)),
cg AS (SELECT *, sum(fresh) OVER (PARTITION BY cluster_id, attr ORDER BY start_ts ROWS UNBOUNDED PRECEDING) AS run FROM cm)
SELECT cluster_id, attr, min(start_ts) AS start_ts, max(end_ts) AS end_ts, "values" FROM cg GROUP BY cluster_id, attr, run, "values\"""")
def direct_conflicts_merged(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    return cf.direct_conflicts(descriptors, assignments, merge_adjacent=True).select("cluster_id", "attr", "start_ts", "end_ts", _shown().alias("values"))


@register("v_cs AS (SELECT o_custkey AS record_id, o_custkey AS of, 'status' AS attr, o_orderstatus AS value, s AS start_ts, s + 15552000 AS end_ts FROM t_ord),\n" + _SLICES.format(k="of, attr", v="v_cs").strip() + '\nSELECT of AS record_id, attr, start_ts, end_ts, "values" FROM vc')
def intra_record_conflicts(spark, sf_dir):
    s = iv.epoch_seconds(F.col("o_orderdate"))
    of_customer = vw.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.lit("status").alias("attr"), F.col("o_orderstatus").alias("value"), s.alias("start_ts"), (s + 180 * DAY).alias("end_ts"))
    return cf.intra_record_conflicts(of_customer, vw.ORDERS).select("record_id", "attr", "start_ts", "end_ts", _shown().alias("values"))


@register("""
o1 AS (SELECT o_orderkey AS record_id, o_orderpriority AS perspective, 'seg=' || (o_custkey % 50) AS part, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS strong, o_orderkey AS s, o_orderkey + 10 AS e FROM orders),
k AS (SELECT DISTINCT part FROM o1 x WHERE EXISTS (SELECT 1 FROM o1 y WHERE y.part = x.part AND y.record_id <> x.record_id AND y.perspective <> x.perspective AND y.strong <> x.strong))
SELECT record_id AS cluster_id, 'seg' AS key_name, part AS key_text, s AS start_ts, e AS end_ts, 'auto_resolved' AS status FROM o1 WHERE part IN (FROM k)""")
def indirect_conflicts(spark, sf_dir):
    t = vw.table(spark, sf_dir, "orders")
    records = t.select(F.col("o_orderkey").alias("record_id"), F.lit("order").alias("entity_type"), F.col("o_orderpriority").alias("perspective"), F.col("o_orderkey").cast("string").alias("uid"))
    which = F.when(F.col("o_orderkey") % 2 == 0, "even").otherwise("odd")
    listed = F.array(F.struct(F.lit("seg").alias("attr"), (F.col("o_custkey") % 50).cast("string").alias("value")), F.struct(which.alias("attr"), F.lit("x").alias("value")))
    descriptors = t.select(F.col("o_orderkey").alias("record_id"), F.explode(listed).alias("d"), F.col("o_orderkey").alias("start_ts"), (F.col("o_orderkey") + 10).alias("end_ts")).select("record_id", "d.attr", "d.value", "start_ts", "end_ts")
    ontology = vw.Ontology().add_identity_key("seg", "seg").add_strong_identifier("even").add_strong_identifier("odd")
    return cf.indirect_conflicts(records, descriptors, records.select("record_id", F.col("record_id").alias("cluster_id")), ontology)


_INSIDE = """
st AS (SELECT cluster_id, record_id, value, start_ts, end_ts FROM v_ord WHERE attr = 'status'),
m AS (SELECT *, max(end_ts) OVER (PARTITION BY cluster_id, value ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM st),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, value ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT cluster_id, value, min(start_ts) AS s, max(end_ts) AS e FROM g GROUP BY cluster_id, value, island),
p AS (SELECT x.cluster_id, x.value AS value_a, y.value AS value_b, greatest(x.s, y.s) AS s, least(x.e, y.e) AS e FROM i x JOIN i y ON x.cluster_id = y.cluster_id AND x.value < y.value AND x.s < y.e AND y.s < x.e),
pm AS (SELECT *, max(e) OVER (PARTITION BY cluster_id, value_a, value_b ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
pg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, value_a, value_b ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM pm)
"""


@register(_INSIDE.strip() + """
SELECT cluster_id, value_a, value_b, min(s) AS start_ts, max(e) AS end_ts,
  (SELECT string_agg(DISTINCT record_id, '+' ORDER BY record_id) FROM st WHERE st.cluster_id = pg.cluster_id AND st.value IN (pg.value_a, pg.value_b)) AS participants
FROM pg GROUP BY cluster_id, value_a, value_b, island""")
def unique_in_cluster(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    found = cf.unique_in_cluster(descriptors, assignments, "status", "unique_status")
    return found.select("cluster_id", "value_a", "value_b", "start_ts", "end_ts", F.array_join(F.col("participants").cast("array<string>"), "+").alias("participants"))


_ACROSS = """
z AS (SELECT o_orderkey AS record_id, o_orderkey // 4 AS cluster_id, o_orderpriority AS perspective, CAST(o_custkey AS VARCHAR) AS value, s, s + 15552000 AS e FROM t_ord)
"""


@register(_ACROSS.strip() + """
SELECT x.perspective, x.value, x.record_id AS record_a, y.record_id AS record_b, greatest(x.s, y.s) AS start_ts, least(x.e, y.e) AS end_ts
FROM z x JOIN z y ON x.perspective = y.perspective AND x.value = y.value AND x.record_id < y.record_id AND x.cluster_id <> y.cluster_id AND x.s < y.e AND y.s < x.e""")
def unique_across_clusters(spark, sf_dir):
    records, descriptors = vw.orders(spark, sf_dir)
    fours = records.select("record_id", F.floor(F.col("record_id") / 4).cast("long").alias("cluster_id"))
    return cf.unique_across_clusters(records, descriptors, fours, "cust", "unique_cust").drop("constraint", "attr")


_SUMMARY = _SLICES.format(k="cluster_id, attr", v="v_ord").strip() + """,
su AS (SELECT DISTINCT 'direct' AS kind, c.attr AS attribute, c.start_ts, c.end_ts, (
         SELECT string_agg(x, ',' ORDER BY x) FROM (
           SELECT DISTINCT r.perspective || '/' || r.uid AS x FROM vi i, unnest(i.who) AS t(w) JOIN r_ord r ON r.record_id = t.w
           WHERE i.cluster_id = c.cluster_id AND i.attr = c.attr AND i.s <= c.start_ts AND i.e >= c.end_ts)) AS records
       FROM vc c)
"""


@register(_SLICES.format(k="cluster_id, attr", v="v_ord").strip() + ",\n" + _INSIDE.strip() + """
SELECT 'direct' AS kind, 'none' AS cause, 'none' AS status, (SELECT count(*) FROM vc) AS n
UNION ALL SELECT 'constraint_violation', 'unique_status', 'violation', (SELECT count(*) FROM (SELECT DISTINCT cluster_id, value_a, value_b, island FROM pg))""")
def observation_kinds(spark, sf_dir):
    """All detectors at once under strong identifiers and a constraint; the orders have nothing for the indirect ones."""
    records, descriptors, assignments = _ord(spark, sf_dir)
    ontology = Ontology().add_identity_key("by_customer", "cust").add_strong_identifier("status").add_constraint("unique_status", "status", ConstraintKind.UNIQUE_WITHIN_PERSPECTIVE)
    found = cf.observations(records, descriptors, assignments, ontology)
    return found.groupBy("kind", F.coalesce("cause", F.lit("none")).alias("cause"), F.coalesce("status", F.lit("none")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _summaries(spark, sf_dir) -> DataFrame:
    records, descriptors, assignments = _ord(spark, sf_dir)
    return cf.summarize(cf.observations(records, descriptors, assignments, vw.PLAIN_ORDERS), records)


def _refs():
    return F.array_join(F.array_sort(F.transform("records", lambda r: F.concat(r["perspective"], F.lit("/"), r["uid"]))), ",")


@register(_SUMMARY.strip() + "\nSELECT * FROM su")
def conflict_summary(spark, sf_dir):
    return _summaries(spark, sf_dir).select("kind", "attribute", "start_ts", "end_ts", _refs().alias("records"))


@register(_SUMMARY.strip() + "\nSELECT * FROM su WHERE attribute = 'status' AND start_ts < 900000000 AND end_ts > 890000000")
def list_conflicts(spark, sf_dir):
    return cf.list_conflicts(_summaries(spark, sf_dir), 890_000_000, 900_000_000, "status").select("kind", "attribute", "start_ts", "end_ts", _refs().alias("records"))


@register("SELECT cluster_id, attr, count(DISTINCT pt) AS unique_boundaries, count(*) AS boundaries, CASE WHEN count(DISTINCT pt) / count(*) < 0.5 THEN 'atomic' ELSE 'sweep' END AS algorithm FROM (SELECT cluster_id, attr, unnest([start_ts, end_ts]) AS pt FROM v_ord) GROUP BY cluster_id, attr")
def boundary_ratio(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    return cf.boundary_ratio(go.cluster_values(descriptors, assignments), ["cluster_id", "attr"])


# ---- golden records, keys and graph ----

_GOLDEN = """
gb AS (SELECT DISTINCT cluster_id, attr, unnest([start_ts, end_ts]) AS pt FROM v_ord),
gl AS (SELECT cluster_id, attr, pt AS s, lead(pt) OVER (PARTITION BY cluster_id, attr ORDER BY pt) AS e FROM gb),
gs AS (SELECT l.cluster_id, l.attr, l.s, l.e, min(v.value) AS value FROM gl l JOIN v_ord v ON v.cluster_id = l.cluster_id AND v.attr = l.attr AND v.start_ts <= l.s AND v.end_ts >= l.e GROUP BY l.cluster_id, l.attr, l.s, l.e HAVING count(DISTINCT v.value) = 1),
gm AS (SELECT *, max(e) OVER (PARTITION BY cluster_id, attr, value ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gs),
gg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id, attr, value ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM gm),
gold AS (SELECT cluster_id, attr, value, min(s) AS start_ts, max(e) AS end_ts FROM gg GROUP BY cluster_id, attr, value, island)
"""


def _gold(spark, sf_dir) -> DataFrame:
    _, descriptors, assignments = _ord(spark, sf_dir)
    return go.golden(descriptors, assignments)


@register(_GOLDEN.strip() + "\nSELECT * FROM gold")
def golden_records(spark, sf_dir):
    return _gold(spark, sf_dir)


@register(_GOLDEN.strip() + "\nSELECT * FROM gold WHERE start_ts <= 900000000 AND 900000000 < end_ts")
def golden_at_instant(spark, sf_dir):
    return go.golden_at(_gold(spark, sf_dir), 900_000_000)


@register(_GOLDEN.strip() + "\nSELECT cluster_id, attr, value, greatest(start_ts, 890000000) AS start_ts, least(end_ts, 900000000) AS end_ts FROM gold WHERE start_ts < 900000000 AND end_ts > 890000000")
def golden_within(spark, sf_dir):
    return go.golden_within(_gold(spark, sf_dir), 890_000_000, 900_000_000)


_TOKEN = """
c1 AS (SELECT c_custkey, v, split_part(lower(regexp_replace(v, '^\\s+|\\s+$', '', 'g')), '@', 1) AS core FROM (SELECT c_custkey, unnest([c_name, c_mktsegment || ' x1.' || c_custkey || '@Home', CAST(c_custkey AS VARCHAR), ' Ab-' || c_nationkey || '  cd ef gh ']) AS v FROM customer)),
c2 AS (SELECT *, regexp_replace(core, '[^a-z0-9]', '', 'g') AS alnum, list_filter(regexp_split_to_array(core, '[^a-z0-9]+'), lambda p: p <> '') AS parts FROM c1),
tok AS (SELECT c_custkey, v, upper(CASE WHEN regexp_full_match(alnum, '[0-9]+') THEN right(alnum, 3) WHEN len(parts) >= 2 THEN array_to_string(list_transform(parts[1:4], lambda p: substr(p, 1, 1)), '') ELSE substr(alnum, 1, 4) END) AS token FROM c2)
"""


@register(_TOKEN.strip() + "\nSELECT * FROM tok")
def short_tokens(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    forms = F.array(F.col("c_name"), F.concat("c_mktsegment", F.lit(" x1."), key, F.lit("@Home")), key, F.concat(F.lit(" Ab-"), F.col("c_nationkey").cast("string"), F.lit("  cd ef gh ")))
    return vw.table(spark, sf_dir, "customer").select("c_custkey", F.explode(forms).alias("v")).select("c_custkey", "v", tk.short_token(F.col("v")).alias("token"))


_SUFFIX = "(SELECT substr('23456789ABCDEFGHJKLMNPQRSTUVWXYZ', h // 32 + 1, 1) || substr('23456789ABCDEFGHJKLMNPQRSTUVWXYZ', h % 32 + 1, 1) FROM (SELECT list_reduce(list_concat([805], list_transform(range(1, length({m}) + 1), lambda i: ascii(substr({m}, i, 1)))), lambda a, b: (xor(a, b) * 435) % 1024) AS h))"


@register("SELECT c_custkey, " + _SUFFIX.format(m="c_name") + " AS suffix FROM customer")
def key_suffixes(spark, sf_dir):
    return vw.table(spark, sf_dir, "customer").select("c_custkey", tk.key_suffix(F.col("c_name")).alias("suffix"))


@register("SELECT cluster_id, attr, value FROM (SELECT cluster_id, attr, value, row_number() OVER (PARTITION BY cluster_id, attr ORDER BY count(*) DESC, value) AS n FROM v_ord GROUP BY cluster_id, attr, value) WHERE n = 1")
def cluster_values(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    return ck.pick_values(go.cluster_values(descriptors, assignments))


_CLUSTER_KEYS = """
val AS (SELECT cluster_id, value FROM (SELECT cluster_id, value, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, value) AS n FROM v_ord WHERE attr = 'cust' GROUP BY cluster_id, value) WHERE n = 1),
sig AS (SELECT cluster_id, string_agg(part, '|' ORDER BY part) AS signature FROM (
  SELECT a.cluster_id, 'record:' || r.entity_type || ':' || r.perspective || ':' || r.uid AS part FROM a_ord a JOIN r_ord r USING (record_id)
  UNION ALL SELECT cluster_id, attr || '=' || value || '@' || start_ts || ':' || end_ts FROM v_ord) GROUP BY cluster_id),
seed AS (SELECT cluster_id, right(value, 3) AS token, 'order|by_customer|cust=' || value || '|' || signature AS m FROM val JOIN sig USING (cluster_id))
SELECT cluster_id, token || '-' || {suffix} AS cluster_key, 'by_customer' AS identity_key FROM seed""".format(suffix=_SUFFIX.format(m="m"))


@register(_CLUSTER_KEYS)
def cluster_keys(spark, sf_dir):
    records, descriptors, assignments = _ord(spark, sf_dir)
    return ck.cluster_keys(records, descriptors, assignments, vw.PLAIN_ORDERS)


@register("SELECT cluster_id, entity_type FROM (SELECT c_nationkey AS cluster_id, c_mktsegment AS entity_type, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE n = 1")
def dominant_entity_type(spark, sf_dir):
    t = vw.table(spark, sf_dir, "customer")
    records = t.select(F.col("c_custkey").alias("record_id"), F.col("c_mktsegment").alias("entity_type"))
    return ck.dominant_entity_type(records, t.select(F.col("c_custkey").alias("record_id"), F.col("c_nationkey").cast("long").alias("cluster_id")))


@register("SELECT a.record_id AS source, b.record_id AS target, 'cluster_member' AS reason FROM a_ord a JOIN a_ord b ON a.cluster_id = b.cluster_id AND a.record_id < b.record_id")
def same_as_edges(spark, sf_dir):
    return gr.same_as_edges(_ord(spark, sf_dir)[2]).select("source", "target", "reason")


_EDGES = _SLICES.format(k="cluster_id, attr", v="v_ord").strip() + """,
ve AS (SELECT DISTINCT least(x.w, y.w) AS source, greatest(x.w, y.w) AS target, c.attr AS attribute, c.start_ts, c.end_ts FROM vc c
  JOIN (SELECT *, unnest(who) AS w FROM vi) x ON x.cluster_id = c.cluster_id AND x.attr = c.attr AND x.s <= c.start_ts AND x.e >= c.end_ts
  JOIN (SELECT *, unnest(who) AS w FROM vi) y ON y.cluster_id = c.cluster_id AND y.attr = c.attr AND y.s <= c.start_ts AND y.e >= c.end_ts AND x.value < y.value AND x.w <> y.w)
"""


@register(_EDGES.strip() + "\nSELECT * FROM ve")
def conflicts_with_edges(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    return gr.conflict_edges(cf.direct_conflicts(descriptors, assignments)).drop("cause")


@register(_EDGES.strip() + """
SELECT 'nodes' AS part, (SELECT count(*) + count(DISTINCT cluster_id) FROM a_ord) AS n
UNION ALL SELECT 'same_as', (SELECT count(*) FROM a_ord a JOIN a_ord b ON a.cluster_id = b.cluster_id AND a.record_id < b.record_id)
UNION ALL SELECT 'conflicts_with', (SELECT count(*) FROM ve)""")
def graph_counts(spark, sf_dir):
    records, descriptors, assignments = _ord(spark, sf_dir)
    return gr.export_graph(records, descriptors, assignments, vw.PLAIN_ORDERS).counts()


@register("""
SELECT 'record_' || record_id AS id, 'record' AS node_type, entity_type AS told, perspective AS root, uid AS size FROM r_ord
UNION ALL SELECT 'cluster_' || cluster_id, 'cluster', NULL, CAST(cluster_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM a_ord GROUP BY cluster_id""")
def graph_nodes(spark, sf_dir):
    records, descriptors, assignments = _ord(spark, sf_dir)
    p = F.col("properties")
    nodes = gr.record_nodes(records).unionByName(gr.cluster_nodes(records, descriptors, assignments, vw.PLAIN_ORDERS))
    return nodes.select("id", "node_type", p["entity_type"].alias("told"), F.coalesce(p["perspective"], p["root_record"]).alias("root"), F.coalesce(p["uid"], p["size"]).alias("size"))


# ---- queries ----

_HITS = """
h AS (SELECT cluster_id, attr, greatest(start_ts, 880000000) AS s, least(end_ts, 910000000) AS e FROM v_ord WHERE start_ts < 910000000 AND end_ts > 880000000 AND ({asked})),
hb AS (SELECT DISTINCT cluster_id, unnest([s, e]) AS pt FROM h),
hl AS (SELECT cluster_id, pt AS s, lead(pt) OVER (PARTITION BY cluster_id ORDER BY pt) AS e FROM hb),
hs AS (SELECT l.cluster_id, l.s, l.e FROM hl l JOIN h ON h.cluster_id = l.cluster_id AND h.s <= l.s AND h.e >= l.e GROUP BY ALL HAVING count(DISTINCT h.attr) = {n}),
hm AS (SELECT *, max(e) OVER (PARTITION BY cluster_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hs),
hg AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cluster_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM hm),
hit AS (SELECT cluster_id, min(s) AS start_ts, max(e) AS end_ts FROM hg GROUP BY cluster_id, island)
"""
#: A customer with a finished order in that time in the tables of every size.
_ASKED = [("cust", "9"), ("status", "F")]
_TWO = _HITS.format(asked="(attr = 'cust' AND value = '9') OR (attr = 'status' AND value = 'F')", n=2).strip()
_ONE = _HITS.format(asked="attr = 'status' AND value = 'F'", n=1).strip()


def _ask(spark, sf_dir, asked):
    _, descriptors, assignments = _ord(spark, sf_dir)
    return qu.query_entities(descriptors, assignments, asked, 880_000_000, 910_000_000)


@register(_TWO + "\nSELECT * FROM hit")
def query_two_descriptors(spark, sf_dir):
    return _ask(spark, sf_dir, _ASKED).matches


@register(_ONE + "\nSELECT * FROM hit")
def query_one_descriptor(spark, sf_dir):
    return _ask(spark, sf_dir, [("status", "F")]).matches


@register(_ONE + """,
ho AS (SELECT *, lag(cluster_id) OVER w AS c, lag(start_ts) OVER w AS s, lag(end_ts) OVER w AS e FROM hit WINDOW w AS (ORDER BY start_ts, end_ts, cluster_id))
SELECT c AS cluster_a, cluster_id AS cluster_b, greatest(s, start_ts) AS start_ts, least(e, end_ts) AS end_ts FROM ho WHERE c <> cluster_id AND s < end_ts AND start_ts < e ORDER BY 3, 4, 1, 2 LIMIT 1""")
def query_conflict(spark, sf_dir):
    return _ask(spark, sf_dir, [("status", "F")]).conflict


@register(_ONE + """,
ho AS (SELECT *, lag(cluster_id) OVER w AS c, lag(start_ts) OVER w AS s, lag(end_ts) OVER w AS e FROM hit WINDOW w AS (ORDER BY start_ts, end_ts, cluster_id)),
f AS (SELECT c AS ca, cluster_id AS cb, greatest(s, start_ts) AS cs, least(e, end_ts) AS ce FROM ho WHERE c <> cluster_id AND s < end_ts AND start_ts < e ORDER BY 3, 4, 1, 2 LIMIT 1),
o AS (SELECT (SELECT min((greatest(s, cs), least(e, ce))) FROM h WHERE cluster_id = ca AND s < ce AND cs < e) AS x, cs, ce FROM f)
SELECT 'status' AS attr, 'F' AS value, cs AS start_ts, ce AS end_ts FROM o""")
def query_offending_descriptors(spark, sf_dir):
    _, descriptors, assignments = _ord(spark, sf_dir)
    asked = [("status", "F")]
    hits = qu.descriptor_hits(descriptors, assignments, asked, 880_000_000, 910_000_000)
    conflict = qu.overlap_conflict(qu.cluster_matches(hits, 1))
    return qu.offending_descriptors(hits, conflict, asked)


@register(_ONE + "\nSELECT * FROM hit")
def query_of_parts(spark, sf_dir):
    """The answers of two halves of the clusters as one."""
    _, descriptors, assignments = _ord(spark, sf_dir)
    halves = [qu.query_entities(descriptors, assignments.where(F.col("cluster_id") % 2 == k), [("status", "F")], 880_000_000, 910_000_000) for k in (0, 1)]
    return qu.merge_outcomes(halves).matches


@register(_ONE + """
SELECT x.cluster_id AS cluster_a, y.cluster_id AS cluster_b, greatest(x.start_ts, y.start_ts) AS start_ts, least(x.end_ts, y.end_ts) AS end_ts
FROM hit x JOIN hit y ON x.cluster_id < y.cluster_id AND x.start_ts < y.end_ts AND y.start_ts < x.end_ts WHERE x.cluster_id % 7 = 0 AND y.cluster_id % 7 = 0""")
def query_all_overlaps(spark, sf_dir):
    matches = _ask(spark, sf_dir, [("status", "F")]).matches.where(F.col("cluster_id") % 7 == 0)
    return qu.overlap_conflict(matches, all_overlaps=True)


@register(_TWO + ",\n" + _GOLDEN.strip() + """
SELECT hit.cluster_id, hit.start_ts, hit.end_ts, (SELECT string_agg(attr || '=' || value || '@' || greatest(gold.start_ts, hit.start_ts) || ':' || least(gold.end_ts, hit.end_ts), ',' ORDER BY attr, value, gold.start_ts)
  FROM gold WHERE gold.cluster_id = hit.cluster_id AND gold.start_ts < hit.end_ts AND hit.start_ts < gold.end_ts) AS golden FROM hit""")
def query_rendered(spark, sf_dir):
    records, descriptors, assignments = _ord(spark, sf_dir)
    told = qu.render_matches(_ask(spark, sf_dir, _ASKED).matches, go.golden(descriptors, assignments), ck.cluster_keys(records, descriptors, assignments, vw.PLAIN_ORDERS))
    one = lambda d: F.concat(d["attr"], F.lit("="), d["value"], F.lit("@"), d["start_ts"].cast("string"), F.lit(":"), d["end_ts"].cast("string"))
    return told.select("cluster_id", "start_ts", "end_ts", F.nullif(F.array_join(F.transform("golden", one), ","), F.lit("")).alias("golden"))


@register("SELECT count(*) AS record_count, count(DISTINCT cluster_id) AS cluster_count, count(*) - count(DISTINCT cluster_id) AS merges FROM a_ord")
def engine_stats(spark, sf_dir):
    records, _, assignments = _ord(spark, sf_dir)
    return qu.entity_stats(records, assignments)


# ---- crosswalks and perspectives ----

_XW = "x AS (SELECT c_mktsegment AS perspective, CAST(c_custkey // 2 AS VARCHAR) AS uid, 'K' || c_nationkey AS canonical_id, c_custkey % 50 AS start_ts, c_custkey % 50 + 10 AS end_ts, c_custkey AS seq FROM customer)\n"


def _crosswalks(spark, sf_dir) -> DataFrame:
    s = F.col("c_custkey") % 50
    return vw.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("perspective"), F.floor(F.col("c_custkey") / 2).cast("string").alias("uid"), F.concat(F.lit("K"), F.col("c_nationkey").cast("string")).alias("canonical_id"), s.alias("start_ts"), (s + 10).alias("end_ts"), F.col("c_custkey").alias("seq")
    )


@register(_XW + "SELECT perspective, uid, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY perspective, uid ORDER BY seq DESC, canonical_id) AS n FROM x) WHERE n = 1")
def crosswalk_latest(spark, sf_dir):
    return cw.latest(_crosswalks(spark, sf_dir), "seq").select("perspective", "uid", "canonical_id")


@register(_XW + "SELECT perspective, uid, canonical_id, seq FROM x WHERE canonical_id = 'K11' AND start_ts < 30 AND end_ts > 20")
def crosswalk_lookup(spark, sf_dir):
    return cw.overlapping(cw.by_canonical_id(_crosswalks(spark, sf_dir), "K11"), 20, 30).select("perspective", "uid", "canonical_id", "seq")


@register(_XW + "SELECT perspective, uid, canonical_id, seq FROM x WHERE start_ts <= 25 AND 25 < end_ts")
def crosswalk_active(spark, sf_dir):
    return cw.active_at(_crosswalks(spark, sf_dir), 25).select("perspective", "uid", "canonical_id", "seq")


@register(_XW + "SELECT r.record_id, x.canonical_id, x.start_ts, x.end_ts FROM r_cu r JOIN x USING (perspective, uid)")
def crosswalk_records(spark, sf_dir):
    return cw.resolve_records(vw.customers(spark, sf_dir)[0], _crosswalks(spark, sf_dir))


@register("""
w AS (SELECT * FROM (VALUES ('1-URGENT', 50), ('2-HIGH', 40), ('3-MEDIUM', 30)) t(perspective, weight))
SELECT perspective, coalesce(weight, 0) AS weight, row_number() OVER (ORDER BY coalesce(weight, 0) DESC, perspective) AS precedence FROM (SELECT DISTINCT perspective FROM r_ord) LEFT JOIN w USING (perspective)""")
def perspective_precedence(spark, sf_dir):
    return cw.perspective_order(vw.orders(spark, sf_dir)[0], vw.ORDERS)


@register("""
w AS (SELECT n_name AS perspective, n_regionkey * 10 AS weight FROM nation), o AS (SELECT n_name AS perspective, 'a' || (n_nationkey % 4) AS attr FROM nation)
SELECT attr, perspective FROM (SELECT attr, perspective, row_number() OVER (PARTITION BY attr ORDER BY weight DESC, perspective) AS n FROM o JOIN w USING (perspective) WHERE weight > 0) WHERE n = 1""")
def authoritative_perspective(spark, sf_dir):
    t = vw.table(spark, sf_dir, "nation")
    owned = t.select(F.col("n_name").alias("perspective"), F.concat(F.lit("a"), (F.col("n_nationkey") % 4).cast("string")).alias("attr"))
    return cw.authoritative_perspectives(owned, t.select(F.col("n_name").alias("perspective"), (F.col("n_regionkey") * 10).alias("weight")))


# ---- shards ----

_BOUNDS = """
bo AS (SELECT k AS key, d.record_id % 4 AS shard, d.record_id % 4 * 1000000 + CAST(k AS BIGINT) AS cluster_id, start_ts, end_ts, d.record_id FROM k_ord d),
bi AS (SELECT key, shard, cluster_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM bo GROUP BY ALL),
bs AS (SELECT b.cluster_id, r.perspective, string_agg(DISTINCT d.value, ',' ORDER BY d.value) AS h FROM bo b JOIN r_ord r USING (record_id) JOIN d_ord d ON d.record_id = b.record_id AND d.attr = 'status' GROUP BY ALL),
bp AS (SELECT x.key, x.shard AS shard_a, x.cluster_id AS cluster_a, y.shard AS shard_b, y.cluster_id AS cluster_b, greatest(x.start_ts, y.start_ts) AS start_ts, least(x.end_ts, y.end_ts) AS end_ts,
  (SELECT string_agg(p.perspective, ',' ORDER BY p.perspective) FROM bs p JOIN bs q ON p.perspective = q.perspective AND p.h <> q.h WHERE p.cluster_id = x.cluster_id AND q.cluster_id = y.cluster_id) AS perspectives
  FROM bi x JOIN bi y ON x.key = y.key AND x.shard < y.shard AND x.start_ts < y.end_ts AND y.start_ts < x.end_ts)
"""


def _boundaries(spark, sf_dir) -> DataFrame:
    records, descriptors = vw.orders(spark, sf_dir)
    rows = ky.key_rows(records, descriptors, vw.PLAIN_ORDERS)
    shards = records.select("record_id", (F.col("record_id") % 4).cast("int").alias("shard"))
    local = rows.select("record_id", (F.col("record_id") % 4 * 1_000_000 + F.col("key_values")[0]["value"].cast("long")).alias("cluster_id"))
    return rc.boundary_index(rows, local, shards, rc.perspective_strong_hashes(records, descriptors, local, ["status"]))


@register(_BOUNDS.strip() + "\nSELECT CAST(shard AS INT) AS shard, cluster_id, start_ts, end_ts, (SELECT count(*) FROM bs WHERE bs.cluster_id = bi.cluster_id) AS perspectives FROM bi")
def boundary_index(spark, sf_dir):
    return _boundaries(spark, sf_dir).select("shard", "cluster_id", "start_ts", "end_ts", F.size("strong").cast("long").alias("perspectives"))


@register(_BOUNDS.strip() + """,
bm AS (SELECT DISTINCT x.key, x.shard, x.cluster_id, greatest(x.start_ts, y.start_ts) AS s, least(x.end_ts, y.end_ts) AS e
  FROM bo x JOIN bo y ON x.key = y.key AND x.shard = y.shard AND x.record_id < y.record_id AND x.start_ts < y.end_ts AND y.start_ts < x.end_ts)
SELECT CAST(shard AS INT) AS shard, cluster_id, min(s) AS start_ts, max(e) AS end_ts FROM bm GROUP BY key, shard, cluster_id""")
def merged_boundaries(spark, sf_dir):
    """Entries of keys that brought two records of a shard together."""
    records, descriptors = vw.orders(spark, sf_dir)
    rows = ky.key_rows(records, descriptors, vw.PLAIN_ORDERS)
    shards = records.select("record_id", (F.col("record_id") % 4).cast("int").alias("shard"))
    local = rows.select("record_id", (F.col("record_id") % 4 * 1_000_000 + F.col("key_values")[0]["value"].cast("long")).alias("cluster_id"))
    found = rc.boundary_index(rows, local, shards, rc.perspective_strong_hashes(records, descriptors, local, ["status"]), merged_only=True)
    return found.select("shard", "cluster_id", "start_ts", "end_ts")


@register(_BOUNDS.strip() + "\nSELECT cluster_id, start_ts, end_ts FROM bi WHERE key IN ('7', '14') AND start_ts < 910000000 AND end_ts > 800000000")
def boundary_lookup(spark, sf_dir):
    found = _boundaries(spark, sf_dir)
    keys = local_frame(spark, [("7",), ("14",)], "value string")
    signed = keys.select(F.hex(ky.signature(F.lit("order"), F.array(F.struct(F.lit("cust").alias("attr"), F.col("value"))))).alias("signature"))
    return rc.overlapping_boundaries(found, signed, 800_000_000, 910_000_000).select("cluster_id", "start_ts", "end_ts")


@register(_BOUNDS.strip() + "\nSELECT DISTINCT cluster_a AS primary, cluster_b AS secondary FROM bp WHERE perspectives IS NULL".replace("AS primary", 'AS "primary"'))
def cross_shard_merges(spark, sf_dir):
    return rc.reconcile(_boundaries(spark, sf_dir)).merges


@register(_BOUNDS.strip() + "\nSELECT cluster_a, cluster_b, start_ts, end_ts, perspectives FROM bp WHERE perspectives IS NOT NULL")
def cross_shard_conflicts(spark, sf_dir):
    return rc.reconcile(_boundaries(spark, sf_dir)).conflicts.select("cluster_a", "cluster_b", "start_ts", "end_ts", F.array_join("perspectives", ",").alias("perspectives"))


@register(_BOUNDS.strip() + "\nSELECT count(DISTINCT key) AS keys_matched, count(*) AS candidates, count(perspectives) AS conflicts_blocked, count(*) - count(perspectives) AS merge_candidates FROM bp")
def reconcile_summary(spark, sf_dir):
    return rc.reconcile(_boundaries(spark, sf_dir)).summary()


@register(_BOUNDS.strip() + """
SELECT DISTINCT cluster_a, cluster_b, start_ts, end_ts FROM bp WHERE perspectives IS NOT NULL
  AND (cluster_a IN (SELECT cluster_id FROM bi WHERE shard = 2) OR cluster_b IN (SELECT cluster_id FROM bi WHERE shard = 2))""")
def conflicts_of_shard(spark, sf_dir):
    found = _boundaries(spark, sf_dir)
    return rc.conflicts_of_shard(rc.reconcile(found).conflicts, found, 2).select("cluster_a", "cluster_b", "start_ts", "end_ts")


@register(_BOUNDS.strip() + "\nSELECT DISTINCT cluster_a AS \"primary\", cluster_b AS secondary FROM bp WHERE perspectives IS NULL AND CAST(key AS BIGINT) % 3 = 0")
def dirty_merges(spark, sf_dir):
    """Reconciliation of the keys of some customers alone."""
    some = vw.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    key = F.array(F.struct(F.lit("cust").alias("attr"), F.col("c_custkey").cast("string").alias("value")))
    return rc.reconcile(_boundaries(spark, sf_dir), some.select(F.hex(ky.signature(F.lit("order"), key)).alias("signature"))).merges


@register(_BOUNDS.strip() + """,
me AS (SELECT DISTINCT cluster_a AS a, cluster_b AS b FROM bp WHERE perspectives IS NULL),
ed AS (SELECT a, b FROM me UNION SELECT b, a FROM me),
re AS (SELECT a, b FROM ed UNION SELECT re.a, ed.b FROM re JOIN ed ON re.b = ed.a)
SELECT record_id, least(cluster_id, coalesce((SELECT min(b) FROM re WHERE re.a = cluster_id), cluster_id)) AS cluster_id FROM bo""")
def apply_cross_shard_merges(spark, sf_dir):
    records, descriptors = vw.orders(spark, sf_dir)
    rows = ky.key_rows(records, descriptors, vw.PLAIN_ORDERS)
    local = rows.select("record_id", (F.col("record_id") % 4 * 1_000_000 + F.col("key_values")[0]["value"].cast("long")).alias("cluster_id"))
    return rc.apply_merges(local, rc.reconcile(_boundaries(spark, sf_dir)).merges)


@register("SELECT c_custkey, (CAST(c_nationkey AS BIGINT) << 48) | (3::BIGINT << 32) | c_custkey AS gid, CAST(c_nationkey AS BIGINT) AS shard, 3::BIGINT AS version, c_custkey AS local, 'GC' || c_nationkey || '.' || c_custkey || '.v3' AS shown FROM customer")
def global_ids(spark, sf_dir):
    gid = tk.global_id(F.col("c_nationkey"), F.lit(3), F.col("c_custkey"))
    g = F.col("gid")
    return vw.table(spark, sf_dir, "customer").select("c_custkey", gid.alias("gid")).select("c_custkey", "gid", tk.shard_of(g).alias("shard"), tk.version_of(g).alias("version"), tk.local_of(g).alias("local"), tk.display_global_id(g).alias("shown"))


# ---- whole runs ----


@register("SELECT record_id, cluster_id FROM a_ord")
def incremental_ingest(spark, sf_dir):
    """Orders in three batches through a store and the linker, which gives what one batch would."""
    from ..engine import Engine

    engine = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", vw.PLAIN_ORDERS)
    rows = src.nested(*vw.orders(spark, sf_dir))
    for k in range(3):
        engine.ingest(rows.where(F.col("index") % 3 == k), keep_ids=True, batch_id=k)
    return engine.assignments


@register(_REPLAY_ORDERS + "\nSELECT record_id, coalesce(zd.cluster_id, record_id) AS cluster_id FROM r_ord LEFT JOIN zd USING (record_id)")
def incremental_ingest_strong(spark, sf_dir):
    """Orders with a strong identifier in two batches, the later records first: the replay goes by record order all the same."""
    from ..engine import Engine

    engine = Engine(spark, f"{shared_dir(spark)}/engine-{uuid.uuid4().hex}", vw.ORDERS)
    rows = src.nested(*vw.orders(spark, sf_dir))
    for k in (1, 0):
        engine.ingest(rows.where(F.col("index") % 2 == k), keep_ids=True, batch_id=k)
    return engine.assignments


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
