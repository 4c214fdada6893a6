"""Records derived from the star-schema tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.interval import epoch_micros, epoch_seconds
from ..sources.records import from_wide
from .ontology import Ontology

DAY = 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order is a record of its priority's desk, about a customer, for 180 days."""
    t = table(spark, sf_dir, "orders")
    start = epoch_seconds(F.col("o_orderdate"))
    attrs = {"cust": F.col("o_custkey"), "status": F.col("o_orderstatus")}
    return from_wide(t, F.col("o_orderkey"), F.lit("order"), F.col("o_orderpriority"), F.col("o_orderkey"), attrs, start, start + 180 * DAY)


def lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A line of an order (of several with one number the first shipped), about a part from a supplier, for a year."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    first = F.min(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")).alias("f")
    t = rows.agg(first).select("l_orderkey", "l_linenumber", "f.*")
    start = epoch_seconds(F.col("l_shipdate"))
    attrs = {"part": F.col("l_partkey"), "supp": F.col("l_suppkey"), "flag": F.col("l_returnflag")}
    uid = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return from_wide(t, F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.lit("line"), F.col("l_linestatus"), uid, attrs, start, start + 365 * DAY)


def sessions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An event of a user as seen by one of three sources, for six hours, in microseconds."""
    t = table(spark, sf_dir, "events")
    start = epoch_micros(F.col("ts"))
    source = F.concat(F.lit("src"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    attrs = {"user": F.col("user_id"), "type": F.col("event_type")}
    return from_wide(t, F.col("event_id"), F.lit("session"), source, F.col("event_id"), attrs, start, start + 6 * 3600 * 1_000_000)


def texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document with its text's hash, source and length, within a stretch of ids."""
    t = table(spark, sf_dir, "documents")
    attrs = {"hash": F.sha2(F.coalesce("text", F.lit("")), 256), "source": F.col("source"), "chars": F.col("n_chars"), "lang": F.col("lang")}
    return from_wide(t, F.col("doc_id"), F.lit("doc"), F.col("source"), F.col("doc_id"), attrs, F.col("doc_id"), F.col("doc_id") + 100)


def customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A customer of a segment, with nation and name, on an opaque axis."""
    t = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    attrs = {"nation": F.col("n_name"), "name": F.col("c_name")}
    start = (F.col("c_custkey") % 97).cast("long")
    return from_wide(t, F.col("c_custkey"), F.lit("customer"), F.col("c_mktsegment"), F.col("c_custkey"), attrs, start, start + 5 + F.col("c_custkey") % 11)


ORDERS = Ontology(perspective_weights={"1-URGENT": 50, "2-HIGH": 40, "3-MEDIUM": 30}, permanent_attributes={"1-URGENT": ("status",), "2-HIGH": ("status", "cust"), "5-LOW": ("cust",)}).add_identity_key("by_customer", "cust").add_strong_identifier("status").add_constraint("unique_status", "status")
PLAIN_ORDERS = Ontology().add_identity_key("by_customer", "cust")
LINES = Ontology().add_identity_key("part_supp", "part", "supp").add_strong_identifier("flag")
SESSIONS = Ontology().add_identity_key("by_user", "user").add_strong_identifier("type")
TEXTS = Ontology().add_identity_key("by_hash", "hash").add_identity_key("by_source", "source", "chars")
CUSTOMERS = Ontology().add_identity_key("by_name", "name").add_identity_key("by_nation", "nation", "name")

#: The same tables for DuckDB: r_* records, d_* descriptors.
SQL = r"""
r_ord AS (SELECT o_orderkey AS record_id, 'order' AS entity_type, o_orderpriority AS perspective, CAST(o_orderkey AS VARCHAR) AS uid FROM orders),
t_ord AS (SELECT *, epoch_us(o_orderdate) // 1000000 AS s FROM orders),
d_ord AS (
  SELECT o_orderkey AS record_id, 'cust' AS attr, CAST(o_custkey AS VARCHAR) AS value, s AS start_ts, s + 15552000 AS end_ts FROM t_ord WHERE o_custkey IS NOT NULL
  UNION ALL SELECT o_orderkey, 'status', o_orderstatus, s, s + 15552000 FROM t_ord WHERE o_orderstatus IS NOT NULL),
k_ord AS (SELECT record_id, value AS k, start_ts, end_ts FROM d_ord WHERE attr = 'cust'),
n_ord AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR start_ts >= max(end_ts) OVER (PARTITION BY k ORDER BY start_ts, end_ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh
          FROM k_ord WINDOW w AS (PARTITION BY k ORDER BY start_ts, end_ts, record_id)),
i_ord AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY start_ts, end_ts, record_id ROWS UNBOUNDED PRECEDING) AS island FROM n_ord),
a_ord AS (SELECT record_id, min(record_id) OVER (PARTITION BY k, island) AS cluster_id FROM i_ord),
v_ord AS (SELECT a.cluster_id, d.* FROM d_ord d JOIN a_ord a USING (record_id)),
t_li AS (SELECT *, l_orderkey * 10 + l_linenumber AS record_id, epoch_us(l_shipdate) // 1000000 AS s FROM lineitem
         QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_returnflag, l_linestatus) = 1),
r_li AS (SELECT record_id, 'line' AS entity_type, l_linestatus AS perspective, l_orderkey || '-' || l_linenumber AS uid FROM t_li),
d_li AS (
  SELECT record_id, 'part' AS attr, CAST(l_partkey AS VARCHAR) AS value, s AS start_ts, s + 31536000 AS end_ts FROM t_li
  UNION ALL SELECT record_id, 'supp', CAST(l_suppkey AS VARCHAR), s, s + 31536000 FROM t_li
  UNION ALL SELECT record_id, 'flag', l_returnflag, s, s + 31536000 FROM t_li),
t_ev AS (SELECT *, epoch_us(ts) AS s FROM events),
r_ev AS (SELECT event_id AS record_id, 'session' AS entity_type, 'src' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS perspective, CAST(event_id AS VARCHAR) AS uid FROM t_ev),
d_ev AS (
  SELECT event_id AS record_id, 'user' AS attr, CAST(user_id AS VARCHAR) AS value, s AS start_ts, s + 21600000000 AS end_ts FROM t_ev
  UNION ALL SELECT event_id, 'type', event_type, s, s + 21600000000 FROM t_ev),
r_doc AS (SELECT doc_id AS record_id, 'doc' AS entity_type, source AS perspective, CAST(doc_id AS VARCHAR) AS uid FROM documents),
d_doc AS (
  SELECT doc_id AS record_id, 'hash' AS attr, sha256(coalesce(text, '')) AS value, doc_id AS start_ts, doc_id + 100 AS end_ts FROM documents
  UNION ALL SELECT doc_id, 'source', source, doc_id, doc_id + 100 FROM documents WHERE source IS NOT NULL
  UNION ALL SELECT doc_id, 'chars', CAST(n_chars AS VARCHAR), doc_id, doc_id + 100 FROM documents WHERE n_chars IS NOT NULL
  UNION ALL SELECT doc_id, 'lang', lang, doc_id, doc_id + 100 FROM documents WHERE lang IS NOT NULL),
r_cu AS (SELECT c_custkey AS record_id, 'customer' AS entity_type, c_mktsegment AS perspective, CAST(c_custkey AS VARCHAR) AS uid FROM customer),
t_cu AS (SELECT c_custkey, n_name, c_name, c_custkey % 97 AS s, c_custkey % 97 + 5 + c_custkey % 11 AS e FROM customer JOIN nation ON c_nationkey = n_nationkey),
d_cu AS (
  SELECT c_custkey AS record_id, 'nation' AS attr, n_name AS value, s AS start_ts, e AS end_ts FROM t_cu
  UNION ALL SELECT c_custkey, 'name', c_name, s, e FROM t_cu)
"""


def sql(query: str) -> str:
    """A query over those tables; further WITH parts go before its final SELECT."""
    return f"WITH RECURSIVE {SQL.strip()},\n{query.strip()}" if not query.lstrip().upper().startswith("SELECT") else f"WITH RECURSIVE {SQL.strip()}\n{query.strip()}"
