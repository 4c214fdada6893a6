"""Line deduplication with keep bitmaps, on DataFrame operations alone.

The keys of a document's lines are hashed to 128 bits and go, as narrow rows,
to partitions by hash range.  Each partition aggregates them by hash and
document (smallest position) and then by hash (first occurrence, number of
documents) before a second exchange by hash, so a line found everywhere
ends as a row for each partition it reached and no task gathers it.  What comes
back for each document is the run-length coded bitmap of its dropped lines;
texts only meet their own bitmap.

Defined cases: null and empty texts have one empty line, whose empty key never
counts; rows of one doc_id (or of none) and one text are one document when keys
are counted, those of one doc_id and different texts are several; each row
stays, with its own lines; of equal first lines that of the least hash of its
text counts as first; a line or text of any length is hashed whole; an empty
table gives no rows; further columns stay whatever their names, one of an
output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, unique_names

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    """A line with white space stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


def _row_hash(prefix: int) -> Column:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(F.lit(prefix), F.col("doc_id"), text)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """Every line with a key of ``min_chars`` code points: the key's hash, the document and the position."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _row_hash(1).alias("row"),
        F.transform(lines_of(F.col("text")), key_of).alias("keys"),
    )
    rows = keyed.select("doc_id", "row", F.posexplode("keys").alias("pos", "key")).where(F.char_length("key") >= min_chars)
    return rows.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"), "doc_id", "row", "pos")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Documents that lose lines: doc_id, row (hash that tells rows apart), n_dropped, drop_runs.

    A key in ``min_docs`` documents or more loses all its lines; with
    ``keep_first`` its first line (smallest doc_id, then position) stays.
    ``drop_runs`` holds [start, length, start, length, ...] of dropped lines.
    """
    n = partitions(docs.sparkSession)
    occurrences = materialise(_occurrences(docs, min_chars), "line-keys")
    ranged = occurrences.repartitionByRange(n, "h", "g", "doc_id", "row").sortWithinPartitions("h", "g", "doc_id", "row", "pos")
    # a key's rows of one document count once, at the smallest position; the sort above asks for nothing here: minima
    # and counts need no order, so Spark leaves it out of the plan
    per_doc = ranged.groupBy("h", "g", "doc_id", "row").agg(F.min("pos").alias("pos"))
    keys = per_doc.groupBy("h", "g").agg(
        F.count(F.lit(1)).alias("docs"),
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "pos")).alias("first"),
    )
    # written first, so that the join below has a plain exchange on both sides, which Spark can split where a key is hot
    common = materialise(keys.where(F.col("docs") >= min_docs).select("h", "g", "first"), "line-common")
    hits = occurrences.join(common, ["h", "g"])
    if keep_first:
        hits = hits.where(~((F.col("row") == F.col("first.row")) & (F.col("pos") == F.col("first.pos")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))))
    dropped = hits.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    starts = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    ends = F.filter("at", lambda p, i: (i == F.size("at") - 1) | (F.get("at", i + 1) != p + 1))
    runs = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b - a + 1)))
    return dropped.select("doc_id", "row", F.size("at").cast("long").alias("n_dropped"), runs.alias("drop_runs"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, kept: str = "kept_text") -> DataFrame:
    """Adds n_lines, n_dropped, drop_runs and the kept text to every row of ``docs``."""
    docs = docs.drop("n_lines", "n_dropped", "drop_runs", *([kept] if kept not in ("doc_id", "text") else []))
    row, own, bid, brow, n, runs, lines = unique_names(docs, "row", "id", "bid", "brow", "n", "runs", "lines")
    left = docs.withColumns({row: _row_hash(1), own: F.col("doc_id").cast("long")})
    right = bitmaps.select(F.col("doc_id").alias(bid), F.col("row").alias(brow), F.col("n_dropped").alias(n), F.col("drop_runs").alias(runs))
    met = left.join(right, (F.col(row) == F.col(brow)) & F.col(own).eqNullSafe(F.col(bid)), "left")
    met = met.withColumn(lines, lines_of(F.col("text")))
    count = F.size(runs) / 2
    past = lambda k: F.when(k == 0, 0).otherwise(F.get(runs, 2 * k - 2) + F.get(runs, 2 * k - 1))
    until = lambda k: F.coalesce(F.get(runs, 2 * k), F.size(lines))
    stay = F.flatten(F.transform(F.sequence(F.lit(0), count.cast("int")), lambda k: F.slice(lines, past(k) + 1, until(k) - past(k))))
    text = F.when(F.col(n).isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    made = {
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.coalesce(F.col(n), F.lit(0).cast("long")),
        "drop_runs": F.coalesce(F.col(runs), F.array().cast("array<int>")),
        kept: text,
    }
    return met.withColumns(made).drop(row, own, bid, brow, n, runs, lines)


__all__ = ["apply_bitmaps", "keep_bitmaps", "key_of", "lines_of"]
