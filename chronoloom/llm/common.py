"""Helpers that the corpus operators share.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` (the
folder that all executors see), so a lost executor never takes data with it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to Python code at once, so that memory follows this bound and not the Arrow batch.
SLICE_CHARS = 2_000_000
SLICE_ROWS = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}
#: Lists of the tables written in each open ``scratch``, the innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session, where all tasks see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.setdefault(app, "") or tempfile.mkdtemp(prefix="corpus-")
        _OWN[app] = where
    return where.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted when it ends, but for those handed to the function that it yields."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.table_path)
        return df

    _OPEN.append(made)
    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for path in made:
            if path not in kept:
                remove_dir(spark, path)
        if _OPEN:
            _OPEN[-1].extend(kept)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results through Hadoop's file system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it ends: what it wrote is read from the table after that."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def write_table(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet and returns the frame that reads it."""
    spark = df.sparkSession
    writer = df.write
    if codec:
        writer = writer.option("compression", codec)
    with _clean_shuffles(spark):
        writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.table_path = path
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of ``df``: later steps read the shared table instead of computing it again."""
    return write_table(df, fresh_dir(df.sparkSession, name))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's way to give freed memory back; not all have one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def release() -> None:
    """Gives memory that is free back to the system: a Python worker stays for later tasks, and else keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(column) -> Iterator[list]:
    """Python values of an Arrow column, a bounded number of rows and bytes at a time."""
    n, at = len(column), 0
    lens = None
    if n:
        import pyarrow.compute as pc

        lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    while at < n:
        end, size = at, 0
        while end < n and end - at < SLICE_ROWS and (size == 0 or size + lens[end] <= SLICE_CHARS):
            size += int(lens[end])
            end += 1
        yield column.slice(at, end - at).to_pylist()
        at = end


def text_key(text: str = "text"):
    """128 bits that stand for a text: two independent 64-bit hashes; equal for equal texts (null: as empty)."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(7), t).alias("b"))


def with_columns(df: DataFrame, made: dict) -> DataFrame:
    """Adds columns; one of the same name in the input (in any letter case) gives way."""
    return df.withColumns(made)


def unique_name(df: DataFrame, base: str) -> str:
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def unique_names(df: DataFrame, *bases: str) -> list[str]:
    """Names for internal columns that no column of ``df`` has, in any letter case."""
    return [unique_name(df, f"_{b}") for b in bases]


def flatten(parts: Iterable[Iterable]) -> list:
    return [x for part in parts for x in part]
