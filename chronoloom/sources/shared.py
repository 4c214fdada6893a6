"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session, where all tasks see it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        where = _OWN.setdefault(app, "") or tempfile.mkdtemp(prefix="chronoloom-")
        _OWN[app] = where
    return where.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage: what is returned reads a table that outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few declared rows as a local relation, which needs no Python worker to read."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kind.names)
    target = to_arrow_schema(kind)
    arrays = [pa.array(list(c), target.field(i).type) for i, c in enumerate(columns)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=target), kind)
