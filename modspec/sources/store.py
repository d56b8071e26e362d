"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def _set_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: later steps read it more than once.

    The folder is ``spark.checkpoint.dir``; only in local mode a temporary one stands in.
    """
    _set_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As ``stored``, as Parquet in the same folder: for large tables whose columns compress, and whose partitioning no later step needs."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition of ``spread``.
SPREAD_ROWS = 100_000


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """``df`` by hash of ``keys``, in ``spark.sql.shuffle.partitions`` parts or one for each SPREAD_ROWS rows, whichever are more.

    Groups and windows over these and more columns need no other shuffle, and a
    task's share doesn't grow with the table.  The rows are counted first.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SPREAD_ROWS))
    return df.repartition(parts, *keys)


def spread_beyond(df: DataFrame, rows: int, *keys: str | Column) -> DataFrame:
    """``df`` of about ``rows`` rows by hash of ``keys``, in a part for each SPREAD_ROWS, where Spark's own parts would be larger; else as it is."""
    parts = -(-rows // SPREAD_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, for files that are written and read again."""
    _set_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
