"""Tables in the shared folder, and small things that several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many rows of two numbers are broadcast to a scan of whole documents (16 MB); beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, the context's own, or a temporary one in local mode.

    Tables there stay until ``drop_tables`` is called or the folder is cleared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            return jsc.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="modspec-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


#: Paths of this process's tables.
_paths: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _paths.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _paths[-1]


def drop_tables(spark: SparkSession) -> None:
    """Deletes the tables that this process has stored, once all results that read them are written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_hash(text_col: str) -> Column:
    """With the doc_id, it tells rows apart whose ids repeat or are null; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _beside(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """Semi or anti join of whole documents with rows (doc_id, text_hash)."""
    own_id, own_hash = fresh(docs, "_id"), fresh(docs, "_hash")
    rows = stored(rows.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)), "rows")
    same = docs[id_col].cast("long").eqNullSafe(F.col(own_id)) & text_hash(text_col).eqNullSafe(F.col(own_hash))
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same, how)


def without_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows ``dropped`` (doc_id, text_hash), and with one row each of those in ``repeated``.

    Rows that repeat id and text differ in other columns at most; the one with
    the least hash over all columns stays.
    """
    kept = _beside(docs, dropped, id_col, text_col, "left_anti")
    repeated = stored(repeated.select("doc_id", "text_hash"), "repeated")
    if not repeated.limit(1).count():
        return kept
    several = _beside(docs, repeated, id_col, text_col, "left_semi")
    least = F.min(F.struct(F.xxhash64(*docs.columns).alias("_row"), F.struct(*docs.columns).alias("_all")))
    one = several.groupBy(F.col(id_col).alias(fresh(docs, "_id")), text_hash(text_col).alias(fresh(docs, "_hash"))).agg(least.alias("_least"))
    return _beside(kept, repeated, id_col, text_col, "left_anti").union(one.select("_least._all.*"))
