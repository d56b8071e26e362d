"""Exact deduplication over an extendible-hash index in the shared folder.

A directory of 2 ** depth slots, addressed by the leading bits of a 64-bit
hash of the text, points to buckets; a bucket with more keys than its capacity
is split by one more bit, and the directory doubles when a bucket as deep as
itself has to be split.  Each bucket is a key range with an owner task, which
writes the bucket's file, sorted by key.  Texts that clash in their hash are
chained under one key, told apart by comparing their bytes.

Rows of a key are combined before any shuffle, so a text with any number of
copies is one entry, and a text of any length is hashed whole.  The capacity
is a sixteenth of a task's share of the keys, within LEAST and MOST, so the
directory, which the driver holds, has some slots for every MOST keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import new_path, stored, tasks, without_rows

#: Least and most keys of a bucket before it is split.
LEAST, MOST = 1_000, 1_000_000
#: Up to so many keys with copies are broadcast to the scan (about 20 bytes each); beyond, it is a shuffled join.
BROADCAST_KEYS = 1_000_000


def grow_directory(counts: dict[int, int], bits: int, capacity: int) -> list[int]:
    """Doubles a directory and splits its buckets until none is overfull or ``bits`` deep.

    ``counts``: keys by their first ``bits`` bits.  Returns the bucket of each slot,
    numbered by key range; the length is 2 ** depth.
    """
    sums = [[counts.get(i, 0) for i in range(1 << bits)]]
    while len(sums[-1]) > 1:
        sums.append([a + b for a, b in zip(sums[-1][::2], sums[-1][1::2])])
    sums.reverse()  # sums[d][p]: keys with the d-bit prefix p
    depth, slots = 0, [(0, 0)]
    while any(sums[d][p] > capacity and d < bits for d, p in slots):
        overfull = {b for b in slots if sums[b[0]][b[1]] > capacity and b[0] < bits}
        if any(d == depth for d, _ in overfull):
            slots = [b for b in slots for _ in range(2)]
            depth += 1
        slots = [(b[0] + 1, i >> (depth - b[0] - 1)) if b in overfull else b for i, b in enumerate(slots)]
    number = {b: i for i, b in enumerate(dict.fromkeys(slots))}
    return [number[b] for b in slots]


def _leading(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else key.bitwiseAND(F.lit(0)).cast("int")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=text_key, capacity: int | None = None) -> DataFrame:
    """Writes the index and returns it: bucket, key, chain (0, 1, ... by falling keep_id), chains, text (null unless chained), keep_id, group_size."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), key(text).alias("key"))
    entries = stored(rows.groupBy("key").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "entries")
    total = entries.count()
    capacity = capacity or min(MOST, max(LEAST, total // (16 * tasks(spark))))
    bits = min(40, max(0, (4 * total // capacity).bit_length()))
    counts = {r[0]: r[1] for r in entries.groupBy(_leading(F.col("key"), bits)).count().collect()}  # some eight for each bucket
    slots = grow_directory(counts, bits, capacity)
    depth = len(slots).bit_length() - 1
    directory = spark.createDataFrame(list(enumerate(slots)), "slot int, bucket int")

    several = entries.where("group_size > 1").select("key")
    several = F.broadcast(several) if several.count() <= BROADCAST_KEYS else several
    # the bytes of texts of one key are compared here; equal ones combine before the shuffle
    chains = rows.join(several, "key").groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    chains = stored(chains, "chains")
    number = chains.groupBy("key").agg(F.count("*").alias("chains"), F.sort_array(F.collect_list(F.struct("keep_id", F.xxhash64("text"), "text")), False).alias("links")).where("chains > 1")
    clashing = number.select("key", "chains", F.posexplode("links").alias("chain", "link")).select("key", "chains", "chain", F.col("link.text").alias("text"))
    alone = chains.join(number.select("key"), "key", "left_anti").select("key", F.lit(1).cast("long").alias("chains"), F.lit(0).alias("chain"), F.lit(None).cast("string").alias("text"), "keep_id", "group_size")
    chained = clashing.join(chains, ["key", "text"]).select("key", "chains", "chain", "text", "keep_id", "group_size")
    single = entries.where("group_size = 1").select("key", F.lit(1).cast("long").alias("chains"), F.lit(0).alias("chain"), F.lit(None).cast("string").alias("text"), "keep_id", "group_size")
    index = single.union(alone).union(chained).withColumn("slot", _leading(F.col("key"), depth)).join(F.broadcast(directory), "slot").drop("slot")  # the driver made it
    path = new_path(spark, "index")
    # an owner task has the buckets of a key range and writes their file
    index.repartitionByRange(min(tasks(spark), max(slots) + 1), "bucket").sortWithinPartitions("bucket", "key", "chain").write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key=text_key, capacity: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, key (the text's hash).

    Texts are equal when their bytes are; null counts as empty.  Of equal texts
    the largest doc_id stays (``kept``); a null doc_id never beats another one,
    and rows that repeat text and doc_id share their fate.  Further columns are
    ignored; an empty table gives an empty result.
    """
    index = build_index(docs, id_col, text_col, key, capacity)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), key(text).alias("key"), F.sha2(text, 256).alias("text_sha256"))
    out = lambda df: df.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "key")
    found = rows.drop("text").join(index.where("chains = 1").select("key", "keep_id", "group_size"), "key")
    chained = index.where("chains > 1").select("key", "text", "keep_id", "group_size")
    if not chained.limit(1).count():
        return out(found)
    return out(found).union(out(rows.join(chained, ["key", "text"])))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, the one with the largest doc_id.

    Of rows that repeat text and doc_id one stays; rows of one doc_id with
    different texts are different documents; a null doc_id never beats another.
    """
    rows = stored(exact_groups(docs, id_col, text_col).groupBy("doc_id", "kept", F.col("key").alias("text_hash")).count(), "grouped")
    return without_rows(docs, rows.where("not kept"), rows.where("kept and count > 1"), id_col, text_col)
