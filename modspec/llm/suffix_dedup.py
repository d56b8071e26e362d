"""Removal of repeated byte strings by a distributed difference cover.

A position is *repeated* if the string of ``length`` bytes that starts there
also starts anywhere else; every byte that such a string covers goes.  Sorting
all suffixes isn't needed for that, only which of them share ``length`` bytes:

1. *sample*: positions whose offset in their document is in a difference cover
   modulo v.  For any two positions some shift below v takes both into the
   sample, so equal strings share a sampled string of length - v + 1 bytes at
   the same place in both.
2. *names*: sampled strings are named by hash and sorted in buckets (key
   ranges); equal neighbours are repeated names.  A name that occurs once
   settles all positions that lean on it, so only the others go on.
3. *merge*: a position within v before a repeated name is named by the hash of
   its whole ``length`` bytes and sorted likewise; equal neighbours are
   repeated positions.

Texts are kept as blocks in a bucketed table of the shared folder.  A block
sends each of its names to a bucket once, and gets back one bit for each, so
whatever is repeated any number of times costs a bucket one name for a block.
Equal texts are one in steps 1 to 3.  Names of strings are 64-bit hashes (in
step 2, 32 bits within a bucket, where a clash only costs time).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import new_path, stored, tasks
from modspec.llm._shingles import U, mix, string_buffers

LENGTH = 200
#: Perfect difference sets by their modulus (of prime powers 2, 3, 9).
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}
BLOCK_BYTES = 1 << 20
#: Up to so many keys of repeated texts are broadcast to the scan (16 bytes each); beyond, it is a shuffled join.
BROADCAST_KEYS = 1_000_000

with np.errstate(over="ignore"):
    _BASE = 0x9E3779B97F4A7C15
    _BYTES = mix(np.arange(1, 257, dtype=U) * U(_BASE))


class _Rolling:
    """Hashes of the windows of one block of bytes."""

    _powers = np.ones(1, U)
    _inverses = np.ones(1, U)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(self._powers) <= n:
            with np.errstate(over="ignore"):
                size = max(n + 1, BLOCK_BYTES + 1)
                for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
                    out = np.ones(size, U)
                    out[1:] = np.cumprod(np.full(size - 1, base, U))
                    setattr(_Rolling, name, out)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, U), np.cumsum(_BYTES[data] * self._powers[:n], dtype=U)])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[places + length] - self.sums[places]) * self._inverses[places])


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    v = max((m for m in COVERS if 2 * m <= length + 1), default=1)
    return v, COVERS.get(v, (0,))


def _samples(ends: np.ndarray, length: int) -> np.ndarray:
    """Sampled places of a block whose documents end at ``ends``."""
    v, cover = cover_for(length)
    starts = np.concatenate([[0], ends[:-1]])
    sampled = np.zeros(v, bool)
    sampled[list(cover)] = True
    offset = np.arange(ends[-1]) - np.repeat(starts, ends - starts)
    left = np.repeat(ends, ends - starts) - np.arange(ends[-1])
    return np.flatnonzero(sampled[offset % v] & (left >= length - v + 1))


def _candidates(ends: np.ndarray, anchors: np.ndarray, length: int) -> np.ndarray:
    """Places with a repeated sample less than v further on and ``length`` bytes left."""
    v, _ = cover_for(length)
    n = int(ends[-1])
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.maximum(anchors - v + 1, 0), 1)
    np.add.at(marks, anchors + 1, -1)
    near = np.cumsum(marks[:n]) > 0
    starts = np.concatenate([[0], ends[:-1]])
    left = np.repeat(ends, ends - starts) - np.arange(n)
    return np.flatnonzero(near & (left >= length))


def _named(hashes: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and name (``width`` bytes) of the distinct hashes in order, whether each occurs twice, and each hash's place among them."""
    bucket = ((hashes >> U(32)) * U(buckets)) >> U(32)
    if width == 4:
        hashes = bucket << U(32) | (hashes & U(0xFFFFFFFF))
    keys, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    first = np.zeros(len(keys), np.int64)
    first[inverse] = np.arange(len(inverse))
    return bucket[first], keys & U((1 << (8 * width)) - 1), counts > 1, inverse


def _places(block: dict, length: int, buckets: int, bits: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the block's samples, or with their bits of the candidates."""
    rolling = block["rolling"]
    samples = _samples(block["ends"], length)
    v, _ = cover_for(length)
    hashes = rolling.at(samples, length - v + 1)
    if bits is None:
        return samples, hashes
    anchors = samples[_marked(hashes, buckets, 4, bits)]
    places = _candidates(block["ends"], anchors, length)
    return places, rolling.at(places, length)


def _marked(hashes: np.ndarray, buckets: int, width: int, bits: list[dict]) -> np.ndarray:
    """Which hashes are repeated, from the bits that the buckets sent back."""
    bucket, _, _, inverse = _named(hashes, buckets, width)
    edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))
    repeated = np.zeros(len(bucket), bool)
    for x in bits:
        a, b = edge[x["bucket"]], edge[x["bucket"] + 1]
        repeated[a:b] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return repeated[inverse]


def _block(ends: list[int], data: bytes) -> dict:
    array = np.frombuffer(data, np.uint8)
    return {"ends": np.array(ends, np.int64), "data": array, "rolling": _Rolling(array)}


def _repeats(blocks: DataFrame, length: int, buckets: int, width: int, with_bits: bool) -> DataFrame:
    """(block, bits): for each block the buckets' answers on its names."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                _, hashes = _places(_block(r["ends"], r["data"]), length, buckets, (r["bits1"] or []) if with_bits else None)
                bucket, name, twice, _ = _named(hashes, buckets, width)
                raw = name.view(np.uint8).reshape(-1, 8)[:, :width]
                edge = np.searchsorted(bucket, np.arange(buckets + 1, dtype=U))
                full = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full.astype(np.int32)), pa.array(np.full(len(full), r["block"], np.int64)),
                    pa.array([raw[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary()), pa.array([np.packbits(twice[edge[k] : edge[k + 1]]).tobytes() for k in full], pa.binary()),
                ], ["bucket", "block", "names", "twice"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if held and r["bucket"] != now:
                    yield met(now, held)
                    held = []
                now = r["bucket"]
                held.append(r)
        if held:
            yield met(now, held)

    def met(bucket: int, held: list[dict]) -> pa.RecordBatch:
        sizes = [len(r["names"]) // width for r in held]
        names = np.zeros((sum(sizes), 8), np.uint8)
        names[:, :width] = np.frombuffer(b"".join(r["names"] for r in held), np.uint8).reshape(-1, width)
        names = names.view(U).ravel()
        repeated = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=n) for r, n in zip(held, sizes)]).astype(bool)
        order = np.argsort(names)
        same = names[order][1:] == names[order][:-1]
        repeated[order[1:][same]] = True
        repeated[order[:-1][same]] = True
        at = np.cumsum([0, *sizes])
        kept = [(r["block"], np.packbits(repeated[a:b]).tobytes()) for r, a, b in zip(held, at[:-1], at[1:]) if repeated[a:b].any()]
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array(np.full(len(kept), bucket, np.int32)), pa.array([k[1] for k in kept], pa.binary())], ["block", "bucket", "bits"])

    sent = blocks.mapInArrow(send, "bucket int, block long, names binary, twice binary")
    answers = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "block long, bucket int, bits binary")
    # a block hears from each bucket once at most
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (array of removed runs: start, stop in bytes), kept (binary) for each row of ``docs``.

    Texts are UTF-8 bytes, null is empty; strings never cross documents and
    are judged on the input.  Texts of fewer than ``length`` bytes lose
    nothing; rows that repeat an id are documents of their own.  A very long
    text is a block of its own, held by one task.  Further columns are
    ignored; an empty table gives an empty result.
    """
    return _spans_and_blocks(docs, id_col, text_col, length)[0]


def _spans_and_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, str]:
    """The spans, and the name of the table of blocks that they are read from."""
    spark = docs.sparkSession
    n_buckets = 4 * tasks(spark)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), data.alias("data")).withColumn("key", F.struct(F.xxhash64("data"), F.length("data"), F.substring(F.sha2("data", 256), 1, 16)))
    # equal texts: all of them go (or none, if short); the one with the least id stands for them
    twins = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("key", "first_id")
    twins = stored(twins, "twins")
    twins = F.broadcast(twins) if twins.count() <= BROADCAST_KEYS else twins
    return _spans_of(spark, rows, twins, length, n_buckets)


def _spans_of(spark, rows: DataFrame, twins: DataFrame, length: int, n_buckets: int) -> tuple[DataFrame, str]:
    marked = rows.join(twins.withColumn("twin", F.lit(True)), "key", "left").withColumn("twin", F.coalesce("twin", F.lit(False)))
    size = F.length("data")
    span = "array<struct<start:bigint,stop:bigint>>"
    none = F.array().cast(span)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("stop")))
    settled = marked.where(F.col("twin") | (size < length))
    settled = settled.select("doc_id", size.cast("long").alias("n_bytes"), F.when(size < length, none).otherwise(whole).alias("spans"), F.when(size < length, F.col("data")).otherwise(F.lit(b"")).alias("kept"))
    standing = marked.where((size >= length) & (~F.col("twin") | F.col("doc_id").eqNullSafe(F.col("first_id"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, twin, texts, held = [], [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([
                pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([twin], pa.list_(pa.bool_())),
                pa.array([np.cumsum([len(t) for t in texts])], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary())], ["block", "ids", "twin", "ends", "data"])

        for batch in batches:
            for i, t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = x.as_py()
                if texts and held + len(x) > BLOCK_BYTES:
                    yield out()
                    ids, twin, texts, held = [], [], [], 0
                ids.append(i)
                twin.append(t)
                texts.append(x)
                held += len(x)
        if texts:
            yield out()

    packed = standing.select("doc_id", "twin", "data").mapInArrow(pack, "block long, ids array<bigint>, twin array<boolean>, ends array<bigint>, data binary")
    name = f"blocks_{uuid.uuid4().hex}"
    packed.write.bucketBy(tasks(spark), "block").option("path", new_path(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)
    bits1 = stored(_repeats(blocks.select("block", "ends", "data"), length, n_buckets, 4, False), "bits")
    with1 = blocks.join(bits1.withColumnRenamed("bits", "bits1"), "block")
    bits2 = stored(_repeats(with1.select("block", "ends", "data", "bits1"), length, n_buckets, 7, True), "bits")
    full = blocks.join(bits1.withColumnRenamed("bits", "bits1"), "block", "left").join(bits2.withColumnRenamed("bits", "bits2"), "block", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = _block(r["ends"], r["data"])
                gone = np.zeros(len(block["data"]) + 1, np.int32)
                if r["bits1"] and r["bits2"]:
                    places, hashes = _places(block, length, n_buckets, r["bits1"])
                    places = places[_marked(hashes, n_buckets, 7, r["bits2"])]
                    np.add.at(gone, places, 1)
                    np.add.at(gone, places + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                out, start = [], 0
                for i, twin, end in zip(r["ids"], r["twin"], r["ends"]):
                    if not twin:
                        g = gone[start:end]
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                        out.append((i, end - start, [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2])], block["data"][start:end][~g].tobytes()))
                    start = end
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(cols[3], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    cuts = full.mapInArrow(cut, f"doc_id long, n_bytes long, spans {span}, kept binary")
    return settled.union(cuts), name


def repeat_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spans, blocks = _spans_and_blocks(docs, **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    digest = stored(spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "digest")
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {blocks}")  # its files stay in the shared folder
    return digest
