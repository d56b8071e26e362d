"""Benchmark decontamination: items whose word shingles a document contains.

Shingles that no item has can't matter, so each document is first projected on
the items' shingles; documents without any are done.  What is left of a
document is put in a size partition (powers of two), where containment of at
least ``percent`` of an item of n shingles bounds the Jaccard similarity from
below: 0.8n / (n + u - 0.8n) for a partition up to size u.  That bound sets how
many min-hashes item and document have to compare so that fewer than one pair
in 10**9 is missed.  Where it asks for more than MAX_HASHES (tiny items in
documents with many), any n - ceil(0.8n) + 1 of the item's shingles are looked
up instead, of which a containing document has one for certain.  Candidates
are checked by exact containment.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import stored, text_hash, without_rows
from modspec.llm._shingles import U, mix, per_row

MAX_HASHES = 64
MISS = 1e-9
#: Up to so many distinct item shingles (8 bytes each) go to the tasks; beyond, documents' shingles meet them in a join.
BROADCAST_SHINGLES = 2_000_000
SIGNATURES = "part int, fn int, value long, id long"


def hashes_needed(n: int, part: int, percent: int) -> int:
    """Min-hashes for items of n shingles in documents with up to 2 ** part; 0 where none can contain it, -1 for exact lookup."""
    most = 1 << part
    least = -(-percent * n // 100)
    if most < least:
        return 0
    jaccard = least / (n + most - least)
    need = 1 if jaccard >= 1 else ceil(log(MISS) / log(1 - jaccard))
    return need if need <= MAX_HASHES else -1


def _minima(items: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each of the first n hash functions over a set."""
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        return mix(items[:, None] ^ seeds[None, :]).min(0).view(np.int64)


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(id, row, items) for (id, row, text): distinct shingles, sorted; texts without words are left out."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, bounds in per_row(batch.column(2), words):
                held = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))
                some = batch.slice(first, len(held))
                out = pa.RecordBatch.from_arrays([some.column(0), some.column(1), held], ["id", "row", "items"])
                yield out.filter(pa.array(np.diff(bounds) > 0))

    return df.mapInArrow(sets, "id long, row long, items array<bigint>")


def _projected(docs: DataFrame, items: DataFrame, words: int) -> DataFrame:
    """(id, row, items): the shingles of each text that some item has, if any."""
    known = items.select(F.explode("items").alias("shingle")).distinct()
    if known.count() > BROADCAST_SHINGLES:
        # equal texts have equal sets, so one row of each goes to the join
        sets = _sets(docs, words)
        rows = sets.groupBy("id").agg(F.first("items").alias("items")).select("id", F.explode("items").alias("shingle"))
        met = rows.join(known, "shingle", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("shingle")).alias("items"))
        return met.join(docs.select("id", "row").distinct(), "id").select("id", "row", "items")
    universe = np.sort(known.toArrow().column(0).to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(universe)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        universe = shared.value
        for batch in batches:
            for first, flat, bounds in per_row(batch.column(2), words):
                if not len(flat) or not len(universe):
                    continue
                values = flat.view(np.int64)
                at = np.searchsorted(universe, values)
                at[at == len(universe)] = 0
                found = universe[at] == values
                counts = np.diff(np.concatenate([[0], np.cumsum(found)])[bounds])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[found]))
                some = batch.slice(first, len(held))
                out = pa.RecordBatch.from_arrays([some.column(0), some.column(1), held], ["id", "row", "items"])
                yield out.filter(pa.array(counts > 0))

    return docs.mapInArrow(hits, "id long, row long, items array<bigint>")


def _signatures(sets: DataFrame, percent: int, parts: list[int], of_items: bool) -> DataFrame:
    """Rows (part, fn, value, id); fn -1 stands for a shingle itself."""

    def rows_of(items: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        n = len(items)
        if of_items:
            for part in parts:
                need = hashes_needed(n, part, percent)
                if need > 0:
                    yield part, 0, _minima(items.view(U), need)
                elif need < 0:
                    yield part, -1, items[: n - -(-percent * n // 100) + 1]
        else:
            part = max(0, (n - 1).bit_length())
            yield part, 0, _minima(items.view(U), MAX_HASHES)
            yield part, -1, items

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            for i in range(batch.num_rows):
                for part, fn, values in rows_of(lists[i].values.to_numpy()):
                    k = len(values)
                    for col, x in zip(cols, (np.full(k, part), np.arange(k) if fn == 0 else np.full(k, -1), values, np.full(k, ids[i]))):
                        col.append(x)
            if cols[0]:
                a, b, c, d = (np.concatenate(x) for x in cols)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(c), pa.array(d)], ["part", "fn", "value", "id"])

    return sets.mapInArrow(sign, SIGNATURES)


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row for each document and item of which it has at least ``percent`` in a hundred shingles: doc_id, text_hash, item_id, n_item, n_common.

    Words and shingles as in the n-gram join; an item with fewer than ``words``
    words is one shingle, found only in documents that are just that.  Null and
    empty texts match nothing; null ids are kept.  Rows that repeat an id with
    other texts are documents, or items, of their own; rows that repeat id and
    text count once.  A text of any length is searched whole, by one task.
    Further columns are ignored; an empty table on either side gives an empty result.
    """
    bench = benchmark.select(F.xxhash64(F.col(item_col), F.col(item_text_col)).alias("id"), F.col(item_col).cast("long").alias("row"), F.col(item_text_col).alias("text"))
    items = stored(_sets(bench, words).dropDuplicates(["id"]), "items")
    texts = docs.select(text_hash(text_col).alias("id"), F.col(id_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    rows = stored(_projected(texts, items, words), "hits")
    hits = stored(rows.groupBy("id").agg(F.first("items").alias("items")), "hits")
    largest = hits.agg(F.max(F.size("items"))).first()[0] or 0
    parts = list(range(max(0, (largest - 1).bit_length()) + 1)) if largest else []
    left = _signatures(hits, percent, parts, False).withColumnRenamed("id", "text_hash")
    right = _signatures(items.select("id", "items"), percent, parts, True).withColumnRenamed("id", "item")
    pairs = left.join(right, ["part", "fn", "value"]).select("text_hash", "item").distinct()
    checked = pairs.join(hits.toDF("text_hash", "d"), "text_hash").join(items.toDF("item", "item_id", "i"), "item")
    checked = checked.select("text_hash", "item_id", F.size("i").cast("long").alias("n_item"), F.size(F.array_intersect("d", "i")).cast("long").alias("n_common"))
    found = checked.where(f"100 * n_common >= {percent} * n_item")
    ids = rows.select(F.col("id").alias("text_hash"), F.col("row").alias("doc_id")).distinct()
    return found.join(ids, "text_hash").select("doc_id", "text_hash", "item_id", "n_item", "n_common")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text contains a benchmark item."""
    dirty = contained_items(docs, benchmark, id_col, text_col, **options).select("doc_id", "text_hash").distinct()
    return without_rows(docs, dirty, dirty.limit(0), id_col, text_col)
