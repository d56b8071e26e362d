"""N-gram Jaccard join: documents whose word-shingle sets are similar, by PartEnum signatures.

``jaccard_components`` finds every link (Jaccard of at least ``percent`` in a
hundred) between texts that differ and returns the connected components.  Its
steps, each a table in the shared folder:

1. *facts*: size, 64-bit set key and a 128-byte sketch of each document's set.
   Documents with equal sets share a key; only keys are compared.
2. *members*: the sets of two keys or more that share a signature, each set
   once.  A map task forwards a signature once per key and batch, packed in
   arrays, so a group of copies doesn't heat a bucket.
3. *stars*: an eighth of the sets propose pairs, each key with a few
   pivots of its group; pairs are checked exactly, which joins most groups
   without listing their pairs.
4. *rest*: sets whose keys are still in different components have all
   cross-component pairs compared by sketch inside tasks (large groups in
   blocks); only those that the sketch can't rule out are checked exactly.
   So every pair that shares a signature is linked, known to be connected
   already, or ruled out.

The exact check of a group's pairs happens in cells of bounded size, to which
each set moves once, straight from the scan of the texts.

Rows count by their text, not by their id: rows that repeat a doc_id, or have
none, have sets and links of their own, in any order of the rows.  Null, empty
and white-space texts have no shingles: ``n_shingles`` 0, linked with nothing.
A very long text is worked on whole (its set is held by one task); further
columns are ignored; an empty table gives an empty result.  Hashes of 64 bits
stand for shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._partenum import signatures
from modspec.llm._shared import stored, tasks, text_hash, without_rows
from modspec.llm._shingles import U, mix, per_row
from modspec.llm.components import connected_components

#: Pivots for each shared signature in the first round.
PIVOTS = 2
#: Keys of one signature that one task compares; larger groups are cut in blocks.
BLOCK = 2000
#: Up to so many candidate keys and cells are broadcast to the scan (some 50 bytes each); beyond, it is a shuffled join.
BROADCAST_KEYS = 500_000
#: Pairs compared by sketch at once.
PAIRS_AT_ONCE = 1 << 16
#: Keys of a set in one row.
KEYS_IN_ROW = 1 << 20
#: Bytes of a sketch.
SKETCH = 128
#: Signatures that a map task sorts and forwards at once.
SIGNATURES_AT_ONCE = 1 << 19
#: Shingles of the documents for which there is one bucket of signatures at least.
BUCKET_SHINGLES = 1 << 19
#: Signatures that a bucket holds before it passes on those of so many keys.
BUCKET_HELD = 1 << 21
HOT_KEYS = 1 << 14
#: Shingles of the sets in one cell of the exact check, but for longer sets; a 64th for stars, in which all but the pivots are in a cell for each pivot.
CELL_SHINGLES = 1 << 21


def _keys(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit key of each set: a hash of its size and the sum of its mixed shingles."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat * U(0x9E3779B97F4A7C15)), dtype=U)])
        return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(U) * U(0xD6E8FEB86659FD93))


def _sketches(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Counts of shingles in 256 buckets, modulo 16, two to a byte.

    The sum over buckets of the circular distances of two sketches is never
    more than the symmetric difference of the sets.
    """
    rows = len(bounds) - 1
    cell = np.repeat(np.arange(rows), np.diff(bounds)) * 256 + (flat >> U(56)).astype(np.int64)
    counts = np.bincount(cell, minlength=rows * 256).astype(np.uint8).reshape(rows, 256) & 15
    return counts[:, ::2] | counts[:, 1::2] << 4


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lower bound of the symmetric differences of pairs of sketches."""
    low = ((a & 15) - (b & 15)) & 15
    high = ((a >> 4) - (b >> 4)) & 15
    return np.minimum(low, 16 - low).sum(1, dtype=np.int64) + np.minimum(high, 16 - high).sum(1, dtype=np.int64)


def _may_link(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray, percent: int) -> np.ndarray:
    able = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    most = (100 - percent) * (na + nb) // (100 + percent)
    able[able] = _apart(sa[able], sb[able]) <= most[able]
    return able


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def shingle_facts(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, text_hash, n, key, sketch); key is null for an empty set."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, bounds in per_row(batch.column(2), words):
                n = np.diff(bounds)
                keys = pa.array(_keys(flat, bounds).view(np.int64), mask=n == 0)
                sketch = pa.Array.from_buffers(pa.binary(SKETCH), len(n), [None, pa.py_buffer(_sketches(flat, bounds).tobytes())])
                some = batch.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64()), keys, sketch.cast(pa.binary())], ["doc_id", "text_hash", "n", "key", "sketch"])

    return _texts(docs, id_col, text_col).mapInArrow(facts, "doc_id long, text_hash long, n long, key long, sketch binary")


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])), [len(sorted_values)]]) if len(sorted_values) else np.zeros(1, np.int64)


def shared_signatures(docs: DataFrame, text_col: str, words: int, percent: int, n_shingles: int = 0) -> DataFrame:
    """(sig, key) for each set of two keys or more that share a signature; ``sig`` names the set.

    Buckets grow in number with ``n_shingles``, those of all documents.  One
    that holds much passes on the keys of its hot signatures, in parts under
    one name, so a signature of any number of keys needs no more memory.
    """
    buckets = max(4 * tasks(docs.sparkSession), n_shingles // BUCKET_SHINGLES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys, held = [], [], 0
        for batch in batches:
            for _, flat, bounds in per_row(batch.column(0), words):
                row, sig = signatures(flat, bounds, percent)
                sigs.append(sig)
                keys.append(_keys(flat, bounds)[row])
                held += len(sig)
                if held > SIGNATURES_AT_ONCE:
                    yield forwarded(np.concatenate(sigs), np.concatenate(keys))
                    sigs, keys, held = [], [], 0
        if held:
            yield forwarded(np.concatenate(sigs), np.concatenate(keys))

    def forwarded(sigs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        bucket = sigs % U(buckets)
        # 40 bits of the signature and those of the bucket; one that clashes only proposes a pair for naught
        sigs >>= U(24)
        order = np.lexsort((keys, sigs, bucket))
        bucket, sigs, keys = bucket[order], sigs[order], keys[order]
        new = np.ones(len(sigs), bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])
        bucket, sigs, keys = bucket[new], sigs[new], keys[new]
        five = sigs.view(np.uint8).reshape(-1, 8)[:, :5]
        starts = _runs(bucket)
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[starts[:-1]].astype(np.int32)),
            pa.array([five[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])], pa.binary()),
            pa.array([keys[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])], pa.binary()),
        ], ["bucket", "sigs", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by bucket; a bucket holds one signature in many
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size, limit, hot, part = None, 0, BUCKET_HELD, np.zeros(0, U), 0
        for batch in batches:
            for bucket, sigs, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket != now and held:
                    rest, lists = split(*grouped(held), now, hot, part, True)
                    yield from written(lists)
                    yield from met(*rest)
                    held, size, limit, hot, part = [], 0, BUCKET_HELD, np.zeros(0, U), 0
                now = bucket
                five = np.zeros((len(keys.as_buffer()) // 8, 8), np.uint8)
                five[:, :5] = np.frombuffer(sigs.as_buffer(), np.uint8).reshape(-1, 5)
                held.append((five.view(U).ravel(), np.frombuffer(keys.as_buffer(), np.int64)))
                size += len(five)
                if size > limit:
                    rest, lists = split(*grouped(held), now, hot, part, False)
                    yield from written(lists)
                    hot, part = np.union1d(hot, np.array([x[0] for x in lists], U)), part + 1
                    held, size, limit = [rest], len(rest[0]), max(BUCKET_HELD, 2 * len(rest[0]))
        if held:
            rest, lists = split(*grouped(held), now, hot, part, True)
            yield from written(lists)
            yield from met(*rest)

    def split(sigs: np.ndarray, keys: np.ndarray, bucket: int, hot: np.ndarray, part: int, last: bool):
        """The signatures that are held on, and the sets of the hot ones, named by signature, bucket and part."""
        starts = _runs(sigs)
        passed = np.isin(sigs[starts[:-1]], hot) | (np.diff(starts) >= HOT_KEYS if not last else False)
        lists = [(sigs[starts[c]], bucket, (part << 12) + k, keys[at : min(at + KEYS_IN_ROW, starts[c + 1])]) for c in np.flatnonzero(passed) for k, at in enumerate(range(starts[c], starts[c + 1], KEYS_IN_ROW))]
        on = ~np.repeat(passed, np.diff(starts))
        return (sigs[on], keys[on]), lists

    def grouped(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (signature, key), in order."""
        sigs, keys = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        order = np.lexsort((keys, sigs))
        sigs, keys = sigs[order], keys[order]
        new = np.ones(len(sigs), bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (keys[1:] != keys[:-1])
        return sigs[new], keys[new]

    def met(sigs: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = _runs(sigs)
        many = np.repeat(np.diff(starts) > 1, np.diff(starts))
        sigs, keys = sigs[many], keys[many]
        if not len(sigs):
            return
        starts = _runs(sigs)
        # signatures with the same keys propose the same pairs: one of them will do
        with np.errstate(over="ignore"):
            sums = [np.add.reduceat(mix(keys.view(U) * U(odd) + U(odd)), starts[:-1]) + np.diff(starts).astype(U) for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
        _, chosen = np.unique(np.stack(sums, 1), axis=0, return_index=True)
        yield from written([(sums[0][c], int(sums[1][c].view(np.int64)), k, keys[at : min(at + KEYS_IN_ROW, starts[c + 1])]) for c in chosen for k, at in enumerate(range(starts[c], starts[c + 1], KEYS_IN_ROW))])

    def written(lists: list[tuple[np.uint64, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(lists), 1 << 15):
            some = lists[i : i + (1 << 15)]
            held_keys = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x[3]) for x in some]).astype(np.int32)), pa.array(np.concatenate([x[3] for x in some])))
            names = np.array([x[0] for x in some], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.int32()), held_keys], ["sig", "check", "part", "keys"])

    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(emit, "bucket int, sigs binary, keys binary")
    met_keys = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "sig long, check long, part int, keys array<bigint>")
    return met_keys.dropDuplicates(["sig", "check", "part"]).select("sig", F.explode("keys").alias("key"))


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each key with a few pivots of its set, for an eighth of the sets; ``leader`` names a set that has both."""
    some = members.where(F.pmod(F.xxhash64("sig"), F.lit(8)) == 0)
    ranked = lambda r: F.struct(F.xxhash64("key", F.lit(r)), "key")
    pivots = some.groupBy("sig").agg(F.min("key").alias("leader"), *[F.min(ranked(r)).alias(f"p{r}") for r in range(PIVOTS)])
    pivots = pivots.select("sig", "leader", F.array(*[F.col(f"p{r}.key") for r in range(PIVOTS)]).alias("pivots"))
    pairs = some.join(pivots, "sig").select("leader", "key", F.explode(F.array_distinct("pivots")).alias("pivot")).where("key <> pivot")
    return pairs.groupBy(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).agg(F.min("leader").alias("leader"))


def _screened(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs that their sketches can't rule out."""
    side = lambda c: facts.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH)
            keep = _may_link(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), flat("sa"), flat("sb"), percent)
            yield batch.select(["a", "b", "leader"]).filter(pa.array(keep))

    able = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    return able.mapInArrow(screen, "a long, b long, leader long")


def _rest_pairs(members: DataFrame, roots: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs of one signature in different components that their sketches can't rule out; ``leader`` names a set that has both."""
    spark = members.sparkSession
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", "key", F.coalesce("root", "key").alias("root"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n_keys"), F.min("key").alias("leader")).where("low <> high")
    mixed = mixed.select("sig", "leader", F.ceil(F.col("n_keys") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(mixed, "sig")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # a row meets every block of its group once: cell (i, j), i <= j, holds blocks i and j
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # signatures with the same smallest key go to one task, where a pair that they share is found once, and a key's sketch is sent once
    cell = ["leader", "i", "j", "own", "key", "root"]
    rows = rows.select("leader", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "root", "sig")
    rows = rows.groupBy(*cell).agg(F.collect_list("sig").alias("sigs")).join(facts, "key").select(*cell, "n", "sketch", "sigs")
    rows = rows.repartition(4 * tasks(spark), "leader", "i", "j").sortWithinPartitions("leader", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        tail = None
        for batch in batches:
            batch = pa.Table.from_batches([batch])
            batch = batch if tail is None else pa.concat_tables([tail, batch])
            cells = np.stack([batch.column(c).to_numpy() for c in ("leader", "i", "j")], 1)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1
            for at, to in zip(np.append(0, cuts[:-1]), cuts):
                found.append(linked(batch.slice(at, to - at)))
            tail = batch.slice(cuts[-1] if len(cuts) else 0)
        if tail is not None:
            found.append(linked(tail))
        pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c]) for c in range(3)], ["a", "b", "leader"])

    def linked(rows: pa.Table) -> np.ndarray:
        if rows.num_rows < 2:
            return np.zeros((0, 3), np.int64)
        leader = rows.column("leader")[0].as_py()
        i, j, own, key, root, n = (rows.column(c).to_numpy() for c in ("i", "j", "own", "key", "root", "n"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        lists = rows.column("sigs").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sigs, row = lists.flatten().to_numpy(), np.repeat(np.arange(rows.num_rows), lists.value_lengths().to_numpy())
        order = np.argsort(sigs, kind="stable")
        sigs, row = sigs[order], row[order]
        starts = _runs(sigs)
        later = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(sigs)) - 1  # entries that come after each with its signature
        done = np.concatenate([[0], np.cumsum(later)])
        out, at = [np.zeros(0, np.int64)], 0
        while at < len(sigs):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, "right")) - 1)
            x = np.repeat(np.arange(at, to), later[at:to])
            y = row[x + 1 + np.arange(len(x)) - np.repeat(done[at:to] - done[at], later[at:to])]
            x = row[x]
            # cells off the diagonal only compare between their two blocks
            keep = (root[x] != root[y]) & ((i[0] == j[0]) | (own[x] != own[y]))
            x, y = np.divmod(np.unique(np.minimum(x, y)[keep] * np.int64(rows.num_rows) + np.maximum(x, y)[keep]), rows.num_rows)
            able = _may_link(n[x], n[y], sketch[x], sketch[y], percent)
            out.append(x[able] * np.int64(rows.num_rows) + y[able])
            at = to
        x, y = np.divmod(np.unique(np.concatenate(out)), rows.num_rows)
        return np.stack([np.minimum(key[x], key[y]), np.maximum(key[x], key[y]), np.full(len(x), leader)], 1)

    return rows.mapInArrow(compare, "a long, b long, leader long").groupBy("a", "b").agg(F.min("leader").alias("leader"))


def _verified(able: DataFrame, cell_shingles: int, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """The pairs (a, b, leader) whose sets pass the exact test.

    A leader's pairs are checked in cells: its keys are dealt among as many
    blocks as their shingles ask for, and a pair goes to the cell of its two
    blocks, with the set of each key that has pairs there.
    """
    spark = able.sparkSession
    able = stored(able, "able")
    ends = able.select("leader", F.col("a").alias("key")).union(able.select("leader", "b")).distinct().join(classes.select("key", "n", "rep"), "key")
    ends = stored(ends, "ends")
    blocks = ends.groupBy("leader").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / cell_shingles)).cast("int").alias("blocks"))
    own = lambda c: F.pmod(F.xxhash64(c), F.col("blocks")).cast("int")
    placed = able.join(blocks, "leader").withColumn("x", own("a")).withColumn("y", own("b"))
    placed = stored(placed.select("leader", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "a", "b"), "cells")
    cell = F.struct("leader", "i", "j")
    wanted = placed.select(F.col("a").alias("key"), cell.alias("cell")).union(placed.select("b", cell)).groupBy("key").agg(F.collect_set("cell").alias("cells"))
    wanted = wanted.join(ends.select("key", "rep").distinct(), "key").select("key", F.col("rep.doc_id").alias("doc_id"), F.col("rep.text_hash").alias("text_hash"), "cells")
    wanted = stored(wanted, "wanted")
    n_cells = wanted.agg(F.sum(F.size("cells"))).first()[0] or 0

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, bounds in per_row(batch.column("text"), words):
                rows = batch.slice(first, len(bounds) - 1)
                # ids and text hashes find the row, its set says whether it is the one
                right = _keys(flat, bounds).view(np.int64) == rows.column("key").to_numpy()
                items = pa.array([flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("cells"), items], ["key", "cells", "items"]).filter(pa.array(right))

    texts = _texts(docs, id_col, text_col)
    same = texts["text_hash"].eqNullSafe(wanted["text_hash"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])
    texts = texts.join(F.broadcast(wanted) if n_cells <= BROADCAST_KEYS else wanted, same).select("key", "cells", "text")
    kinds = dict(wanted.dtypes)
    items = texts.mapInArrow(sets, f"key long, cells {kinds['cells']}, items binary").select(F.explode("cells").alias("cell"), "key", "items")
    items = items.select("cell.leader", "cell.i", "cell.j", F.lit(None).cast("long").alias("a"), F.col("key").alias("b"), "items")
    rows = placed.select("leader", "i", "j", "a", "b", F.lit(None).cast("binary").alias("items")).union(items)
    # a cell's sets come first
    rows = rows.repartition(4 * tasks(spark), "leader", "i", "j").sortWithinPartitions("leader", "i", "j", F.col("a").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            out = []
            for leader, i, j, a, b, items in zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "a", "b", "items"))):
                if (leader, i, j) != now:
                    now, held = (leader, i, j), {}
                if items is not None:
                    held[b] = np.frombuffer(items, U)
                    continue
                x, y = held[a], held[b]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common = int((y[at] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in range(2)], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, set_key, class_id (smallest doc_id with the same set),
    component_id (smallest doc_id reachable by links of at least ``percent`` in a hundred) and component_key
    (a set key that names the component; null for an empty set)."""
    facts = stored(shingle_facts(docs, id_col, text_col, words), "facts")
    rep = F.min(F.struct("doc_id", "text_hash")).alias("rep")
    classes = facts.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), rep, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(classes, "classes")
    n_shingles = facts.agg(F.sum("n")).first()[0] or 0
    members = stored(shared_signatures(docs, text_col, words, percent, n_shingles), "members")
    args = (classes, docs, id_col, text_col, words, percent)
    edges = stored(_verified(_screened(_star_pairs(members), classes, percent), max(1, CELL_SHINGLES // 64), *args), "links")
    roots = connected_components(edges)
    rest = _rest_pairs(members, roots, classes.select("key", "n", "sketch"), percent)
    more = stored(_verified(rest, CELL_SHINGLES, *args), "links")
    if more.limit(1).count():
        roots = connected_components(edges.union(more))
    placed = classes.select("key", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = stored(placed.join(least, "root").select("key", F.col("least").alias("class_id"), "component_id", F.col("root").alias("component_key")), "placed")
    full = facts.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "key").join(placed, "key", "left")
    own = lambda c: F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return full.select("doc_id", "text_hash", "n_shingles", F.col("key").alias("set_key"), own("class_id"), own("component_id"), "component_key")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last), of equal ones the smallest text hash.

    Documents without words stay, each by itself.
    """
    rows = jaccard_components(docs, id_col, text_col, **options).where("component_key is not null")
    rows = stored(rows.groupBy("component_key", "doc_id", "text_hash").count(), "grouped")
    first = rows.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"), F.count("*").alias("several"))
    one = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    dropped = rows.join(first.where("several > 1"), "component_key").where(~one)
    # what stays may be a row that repeats id and text
    return without_rows(docs, dropped, rows.where("count > 1").join(first, "component_key").where(one), id_col, text_col)
