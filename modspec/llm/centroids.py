"""Centroid clustering of integer vectors with Orchard's search for the nearest centroid.

Each centroid has the list of the others by growing distance from it.  A search
stands at a centroid and walks its list: a centroid met for the first time is
compared with the vector, and when it is nearer (or as near, with a smaller
number) the search moves to its list.  It ends where the list is strictly beyond
twice the current distance: whatever follows is farther from the vector than the
centroid it stands at, so all centroids of equal distance have been seen.

All arithmetic is in integers.  The vectors are written once as integers; a
round reads them, assigns each in its task and sends one row of sums per task
and cluster.  Only the centroids, ``clusters * components`` numbers, pass the
driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import stored

CLUSTERS, ROUNDS, COMPONENTS = 16, 3, 64
#: Vectors that are searched together.
BLOCK = 8192


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = 64) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the vectors with exactly ``components`` finite components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == components) & whole)
    return kept.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all of them by distance from it, then number; and these squared distances."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.array([sorted(range(len(centroids)), key=lambda j: (apart[i, j], j)) for i in range(len(centroids))], np.int64)
    return order, np.take_along_axis(apart, order, 1)


def orchard(vectors: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid; of equally near ones the smallest number."""
    n, k = len(vectors), len(centroids)
    at = np.zeros(n, np.int64)
    best = ((vectors - centroids[0]) ** 2).sum(axis=1)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    step = np.zeros(n, np.int64)
    walking = np.arange(n)
    while len(walking):
        here, where = at[walking], step[walking]
        walking = walking[apart[here, where] <= 4 * best[walking]]  # strictly beyond twice the distance: done
        if not len(walking):
            break
        candidate = order[at[walking], step[walking]]
        step[walking] += 1
        new = ~visited[walking, candidate]
        rows, numbers = walking[new], candidate[new]
        visited[rows, numbers] = True
        distance = ((vectors[rows] - centroids[numbers]) ** 2).sum(axis=1)
        nearer = (distance < best[rows]) | ((distance == best[rows]) & (numbers < at[rows]))
        moved = rows[nearer]
        at[moved], best[moved], step[moved] = numbers[nearer], distance[nearer], 0
        walking = walking[step[walking] < k]
    return at, best


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)


def _exact(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit integers where no sum of squares can leave them, and as Python's own integers elsewhere."""
    top = max(int(abs(vectors).max(initial=0)), int(abs(centroids).max(initial=0)))
    if centroids.shape[1] * (2 * top) ** 2 < 2**61:
        return vectors, centroids.astype(np.int64)
    return vectors.astype(object), centroids.astype(object)


def _search(batches: Iterator[pa.RecordBatch], centroids: list[list[int]]):
    """(batch, first row, vectors, numbers, squared distances) of every block."""
    middle = np.array(centroids, dtype=object)
    for batch in batches:
        rows = _matrix(batch.column(1), middle.shape[1])
        for i in range(0, len(rows), BLOCK):
            block, own = _exact(rows[i : i + BLOCK], middle)
            yield (batch, i, block, *orchard(block, own, *neighbours(own)))


def sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of each centroid's vectors; exact."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), len(centroids[0])), dtype=object)
        for _, _, block, at, _ in _search(batches, centroids):
            for c in np.unique(at).tolist():
                own = block[at == c]
                count[c] += len(own)
                total[c] += own.astype(object).sum(axis=0) if own.dtype == object or abs(own).max() > 2**40 else own.sum(axis=0).astype(object)
        some = np.flatnonzero(count).tolist()
        totals = pa.array([[Decimal(int(x)) for x in total[c]] for c in some], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some], pa.int64()), totals], ["cluster", "n", "total"])

    rows = vectors.select("vec_id", "v").mapInArrow(partial, "cluster int, n long, total array<decimal(38,0)>")
    columns = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(len(centroids[0]))]
    return {r["cluster"]: (int(r["n"]), [int(r[f"t{i}"]) for i in range(len(centroids[0]))]) for r in rows.groupBy("cluster").agg(F.sum("n").alias("n"), *columns).collect()}  # a row for each centroid


def cluster_vectors(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = 64, seed: int = 1
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for each vector kept.

    Kept are vectors with exactly ``components`` components, none null, NaN or
    infinite; a null vector isn't.  The first centroids are those of the least
    hashes of seed and id; ids that repeat go by their components, a null id is
    hashed as ``null``; with fewer vectors than ``clusters`` there are as many
    centroids.  Equally near centroids: the smaller number; a centroid without
    vectors stays.  Rows that repeat an id stay rows, further columns are
    ignored, an empty table gives an empty result.  Components whose scaled
    value isn't a 64-bit integer, and distances beyond one, are an error.
    """
    spark = table.sparkSession
    vectors = stored(integer_vectors(table, id_col, vector_col, components, scale), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    centroids = [list(r["v"]) for r in vectors.select(rank.alias("rank"), "v").orderBy("rank", "v").limit(clusters).collect()]
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], out)
    for _ in range(rounds):
        for c, (n, total) in sums(vectors, centroids).items():
            centroids[c] = [t // n for t in total]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block, at, distance in _search(batches, centroids):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(block)), pa.array(at, pa.int32()), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # a row for each centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    about = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), digest(c)) for c in inertia], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
