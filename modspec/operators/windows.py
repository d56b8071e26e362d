"""Windows over ordered rows: running counts, clusters, fills, intervals, best-of.

All take column names, so they serve spectra and any other table.  Those with
partition columns shuffle once on them; those over a whole table, or over
groups that may be few and large, work in two levels (runs of a value range,
then rows within a run) and never put all rows of a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspec.sources.store import stored


#: Rows of a group that one task puts in order without cutting it into runs.
RUN_ROWS = 100_000
LEAST_RUNS = 16


def ranged(df: DataFrame, order: list[Column], runs: int | None = None) -> DataFrame:
    """``df`` stored with _run, the number of its range in ``order``; ranges have about as many rows each.

    Ranges are of the whole order, so rows with one value of its first
    expression are spread over as many as they fill.  By default there are as
    many as ``spark.sql.shuffle.partitions``, and LEAST_RUNS at least; a task
    sorts one, and spills where it is larger than memory.
    """
    runs = runs or max(LEAST_RUNS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stored(df.repartitionByRange(runs, *order).withColumn("_run", F.spark_partition_id()))


def is_hot(df: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether some group of ``keys`` has more than ``rows`` rows."""
    return (df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > rows


def _joined(rows: DataFrame, of_runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what ``of_runs`` (_key_ columns, _of) says of their group and run."""
    same = F.col("_run") == F.col("_of")
    for k in keys:
        # plain equality keeps the partitioning of the rows
        same = same & (F.col(k).eqNullSafe(F.col(f"_key_{k}")) if rows.schema[k].nullable else F.col(k) == F.col(f"_key_{k}"))
    return rows.join(of_runs, same)


def _ordered(order: list[str], back: bool, strict: bool) -> tuple[list[Column], tuple[int, int]]:
    """``order``, turned round for ``back``, and the frame of the rows up to a row in it.

    Frames that end at the group's last row are evaluated anew for each row, which is quadratic; those that begin at the first one run on.
    """
    return [F.col(c).desc() if back else F.col(c).asc() for c in order], (Window.unboundedPreceding, -1 if strict else 0)


def over_runs(placed: DataFrame, keys: list[str], order: list[str], fills: dict[str, Column], back: bool = False, strict: bool = False) -> DataFrame:
    """As ``carried``, for rows that say which run of their group they are in (_run, any type whose order is that of the runs).

    Each run is filled on its own; what its rows lack comes over the run's edge, from a row for each run.
    """
    by, frame = _ordered(order, back, strict)
    inside = Window.partitionBy(*keys, "_run").orderBy(*by).rowsBetween(*frame)
    local = placed.select("*", *[F.last(e, ignorenulls=True).over(inside).alias(n) for n, e in fills.items()])
    at = F.struct(*order)
    edge = [(F.min_by if back else F.max_by)(e, F.when(e.isNotNull(), at)).alias(n) for n, e in fills.items()]
    ends = placed.groupBy(*keys, "_run").agg(*edge)
    runs, before = _ordered(["_run"], back, True)
    over = Window.partitionBy(*keys).orderBy(*runs).rowsBetween(*before)
    ends = ends.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_of"), *[F.last(n, ignorenulls=True).over(over).alias(f"_edge_{n}") for n in fills])
    return _joined(local, ends, keys).select(*placed.columns, *[F.coalesce(n, f"_edge_{n}").alias(n) for n in fills])


def carried(df: DataFrame, keys: list[str], value: str, order: list[str], fills: dict[str, Column], back: bool = False, strict: bool = False, rows: int = RUN_ROWS, hot: bool | None = None) -> DataFrame:
    """For each name, the last non-null value of its expression at or before the row in ``order``, which begins with ``value``.

    ``back``: the first one at or after it; ``strict``: not the row's own.  Where
    a group has more than ``rows`` rows (or ``hot`` says so), the table is stored
    in ranges of the order, which cut groups into runs (``over_runs``).
    """
    if is_hot(df, keys, rows) if hot is None else hot:
        return over_runs(ranged(df, [F.col(c) for c in order]), keys, order, fills, back, strict).drop("_run")
    by, frame = _ordered(order, back, strict)
    w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(*frame)
    return df.select("*", *[F.last(e, ignorenulls=True).over(w).alias(n) for n, e in fills.items()])


def falling(df: DataFrame, score: str, tie: str, runs: int | None = None) -> DataFrame:
    """``df`` stored in ranges of falling score, then tie: what ``sums_of_runs`` and ``least_of_runs`` take."""
    return ranged(df, [F.desc(score), F.asc(tie)], runs)


def sums_of_runs(placed: DataFrame, score: str, tie: str, flags: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """``placed`` with running sums of ``flags``: those within a run and the totals of the runs before it."""
    keys = keys or []
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_run").agg(*[F.sum(f.cast("long")).alias(f"_{n}") for n, f in flags.items()])
    offsets = totals.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in flags])
    inside = Window.partitionBy(*keys, "_run").orderBy(F.col(score).desc(), tie).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(f.cast("long")).over(inside).alias(n) for n, f in flags.items()])
    return _joined(local, offsets, keys).select(*placed.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in flags])


def least_of_runs(placed: DataFrame, keys: list[str], score: str, tie: str, ratio: str, cap: float | None = 1.0) -> DataFrame:
    """``placed`` with q: the least ratio of the row, those after it in its run and the runs after it, capped."""
    lows = placed.groupBy(*keys, "_run").agg(F.min(ratio).alias("_low"))
    # from the last row backwards: a frame that ends at the last row is evaluated anew for each row
    after = Window.partitionBy(*keys).orderBy(F.col("_run").desc()).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_of"), F.min("_low").over(after).alias("_low"))
    inside = Window.partitionBy(*keys, "_run").orderBy(F.col(score).asc(), F.col(tie).desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.col("_q"), F.col("_low")) if cap is None else F.least(F.col("_q"), F.col("_low"), F.lit(cap))
    return _joined(placed.withColumn("_q", F.min(ratio).over(inside)), lows, keys).withColumn("q", q).select(*placed.columns, "q")


def running_sums(df: DataFrame, score: str, tie: str, flags: dict[str, Column], runs: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Running sums of ``flags`` by falling score, then tie, over the whole table or within the groups of ``keys``; any group is spread over runs."""
    return sums_of_runs(falling(df, score, tie, runs), score, tie, flags, keys).drop("_run")


def monotone_q(df: DataFrame, keys: list[str], score: str, tie: str, ratio: str, cap: float | None = 1.0) -> DataFrame:
    """q: the smallest ratio at this or any later row by falling score, then tie, capped."""
    return least_of_runs(falling(df, score, tie), keys, score, tie, ratio, cap).drop("_run")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "i", total: str = "n") -> DataFrame:
    """``df`` with the place of each row in its group by ``order``, from 1, and the number of the group's rows; any group is spread over runs."""
    placed = ranged(df, [F.col(c) for c in (*keys, *order)])
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_run").agg(F.count("*").alias("_rows"))
    counts = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy(*keys)).alias(total))
    local = placed.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)))
    return _joined(local, counts, keys).select(*df.columns, (F.col("_in") + F.col("_before")).cast("int").alias(name), total)


def gap_clusters(df: DataFrame, keys: list[str], value: str, tie: str, tol: Column) -> DataFrame:
    """cluster: 1, 2, ... by rising value; a new one begins where the gap to the row before exceeds ``tol`` (an expression over ``_prev``).

    Cuts are found within runs of the value, the largest value of the run
    before standing in front of a run's first row; counts of cuts add up over
    the runs.
    """
    placed = ranged(df, [F.asc(value), F.asc(tie)])
    order = Window.partitionBy(*keys).orderBy("_run")
    tops = placed.groupBy(*keys, "_run").agg(F.max(value).alias("_top")).select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_of"), "_top")
    tops = tops.withColumn("_edge", F.lag("_top").over(Window.partitionBy(*[f"_key_{k}" for k in keys]).orderBy("_of"))).drop("_top")
    w = Window.partitionBy(*keys, "_run").orderBy(value, tie)
    stepped = _joined(placed, tops, keys).withColumn("_prev", F.coalesce(F.lag(value).over(w), F.col("_edge")))
    stepped = stepped.withColumn("_cut", F.coalesce((F.col(value) - F.col("_prev") > tol).cast("long"), F.lit(1))).drop("_of", "_edge", *[f"_key_{k}" for k in keys])
    cuts = stepped.groupBy(*keys, "_run").agg(F.sum("_cut").alias("_cuts"))
    cuts = cuts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_run").alias("_of"), F.coalesce(F.sum("_cuts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = stepped.withColumn("_in", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _joined(local, cuts, keys).withColumn("cluster", F.col("_in") + F.col("_before")).select(*df.columns, "cluster")


def forward_fill(df: DataFrame, keys: list[str], order: list[str], fills: dict[str, Column]) -> DataFrame:
    """For each name, the last non-null value of its expression at or before the row: parents of sectioned text."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[F.last(e, ignorenulls=True).over(w).alias(n) for n, e in fills.items()])


def only_once(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key combination occurs exactly once; counts combine before the shuffle."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, keys, "left_semi")


def moving_mean(df: DataFrame, keys: list[str], order: list[str], value: str, half: int = 2, name: str = "smooth") -> DataFrame:
    """Centred mean of 2 * half + 1 points, of fewer at the ends."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))


def merge_intervals(df: DataFrame, keys: list[str], start: str, stop: str, widen: float = 0.2) -> DataFrame:
    """Merged intervals after widening each by a share of its length on both sides; touching ones merge, null ones count in their group's last."""
    pad = (F.col(stop) - F.col(start)) * widen
    wide = df.select(*keys, (F.col(start) - pad).alias("_a"), (F.col(stop) + pad).alias("_b"))
    island = islands(wide, keys, "_a", "_b", "island")
    return island.groupBy(*keys, "island").agg(F.min("_a").alias("lo"), F.max("_b").alias("hi"), F.count("*").alias("n_members"))


def islands(df: DataFrame, keys: list[str], start: str, stop: str, name: str) -> DataFrame:
    """``df`` with the number of the island of overlapping or touching intervals that a row is in; one without a start is in its group's last."""
    w = Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(stop).asc_nulls_last())
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.withColumn("_reach", reach).withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long"))
    return opened.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach", "_new")


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def drop_consecutive_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_prev", before).where(F.col("_prev").isNull() | (F.col("_prev") != F.col(value))).drop("_prev")


def ladder_gaps(df: DataFrame, keys: list[str], position: str, last: Column) -> DataFrame:
    """Per group of matched positions: n_hits (distinct) and breaks in the ladder 1..last, both ends included."""
    hits = df.select(*keys, position, last.alias("_last")).distinct()
    w = Window.partitionBy(*keys).orderBy(position)
    step = (F.col(position) - F.coalesce(F.lag(position).over(w), F.lit(0)) > 1).cast("long")
    return hits.withColumn("_break", step).groupBy(*keys).agg(F.count("*").alias("n_hits"), (F.sum("_break") + (F.max(position) < F.max("_last")).cast("long")).alias("gaps"))
