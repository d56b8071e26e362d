"""Target-decoy false discovery rates in three modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.operators import windows
from modspec.operators.selection import ranked_values

#: Stands for no target yet in a ratio's denominator.
NO_TARGET = 1e-6


def _counts(placed: DataFrame, score: str, tie: str, decoy: str, group: str | None = None) -> DataFrame:
    """Running targets and decoys of a table in ranges: n_ of all rows, g_ of a group's."""
    head, keys = ("g", [group]) if group else ("n", [])
    return windows.sums_of_runs(placed, score, tie, {f"{head}_targets": ~F.col(decoy), f"{head}_decoys": F.col(decoy)}, keys)


def target_decoy_counts(psms: DataFrame, score: str = "score", tie: str = "id", decoy: str = "decoy", group: str = "grp") -> DataFrame:
    """Running targets and decoys by falling score: over all rows (n_targets, n_decoys) and in the group (g_targets, g_decoys)."""
    return _counts(_counts(windows.falling(psms, score, tie), score, tie, decoy), score, tie, decoy, group).drop("_run")


def accept(rated: DataFrame, limit: float, score: str = "score", decoy: str = "decoy", keys: list[str] | None = None) -> DataFrame:
    """threshold: the lowest score whose own ratio is within the limit; accepted: targets at or above it; final_fdr: the least ratio at it, else 1."""
    keys = keys or []
    # of the rows at the lowest score the least ratio is within the limit, so one aggregate has both
    low = rated.where(F.col("ratio") <= limit).where(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.col(score).alias("s"), F.col("ratio").alias("r"))).alias("_low"))
    low = low.select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_low")
    marked = rated.join(low, [F.col(k) == F.col(f"_key_{k}") for k in keys], "left") if keys else rated.crossJoin(F.broadcast(low))  # one row
    accepted = F.coalesce(~F.col(decoy) & (F.col(score) >= F.col("_low.s")), F.lit(False))
    return marked.select(*rated.columns, F.col("_low.s").alias("threshold"), accepted.alias("accepted"), F.coalesce("_low.r", F.lit(1.0)).alias("final_fdr"))


def global_fdr(psms: DataFrame, limit: float, score: str = "score", tie: str = "id", decoy: str = "decoy") -> DataFrame:
    """Decoys over targets among all rows."""
    counts = _counts(windows.falling(psms, score, tie), score, tie, decoy).drop("_run")
    return accept(counts.withColumn("ratio", F.col("n_decoys") / F.greatest(F.col("n_targets").cast("double"), F.lit(NO_TARGET))), limit, score, decoy)


def separate_fdr(psms: DataFrame, limit: float, group: str = "grp", score: str = "score", tie: str = "id", decoy: str = "decoy") -> DataFrame:
    """Decoys over targets within each group, with monotone q.

    The matches are stored once, in ranges of the score; counts go forwards over
    the ranges, least ratios backwards.
    """
    counts = _counts(windows.falling(psms, score, tie), score, tie, decoy, group)
    rated = counts.withColumn("ratio", F.col("g_decoys") / F.greatest(F.col("g_targets").cast("double"), F.lit(NO_TARGET)))
    return accept(windows.least_of_runs(rated, [group], score, tie, "ratio").drop("_run"), limit, score, decoy, [group])


#: Fixed values of the bisquare fit: tuning constant, normal consistency of the median, largest leverage, least scale over the spread of y.
TUNE, CONSISTENT, MOST_LEVERAGE, LEAST_SCALE = 4.685, 0.6745, 0.9999, 1e-6
#: A change of both coefficients below this share ends the passes.
STEADY = 2.0**-26


def robust_line(df: DataFrame, x: str, y: str, passes: int = 50) -> tuple[float, float]:
    """(slope, intercept) by bisquare reweighting until neither changes, in at most ``passes`` passes.

    Residuals are adjusted by leverage; their scale is the exact median of their
    absolute values but the least one (``selection.ranked_values``).  A pass
    sends five sums and the values of one narrow range to the driver.  Rows
    with a null or NaN don't count; two rows or fewer give (0, 0), and rows of
    one x a slope of 0.
    """
    base = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    base = base.where("x is not null and y is not null and not isnan(x) and not isnan(y)").persist()
    try:
        return _reweighted(base, base.count(), passes)
    finally:
        base.unpersist()


def _reweighted(base: DataFrame, n: int, passes: int) -> tuple[float, float]:
    if n <= 2:
        return 0.0, 0.0
    mean, level, var, spread = base.agg(F.avg("x"), F.avg("y"), F.var_pop("x"), F.stddev_samp("y")).first()
    dx, dy = F.col("x") - mean, F.col("y") - level
    lever = F.least(F.lit(MOST_LEVERAGE), F.lit(1.0 / n) + (dx * dx / (n * var) if var else F.lit(0.0)))
    least = LEAST_SCALE * spread or 1.0
    weight, slope, offset = F.lit(1.0), 0.0, 0.0
    for i in range(passes + 1):
        w, wx, wy, wxx, wxy = base.agg(*[F.sum(weight * c) for c in (F.lit(1.0), dx, dy, dx * dx, dx * dy)]).first()
        det = w * wxx - wx * wx
        before = slope, offset
        slope = (w * wxy - wx * wy) / det if var and det > 0 else 0.0
        offset = (wy - slope * wx) / w  # at the means
        now, then = (slope, offset + level - slope * mean), (before[0], before[1] + level - before[0] * mean)
        if i and all(abs(a - b) <= STEADY * max(abs(a), abs(b)) for a, b in zip(now, then)):
            break
        residual = (dy - slope * dx - offset) / F.sqrt(1 - lever)
        # the median of all but the least
        ranks = sorted({1 + (n - 2) // 2, 1 + (n - 1) // 2})
        median = sum(ranked_values(base, F.abs(residual), ranks, count=n)) / len(ranks)
        u = residual / (max(median / CONSISTENT, least) * TUNE)
        weight = F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
    return slope, offset + level - slope * mean


def transfer_fdr(psms: DataFrame, limit: float, wanted: str, group: str = "grp", score: str = "score", tie: str = "id", decoy: str = "decoy") -> DataFrame:
    """Rates of one group from all decoys, by the group's share of decoys as a line over the score; monotone q, capped at 1."""
    counts = _counts(_counts(windows.falling(psms, score, tie), score, tie, decoy), score, tie, decoy, group).where(F.col(group) == wanted)
    slope, intercept = robust_line(counts.where(decoy).withColumn("share", F.col("g_decoys") / F.col("n_decoys")), score, "share")
    ratio = F.greatest(F.lit(0.0), F.col("n_decoys") / F.greatest(F.col("g_targets").cast("double"), F.lit(NO_TARGET)) * (slope * F.col(score) + intercept))
    rated = windows.least_of_runs(counts.withColumn("ratio", ratio), [group], score, tie, "ratio").drop("_run")
    return accept(rated, limit, score, decoy, [group])


def summary(rated: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and accepted rows of each group."""
    return rated.groupBy(*keys).agg(F.count("*").alias("n_in_group"), F.count_if("accepted").alias("n_accepted"))
