"""Exact order statistics of a column, without an order of the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a histogram, and values of one range that the driver may put in order.
BINS = 4096
IN_DRIVER = 10_000


def ranked_values(df: DataFrame, value: Column, ranks: list[int], bins: int = BINS, in_driver: int = IN_DRIVER, count: int | None = None) -> list[float]:
    """The values of the given ranks (from 0, rising order) of a finite double, exactly; ties count as often as they occur.

    A histogram of equal bins tells which bin has a rank; the least and largest
    value of that bin are the next histogram's range, until a range has one
    value or at most ``in_driver`` rows, which go to the driver.  A pass sends
    ``bins`` counts at most.  ``df`` is read once a pass, and once before if
    ``count``, the number of values that aren't null, isn't given or is large.
    """
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    n, low, high = (count, None, None) if count is not None and count <= in_driver else rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"ranks {ranks} of {n} values")
    found: dict[int, float] = {}
    _narrow(rows, sorted(set(ranks)), 0, n, low, high, bins, in_driver, found)
    return [found[r] for r in ranks]


def _narrow(rows: DataFrame, ranks: list[int], below: int, n: int, low: float | None, high: float | None, bins: int, in_driver: int, found: dict[int, float]) -> None:
    """Finds ``ranks`` among the ``n`` values from ``low`` to ``high``, with ``below`` values under them."""
    if low is not None and low == high:
        found.update(dict.fromkeys(ranks, low))
        return
    inside = rows if low is None else rows.where(F.col("v").between(low, high))
    if n <= in_driver:
        values = sorted(r[0] for r in inside.collect())
        found.update({r: values[r - below] for r in ranks})
        return
    width = (high - low) / bins
    # a range too narrow for bins: its least value, and the rest
    number = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if low + width > low and width > 0 else (F.col("v") > low).cast("long")
    told = inside.groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
    for b in sorted(told, key=lambda r: r["b"]):
        here = [r for r in ranks if below <= r < below + b["n"]]
        if here:
            _narrow(rows, here, below, b["n"], b["low"], b["high"], bins, in_driver, found)
        below += b["n"]
