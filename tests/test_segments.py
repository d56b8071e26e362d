"""Walks of segments and two-level joins against those of whole groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modspec.operators import chrom, joins, windows


def walked_whole(rt, raw, y, times, alpha):
    """The walk by rule over one whole trace."""
    times, found, n = np.sort(times), [], 0
    while n < len(times):
        seed = int(np.abs(rt - times[n]).argmin())
        if y[seed] == 0:
            n += 1
            continue
        bounds, top = {}, y[seed]
        last = seed
        for step in (1, -1):
            low, low_at, i = y[seed], seed, seed + step
            while 0 <= i < len(y):
                if step == 1 and n + 1 < len(times) and rt[i] > times[n + 1]:
                    n, last = n + 1, i
                if y[i] > top:
                    top = low = y[i]
                    low_at = i
                if y[i] < low:
                    low, low_at = y[i], i
                if y[i] < top * alpha:
                    bounds[step] = i - step
                    break
                if low < 0.5 * min(y[i], top):
                    bounds[step] = low_at
                    break
                i += step
        a, b = bounds.get(-1, seed), bounds.get(1, last)
        if (raw[a : b + 1] != 0).sum() >= 5:
            found.append((a + 1, b + 1))
        n += 1
    return found


@pytest.mark.parametrize("hot", [False, True])
def test_segments_walk_as_the_whole_trace(spark, hot):
    rng = np.random.default_rng(8)
    points, hits, want = [], [], {}
    for g in range(25):
        n = int(rng.integers(8, 120))
        y = np.abs(np.convolve(rng.normal(size=n + 4) ** 3, np.ones(5) / 5, "valid"))
        y[rng.uniform(size=n) < 0.15] = 0
        for _ in range(3):
            a = int(rng.integers(0, n))
            y[a : a + int(rng.integers(0, 9))] = 0
        raw = np.where(rng.uniform(size=n) < 0.8, y, 0)
        rt = np.cumsum(rng.integers(1, 4, n)) / 10
        times = rng.choice(rt, int(rng.integers(1, 9))) + rng.choice([0.0, 0.02, -0.02], 1)
        points += [(g, k + 1, float(rt[k]), float(raw[k]), float(y[k])) for k in range(n)]
        hits += [(g, float(t)) for t in times]
        want[g] = walked_whole(rt, raw, y, times, 0.1)
    xic = spark.createDataFrame(points, "g int, i int, rt double, raw double, smooth double").repartition(4)
    got = {}
    for r in chrom.detect_xic_peaks(xic, spark.createDataFrame(hits, "g int, rt double"), ["g"], 0.1, hot).orderBy("g", "peak_no").collect():
        got.setdefault(r["g"], []).append((r["left_i"], r["right_i"]))
        assert r["peak_no"] == len(got[r["g"]])
    assert got == {g: w for g, w in want.items() if w}


def test_large_groups_join_as_small_ones(spark):
    """One key has half of the rows; values and ties repeat, some are null."""
    rng = np.random.default_rng(9)
    key = lambda: int(rng.choice([0, 1, 2, 3], p=[0.5, 0.2, 0.2, 0.1]))
    left = spark.createDataFrame([(key(), int(rng.integers(0, 80)) / 2, k) for k in range(400)] + [(None, 3.0, 900), (0, None, 901)], "k int, t double, id int")
    right = spark.createDataFrame([(key(), int(rng.integers(0, 60)) / 2, k) for k in range(300)] + [(None, 1.0, 900)], "k int, t double, id int")
    for join in (lambda hot: joins.asof_join(left, right.withColumn("at", F.col("t")), ["k"], "t", {"id": "other", "at": "other_t"}, "id", hot), lambda hot: joins.nearest_join(left, right.withColumnRenamed("id", "i"), ["k"], "t", "i", 5.0, hot)):
        one, two = (sorted(map(str, map(tuple, join(hot).collect()))) for hot in (False, True))
        assert one == two and len(one) > 100
    rows = left.withColumn("v", F.when(F.col("id") % 5 == 0, F.col("id")))
    for back in (False, True):
        for strict in (False, True):
            one, two = (sorted(map(str, map(tuple, windows.carried(rows, ["k"], "t", ["t", "id"], {"x": F.col("v")}, back, strict, hot=hot).collect()))) for hot in (False, True))
            assert one == two
