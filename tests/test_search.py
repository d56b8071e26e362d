"""Substring search by automaton and by seeds, peptides in named proteins, order statistics and the robust line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modspec.operators import fdr, joins
from modspec.operators.selection import ranked_values
from modspec.plans.adapters import psms
from modspec.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_automaton_equals_seeds_and_search(spark):
    needles = [(1, "aa"), (2, "a"), (3, "ab"), (4, ""), (5, None), (6, "aa"), (None, "bab"), (8, "\U0001f600a"), (9, "aba" * 5)]
    texts = [(10, "aaaa"), (11, "abab" * 9), (12, ""), (None, "bab"), (13, None), (2**60 + 1, "x\U0001f600ab\U0001f600a"), (14, "aa"), (14, "aa")]
    a, b = spark.createDataFrame(needles, "k long, n string"), spark.createDataFrame(texts, "t long, s string")
    want = sorted(repr((k, t, p + 1)) for k, n in needles for t, s in texts if n and s for p in range(len(s)) if s.startswith(n, p))
    few = joins.locate_substrings(a, b, "k", "n", "t", "s")
    assert sorted(repr(tuple(r)) for r in few.collect()) == want
    # texts that repeat their key are told apart by nothing in the seeded search
    once = b.where("t is not null").dropDuplicates()
    many = joins.locate_substrings(a, once, "k", "n", "t", "s", small=3)
    assert sorted(repr(tuple(r)) for r in many.collect()) == sorted(repr(tuple(r)) for r in joins.locate_substrings(a, once, "k", "n", "t", "s").collect())
    assert joins.locate_substrings(a.where("k = 4"), b, "k", "n", "t", "s").count() == 0
    assert joins.locate_substrings(a, b.where("false"), "k", "n", "t", "s").count() == 0


def test_peptides_in_named_proteins(spark):
    peptides = spark.createDataFrame([("AA", ["P", "Q", "X"]), ("K", ["Q"]), ("", ["P"]), (None, ["P"]), ("W", None)], "peptide string, proteins array<string>")
    proteins = spark.createDataFrame([("P", "AAAA"), ("Q", "KAK"), ("R", "AA"), ("S", None)], "protein string, sequence string")
    found, unknown = joins.locate_peptides(peptides, proteins)
    assert {tuple(r) for r in found.collect()} == {("AA", "P", 1), ("AA", "P", 2), ("AA", "P", 3), ("K", "Q", 1), ("K", "Q", 3)}
    assert [r[0] for r in unknown.collect()] == ["X"]


@pytest.mark.parametrize("kind", ["normal", "ties", "steps", "tiny"])
def test_ranked_values_are_those_of_a_sort(spark, kind):
    rng = np.random.default_rng(4)
    v = {"normal": rng.normal(size=700), "ties": rng.integers(0, 5, 700) * 0.1, "steps": 10.0 ** rng.integers(-12, 12, 700), "tiny": 1 + rng.integers(0, 4, 700) * 2.0**-52}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double").repartition(3)
    ranks = [0, 1, 349, 350, 698, 699]
    assert ranked_values(df, F.col("v"), ranks, bins=32, in_driver=20) == list(np.sort(v)[ranks])
    with pytest.raises(ValueError):
        ranked_values(df, F.col("v"), [700])


def plain_line(x, y, passes=50):
    """Bisquare reweighting with numpy, on the uncentred design."""
    n, X = len(x), np.column_stack([x, np.ones(len(x))])
    lever = np.minimum(0.9999, 1 / n + (x - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    least = 1e-6 * y.std(ddof=1) or 1.0
    b = np.linalg.lstsq(X, y, rcond=None)[0]
    for _ in range(passes):
        r = (y - X @ b) / np.sqrt(1 - lever)
        s = max(np.median(np.sort(np.abs(r))[1:]) / 0.6745, least)
        u = r / (s * 4.685)
        w = np.where(np.abs(u) < 1, (1 - u**2) ** 2, 0)
        old, b = b, np.linalg.lstsq(X * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        if all(abs(b - old) <= 2.0**-26 * np.maximum(abs(b), abs(old))):
            break
    return b


@pytest.mark.parametrize("n, digits", [(201, 12), (200, 1), (3, 6)])
def test_robust_line_equals_a_plain_fit(spark, n, digits):
    """Odd and even numbers of rows, ties in the residuals, a tenth of outliers."""
    rng = np.random.default_rng(n)
    x = np.round(rng.uniform(0, 20, n), digits)
    y = np.round(0.3 * x - 2 + rng.normal(0, 0.2, n), digits)
    y[::10] += 15
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(1.0, None), (float("nan"), 1.0)], "x double, y double")
    assert np.allclose(fdr.robust_line(df, "x", "y"), plain_line(x, y), rtol=1e-9, atol=1e-9)
    assert fdr.robust_line(df.limit(2), "x", "y") == (0.0, 0.0)


def test_line_of_one_x_is_a_level(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 1.0), (2.0, 1.0), (2.0, 9.0)], "x double, y double")
    slope, level = fdr.robust_line(df, "x", "y")
    assert slope == 0 and abs(level - 1) < 1e-6


def test_transfer_queries_equal_a_plain_fit(spark):
    """The queries that ship without SQL, by sorting all matches in one place."""
    rows = sorted(psms(spark, FOLDER).select("id", "score", "decoy", "grp").collect(), key=lambda r: (-r["score"], r["id"]))
    decoys, own, xs, ys = 0, 0, [], []
    targets, rated = 0, []
    for r in rows:
        decoys += r["decoy"]
        if r["grp"] == "F":
            own, targets = own + r["decoy"], targets + (not r["decoy"])
            rated.append((r["id"], r["score"], decoys, targets))
            if r["decoy"]:
                xs.append(r["score"])
                ys.append(own / decoys)
    slope, level = plain_line(np.array(xs), np.array(ys))
    line = QUERIES["robust_line"](spark, FOLDER).first()
    assert line["n"] == len(xs) and abs(line["slope"] - slope) < 1e-10 and abs(line["intercept"] - level) < 1e-6
    got = {r["id"]: (r["ratio"], r["q"]) for r in QUERIES["fdr_transfer"](spark, FOLDER).collect()}
    q = 1.0
    assert len(got) == len(rated)
    for i, score, d, t in reversed(rated):
        ratio = max(0.0, d / max(t, 1e-6) * (slope * score + level))
        q = min(q, ratio)
        assert abs(got[i][0] - ratio) <= 2e-6 * max(1, ratio) and abs(got[i][1] - q) < 2e-6
