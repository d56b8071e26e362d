"""Reports of any size: files cut in many splits read as whole ones; ranges of the whole order."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from modspec.operators import fdr, windows
from modspec.sources import readers


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 64 bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_msms_report_in_many_splits(small_splits, tmp_path):
    text, want = [], []
    for p in range(6):
        text.append(f"P\tPEPTIDE{p}")
        for s in range(p):
            text.append(f"S\tdata{s % 2}\ttitle {p}.{s}")
            for f in range(s * s):
                text.append(f"form{f}\t{f + 0.5}")
                want.append((f"PEPTIDE{p}", f"data{s % 2}", f"title {p}.{s}", f"form{f}", f + 0.5))
    for name, end in (("a", "\n"), ("b", "\r\n")):
        (tmp_path / name).write_bytes((end.join(text) + end).encode())
        got = readers.read_msms_report(small_splits, str(tmp_path / name))
        assert readers._lines(small_splits, str(tmp_path / name)).select("_run").distinct().count() > 10
        assert rows(got) == sorted(map(repr, want))
    both = readers.read_msms_report(small_splits, str(tmp_path))
    assert rows(both) == sorted(map(repr, want * 2))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty").write_text("")
    assert readers.read_msms_report(small_splits, str(tmp_path / "none")).count() == 0


def test_a_heading_far_above_its_rows(small_splits, tmp_path):
    """One section is larger than many splits; rows before the first heading have none."""
    (tmp_path / "s").write_text("*\tlost\t1\tr\t1\n" + "SITE\t9\n" + "".join(f"*\tform{k}\t2\trun\t{k}.5\n" for k in range(100)))
    got = readers.read_site_report(small_splits, str(tmp_path / "s")).collect()
    assert len(got) == 101 and {r["site"] for r in got if r["imp"] != "lost"} == {"SITE"} and [r["site"] for r in got if r["imp"] == "lost"] == [None]


def test_pair_and_peptide_reports_in_many_splits(small_splits, tmp_path):
    (tmp_path / "pair.txt").write_text("Sites\tSequence\tCharge\t1\t2\n" + "".join(f"{f'S{k // 20}' if k % 20 == 0 else ''}\tform{k}\t2\t{k}\t{k + 1}\n" for k in range(60)))
    got = readers.read_pair_report(small_splits, str(tmp_path / "pair.txt")).collect()
    assert {(r["pair"], r["site"], r["imp"], r["q_left"]) for r in got} == {("pair", f"S{k // 20}", f"form{k}", float(k)) for k in range(60)} and len(got) == 60
    lines, want = [], {}
    for p in range(4):
        lines.append(f"P{p},10;")
        for f in range(5):
            lines.append(f"*\t_F{f}_\t+2\trun\t1.5\t1.4\t1.6\t{10 * p + f}")
            if (p + f) % 3:
                lines += [f"@\t{p}\t{r}\t0.5\t{r % 2}" for r in range(1 + p)]
                want[f"_F{f}_"] = (f"P{p},10;", 10.0 * p + f, 1 + p)
    (tmp_path / "pep.txt").write_text("\n".join(lines) + "\n")
    imps, ranges = readers.read_peptide_report(small_splits, str(tmp_path / "pep.txt"))
    counts = {r["imp"]: r["count"] for r in ranges.groupBy("imp").count().collect()}
    assert {r["imp"]: (r["protein_line"], r["area"], counts[r["imp"]]) for r in imps.collect()} == want


def test_equal_scores_are_spread(spark):
    """A table of one score has many ranges, and its error rates are those of one window."""
    df = spark.range(3000).select("id", F.lit(5.0).alias("score"), (F.col("id") % 4 == 1).alias("decoy"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("grp")).repartition(5)
    placed = windows.falling(df, "score", "id")
    sizes = [r["count"] for r in placed.groupBy("_run").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 1000
    w = Window.partitionBy("grp").orderBy(F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("ratio", F.sum(F.col("decoy").cast("long")).over(w) / F.greatest(F.sum((~F.col("decoy")).cast("double")).over(w), F.lit(1e-6)))
    want = want.withColumn("q", F.least(F.min("ratio").over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0)))
    got = fdr.separate_fdr(df, 0.4)
    assert {(r["id"], r["ratio"], r["q"]) for r in got.collect()} == {(r["id"], r["ratio"], r["q"]) for r in want.collect()}
    assert {(r["grp"], r["threshold"]) for r in got.select("grp", "threshold").distinct().collect()} == {("big", 5.0), ("small", 5.0)}


def test_no_score_within_the_limit(spark):
    df = spark.createDataFrame([(1, 3.0, True, "a"), (2, 2.0, True, "a"), (3, None, False, "a"), (4, 1.0, False, None)], "id long, score double, decoy boolean, grp string")
    got = {r["id"]: (r["threshold"], r["accepted"], r["final_fdr"]) for r in fdr.separate_fdr(df, 0.1).collect()}
    assert got[1] == (None, False, 1.0) and got[2] == (None, False, 1.0) and got[3] == (None, False, 1.0)
    assert fdr.separate_fdr(df.where("false"), 0.1).count() == 0
    everywhere = {r["id"]: r["accepted"] for r in fdr.global_fdr(df, 10.0).collect()}
    assert everywhere[4] and not everywhere[1]


def test_spectrum_files_find_their_survey_files(spark):
    from modspec.sources.runs import pair_files, paired

    files = spark.createDataFrame([("a_HCDFT",), ("b",), ("c_CIDIT_HCDFT",), ("d_HCDFT",), ("e_ETDFT",)], "stem string")
    runs = spark.createDataFrame([("a",), ("b",), ("b",), ("c_CIDIT",), ("c",), ("d_HCDFT",), ("d",)], "run string")
    got = {r["stem"]: (r["run"], r["n_found"]) for r in pair_files(files, runs).collect()}
    assert got == {"a_HCDFT": ("a", 1), "b": ("b", 1), "c_CIDIT_HCDFT": ("c_CIDIT", 1), "d_HCDFT": ("d", 2), "e_ETDFT": (None, 0)}
    with pytest.raises(ValueError, match="e_ETDFT"):
        paired(files, runs)
    assert paired(files.where("stem like '%HCDFT'"), runs).count() == 3
