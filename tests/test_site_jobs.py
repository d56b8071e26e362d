"""Sites, pairs and merged pairs from files to files."""

from __future__ import annotations

from modspec.operators import jobs
from modspec.sources import readers, writers

IMPS = "protein_line string, imp string, charge string, run string, mz_mid double, mz_lo double, mz_hi double, area double"
RANGES = "protein_line string, imp string, charge string, run string, rt_start double, rt_end double, ratio double, check_label int"


def report(spark, path, rows):
    """A peptide report of (protein line, form, charge, run, area)."""
    imps = spark.createDataFrame([(*r[:4], 500.0, 499.0, 501.0, r[4]) for r in rows], IMPS)
    ranges = spark.createDataFrame([(*r[:4], 1.0, 2.0, 1.0, 1) for r in rows], RANGES)
    writers.write_peptide_report(imps, ranges, path)


def test_peptide_reports_to_the_merged_report(spark, tmp_path):
    proteins = spark.createDataFrame([("H3", "h"), ("H4", "q")], "protein string, prot_abbr string")
    mods = spark.createDataFrame([("Acetyl", "ac"), ("Methyl", "me")], "mod string, mod_abbr string")
    both, lone = "X9,4;H4,11;H3,6;", "H3,6;"
    a = [(both, "_AK{Acetyl}R{Heavy}K_", "+2", "r1", 3.0), (both, "_AK{Acetyl}RK_", "+2", "r2", 4.0), (lone, "_GK{Methyl}AK{Acetyl}_", "+2", "r1", 5.0), ("X9,4;", "_K{Acetyl}_", "+1", "r1", 9.0), (lone, "_GK{Methyl}AK{Other}_", "+3", "r1", 1.0)]
    b = [(both, "_AK{Acetyl}RK_", "+2", "r3", 10.0), (lone, "_GK{Methyl}AK{Acetyl}_", "+2", "r3", 20.0)]
    for name, rows in (("a", a), ("b", b)):
        report(spark, f"{tmp_path}/{name}", rows)
        jobs.summarise_files(spark, f"{tmp_path}/{name}", f"{tmp_path}/{name}_out", proteins, mods, ("{Heavy}",))
    got = sorted(tuple(r) for r in readers.read_site_report(spark, f"{tmp_path}/a_out/sites").collect())
    # of the first wanted protein of the line; the initiator isn't counted; an unknown modification has no site
    assert got == [("hK6me", "_GK{Methyl}AK{Acetyl}_", "+2", "r1", 5.0), ("hK6me", "_GK{Methyl}AK{Other}_", "+3", "r1", 1.0), ("hK8ac", "_GK{Methyl}AK{Acetyl}_", "+2", "r1", 5.0), ("qK11ac", "_AK{Acetyl}RK_", "+2", "r1", 3.0), ("qK11ac", "_AK{Acetyl}RK_", "+2", "r2", 4.0)]
    others = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/a_out/others").collect()
    assert [(r["protein_line"], r["imp"]) for r in others] == [("X9,4;", "_K{Acetyl}_")]
    jobs.compare_files(spark, f"{tmp_path}/a_out/sites", f"{tmp_path}/b_out/sites", f"{tmp_path}/pair")
    jobs.compare_files(spark, f"{tmp_path}/b_out/sites", f"{tmp_path}/b_out/sites", f"{tmp_path}/same")
    pairs = {(r["site"], r["imp"]): (r["q_left"], r["q_right"]) for r in readers.read_pair_report(spark, f"{tmp_path}/pair").collect()}
    assert pairs == {("qK11ac", "_AK{Acetyl}RK_"): (7.0, 10.0), ("hK6me", "_GK{Methyl}AK{Acetyl}_"): (5.0, 20.0), ("hK8ac", "_GK{Methyl}AK{Acetyl}_"): (5.0, 20.0)}
    jobs.merge_files(spark, {"ab": f"{tmp_path}/pair", "bb": f"{tmp_path}/same"}, f"{tmp_path}/merged")
    lines = [r[0].split("\t") for r in spark.read.text(f"{tmp_path}/merged").collect()]
    assert lines.count(lines[0]) == 1 and ["", "SUM", "", "7.000000", "10.000000", "0.700000", "", "10.000000", "10.000000", "1.000000", ""] in lines
    assert sum(x[1] == "SUM" for x in lines) == 3 and len(lines) == 7
