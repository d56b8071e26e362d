"""Numeric expectations on tiny tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modspec.functions import scalars
from modspec.functions.constants import isotope_pattern
from modspec.operators import chrom, filters, joins, solve, windows
from modspec.operators.enumerate import arrangements, count_arrangements
from modspec.sources import readers


def trace(spark, rt, y, **more):
    cols = {"g": [1] * len(rt), "i": list(range(1, len(rt) + 1)), "rt": [float(x) for x in rt], "y": [float(v) for v in y], **more}
    return spark.createDataFrame(list(zip(*cols.values())), list(cols))


def ranges(spark, *pairs):
    return spark.createDataFrame([(1, k + 1, a, b) for k, (a, b) in enumerate(pairs)], "g int, peak_no int, left_i int, right_i int")


def test_closed_area(spark):
    x = trace(spark, range(6), [0, 10, 20, 10, 0, 0])
    got = {r["peak_no"]: r["area"] for r in chrom.closed_auc(x, ranges(spark, (2, 4), (1, 2)), ["g"], ["peak_no"], "y").collect()}
    assert got == {1: 2400.0, 2: 600.0}


def test_width_of_a_gaussian_and_of_nothing(spark):
    rt = np.linspace(-5, 5, 1000)
    x = trace(spark, rt, np.exp(-rt**2 / 2))
    assert abs(chrom.fwhm(x, ranges(spark, (1, 1000)), ["g"], ["peak_no"], "y").first()["fwhm"] - 2.3548) < 0.02
    assert chrom.fwhm(trace(spark, range(5), [0] * 5), ranges(spark, (1, 5)), ["g"], ["peak_no"], "y").first()["fwhm"] == 0


def test_peak_detection(spark):
    rt = np.arange(0, 20.05, 0.1)
    y = 100 * np.exp(-((rt - 5) ** 2) / 0.5) + 80 * np.exp(-((rt - 15) ** 2) / 0.5)
    x = trace(spark, rt, y, raw=[float(v) for v in y], smooth=[float(v) for v in y])
    hits = spark.createDataFrame([(1, 5.1), (1, 14.9)], "g bigint, rt double")
    got = chrom.detect_xic_peaks(x, hits, ["g"]).orderBy("peak_no").collect()
    assert len(got) == 2
    for r, center in zip(got, (5, 15)):
        lo, hi = rt[r["left_i"] - 1], rt[r["right_i"] - 1]
        assert abs((lo + hi) / 2 - center) < 0.5 and hi - lo > 1
    assert chrom.detect_xic_peaks(x.withColumn("raw", F.lit(0.0)), hits, ["g"]).count() == 0
    assert chrom.detect_xic_peaks(x, hits.limit(1), ["g"]).count() == 1


def test_kernel_ratio(spark):
    x = trace(spark, np.arange(0, 10.05, 0.1), np.ones(101))
    hits = spark.createDataFrame([(1, k, t, 0.2, 0.8) for k, t in enumerate((4.9, 5.0, 5.1))], "g bigint, psm int, rt double, r_a double, r_b double")
    got = {r["i"]: (r["r_a"], r["r_b"]) for r in chrom.kernel_ratio(x, ranges(spark, (41, 61)), hits, ["g"], ["a", "b"]).collect()}
    assert got[51] == pytest.approx((0.2, 0.8)) and set(got) == set(range(41, 62))


def test_shares_below_the_threshold_vanish(spark):
    areas = spark.createDataFrame([(1, 1, "a", 0.9), (1, 1, "b", 0.1), (1, 2, "a", 0.0)], "g int, peak_no int, imp string, area double")
    got = {(r["peak_no"], r["imp"]): r["share"] for r in chrom.filter_peak_shares(areas, ["g"], 0.2).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 0.0, (2, "a"): 0.0}


def test_intensity_floor_and_group_size(spark):
    df = spark.createDataFrame([(1, 1000.0)] * 5 + [(1, 10.0)] * 5, "g int, v double")
    assert filters.relative_intensity(df, ["g"], "v", 0.05).count() == 5
    assert filters.min_rows(df.limit(3), ["g"], 5).count() == 0


def test_nearest_index(spark):
    grid = spark.createDataFrame([(1, 10 + k / 10, k + 1) for k in range(101)], "g int, rt double, i int")
    pts = spark.createDataFrame([(1, 12.0), (1, 13.0), (1, 999.0)], "g int, rt double")
    got = {r["rt"]: r["i"] for r in joins.nearest_join(pts, grid, ["g"], "rt", "i", 1.0).collect()}
    assert got == {12.0: 21, 13.0: 31, 999.0: None}


def test_locate_overlapping(spark):
    needles = spark.createDataFrame([(1, "KAW"), (2, "AA"), (3, "")], "k int, n string")
    texts = spark.createDataFrame([("p", "MKAWVLK"), ("q", "AAAA"), ("r", None)], "t string, s string")
    got = {tuple(r) for r in joins.locate_substrings(needles, texts, "k", "n", "t", "s").collect()}
    assert got == {(1, "p", 2), (2, "q", 1), (2, "q", 2), (2, "q", 3)}


def test_global_running_sums_equal_one_window(spark):
    df = spark.range(1000).select("id", ((F.col("id") * 7919) % 101).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("d"))
    got = {r["id"]: r["n"] for r in windows.running_sums(df, "score", "id", {"n": F.col("d")}, 7).collect()}
    rows = sorted(df.collect(), key=lambda r: (-r["score"], r["id"]))
    run = 0
    for r in rows:
        run += r["d"]
        assert got[r["id"]] == run


def test_best_of_prefers_the_first_on_ties(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, 5.0), (2, 1, 0.0)], "g int, k int, v double")
    assert {(r["g"], r["k"]) for r in windows.best_of(df, ["g"], [F.desc("v"), F.col("k")]).collect()} == {(1, 1), (2, 1)}


def test_active_sets_meet_the_optimality_conditions():
    rng = np.random.default_rng(0)
    for n in range(1, 8):
        a = rng.normal(size=(60, n + 2, n))
        a[::7, :, 0] = 0  # an empty form
        a[::5, :, -1] = a[::5, :, 0]  # equal forms
        h, f = np.einsum("bki,bkj->bij", a, a), np.einsum("bki,bk->bi", a, rng.normal(size=(60, n + 2)))
        f[::3] += 0.3 * (np.abs(a[::3]).sum(1) > 0)  # with penalties
        x, _, fine = solve.active_set(h, f)
        g = np.einsum("bij,bj->bi", h, x) + f
        assert fine.all() and (x >= 0).all() and (g > -1e-9).all() and np.abs(g * x).max() < 1e-9
        low = rng.uniform(0, 1, f.shape)
        x, _, fine = solve.active_set(h, f, low)
        g = np.einsum("bij,bj->bi", h, x) + f
        assert fine.all() and (x >= low).all() and (g > -1e-9).all() and np.abs(g * (x - low)).max() < 1e-9


@pytest.mark.parametrize("condition", [1e2, 1e5, 1e8])
def test_active_sets_equal_their_enumeration(condition):
    """Near-collinear forms: the best of all sets of free forms, solved in longer numbers."""
    from fractions import Fraction
    from itertools import product

    def exact(h, f, free):
        rows = [[Fraction(float(h[i, j])) for j in free] + [Fraction(float(-f[i]))] for i in free]
        for k in range(len(free)):
            p = next(r for r in range(k, len(free)) if rows[r][k])
            rows[k], rows[p] = rows[p], rows[k]
            for r in range(len(free)):
                if r != k and rows[r][k]:
                    q = rows[r][k] / rows[k][k]
                    rows[r] = [x - q * y for x, y in zip(rows[r], rows[k])]
        return [rows[k][-1] / rows[k][k] for k in range(len(free))]

    rng = np.random.default_rng(3)
    for n in (2, 3, 6):
        q, _ = np.linalg.qr(rng.normal(size=(n, n)))
        h = q @ np.diag(np.geomspace(1, 1 / condition, n)) @ q.T
        h = (h + h.T) / 2
        for _ in range(4):
            f = h @ -np.maximum(rng.normal(size=n), 0) + (rng.uniform(size=n) < 0.3) * 1e-3
            best = None
            for some in product([0, 1], repeat=n):
                free = [i for i in range(n) if some[i]]
                z = exact(h, f, free)
                if all(v >= 0 for v in z):
                    x = [Fraction(0)] * n
                    for i, v in zip(free, z):
                        x[i] = v
                    value = sum(x[i] * (sum(Fraction(float(h[i, j])) * x[j] for j in range(n)) / 2 + Fraction(float(f[i]))) for i in range(n))
                    best = min(best, (value, x), key=lambda v: v[0]) if best else (value, x)
            x, _, fine = solve.active_set(h[None], f[None])
            want = np.array([float(v) for v in best[1]])
            assert fine[0] and np.abs(x[0] - want).max() <= 1e-15 * condition * 50 * max(1, want.max())


def test_rows_without_a_target_count_as_zero(spark):
    terms = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 1.0)], "s long, r int, c string, x double")
    targets = spark.createDataFrame([(1, 1, 2.0)], "s long, r int, y double")
    got = {r["c"]: (r["abundance"], r["status"]) for r in solve.estimate_abundance(terms, targets, "s", "r", "c", "x", "y").collect()}
    assert got == {"a": (1.0, "ok"), "b": (0.0, "ok")}


def test_arrangement_counts(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 1, 1)], "sites array<int>, a int, b int")
    assert arrangements(df, "sites", {"A": "a", "B": "b"}).count() == 20
    assert df.select(count_arrangements(F.size("sites"), [F.col("a"), F.col("b")])).first()[0] == 20


def test_scan_of_title(spark):
    df = spark.createDataFrame([("run.17.17.2.0.dta",), ("scan:42",), ("x.y",)], "t string")
    assert [r[0] for r in df.select(scalars.scan_of_title(F.col("t"))).collect()] == [17, 42, None]


def test_isotope_pattern_is_normal():
    p = isotope_pattern(1000.0)
    assert max(p) == 1 and p[0] > p[2] > p[4]


def test_unknown_modification_is_an_error(spark):
    with pytest.raises(Exception, match="unknown modification"):
        spark.createDataFrame([("_A{zz}C_",)], "imp string").select(scalars.imp_mass(F.col("imp"), {"a": 1.0})).collect()


def test_read_mgf_and_fasta_and_reports(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=run.17.17.2.0.dta\nCHARGE=2+\nPEPMASS=768.946455 1\n147.1128 5.0\n148 2\nEND IONS\nBEGIN IONS\nTITLE=run.17.17.2.0.dta\nCHARGE=3+\nPEPMASS=7\n1 5\nEND IONS\n")
    got = readers.read_mgf(spark, str(tmp_path / "a.mgf")).collect()
    assert [(r["title"], r["scan"], r["charge"], len(r["peaks"])) for r in got] == [("run.17.17.2.0.dta", 17, 3, 1)]
    (tmp_path / "a.fasta").write_text(">sp|P12345|ProtA Description\nMKAW VLK\n>sp|P67890|ProtB Description\nLLQWERTY\nLLQWERTY\n")
    fasta = readers.read_fasta(spark, str(tmp_path / "a.fasta"), r"^>sp\|(\w+)\|")
    assert {tuple(r) for r in fasta.collect()} == {("P12345", "MKAWVLK"), ("P67890", "LLQWERTYLLQWERTY")}
    (tmp_path / "r.txt").write_text("P\tPEPTIDE_A\nS\tDataset1\tSpecA1\nFormA1\t100\nFormA2\t200\nS\tDataset1\tEmpty\nP\tPEPTIDE_B\n")
    msms = {tuple(r) for r in readers.read_msms_report(spark, str(tmp_path / "r.txt")).collect()}
    assert msms == {("PEPTIDE_A", "Dataset1", "SpecA1", "FormA1", 100.0), ("PEPTIDE_A", "Dataset1", "SpecA1", "FormA2", 200.0)}
    (tmp_path / "l.txt").write_text("PEPTIDE\n\nDataset1\tSpecA1\nDataset1\tSpecA2\n")
    assert readers.read_pep_spec(spark, str(tmp_path / "l.txt")).count() == 2


def test_read_ms1_and_map(spark, tmp_path):
    (tmp_path / "run.ms1").write_text("H\tDataType\tCentroid\nS\t000001\t000001\nI\tRetTime\t60\nI\tIonInjectionTime\t5\n400.0 10\n420.5 20\n430 0\nS\t000002\t000002\nI\tRetTime\t120\n400.0 10\n401 5\n")
    got = readers.read_ms1(spark, str(tmp_path / "run.ms1")).collect()
    assert [(r["run"], r["scan"], r["rt_min"], len(r["peaks"])) for r in got] == [("run", 1, 1.0, 2)]
    (tmp_path / "run.ms2").write_text("H\tx\nS\t000003\t000003\t500.1\nI\tPrecursorScan\t1\nS\t000004\t000004\t600\n")
    assert [tuple(r) for r in readers.read_ms2_map(spark, str(tmp_path / "run.ms2")).collect()] == [("run", 1, 3)]


def test_read_matches_and_peptide_and_pair_reports(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("Scan\tPeptide\tPROTEIN\tScore\n1\tAAK\tP1,P2\t3.5\n2\t \tP1\t1\n")
    got = readers.read_psm_tsv(spark, str(tmp_path / "p.tsv")).collect()
    assert [(r["peptide"], r["protein"], r["Score"]) for r in got] == [("AAK", "P1,P2", 3.5)]
    (tmp_path / "pep.txt").write_text("h\nh\n@\th\nP1,10;\n*\t_A_\t+2\trun\t1.5\t1.4\t1.6\t99\n@\t1\t2\t0.5\t1\n@\t3\t4\t0.5\t0\n*\t_B_\t+2\trun\t1\t1\t1\t5\n")
    imps, ranges_ = readers.read_peptide_report(spark, str(tmp_path / "pep.txt"))
    assert [(r["protein_line"], r["imp"], r["area"]) for r in imps.collect()] == [("P1,10;", "_A_", 99.0)]
    assert {(r["rt_start"], r["check_label"]) for r in ranges_.collect()} == {(1.0, 1), (3.0, 0)}
    (tmp_path / "pair.txt").write_text("site\timp\tz\tl\tr\nS1\ta\t2\t1\t2\n\tb\t2\t3\t4\nS2\ta\t2\t5\t6\n")
    assert [(r["pair"], r["site"], r["imp"], r["q_right"]) for r in readers.read_pair_report(spark, str(tmp_path / "pair.txt")).orderBy("q_left").collect()] == [("pair", "S1", "a", 2.0), ("pair", "S1", "b", 4.0), ("pair", "S2", "a", 6.0)]
    (tmp_path / "run.ms2").write_text("H\tx\nS\t3\t3\t500.1\nI\tRetTime\t60\nI\tActivationType\tHCD\nZ\t2\t999\n100 5\n200 0\nS\t3\t3\t500.1\nS\t4\t4\t600\nZ\t2\t1\nZ\t3\t1\n")
    ms2 = readers.read_ms2(spark, str(tmp_path / "run.ms2")).orderBy("ms2_scan").collect()
    assert [(r["ms2_scan"], r["precursor_mz"], r["charge"], r["activation"], len(r["peaks"])) for r in ms2] == [(3, 500.1, 2, "HCD", 1), (4, 600.0, 0, None, 0)]


def test_reports_round_trip(spark, tmp_path):
    from modspec.sources import writers

    msms = spark.createDataFrame([("A", "d", "t1", "f1", 0.25), ("A", "d", "t1", "f2", 0.75), ("A", "d", "t2", "f1", 0.0), ("B", "d", "t3", "f", 1.0)], "peptide string, dataset string, title string, imp string, abundance double")
    writers.write_msms_report(msms, str(tmp_path / "msms"))
    assert {tuple(r) for r in readers.read_msms_report(spark, str(tmp_path / "msms")).collect()} == {tuple(r) for r in msms.where("abundance <> 0").collect()}
    sited = spark.createDataFrame([("S1", "f", "+2", "r", 1.5), ("S1", "g", "+2", "r", 2.0), ("S2", "f", "+3", "r", 4.0)], "site string, imp string, charge string, run string, area double")
    writers.write_site_report(sited, str(tmp_path / "sites"))
    assert {tuple(r) for r in readers.read_site_report(spark, str(tmp_path / "sites")).collect()} == {tuple(r) for r in sited.collect()}
    pairs = spark.createDataFrame([("S1", "a", "2", 1.0, 2.0), ("S1", "b", "2", 3.0, 4.0), ("S2", "a", "2", 5.0, 6.0)], "site string, imp string, charge string, q_left double, q_right double")
    writers.write_pair_report(pairs, str(tmp_path / "pairs"))
    assert {tuple(r)[1:] for r in readers.read_pair_report(spark, str(tmp_path / "pairs")).collect()} == {tuple(r) for r in pairs.collect()}
    writers.write_pep_spec(msms.select("peptide", "dataset", "title").distinct(), str(tmp_path / "list"))
    assert readers.read_pep_spec(spark, str(tmp_path / "list")).count() == 3


def test_runs_of_groups_equal_one_window(spark):
    """Sums, least ratios and clusters by group in several runs of the score, with ties, nulls and a group of most rows."""
    from pyspark.sql import Window

    rows = [(i, float(i * 37 % 90) if i % 41 else None, "big" if i % 5 else ("small" if i % 2 else None), i % 3 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, grp string, decoy boolean").repartition(3)
    w = Window.partitionBy("grp").orderBy(F.col("score").desc(), "id")
    want = df.withColumn("n", F.sum(F.col("decoy").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q", F.least(F.min(F.col("id") % 7 / 7).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0)))
    got = windows.running_sums(df, "score", "id", {"n": F.col("decoy")}, 6, ["grp"])
    got = windows.monotone_q(got.withColumn("ratio", F.col("id") % 7 / 7), ["grp"], "score", "id", "ratio")
    assert {(r["id"], r["n"], r["q"]) for r in got.collect()} == {(r["id"], r["n"], r["q"]) for r in want.collect()}
    up = Window.partitionBy("grp").orderBy("score", "id")
    cut = F.coalesce((F.col("score") - F.lag("score").over(up) > 0.5).cast("long"), F.lit(1))
    known = df.where("score is not null")
    want = known.withColumn("cut", cut).withColumn("c", F.sum("cut").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    got = windows.gap_clusters(known, ["grp"], "score", "id", F.lit(0.5))
    assert {(r["id"], r["cluster"]) for r in got.collect()} == {(r["id"], r["c"]) for r in want.collect()}


SEARCH = """Content-Type: application/x-result; name="parameters"

MODS=Carb (C),Tag (N-term)
FILE=X=C:\\data\\run7.mgf
CHARGE=2+
IT_MODS=Ox (M),Acetyl (K)
Content-Type: application/x-result; name="peptides"

q1_p1=1,604.35,-0.25,2,KCTMGC,8,02000000,11.74,000,0,0;"P68433 x":0:10:15:2,"P84228":0:10
q1_p2=1,604.35,-0.25,2,KKKK,8,000000,1.74,000,0,0;"P1":0:10
q2_p1=-1
q3_p1=0,500.5,0.5,3,CKM,8,10100,21.5,000,0,0;"P9":0:1
q4_p1=7,500.5,0.5,3,CKM,8,10100,21.5,000,0,0;"P9":0:1
q5_p1=0,400.0,0.0,3,AAA,8,00000,1.5,000,0,0
Content-Type: application/x-result; name="proteins"

Content-Type: application/x-result; name="query1"

title=run7%2e101%2e101%2e2
charge=2+
Content-Type: application/x-result; name="query3"

title=scan%3a 77
charge=3+
Content-Type: application/x-result; name="query4"

title=scan%3a78
charge=3+
Content-Type: application/x-result; name="query5"

title=run7%2e5%2e5
Content-Type: application/x-result; name="index"

title=none
charge=9+
"""


def test_read_search_results(spark, tmp_path):
    (tmp_path / "a.dat").write_text(SEARCH.replace("\n", "\r\n"))
    (tmp_path / "b.dat").write_text(SEARCH.replace("MODS=Carb (C),Tag (N-term)", "MODS=", 1).replace("run7", "run8"))
    got = {(r["dataset"], r["scan"]): r for r in readers.read_search_dat(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(f"run{n}.mgf", s) for n in (7, 8) for s in (5, 77, 101)]
    first = got["run7.mgf", 101]
    assert (first["modification"], first["modificationlocation"]) == ("Carb (C),Carb (C),Tag (N-term),Acetyl (K)", "2,6,0,1")
    assert (first["spectrum"], first["charge"], first["protein"], first["num_match_ions"], first["score"]) == ("run7.101.101.2", 2, "P68433,P84228", 2, 11.74) and first["precursor_neutral_mass"] == pytest.approx(604.1)
    # a variable modification of the N-terminus stands for the fixed one
    assert (got["run7.mgf", 77]["modification"], got["run7.mgf", 77]["modificationlocation"]) == ("Carb (C),Ox (M),Ox (M)", "1,0,2")
    assert got["run8.mgf", 5]["modification"] == "-" and got["run8.mgf", 5]["charge"] is None and got["run8.mgf", 5]["protein"] == ""


def test_prefilter_from_files_to_files(spark, tmp_path):
    from modspec.operators.jobs import prefilter_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dat").write_text(SEARCH.replace("MODS=Carb (C),Tag (N-term)", "MODS=", 1))
    prefilter_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["Acetyl"], "REV_", ["Acetyl"], 0.01)
    kept = readers.read_psm_tsv(spark, str(tmp_path / "out" / "psms")).collect()
    assert [(r["peptide"], r["modification"]) for r in kept] == [("CKM", "Ox (M),Ox (M)"), ("KCTMGC", "Acetyl (K)")]
    listed = readers.read_pep_spec(spark, str(tmp_path / "out" / "pep_spec"))
    assert {tuple(r) for r in listed.select("peptide", "dataset").collect()} == {("CKM", "run7.mgf"), ("KCTMGC", "run7.mgf")}


def test_baseline_of_one_array_equals_the_grouped_one(spark):
    import random

    from modspec.functions.scalars import baseline_of
    from modspec.operators.chrom import histogram_baseline

    draw = random.Random(3)
    df = spark.createDataFrame([(k, 10 ** draw.gauss(3, 1)) for k in range(12) for _ in range(70 + k * 10)], "k int, v double")
    one = dict(df.groupBy("k").agg(F.collect_list("v").alias("v")).select("k", baseline_of(F.col("v"))).collect())
    assert one == pytest.approx(dict(histogram_baseline(df, ["k"], "v").collect())) and sum(v == 0 for v in one.values()) == 4


def test_review_scores(spark):
    from modspec.operators.review import review_scores

    psm = spark.createDataFrame([(1, 30.0, 600.0), (2, 50.0, 600.0)], "spectrum int, score double, precursor_mz double")
    forms = spark.createDataFrame([(1, 1, 5, [2], [42.0]), (1, 2, 5, [5], [14.0])], "spectrum int, imp int, length int, sites array<int>, masses array<double>")
    hits = spark.createDataFrame([(1, 1, 1, 1, 7), (1, 1, 1, 2, 8), (1, 2, 2, 4, 9)], "spectrum int, imp int, type int, pos int, peak int")
    peaks = spark.createDataFrame([(1, 7, 500.0, 100.0), (1, 11, 510.0, 80.0), (1, 12, 700.0, 50.0), (1, 13, 205.0, 100.0), (1, 14, 580.0, 100.0)], "spectrum int, peak int, mz double, intensity double")
    one, two = review_scores(psm, forms, peaks, hits, 0.0, 60.0).orderBy("spectrum").collect()
    assert one["enzyme"] == -float("inf") and one["main"] == 0.5
    # form 1: two hits, one gap; form 2: one hit, one gap
    assert one["ladder"] == pytest.approx(((2 - 0.5) / 8 + (1 - 0.5) / 8) / 2)
    # form 1 knows both borders of place 2; form 2 needs the left border of place 5, which the ion from the right at 4 isn't
    assert one["localisation"] == pytest.approx(((1.0 - 0.75) / 0.25 + (0.0 - 0.75) / 0.25) / 2)
    # 80 of a bin whose top is 100, and a bin's own top of 50
    assert one["unmatched"] == pytest.approx(1 - (80 - 60) / 40 - 1)
    assert two["enzyme"] is None and two["unmatched"] is None and two["main"] == pytest.approx(5 / 6)
    with pytest.raises(Exception, match="out of its bounds"):
        review_scores(psm, forms, peaks, hits, 0.0, 40.0).collect()


RULES = [("ac", "K", 42.010565), ("me", "K", 14.01565), ("ph", "S", 79.966331), ("tag", "N-termA", 229.16)]


def test_arrangements_across_specificities(spark):
    from itertools import product

    from modspec.operators.placements import site_arrangements, site_compositions, slots

    df = spark.createDataFrame([("AKSKS",), ("KS",), ("GG",)], "peptide string")
    got = {}
    for r in site_arrangements(site_compositions(df, RULES), RULES).collect():
        got.setdefault(r["peptide"], []).append((tuple(r["placement"]), tuple(r["counts"]), round(r["delta"], 6), r["n_forms"]))
    at = {r[0]: [(s["site"], s["kind"]) for s in r[1]] for r in df.select("peptide", slots(F.col("peptide"), RULES)).collect()}
    assert at == {"AKSKS": [(0, "N-term"), (2, "K"), (3, "S"), (4, "K"), (5, "S")], "KS": [(0, "N-term"), (1, "K"), (2, "S")], "GG": [(0, "N-term")]}
    allowed = {"N-term": ["", "tag"], "K": ["", "ac", "me"], "S": ["", "ph"]}
    mass = {"": 0.0} | {m: v for m, _, v in RULES}
    for peptide, where in at.items():
        want = [p for p in product(*[allowed[k] for _, k in where]) if peptide.startswith("A") or p[0] == ""]
        assert sorted(p for p, *_ in got[peptide]) == sorted(want)
        by = {}
        for p, counts, delta, n in got[peptide]:
            assert delta == pytest.approx(sum(mass[m] for m in p)) and counts == tuple(p.count(m) for m, _, _ in RULES)
            by.setdefault(counts, (n, set()))[1].add(p)
        assert all(n == len(s) for n, s in by.values())


@pytest.mark.parametrize("model", ["constant", "equal", "variable"])
def test_deconvolution_from_spectra(spark, model):
    """Two forms of a peptide mixed 3 : 1, a lone form, a spectrum without ions, one of another mass and one unmodified."""
    from modspec.functions.constants import PROTON, RESIDUES, WATER
    from modspec.operators.placements import deconvolve_msms

    def ladder(peptide, mods):
        m = [RESIDUES[r] + mods.get(i + 1, 0.0) for i, r in enumerate(peptide)]
        return sum(m) + WATER, [(round(sum(m[:k]) + PROTON, 6)) for k in range(1, len(m))] + [round(sum(m[k:]) + WATER + PROTON, 6) for k in range(1, len(m))]

    whole, first = ladder("GKAKG", {2: 42.010565})
    _, second = ladder("GKAKG", {4: 42.010565})
    bare, _ = ladder("GKAKG", {})
    lone, _ = ladder("GKAAG", {2: 42.010565})
    mz = lambda mass: (mass + 2 * PROTON) / 2
    spectra = spark.createDataFrame([(1, "GKAKG", mz(whole), 2), (2, "GKAAG", mz(lone), 2), (3, "GKAKG", mz(whole), 2), (4, "GKAKG", mz(whole + 5), 2), (5, "GKAKG", mz(bare), 2), (6, "GKAKG", mz(whole), 2)], "spectrum int, peptide string, precursor_mz double, charge int")
    peaks = [(1, m, 75.0) for m in first] + [(1, m, 25.0) for m in second] + [(6, m, 10.0) for m in first] + [(3, 50.0, 1.0)]
    got = deconvolve_msms(spectra, spark.createDataFrame(peaks, "spectrum int, mz double, intensity double"), [("ac", "K", 42.010565)], 0.01, 0.01, model=model).collect()
    rows = {(r["spectrum"], r["imp"]): (r["abundance"], r["status"]) for r in got}
    assert rows[1, "_GK{ac}AKG_"][0] == pytest.approx(0.75, abs=1e-3) and rows[1, "_GKAK{ac}G_"][0] == pytest.approx(0.25, abs=1e-3)
    assert rows[2, "_GK{ac}AAG_"] == (1.0, "ok") and rows[6, "_GK{ac}AKG_"] == (1.0, "ok")
    assert rows[3, None] == (None, "failed") and rows[4, None] == (None, "no arrangement") and rows[5, None] == (None, "unmodified") and len(rows) == 7


def brute_compositions(delta, masses, kinds, most, room, tol):
    """The search by rule: one count at a time, a hit isn't extended."""
    out = []

    def go(used, i, left):
        if any(sum(u for u, k in zip(used, kinds) if k == j) > r for j, r in enumerate(room)):
            return
        if abs(left) < tol:
            out.append(tuple(used))
            return
        if i < len(masses):
            if used[i] < most[i]:
                go(used[:i] + [used[i] + 1] + used[i + 1 :], i, left - masses[i])
            if i + 1 < len(masses):
                go(used, i + 1, left)

    go([0] * len(masses), 0, delta)
    return sorted(out)


def test_compositions_meet_in_the_middle():
    from modspec.operators.compositions import n_placements, search

    rng = np.random.default_rng(4)
    for _ in range(150):
        r = int(rng.integers(1, 6))
        masses = rng.choice([14.0, 20.0, -20.0, 6.0, 0.0, -8.0, 13.5], r)
        kinds = rng.integers(0, 3, r)
        room, most = rng.integers(0, 5, 3), np.where(rng.uniform(size=r) < 0.8, 9, 0)
        deltas = rng.integers(-30, 60, 6).astype(float)
        at, counts = search(deltas, masses, kinds, most, room, 0.75)
        for i, d in enumerate(deltas):
            want = brute_compositions(d, masses.tolist(), kinds.tolist(), np.minimum(most, room[kinds]).tolist(), room.tolist(), 0.75)
            assert sorted(map(tuple, counts[at == i].tolist())) == want
    # the rule's own example: the hit of one K isn't extended by A and G, which cancel
    at, counts = search(np.array([14.0]), np.array([14.0, 20.0, -20.0]), np.array([0, 1, 2]), np.array([2, 2, 2]), np.array([2, 2, 2]), 0.1)
    assert counts.tolist() == [[1, 0, 0]] and n_placements(counts[0], np.array([0, 1, 2]), np.array([2, 2, 2])) == 2
    # five rules on thirty places: 324,632 vectors, of which only hits become rows
    at, counts = search(np.array([500.0]), np.array([14.01, 42.02, 79.9, 56.03, 28.3]), np.zeros(5, int), np.full(5, 30), np.array([30]), 0.001)
    assert (np.abs(counts @ np.array([14.01, 42.02, 79.9, 56.03, 28.3]) - 500) < 0.001).all()


def test_composition_rows(spark):
    from modspec.operators.compositions import find_compositions

    rows = [("a", 14.0, [2, 2, 2], [2, 2, 2]), ("none", 3.0, [2, 2, 2], [2, 2, 2]), ("null", None, [2, 2, 2], [2, 2, 2]), ("wide", 14.0, [30, 2, 2], [30, 2, 2]), ("bare", 0.0, [2, 2, 2], [2, 2, 2]), ("not wide", 20.0, [0, 1, 0], [30, 1, 0])]
    df = spark.createDataFrame(rows, "k string, delta double, most array<int>, room array<int>")
    got = {(r["k"], tuple(r["counts"]) if r["counts"] else None, r["n_forms"], r["too_many_sites"]) for r in find_compositions(df, [14.0, 20.0, -20.0], [0, 1, 2], 0.1, "k").collect()}
    assert got == {("a", (1, 0, 0), 2, False), ("wide", None, 30, True), ("bare", (0, 0, 0), 1, False), ("not wide", (0, 1, 0), 1, False)}
    assert find_compositions(df.limit(0), [14.0, 20.0, -20.0], [0, 1, 2], 0.1, "k").collect() == []


def test_names_of_forms_have_every_modification(spark):
    """Two rules on the C-terminus give two names; fixed modifications stand before variable ones."""
    from modspec.functions.constants import PROTON
    from modspec.operators.placements import base_masses, candidate_forms

    whole = lambda shift, fixed: (F.aggregate(base_masses(F.col("peptide"), fixed), F.lit(18.0105647 + shift), lambda a, m: a + m) + 2 * PROTON) / 2
    rules = [("am", "C-term", 10.0), ("bm", "C-term", 10.004), ("t", "N-term", 10.002), ("x", "K", 50.0)]
    peptide = spark.createDataFrame([("AKGKA",)], "peptide string")
    spectra = peptide.select("peptide", F.lit(1).alias("spectrum"), whole(10.0, None).alias("precursor_mz"), F.lit(2).alias("charge"))
    forms, _ = candidate_forms(spectra, rules, 0.01)
    assert {r["imp"] for r in forms.collect()} == {"_AKGKA_{am}", "_AKGKA_{bm}", "_{t}AKGKA_"}
    fixed = {"K": 28.5, "C-term": 3.0}
    spectra = peptide.select("peptide", F.lit(1).alias("spectrum"), whole(50.0, fixed).alias("precursor_mz"), F.lit(2).alias("charge"))
    forms, _ = candidate_forms(spectra, rules, 0.01, fixed, fixed_names={"K": "fk"})
    assert {r["imp"] for r in forms.collect()} == {"_AK{fk}{x}GK{fk}A_{C-term}", "_AK{fk}GK{fk}{x}A_{C-term}"}


def test_sites_at_both_ends(spark):
    from modspec.operators.sites import parse_sites

    rows = spark.createDataFrame([("P", "_{m}AK{m}B_{m}", 10)], "protein string, imp string, start int")
    got = parse_sites(rows, spark.createDataFrame([("P", "p")], "protein string, prot_abbr string"), spark.createDataFrame([("m", "M")], "mod string, mod_abbr string"))
    assert sorted(r["site"] for r in got.collect()) == ["pC-term_M", "pK10M", "pN-term_M"]


def test_chemical_prior_asks_all_at_the_last_place(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [5, 5]), (2, ["a", "a"], [5, 5]), (3, ["b", "a"], [4, 5]), (4, ["b"], [4]), (5, [], [])], "id int, m array<string>, p array<int>").withColumn("n", F.lit(5))
    assert {r["id"] for r in filters.chem_prior(df, "m", "p", "n", ["a"]).collect()} == {2, 3, 4, 5}


def test_hyperscore_errors_and_theoretical_grid(spark):
    rows = spark.createDataFrame([(1, "f", 1, 1, 0.5)], "s int, imp string, kind int, pos int, raw double")
    with pytest.raises(Exception, match="below 1"):
        solve.hyperscores(rows, ["s"], "imp", F.col("kind") == 1, "raw").collect()
    with pytest.raises(Exception, match="more than 1000"):
        solve.hyperscores(spark.range(1001).select(F.lit(1).alias("s"), F.lit("f").alias("imp"), F.lit(2.0).alias("raw")), ["s"], "imp", F.lit(True), "raw").collect()
    theory = spark.createDataFrame([(1, k, p) for k in (1, 2) for p in range(1, 5)], "s int, kind int, pos int")
    got = solve.ksdp_scores(rows, ["s"], "imp", "kind", "pos", "raw", theory=theory).first()["score"]
    # of kind 1 the place 1 is hit: windows of 1..3, 1..4, 1..4, 2..4 places; of kind 2 nothing
    misses = [2, 3, 3, 3] + [3, 4, 4, 3]
    assert got == pytest.approx(0.5 * sum(np.exp(-0.9 * m) for m in misses) ** 0.5 / 8)
