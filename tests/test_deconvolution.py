"""The deconvolution from files to its reports, its penalties and row weights."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modspec.functions.constants import PROTON, RESIDUES, WATER
from modspec.operators import jobs, solve
from modspec.sources import readers, writers

ACETYL, LABEL, TAG = 42.010565, 6.020129, 229.162932
LIBRARY = f"""@NAME_NUMBER=4
total=4
name1=Acetyl[K]
Acetyl[K]=K NORMAL {ACETYL} 42.0367 0
name2=Acetyl[Protein N-term]
Acetyl[Protein N-term]=ABCDEFGHIJKLMNOPQRSTUVWXYZ PRO_N {ACETYL} 42.0367 0
name3=Label_13C(6)[R]
Label_13C(6)[R]=R NORMAL {LABEL} 5.9559 0
name4=Tag[Protein C-term]
Tag[Protein C-term]=ABCDEFGHIJKLMNOPQRSTUVWXYZ PRO_C {TAG} 229.2634 0
"""


def ladder(peptide, at, tagged):
    """Mass and singly charged b and y ions of a form: acetyl at 1-based ``at`` (0: before the first), every R labelled, a tag behind the last."""
    m = [RESIDUES[r] + (LABEL if r == "R" else 0) + (ACETYL if i + 1 == max(at, 1) else 0) for i, r in enumerate(peptide)]
    m[-1] += TAG if tagged else 0
    return sum(m) + WATER, [sum(m[:k]) + PROTON for k in range(1, len(m))] + [sum(m[k:]) + WATER + PROTON for k in range(1, len(m))]


@pytest.fixture
def files(tmp_path):
    """Spectra of two peptides, one at its protein's beginning, one at its end; one listed spectrum that no file has."""
    (tmp_path / "lib.ini").write_text(LIBRARY)
    (tmp_path / "p.fasta").write_text(">P1\nMGAKRVKLKK\n>P2\nAAKVGKR\n>P3\nWWWWGAKRVK\n")
    mixes = {("a", "s.1"): ("GAKRVK", False, {0: 0.5, 3: 0.3, 6: 0.2}), ("a", "s.2"): ("GAKRVK", False, {3: 1.0}), ("b", "s.1"): ("KVGKR", True, {1: 0.6, 4: 0.4})}
    out = {}
    for (dataset, title), (peptide, tagged, shares) in mixes.items():
        forms = {at: ladder(peptide, at, tagged) for at in shares}
        peaks = sorted((mz, 1000 * shares[at]) for at, (_, ions) in forms.items() for mz in ions)
        text = "".join(f"{mz:.6f} {h:.3f}\n" for mz, h in peaks)
        mass = next(iter(forms.values()))[0]
        out.setdefault(dataset, []).append(f"BEGIN IONS\nTITLE={title}\nCHARGE=2+\nPEPMASS={(mass + 2 * PROTON) / 2:.6f}\n{text}END IONS\n")
    (tmp_path / "mgf").mkdir()
    for dataset, blocks in out.items():
        (tmp_path / "mgf" / f"{dataset}.mgf").write_text("\n".join(blocks))
    (tmp_path / "list.txt").write_text("GAKRVK\na.mgf\ts.1\na.mgf\ts.2\na.mgf\ts.9\nKVGKR\nb\ts.1\n")
    return tmp_path


def run(spark, files, out, **options):
    args = [str(files / n) for n in ("mgf", "p.fasta", "lib.ini", "list.txt")]
    return jobs.deconvolve_files(spark, *args, str(files / out), "Acetyl[K];Acetyl[Protein N-term]", 0.01, 0.002, "Label_13C(6)[R];Tag[Protein C-term]", r"^>(\w+)", **options)


WANT = {
    ("GAKRVK", "a.mgf", "s.1", "_{Acetyl}GAKR{Label_13C(6)}VK_"): 0.5, ("GAKRVK", "a.mgf", "s.1", "_GAK{Acetyl}R{Label_13C(6)}VK_"): 0.3, ("GAKRVK", "a.mgf", "s.1", "_GAKR{Label_13C(6)}VK{Acetyl}_"): 0.2,
    ("GAKRVK", "a.mgf", "s.2", "_GAK{Acetyl}R{Label_13C(6)}VK_"): 1.0, ("KVGKR", "b", "s.1", "_K{Acetyl}VGKR{Label_13C(6)}_{Tag}"): 0.6, ("KVGKR", "b", "s.1", "_KVGK{Acetyl}R{Label_13C(6)}_{Tag}"): 0.4,
}


@pytest.mark.parametrize("options", [{"model": "variable", "weights": "observed"}, {"model": "constant", "penalty": "exp_intens_ksdp", "grid": "exp_intens_sum", "lam": 1e-6}], ids=str)
def test_files_to_reports(spark, files, options):
    told, parts = run(spark, files, "out", **options)
    report = readers.read_msms_report(spark, str(files / "out" / "report_msms"))
    got = {(r["peptide"], r["dataset"], r["title"], r["imp"]): r["abundance"] for r in report.collect()}
    assert got.keys() == WANT.keys() and all(got[k] == pytest.approx(WANT[k], abs=2e-3) for k in WANT)
    assert {(r["title"], r["status"]) for r in told.collect()} == {("s.1", "ok"), ("s.2", "ok"), ("s.9", "no spectrum")}
    # without noise, efficiencies and shares solve the variable model's system of right side 0 exactly: its columns depend on each other
    ambiguous = sorted(r[0] for r in spark.read.text(str(files / "out" / "report_spectra_may_FP")).collect())
    assert ambiguous == (["a.mgf\ts.1", "b\ts.1"] if options["model"] == "variable" else [])
    if options["model"] == "variable":
        parts = parts.collect()
        assert {(r["peptide"], r["title"]) for r in parts} == {("GAKRVK", "s.1"), ("KVGKR", "s.1")}
        assert all(r["intensity"] > 0 and 0 < r["efficiency"] <= 1 for r in parts)
    else:
        assert parts is None


def test_lists_and_proteins_must_match(spark, files):
    with pytest.raises(ValueError, match="no protein has the peptides QQQ"):
        (files / "list.txt").write_text("QQQ\na\ts.1\n")
        run(spark, files, "bad")
    library = readers.read_mod_library(spark, str(files / "lib.ini"))
    with pytest.raises(ValueError, match=r"the library has no Methyl\[K\]"):
        jobs.rules_of(spark, "Acetyl[K];Methyl[K]", library)
    assert jobs.rules_of(spark, "Label_13C(6)[R]; ", library) == [("Label_13C(6)", "R", LABEL)]


def test_of_fixed_modifications_of_one_end_the_last_stands(spark):
    from modspec.operators.placements import base_masses, fixed_places

    fixed = {"N-term": 1.0, "Protein N-term": 2.0, "N-termK": 4.0, "C-termR": 8.0, "K": 16.0}
    rows = spark.createDataFrame([("AKA", False, False), ("AKA", True, False), ("KAR", True, True)], "peptide string, prot_n boolean, prot_c boolean")
    got = [tuple(r) for r in rows.select(base_masses(F.col("peptide"), fixed), fixed_places(F.col("peptide"), fixed)).collect()]
    shifts = [[round(m - RESIDUES[c], 6) for m, c in zip(masses, p)] for (masses, _), p in zip(got, ("AKA", "AKA", "KAR"))]
    assert shifts == [[1.0, 16.0, 0.0], [2.0, 16.0, 0.0], [20.0, 0.0, 8.0]]
    assert [[tuple(x) for x in places] for _, places in got] == [[(0, "N-term"), (2, "K")], [(0, "Protein N-term"), (2, "K")], [(1, "N-termK"), (1, "K"), (3, "C-termR")]]


MODES = [*[(m, "intens_sum") for m in solve.SUMS], *itertools.product(("exp_intens_ksdp",), solve.GRIDS), ("sqrt_intens_ksdp_sqrt", "intens_sum"), ("sqrt_intens_ksdp_sqrt", "exp_intens_sum"), (solve.HYPERSCORE, "intens_sum")]


def plain_score(mode, grid, ions, peaks, own):
    """``ions``: (type, z, pos) by number, ``peaks``: number to (norm, raw), ``own``: numbers of a form's ions."""
    met = [i for i in peaks if i in own]
    if mode in solve.SUMS:
        of = {"intens_sum": lambda n, r: n, "log_intens_sum": lambda n, r: math.log(r), "sqrt_intens_sum": lambda n, r: math.sqrt(r), "exp_intens_sum": lambda n, r: math.exp(n)}[mode]
        return sum(of(*peaks[i]) for i in met)
    if mode == solve.HYPERSCORE:
        out = 0.0
        for t in (1, 2):
            raws = [peaks[i][1] for i in met if ions[i][0] == t]
            out += sum(math.log10(k) for k in range(1, len(raws) + 1)) + math.log(sum(raws)) if raws else 0.0
        return out
    kinds, places = sorted({i[:2] for i in ions}), sorted({i[2] for i in ions})
    seen = np.zeros((len(kinds), len(places)))
    for i in met:
        seen[kinds.index(ions[i][:2]), places.index(ions[i][2])] = 1
    kernel = sum(math.exp(-0.9 * (seen[k, max(0, p - 2) : p + 3] == 0).sum()) for k in range(len(kinds)) for p in range(len(places)))
    of = {"intens_sum": lambda n: n, "log_intens_sum": math.log, "sqrt_intens_sum": math.sqrt, "exp_intens_sum": math.exp}[grid]
    total = sum(of(peaks[i][0]) for i in met) + (len(peaks) - len(met) if grid == "exp_intens_sum" else 0)
    score = total * math.sqrt(kernel) / seen.size
    return math.sqrt(score) if mode == "sqrt_intens_ksdp_sqrt" else score


@pytest.mark.parametrize("mode,grid", MODES)
def test_scores_of_forms(spark, mode, grid):
    """Every mode against its formula, over a grid with kinds and places that nothing matches."""
    rng = np.random.default_rng(5)
    rows, theory, want = [], [], {}
    for s in range(6):
        ions = [(t, z, p) for t in (1, 2, 11) for z in (1, 2) for p in range(2, 9)]
        raws = {i: float(rng.uniform(2, 900)) for i in rng.choice(len(ions), 17, replace=False)}
        peaks = {i: (r / max(raws.values()), r) for i, r in raws.items()}
        theory += [(s, f"{t}/{z}", p) for t, z, p in ions]
        for f in range(3):
            own = {i for i in range(len(ions)) if rng.random() < 0.6}
            if met := [i for i in peaks if i in own]:
                want[s, f] = plain_score(mode, grid, ions, peaks, own)
                rows += [(s, f, int(i), f"{ions[i][0]}/{ions[i][1]}", ions[i][0], ions[i][2], *peaks[i]) for i in met]
        for i in peaks:  # a form that has every match
            rows.append((s, 9, int(i), f"{ions[i][0]}/{ions[i][1]}", ions[i][0], ions[i][2], *peaks[i]))
        want[s, 9] = plain_score(mode, grid, ions, peaks, set(range(len(ions))))
    matches = spark.createDataFrame(rows, "spectrum int, imp int, ion int, kind string, type int, pos int, norm double, raw double")
    got = solve.form_scores(matches, ["spectrum"], "imp", mode, "ion", "kind", "type", "pos", "norm", "raw", grid, spark.createDataFrame(theory, "spectrum int, kind string, pos int"))
    assert {(r["spectrum"], r["imp"]): r["score"] for r in got.collect()} == pytest.approx(want, rel=1e-9)


def test_scores_of_nought_and_unknown_modes(spark):
    scored = spark.createDataFrame([(1, "a", 2.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", 1.0), (3, "b", 4.0)], "k int, imp string, score double")
    got = {(r["k"], r["imp"]): r["penalty"] for r in solve.penalty(scored, ["k"], "score", 0.5).collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): solve.BARRED, (2, "a"): 0.5, (2, "b"): 0.5, (3, "a"): 2.0, (3, "b"): 0.5}
    matches = spark.createDataFrame([(1, "a", 1, "1/1", 1, 2, 1.0, 5.0)], "k int, imp string, ion int, kind string, type int, pos int, norm double, raw double")
    of = lambda *mode: solve.form_scores(matches, ["k"], "imp", mode[0], "ion", "kind", "type", "pos", "norm", "raw", *mode[1:])
    for bad in (("xcorr",), ("log_intens_ksdp", "squares"), ("sqrt_intens_ksdp_sqrt", "log_intens_sum")):
        with pytest.raises(ValueError):
            of(*bad)


def test_a_barred_form_gets_nothing():
    x, _, fine = solve.active_set(np.array([[[2.0, 1.0], [1.0, 2.0]]]), np.array([[-1.0, solve.BARRED / 2]]))
    assert fine.all() and x[0] == pytest.approx([0.5, 0.0])
