"""Steps whose cost must not grow faster than their input: what their plans may not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.operators import windows


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_backward_windows_run_on(spark):
    """A frame that ends at its group's last row is evaluated anew for each row."""
    rows = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 50).alias("s"), (F.col("id") % 5 / 5).alias("ratio"))
    placed = windows.falling(rows, "s", "t", 3)
    least = windows.least_of_runs(placed, ["k"], "s", "t", "ratio")
    both = [windows.carried(rows, ["k"], "t", ["t", "s"], {"x": F.col("ratio")}, back=True, strict=strict, hot=hot) for hot in (False, True) for strict in (False, True)]
    for df in (least, *both):
        assert "unboundedfollowing" not in plan_of(df).lower()
    got = {(r["k"], r["t"]): r["q"] for r in least.collect()}
    every = rows.collect()
    for r in every:
        assert got[r["k"], r["t"]] == min(o["ratio"] for o in every if o["k"] == r["k"] and (-o["s"], o["t"]) >= (-r["s"], r["t"]))


def test_equal_windows_have_one_trace(spark, monkeypatch):
    """Peaks meet each window once, however many keys it has."""
    from modspec.operators import traces

    fans = spark.createDataFrame([(g, 1, 2, 100.0, 100.2) for g in range(30)] + [(99, 1, 2, 300.0, 300.2)], "g int, run int, charge int, low double, high double")
    peaks = [(100.1 + k * 1.00335 / 2, v) for k, v in enumerate((10.0, 1.0, 0.1))]
    scans = spark.createDataFrame([(1, n, n / 10, peaks) for n in range(1, 12)], "run int, scan int, rt_min double, peaks array<struct<mz:double,intensity:double>>")
    met = []
    points = traces.isotope_points
    monkeypatch.setattr(traces, "isotope_points", lambda *a: met.append(a[1].count()) or points(*a))
    got = traces.xic_traces(scans, traces.scan_grid(scans), fans, ["g"]).collect()
    assert met == [2]
    assert len(got) == 30 * 11 and {r["g"] for r in got} == set(range(30)) and all(r["raw"] == r["smooth"] == 10.0 for r in got)


def shuffles(df) -> int:
    """Exchanges of a plan that move rows, without those that are used again."""
    return sum("Exchange " in line and "Reused" not in line and "Broadcast" not in line for line in plan_of(df).splitlines())


def test_scores_of_all_modes_move_no_rows(spark):
    """Matches that lie by spectrum are scored by all modes where they are, in parts whose number goes by their rows."""
    from modspec.operators import solve
    from modspec.sources import store

    rows = [(s, i, ion, ion % 2, ion % 3, ion // 2, (i + ion) / 10, 1.0 + ion) for s in range(6) for i in range(3) for ion in range(10) if (s + i * ion) % 3]
    matches = store.spread(spark.createDataFrame(rows, "spectrum long, imp long, ion long, kind long, series long, pos long, norm double, raw double").where("norm > 0"), "spectrum")
    modes = {f"m{n}": (mode, "sqrt_intens_sum") for n, mode in enumerate((*solve.SUMS, *solve.LADDERS, solve.HYPERSCORE))}
    got = solve.mode_scores(matches, ["spectrum"], "imp", modes, "ion", "kind", "series", "pos", "norm", "raw")
    for name in modes:
        got = solve.penalty(got, ["spectrum"], name, 0.5, name)
    assert shuffles(got) <= 2  # the same rows, read for forms and for grids
    ladder = solve.ksdp_scores(matches.withColumn("v", F.sqrt("norm")), ["spectrum"], "imp", "kind", "pos", "v").collect()
    plain = {(r["spectrum"], r["imp"]): r["score"] for r in ladder}
    scored = solve.mode_scores(matches, ["spectrum"], "imp", {"x": ("sqrt_intens_ksdp", "sqrt_intens_sum")}, "ion", "kind", "series", "pos", "norm", "raw").collect()
    assert len(scored) == len(plain) and all(abs(r["x"] - plain[r["spectrum"], r["imp"]]) < 1e-12 for r in scored)


def test_spread_has_more_parts_for_more_rows(spark, monkeypatch):
    from modspec.sources import store

    monkeypatch.setattr(store, "SPREAD_ROWS", 10)
    assert store.spread(spark.range(95), "id").rdd.getNumPartitions() == 10
    assert store.spread(spark.range(5), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_abundances_move_no_rows(spark):
    """Terms and targets that lie by spectrum are solved where they are."""
    from modspec.operators import solve
    from modspec.sources import store

    rows = spark.createDataFrame([(s, ion, i, 1.0) for s in range(6) for ion in range(5) for i in range(3) if (s + i * ion) % 3], "spectrum long, ion long, imp long, x double")
    rows = store.spread(rows, "spectrum")
    aims = rows.groupBy("spectrum", "ion").agg(F.sum("x").alias("y"))
    got = solve.estimate_abundance(rows, aims, "spectrum", "ion", "imp", "x", "y", 0.5)
    assert shuffles(got) <= 4  # the same rows, read for entries and right sides, of the two parts of the system


def test_traces_are_walked_many_at_a_time(spark):
    """One call of a grouped function gets many traces, and gives each what it gets alone."""
    from modspec.operators import chrom

    points, matches = [], []
    for g in range(40):
        for i in range(1, 31):
            smooth = 0.0 if i % 15 == g % 5 else float((i * (g + 3)) % 11 + 1)
            points.append((f"t{g}", i, i / 10 + g, smooth, smooth, (i + g) % 4 / 3, 1 - (i + g) % 4 / 3))
        matches += [(f"t{g}", g + k) for k in (0.52, 0.97, 2.31)]
    xic = spark.createDataFrame(points, "g string, i int, rt double, raw double, smooth double, r_A double, r_B double")
    psms = spark.createDataFrame(matches, "g string, rt double")
    ranges = spark.createDataFrame([(f"t{g}", n, a, b) for g in range(40) for n, (a, b) in enumerate([(2, 9), (7, 12), (20, 26)], 1)], "g string, peak_no int, left_i int, right_i int")
    shaped = xic.drop("raw")
    found, kept = chrom.detect_xic_peaks(xic.drop("r_A", "r_B"), psms, ["g"], hot=False), chrom.filter_peak_ratios(shaped, ranges, ["g"], ["A", "B"], 0.5)
    assert all("_batch" in plan_of(df).split("FlatMapCoGroupsInPandas")[1].split("\n")[0] for df in (found, kept))
    assert found.count() > 40
    for g in ("t0", "t7", "t39"):
        own = F.col("g") == g
        assert sorted(found.where(own).collect()) == sorted(chrom.detect_xic_peaks(xic.drop("r_A", "r_B").where(own), psms.where(own), ["g"], hot=False).collect())
        assert sorted(kept.where(own).collect()) == sorted(chrom.filter_peak_ratios(shaped.where(own), ranges.where(own), ["g"], ["A", "B"], 0.5).collect())


def test_equal_values_match_once(spark, monkeypatch):
    """Repeats of ions and of peaks don't multiply: distinct values meet the first ion of each value."""
    from modspec.operators import joins

    met, band = [], joins.band_join
    monkeypatch.setattr(joins, "band_join", lambda a, b, *rest, **named: met.append((a.count(), b.count())) or band(a, b, *rest, **named))
    peaks = spark.createDataFrame([(n, 100.0 + n % 3) for n in range(60)], "peak int, mz double")
    ions = spark.createDataFrame([(n, 100.1 + n % 2, 50 - n) for n in range(50)] + [(99, 100.0, 1)], "ion int, ion_mz double, cls int")
    got = joins.first_match(peaks, ions, "mz", "ion_mz", 0.15, [F.col("cls"), F.col("ion")]).collect()
    assert met == [(3, 3)]
    assert sorted((r["peak"], r["ion"]) for r in got) == [(n, 99 if n % 3 == 0 else 49) for n in range(60) if n % 3 < 2]


def test_equal_windows_are_extracted_once(spark, monkeypatch):
    from modspec.operators import chrom, joins

    met, ranged = [], joins.range_join
    monkeypatch.setattr(joins, "range_join", lambda a, b, *rest: met.append(b.count()) or ranged(a, b, *rest))
    peaks = spark.createDataFrame([(1, s, 100.0 + k / 10, float(s + k)) for s in range(4) for k in range(6)], "run int, scan int, mz double, intensity double")
    windows = spark.createDataFrame([(1, w, 99.95, 100.35) for w in range(20)] + [(1, 99, 100.25, 100.6), (2, 100, 99.95, 100.35)], "run int, window int, low double, high double")
    got = chrom.xic_extract(peaks, windows, ["run"], "scan", "mz", "intensity", 1.0).collect()
    assert met == [3]
    assert sorted((r["window"], r["scan"], r["intensity"]) for r in got) == [(w, s, float(s + (5 if w == 99 else 3))) for w in (*range(20), 99) for s in range(4)]


def test_pairs_lie_in_parts_by_rows(spark, monkeypatch):
    """Parts follow the rows, and both sums of a pair are made where its rows lie."""
    from modspec.plans.registry import QUERIES
    from modspec.sources import store

    monkeypatch.setattr(store, "SPREAD_ROWS", 500)
    plan = plan_of(QUERIES["pairs_pivot"](spark, "/root/testdata/sf0.001"))
    parts = -(-spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() // 500)
    assert parts > 4 and plan.count(f", {parts}), REPARTITION_BY_NUM") == 2
    assert "pivotfirst" not in plan.lower() and plan.lower().split("repartition_by_num")[0].count("exchange") == 1


def test_review_goes_by_spectrum(spark):
    """Scores need no shuffle of matches by more than their spectrum."""
    import re

    from modspec.operators import review

    psms = spark.createDataFrame([(s, 0.5, 600.0) for s in range(5)], "spectrum long, score double, precursor_mz double")
    forms = spark.createDataFrame([(s, 1, 8, [3], [42.0]) for s in range(5)] + [(1, 2, 8, [5], [42.0])], "spectrum long, imp int, length int, sites array<int>, masses array<double>")
    peaks = spark.createDataFrame([(s, k, 400.0 + k, 5.0 + k) for s in range(5) for k in range(6)], "spectrum long, peak int, mz double, intensity double")
    # two hits at a place, and a form that isn't there
    matches = spark.createDataFrame([(1, 1, 1, 2, 0), (1, 1, 1, 2, 1), (1, 1, 1, 3, 2), (1, 1, 1, 6, 3), (1, 1, 2, 7, 4), (1, 9, 2, 5, 5), (1, 1, 3, 1, 5)], "spectrum long, imp int, type int, pos int, peak int")
    got = review.review_scores(psms, forms, peaks, matches, 0.0, 1.0)
    assert {re.sub("#.*", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(got))} == {"spectrum"}
    row = {r["spectrum"]: r for r in got.collect()}[1]
    # 3 hits less 1.5 for gaps at 1, 4 and 7, one less 0.5 for that before it, over 14; the other form has none
    assert row["ladder"] == ((3 - 1.5) + (1 - 0.5)) / 14 / 2 and row["unmatched"] == 1.0


def test_only_forms_that_stay_are_put_in_order(spark, monkeypatch, tmp_path):
    """Of a report that repeats its forms, the last ones and the headings meet."""
    from modspec.operators import windows
    from modspec.sources import readers

    ordered, over = [], windows.over_runs
    monkeypatch.setattr(windows, "over_runs", lambda placed, *rest, **named: ordered.append(placed.count()) or over(placed, *rest, **named))
    lines = ["Protein_name,Peptide_start_position_on_protein;", "*\tIMP\tCharge\tDataset\tMass_center\tLow_mass_bound\tHigh_mass_bound\tPeak_area", "@\tRT_start\tRT_end\tProportion\tCheck_label"]
    for p in range(30):
        lines.append(f"P{p},10;")
        for f in range(5):
            lines.append(f"*\t_F{f}_\t2\trun\t1.5\t1.0\t2.0\t{p}.0")
            lines += [f"@\t{p}.0\t{p + 1}.0\t0.25\t1"] * (0 if p == 29 and f == 4 else 2)
    (tmp_path / "pep.txt").write_bytes("\r\n".join(lines).encode())
    imps, ranges = readers.read_peptide_report(spark, str(tmp_path / "pep.txt"))
    assert sorted((r["imp"], r["protein_line"], r["area"], r["mz_mid"]) for r in imps.collect()) == [(f"_F{f}_", f"P{29 if f < 4 else 28},10;", 29.0 if f < 4 else 28.0, 1.5) for f in range(5)]
    assert sorted((r["imp"], r["rt_start"], r["check_label"]) for r in ranges.collect()) == sorted([(f"_F{f}_", 29.0 if f < 4 else 28.0, 1) for f in range(5)] * 2)
    assert ordered == [5 + 30]


def test_sets_move_once_by_group(spark):
    """Sets are compared where a group lies: one shuffle of the rows, none of pairs."""
    from modspec.operators import joins

    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 1), (1, "c", 1), (1, "c", 2), (1, "d", 3), (2, "a", 1), (2, "b", 1), (2, "b", 1), (3, "a", 1), (3, "a", None), (3, "b", 1), (3, "c", None), (None, "a", 1), (None, "b", 1), (None, "b", 2)]
    got = joins.drop_dominated(spark.createDataFrame(rows, "g int, o string, i int"), "g", "o", "i")
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a"), (1, "c"), (1, "d"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (None, "a"), (None, "b")], key=str)


def test_an_ion_is_one_number(spark):
    from modspec.operators import placements

    ions = spark.createDataFrame([(32, 1, 1, 100.0000005), (2, 65535, 3, 549755.8), (1, 7, 2, 0.5)], "type int, pos int, z int, mz double").withColumn("ion", placements.ion_key())
    got = placements.classed(ions.select("ion", "mz")).collect()
    assert [(r["type"], r["pos"], r["z"], r["ion"] & ((1 << placements.MZ_BITS) - 1)) for r in got] == [(32, 1, 1, 100000001), (2, 65535, 3, 549755800000), (1, 7, 2, 500000)]


def test_ions_and_peaks_move_once_by_spectrum(spark, monkeypatch):
    """Spectra of one peptide have their ions from one row, and ions meet peaks without pairs in a shuffle."""
    from modspec.functions.constants import PROTON, RESIDUES, WATER
    from modspec.operators import joins, placements

    seen, sums = [], joins.band_sums
    monkeypatch.setattr(joins, "band_sums", lambda *a: seen.append((sums(*a), a)) or seen[-1][0])
    mass = sum(RESIDUES[r] for r in "AKAVKG") + WATER + 42.0
    y1, shifted = RESIDUES["G"] + WATER + PROTON, RESIDUES["A"] + RESIDUES["K"] + PROTON
    spectra = spark.createDataFrame([(s, "AKAVKG", mass / 2 + PROTON, 2) for s in range(5)], "spectrum long, peptide string, precursor_mz double, charge int")
    # two peaks near the b ion with the modification, one near that without it
    peaks = spark.createDataFrame([(s, [(shifted + 42.0, 30.0), (shifted + 42.004, 30.0), (shifted, 20.0 * (s + 1)), (y1, 5.0)]) for s in range(5)], "spectrum long, peaks array<struct<mz:double,intensity:double>>")
    rules = [("m", "K", 42.0)]
    got = placements.deconvolve_msms(spectra, peaks, rules, 0.01, 0.01).collect()
    met, (points, items, _, at, value, item_at, tol, name) = seen[0]
    assert shuffles(items) + shuffles(points) == shuffles(met)
    share = {(r["spectrum"], r["imp"]): r["abundance"] for r in got}
    assert {k: round(v, 6) for k, v in share.items()} == {(s, imp): round(part / (60 + 20 * (s + 1)), 6) for s in range(5) for imp, part in (("_AK{m}AVKG_", 60), ("_AKAVK{m}G_", 20 * (s + 1)))}
    flat = placements.deconvolve_msms(spectra, peaks.select("spectrum", F.inline("peaks")), rules, 0.01, 0.01).collect()
    assert sorted(map(tuple, flat)) == sorted(map(tuple, got))


def test_sums_of_a_band_are_those_of_the_join(spark):
    from modspec.operators import joins

    points = spark.createDataFrame([(g, n * 0.37 % 5, 1.0 + n % 4) for g in range(3) for n in range(40)] + [(1, None, 1.0), (2, 2.0, None)], "g int, mz double, v double").repartition(3, "g")
    items = spark.createDataFrame([(g, i, i * 0.5) for g in range(4) for i in range(12)] + [(1, 99, None)], "g int, item int, at double").repartition(3, "g")
    got = joins.band_sums(points, items, "g", "mz", "v", "at", 0.25, "sum")
    assert shuffles(got) == 2
    want = joins.band_join(points, items, "mz", "at", 0.25, ("g",)).groupBy("g", "item").agg(F.sum("v").alias("sum"))
    both = items.join(want, ["g", "item"], "left").collect()
    key = lambda r: (r["g"], r["item"], None if r["sum"] is None else round(r["sum"], 9))
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, both), key=str)


def test_traces_stay_where_they_are(spark, monkeypatch):
    """Intensities move once, by window and block of places; no row of the result does, nor do peaks."""
    import re

    from modspec.operators import traces

    monkeypatch.setattr(traces, "BLOCK", 8)
    fans = spark.createDataFrame([(g, g % 2, 2, 100.0, 100.2) for g in range(6)] + [(9, 1, 2, 300.0, 300.2)], "g int, run int, charge int, low double, high double")
    shape = lambda n: [(100.1 + k * 1.00335 / 2, v * (n % 5 + 1)) for k, v in enumerate((10.0, 1.0, 0.1))]
    scans = spark.createDataFrame([(run, n, n / 10, shape(n) if n % (run + 3) == 0 or n > 44 else []) for run in (0, 1) for n in range(10, 50)], "run int, scan int, rt_min double, peaks array<struct<mz:double,intensity:double>>")
    grid = traces.scan_grid(scans)
    assert all(r["n"] == 40 and r["i"] == r["scan"] - 9 and r["near"] == [k / 10 for k in range(max(10, r["scan"] - 3), min(49, r["scan"] + 3) + 1)] for r in grid.collect())
    got = traces.xic_traces(scans, grid.checkpoint(), fans, ["g"])
    moved = [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(got))]
    assert "run, _w, _block" in moved and not [keys for keys in moved if re.search(r"\bi\b|_bucket", keys)]
    joins = [re.sub(r"#\d+L?", "", line) for line in plan_of(got).splitlines() if "Join [" in line]
    assert "BroadcastHashJoin [run, _w], [run, _w]" in joins[0]
    want = set()
    for g in range(6):
        raw = [10.0 * (n % 5 + 1) if n % (g % 2 + 3) == 0 or n > 44 else 0.0 for n in range(10, 50)]
        for i in range(40):
            if max(raw[max(0, i - 3) : i + 4]) > 0:
                near = raw[max(0, i - 2) : i + 3]
                want.add((g, g % 2, i + 1, (i + 10) / 10, raw[i], round(sum(near) / len(near), 9)))
    rows = [(r["g"], r["run"], r["i"], r["rt"], r["raw"], round(r["smooth"], 9)) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
