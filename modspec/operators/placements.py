"""Forms of a peptide with modifications of several specificities at once, and the deconvolution of its spectra.

A rule is (modification, specificity, mass); a specificity is a residue, or
``N-term`` or ``C-term``, with a residue behind it if the terminal one must be
that, and ``Protein `` before it if it must be a protein's end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspec.functions.constants import PROTON, RESIDUES, WATER
from modspec.functions.scalars import max_fragment_charge, render_imp
from modspec.operators import enumerate as E
from modspec.operators import filters, joins, solve
from modspec.operators.compositions import find_compositions
from modspec.sources.store import stored

Rule = tuple[str, str, float]
TERMINUS = re.compile(r"^(Protein )?([NC]-term)(.?)$")


def slot_class(specificity: str) -> str:
    """The kind of place that a specificity is of: a residue, N-term or C-term."""
    end = TERMINUS.match(specificity)
    return end.group(2) if end else specificity


def applies(specificity: str, peptide: Column) -> Column:
    """Whether a specificity holds at all for the peptide; protein ends are the columns prot_n and prot_c."""
    end = TERMINUS.match(specificity)
    if not end:
        return F.lit(True)
    protein, kind, residue = end.groups()
    first = kind == "N-term"
    at_end = F.col("prot_n" if first else "prot_c") if protein else F.lit(True)
    return at_end & (F.startswith(peptide, F.lit(residue)) if first else F.endswith(peptide, F.lit(residue))) if residue else at_end


def slots(peptide: Column, rules: list[Rule]) -> Column:
    """Array of (site, kind) by site: 0 is the N-terminus, length + 1 the C-terminus."""
    kinds = {slot_class(s) for _, s, _ in rules}
    residues = "".join(sorted(k for k in kinds if len(k) == 1))
    slot = lambda site, kind: F.struct(site.cast("int").alias("site"), kind.alias("kind"))
    inner = F.transform(E.sites_of(peptide, residues), lambda i: slot(i, F.substr(peptide, i, F.lit(1))))
    ends = [F.array(slot(at, F.lit(k))) if k in kinds else F.array().cast("array<struct<site:int,kind:string>>") for k, at in (("N-term", F.lit(0)), ("C-term", F.length(peptide) + 1))]
    return F.concat(ends[0], inner, ends[1])


def n_slots(kind: str) -> Column:
    """Number of the slots of a kind."""
    return F.size(F.filter("slots", lambda x: x["kind"] == kind))


def site_compositions(peptides: DataFrame, rules: list[Rule], peptide: str = "peptide") -> DataFrame:
    """``peptides`` with slots, counts (array, one for each rule), delta, n_forms and too_many_sites: all counts that the places hold.

    ``n_forms`` is the number of arrangements in closed form, null with too many
    sites of one kind.  ``peptides`` must be distinct, with the booleans prot_n
    and prot_c where a rule is about protein ends.
    """
    out = peptides.withColumn("slots", slots(F.col(peptide), rules))
    kinds = list(dict.fromkeys(slot_class(s) for _, s, _ in rules))
    size = {k: n_slots(k) for k in kinds}
    used = {k: F.lit(0) for k in kinds}
    for i, (_, specificity, _) in enumerate(rules):
        kind = slot_class(specificity)
        most = F.when(applies(specificity, F.col(peptide)), size[kind] - used[kind]).otherwise(0)
        out = out.withColumn(f"_k{i}", F.explode(F.sequence(F.lit(0), most.cast("int"))))
        used[kind] = used[kind] + F.col(f"_k{i}")
    ways, wide = F.lit(1).cast("long"), F.lit(False)
    for kind in kinds:
        counts = [F.col(f"_k{i}") for i, r in enumerate(rules) if slot_class(r[1]) == kind]
        ways = ways * F.when(used[kind] == 0, F.lit(1).cast("long")).otherwise(E.count_arrangements(size[kind], counts))
        wide = wide | ((used[kind] > 0) & (size[kind] > E.MAX_SITES))
    delta = sum((F.col(f"_k{i}") * mass for i, (_, _, mass) in enumerate(rules)), F.lit(0.0))
    counted = out.withColumn("counts", F.array(*[F.col(f"_k{i}") for i in range(len(rules))])).withColumn("delta", delta).withColumn("n_forms", ways).withColumn("too_many_sites", wide)
    return counted.drop(*[f"_k{i}" for i in range(len(rules))])


def site_arrangements(compositions: DataFrame, rules: list[Rule], name: str = "placement") -> DataFrame:
    """One row per distinct placement of ``counts`` on ``slots``: an array with the modification ('' for none) of each slot.

    A fold over the slots, whose prefixes use no more of a rule than counted and
    leave no more places of a kind empty than the counts do.
    """
    kinds = list(dict.fromkeys(slot_class(s) for _, s, _ in rules))
    choice = lambda code, kind, most: F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"), most.cast("int").alias("most"))
    chosen = [choice(i, slot_class(s), F.get("counts", F.lit(i))) for i, (_, s, _) in enumerate(rules)]
    for n, kind in enumerate(kinds):
        full = sum((F.get("counts", F.lit(i)) for i, r in enumerate(rules) if slot_class(r[1]) == kind), F.lit(0))
        chosen.append(choice(-1 - n, kind, n_slots(kind) - full))
    rows = compositions.withColumn("_choices", F.filter(F.array(*chosen), lambda c: c["most"] > 0))
    grow = lambda acc, slot: F.flatten(F.transform(acc, lambda p: F.transform(F.filter("_choices", lambda c: (c["kind"] == slot["kind"]) & (F.size(F.filter(p, lambda x: x == c["code"])) < c["most"])), lambda c: F.concat(p, F.array(c["code"])))))
    placed = rows.withColumn("_codes", F.explode(F.aggregate("slots", F.array(F.array().cast("array<int>")), grow)))
    names = F.array(*[F.lit(m) for m, _, _ in rules])
    return placed.withColumn(name, F.transform("_codes", lambda c: F.when(c < 0, "").otherwise(F.get(names, c)))).drop("_codes", "_choices")


def fixed_ends(peptide: Column, fixed: dict[str, float] | None) -> list[tuple[Column, Column, str]]:
    """(whether it stands, its site, specificity) of each terminal fixed modification; of those of one end the last that applies stands.

    One that asks for a residue lies on that residue, the others outside of it.
    """
    out = []
    specs = [s for s in fixed or {} if TERMINUS.match(s)]
    for i, spec in enumerate(specs):
        later = [applies(s, peptide) for s in specs[i + 1 :] if slot_class(s) == slot_class(spec)]
        stands = applies(spec, peptide)
        for other in later:
            stands = stands & ~other
        first, residue = slot_class(spec) == "N-term", TERMINUS.match(spec).group(3)
        out.append((stands, F.lit(1 if residue else 0) if first else F.length(peptide) + (0 if residue else 1), spec))
    return out


def base_masses(peptide: Column, fixed: dict[str, float] | None = None) -> Column:
    """Masses by place of the residues with their fixed modifications (a specificity as in rules to its mass); null for a letter that is no residue."""
    fixed = fixed or {}
    table = F.create_map(*[F.lit(x) for r, m in RESIDUES.items() for x in (r, m + fixed.get(r, 0.0))])
    of = lambda kind: sum((F.when(stands, fixed[s]).otherwise(0.0) for stands, _, s in fixed_ends(peptide, fixed) if slot_class(s) == kind), F.lit(0.0))
    ends = lambda i: F.when(i == 0, of("N-term")).otherwise(0.0) + F.when(i == F.length(peptide) - 1, of("C-term")).otherwise(0.0)
    return F.transform(F.split(peptide, ""), lambda r, i: F.try_element_at(table, r) + ends(i))


def fixed_places(peptide: Column, fixed: dict[str, float] | None, names: dict[str, str] | None = None) -> Column:
    """Array of (site, name) of the fixed modifications of a peptide, sites as in ``slots``."""
    none = F.array().cast("array<struct<site:int,name:string>>")
    at = lambda sites, spec: F.transform(sites, lambda i: F.struct(i.cast("int").alias("site"), F.lit((names or {}).get(spec, spec)).alias("name")))
    inner = [at(E.sites_of(peptide, s), s) for s in fixed or {} if not TERMINUS.match(s)]
    ends = lambda kind: [F.when(stands, at(F.array(site), s)).otherwise(none) for stands, site, s in fixed_ends(peptide, fixed) if slot_class(s) == kind]
    return F.concat(none, *ends("N-term"), *inner, *ends("C-term"))


def trypsin_cterm(length: Column, tol: float, limits: list[float], masses: Column) -> Column:
    """Whether a placement is possible for trypsin: no more than ``tol`` on the C-terminal residue, or a mass within it of a limit."""
    at = F.filter(F.arrays_zip(F.col("slots").alias("s"), masses.alias("m")), lambda x: x["s"]["site"] == length)
    return ~F.exists(at, lambda x: (x["m"] >= tol) & ~F.exists(F.array(*[F.lit(float(v)) for v in limits]), lambda v: F.abs(x["m"] - v) < tol))


def candidate_forms(spectra: DataFrame, rules: list[Rule], ms1_tol: float, fixed: dict[str, float] | None = None, limits: list[float] | None = None, cap: int = E.MAX_CANDIDATES, fixed_names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((spectrum, peptide, prot_n, prot_c, imp, slots, placement), (spectrum, status)): forms whose mass is that of the spectrum.

    ``spectra``: spectrum, peptide, precursor_mz, charge, and prot_n and prot_c
    where a rule or a fixed modification needs them.  Placements are made once for each composition
    of a distinct peptide, after their number is known; a spectrum whose candidates
    are too many, or that may be unmodified, has none, and its status says so.
    Names of forms have the fixed modifications, each named by ``fixed_names``
    (specificity to name, the specificity itself where it isn't given) before
    the variable one of the same place.
    ``limits``, if given, are the masses that trypsin allows at the C-terminus.
    """
    ends = [c for c in ("prot_n", "prot_c") if c in spectra.columns]
    peptide = ["peptide", *ends]
    masses = base_masses(F.col("peptide"), fixed)
    theory = F.aggregate(masses, F.lit(WATER), lambda acc, m: acc + m)
    measured = spectra.withColumn("_dm", (F.col("precursor_mz") - PROTON) * F.col("charge") - theory).where("_dm is not null")
    kinds = list(dict.fromkeys(slot_class(r[1]) for r in rules))
    most = F.array(*[F.when(applies(r[1], F.col("peptide")), n_slots(slot_class(r[1]))).otherwise(0) for r in rules])
    profiled = measured.withColumn("slots", slots(F.col("peptide"), rules)).select("spectrum", *peptide, "slots", "_dm", most.alias("most"), F.array(*[n_slots(k) for k in kinds]).alias("room"))
    hits = find_compositions(profiled, [r[2] for r in rules], [kinds.index(slot_class(r[1])) for r in rules], ms1_tol, "spectrum", "_dm", cap=cap)
    met = stored(hits.join(profiled.select("spectrum", *peptide, "slots"), "spectrum"))
    bare = F.aggregate("counts", F.lit(0), lambda acc, k: acc + k) == 0
    judged = met.groupBy("spectrum").agg(F.sum("n_forms").alias("n"), F.bool_or(bare).alias("_bare"), F.bool_or("too_many_sites").alias("_wide"))
    status = F.when(F.col("n").isNull() & F.col("_wide").isNull(), "no arrangement").when(F.col("_bare"), "unmodified").when(F.col("_wide"), "too many sites").when(F.col("n") > cap, "too many").otherwise("ok")
    told = spectra.select("spectrum").join(judged, "spectrum", "left").select("spectrum", status.alias("status"))
    fit = met.join(told.where("status = 'ok'"), "spectrum", "left_semi").select("spectrum", *peptide, "slots", "counts")
    wanted = fit.select(*peptide, "slots", "counts").distinct()
    placed = site_arrangements(wanted, rules)
    if limits is not None:
        table = F.create_map(F.lit(""), F.lit(0.0), *[F.lit(x) for m, _, mass in rules for x in (m, mass)])
        placed = placed.where(trypsin_cterm(F.length("peptide"), ms1_tol, limits, F.transform("placement", lambda m: F.element_at(table, m))))
    occupied = F.filter(F.arrays_zip(F.col("slots").alias("s"), F.col("placement").alias("m")), lambda x: x["m"] != "")
    named = F.concat(fixed_places(F.col("peptide"), fixed, fixed_names), F.transform(occupied, lambda x: F.struct(x["s"]["site"].alias("site"), x["m"].alias("name"))))
    placed = placed.withColumn("_named", named).withColumn("imp", render_imp(F.col("peptide"), F.col("_named.site"), F.col("_named.name")))
    return stored(fit.drop("slots").join(placed.select(*peptide, "counts", "imp", "slots", "placement"), [*peptide, "counts"]).select("spectrum", *peptide, "imp", "slots", "placement")), told


#: Bits of an ion's number: m/z in millionths, charge, place, type.
MZ_BITS, Z_BITS, POS_BITS, TYPE_BITS = 39, 2, 16, 6


def ion_key() -> Column:
    """An ion's type, pos, z and m/z, rounded to six digits, as one number; its class is what stands above the m/z (``classed``)."""
    micro = F.round(F.round("mz", 6) * 1_000_000).cast("long")
    fits = (micro >= 0) & (micro < 1 << MZ_BITS) & (F.col("z") < 1 << Z_BITS) & (F.col("pos") < 1 << POS_BITS) & (F.col("type") < 1 << TYPE_BITS)
    upper = (F.col("type").cast("long") * (1 << POS_BITS) + F.col("pos")) * (1 << Z_BITS) + F.col("z")
    return F.when(fits, upper * (1 << MZ_BITS) + micro).otherwise(F.raise_error(F.concat(F.lit("an ion that has no number: "), F.col("mz").cast("string"))).cast("long"))


def classed(rows: DataFrame) -> DataFrame:
    """``rows`` with cls, type, pos and z of their ion's number."""
    cls = F.shiftright("ion", MZ_BITS)
    part = lambda low, bits: F.shiftright(cls, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return rows.select("*", cls.alias("cls"), part(Z_BITS + POS_BITS, TYPE_BITS).alias("type"), part(Z_BITS, POS_BITS).alias("pos"), part(0, Z_BITS).alias("z"))


def class_share() -> Column:
    """An ion's share of the intensity of its class, over rows of (spectrum, ion, norm)."""
    return F.col("norm") / F.nullif(F.sum("norm").over(Window.partitionBy("spectrum", F.shiftright("ion", MZ_BITS))), F.lit(0.0))


#: Forms and peaks, on average, of a part by spectrum.
PART_FORMS, PART_PEAKS = 40_000, 500_000


def deconvolve_msms(spectra: DataFrame, peaks: DataFrame, rules: list[Rule], ms1_tol: float, ms2_tol: float, **options) -> DataFrame:
    """(spectrum, imp, abundance, rank_deficient, status): the forms of each spectrum and their shares; see ``deconvolution``."""
    return deconvolution(spectra, peaks, rules, ms1_tol, ms2_tol, **options)[0]


def deconvolution(
    spectra: DataFrame, peaks: DataFrame, rules: list[Rule], ms1_tol: float, ms2_tol: float, fixed: dict[str, float] | None = None, limits: list[float] | None = None, alpha: float = 0.01, lam: float = 0.0, least: float = 0.01,
    model: str = "constant", types: tuple[int, ...] = (1, 2), fixed_names: dict[str, str] | None = None, penalty: str | None = None, grid: str = "intens_sum", weights: str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """((spectrum, imp, abundance, rank_deficient, status), (spectrum, type, pos, z, intensity, efficiency)).

    ``spectra`` as in ``candidate_forms``; ``peaks``: spectrum, mz, intensity, or
    spectrum and ``peaks``, an array of them.
    Only ions that tell forms apart count, those within ``ms2_tol`` of a peak and
    with at least ``alpha`` of the largest matched intensity.  A form whose
    matched ions are among another's drops out; one form left has abundance 1.
    ``model`` is ``constant`` (shares in a class of ions), ``equal`` (shares of
    the largest intensity) or ``variable`` (an efficiency for each class).
    ``lam`` weighs a penalty that is the same for all forms (half of it is the
    linear term), or with ``penalty`` (a mode of ``solve.form_scores``, its sums by
    ``grid``) each form's own, all of which is the linear term.  ``weights``
    (``solve.WEIGHTS``) are those of the variable model's rows, 0 where they would
    be negative.
    Abundances below ``least`` of the largest become 0.  A spectrum without a
    result has one row with its status and null form.

    The second table has the classes of ions that the variable model solved for,
    each with its summed, weighted intensity; other models have none.
    """
    if penalty is not None and model == "equal":
        raise ValueError("the model of equal efficiencies has no penalties of forms")
    if weights is not None and (model != "variable" or weights not in solve.WEIGHTS):
        raise ValueError(f"no weights {weights} in the {model} model")
    forms, told = candidate_forms(spectra, rules, ms1_tol, fixed, limits, fixed_names=fixed_names)
    # names of forms are long, and on the way a form has a row for each of its ions
    named, forms = forms.select("spectrum", F.xxhash64("imp").alias("imp"), F.col("imp").alias("_name")), forms.withColumn("imp", F.xxhash64("imp"))
    ends = tuple(c for c in ("prot_n", "prot_c") if c in spectra.columns)
    masses = {m: mass for m, _, mass in rules}
    once = forms.select("peptide", *ends, "imp", F.transform("slots", lambda s: s["site"]).alias("sites"), "placement").distinct()
    # charges that no spectrum has need no ions
    most = spectra.agg(F.max(max_fragment_charge(F.col("charge")))).first()[0] or 1
    fragments = E.fragment_ions(once.select("peptide", *ends).distinct(), list(range(1, min(max(most, 1), 3) + 1)), base_masses(F.col("peptide"), fixed), PROTON, WATER, also=ends)
    ions = E.ion_types(E.discriminating_ions(once, fragments, masses, also=ends), types)
    ions = ions.select("peptide", *ends, "imp", ion_key().alias("ion"), F.col("mz").alias("ion_mz"), "z")
    # spectra of one peptide with the same forms and charges have the same ions, which are made once
    kind = ["peptide", *ends, "_forms", "_most"]
    of_spectrum = forms.groupBy("spectrum").agg(*[F.first(c).alias(c) for c in ("peptide", *ends)], F.sort_array(F.collect_list("imp")).alias("_forms"))
    of_spectrum = stored(of_spectrum.join(spectra.select("spectrum", max_fragment_charge(F.col("charge")).alias("_most")), "spectrum"))
    owned = of_spectrum.select(*kind).distinct().withColumn("imp", F.explode("_forms")).join(ions, ["peptide", *ends, "imp"]).where("z <= _most")
    owned = owned.groupBy(*kind, "ion").agg(F.min("ion_mz").alias("ion_mz"), F.collect_list("imp").alias("imps"))
    owned = owned.groupBy(*kind).agg(F.collect_list(F.struct("ion", "ion_mz", "imps")).alias("_ions"))
    theory = of_spectrum.join(owned, kind).select("spectrum", "_ions")
    # ions and peaks move once, by spectrum, and meet there
    listed = "peaks" in peaks.columns
    n_peaks = peaks.agg(F.sum(F.size("peaks")) if listed else F.count("*")).first()[0] or 0
    parts = max(int(spectra.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-forms.count() // PART_FORMS), -(-n_peaks // PART_PEAKS))
    theory, peaks = theory.repartition(parts, "spectrum"), peaks.repartition(parts, "spectrum")
    matched = joins.band_sums(peaks.select("spectrum", F.inline("peaks")) if listed else peaks, theory.select("spectrum", F.inline("_ions")), "spectrum", "mz", "intensity", "ion_mz", ms2_tol, "raw")
    top = F.max(F.when(F.col("raw") > 0, F.col("raw"))).over(Window.partitionBy("spectrum"))
    seen = (F.col("raw") > 0) & (F.col("raw") >= alpha * F.col("_top"))
    matched = matched.withColumn("_top", top).select("spectrum", "ion", "imps", F.when(seen, F.col("raw")).alias("raw"), F.when(seen, F.col("raw") / F.col("_top")).alias("norm"))
    # (spectrum, ion, imps, raw, norm): the forms that have an ion, and its intensity, null where nothing matches it
    matched = stored(matched)
    observed = matched.where("norm is not null")
    hit = observed.select("spectrum", F.explode("imps").alias("imp"), "ion")
    left = joins.drop_dominated(hit, "spectrum", "imp", "ion")
    left = stored(left.withColumn("_left", F.count("*").over(Window.partitionBy("spectrum"))))
    some = left.where("_left > 1").groupBy("spectrum").agg(F.collect_list("imp").alias("_some"))
    whole = matched.join(some, "spectrum")
    # the rows of the design: what is left of an ion's forms
    rows = whole.withColumn("y", F.coalesce(class_share() if model == "constant" else F.col("norm"), F.lit(0.0))).withColumn("imps", F.array_intersect("imps", "_some")).where("size(imps) > 0")
    own = None
    if penalty is not None:
        kind = F.concat_ws("/", "type", "z")
        met = classed(rows.where("norm is not null").select("spectrum", F.explode("imps").alias("imp"), "ion", "norm", "raw")).withColumn("kind", kind)
        every = classed(whole.select("spectrum", "ion")).select("spectrum", kind.alias("kind"), "pos")
        scores = solve.form_scores(met, ["spectrum"], "imp", penalty, "ion", "kind", "type", "pos", "norm", "raw", grid, every)
        # the solver halves what it is given
        own = stored(solve.penalty(scores, ["spectrum"], "score", 2.0).select("spectrum", "imp", "penalty"))
    parts = None
    if model == "variable":
        observed, each = observed.select("spectrum", "ion", "raw", "norm"), classed(whole.select("spectrum", "ion"))
        weighed = None if weights is None else stored(solve.row_weights(each, observed, "spectrum", "ion", "cls", "norm", "raw", weights).withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))))
        design = classed(rows.select("spectrum", F.explode("imps").alias("imp"), "ion"))
        solved, inverse = solve.variable_efficiency(design, design.select("spectrum", "ion", "cls").distinct(), observed, "spectrum", "ion", "imp", "cls", "norm", lam, own, weights=weighed)
        sums = design.select("spectrum", "ion", "cls", "type", "pos", "z").distinct().join(observed.select("spectrum", "ion", "norm"), ["spectrum", "ion"])
        if weighed is not None:
            sums = sums.join(weighed, ["spectrum", "ion"]).withColumn("norm", F.col("norm") * F.sqrt("weight"))
        parts = sums.groupBy("spectrum", "cls", "type", "pos", "z").agg(F.sum("norm").alias("intensity")).join(inverse, ["spectrum", "cls"]).drop("cls")
    else:
        entries = F.transform("imps", lambda i: F.struct(i.alias("i"), F.lit(1.0).alias("v")))
        solved = solve.estimate_rows(rows.select("spectrum", entries.alias("_all"), F.col("y").alias("_aim")), "spectrum", "imp", lam, own)
    solved = stored(solved.select("spectrum", "imp", "abundance", "rank_deficient"))
    cut = filters.abundance_cut(solved.select("spectrum", "imp", F.col("abundance").alias("_a"), "rank_deficient"), ["spectrum"], "_a", least)
    many = cut.where("abundance > 0").select("spectrum", "imp", "abundance", "rank_deficient")
    one = lambda rows: rows.select("spectrum", "imp", F.lit(1.0).alias("abundance"), F.lit(False).alias("rank_deficient"))
    lone = left.where("_left = 1")
    # a spectrum's only candidate needs no ion
    only = forms.groupBy("spectrum").agg(F.count("*").alias("_n"), F.first("imp").alias("imp")).where("_n = 1").join(left.select("spectrum").distinct(), "spectrum", "left_anti")
    got = many.unionByName(one(lone)).unionByName(one(only))
    got = got.join(named, ["spectrum", "imp"]).select("spectrum", F.col("_name").alias("imp"), "abundance", "rank_deficient")
    failed = told.withColumn("status", F.when(F.col("status") == "ok", "failed").otherwise(F.col("status")))
    rest = failed.join(got, "spectrum", "left_anti").select("spectrum", F.lit(None).cast("string").alias("imp"), F.lit(None).cast("double").alias("abundance"), F.lit(None).cast("boolean").alias("rank_deficient"), "status")
    return got.withColumn("status", F.lit("ok")).unionByName(rest), parts
