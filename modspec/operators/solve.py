"""Match sums, penalties, design terms and the bounded estimation of abundances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


EPS = 2.220446049250313e-16


#: The penalty of a form whose score is 0 beside one whose score isn't.
BARRED = 1e30


def penalty(scored: DataFrame, keys: list[str], score: str, lam: float, name: str = "penalty") -> DataFrame:
    """penalty = lam * (1 / score) / min(1 / score) over the group; BARRED where the score is 0, lam where all of them are."""
    inverse = 1 / F.nullif(F.col(score), F.lit(0.0))
    least = F.min(inverse).over(Window.partitionBy(*keys))
    return scored.withColumn(name, F.when(inverse.isNotNull(), lam * inverse / least).when(least.isNotNull(), BARRED).otherwise(float(lam)))


def sdp_scores(matches: DataFrame, keys: list[str], imp: str, norm: str, raw: str) -> DataFrame:
    """Four sums per form: of normalised, log raw, root raw and exp normalised intensities."""
    return matches.groupBy(*keys, imp).agg(F.sum(norm).alias("s_norm"), F.sum(F.log(raw)).alias("s_log"), F.sum(F.sqrt(raw)).alias("s_sqrt"), F.sum(F.exp(norm)).alias("s_exp"))


def ksdp_scores(matches: DataFrame, keys: list[str], imp: str, kind: str, pos: str, value: str, window: int = 2, gamma: float = 0.9, theory: DataFrame | None = None) -> DataFrame:
    """Ladder-aware score: intensities times the root of the summed exp(-gamma * misses in a window) over the grid kind x place, by its cells.

    The grid has the kinds and places of ``theory`` (keys, kind, pos), all
    theoretical ions of the group, matched or not; without it those of the
    matches alone.
    """
    every = matches if theory is None else theory
    kinds = every.select(*keys, kind).distinct()
    places = every.select(*keys, pos).distinct()
    imps = matches.groupBy(*keys, imp).agg(F.sum(value).alias("_sum"))
    hits = matches.select(*keys, imp, kind, pos).distinct().withColumn("_hit", F.lit(1))
    grid = imps.join(kinds, keys).join(places, keys).join(hits, [*keys, imp, kind, pos], "left")  # a spectrum's grid is small
    near = Window.partitionBy(*keys, imp, kind).orderBy(pos).rowsBetween(-window, window)
    missed = grid.withColumn("_miss", F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).over(near))
    kernel = missed.groupBy(*keys, imp).agg(F.sum(F.exp(-gamma * F.col("_miss"))).alias("_kernel"), F.count("*").alias("_cells"), F.first("_sum").alias("_sum"))
    return kernel.select(*keys, imp, (F.col("_sum") * F.sqrt("_kernel") / F.col("_cells")).alias("score"))


def hyperscores(matches: DataFrame, keys: list[str], imp: str, is_b: Column, raw: str) -> DataFrame:
    """log10 of the factorials of b and y counts plus the natural logs of their intensity sums, each term only where there is a match.

    An intensity below 1, and more than 1000 matches of a series, are errors.
    """
    return matches.groupBy(*keys, imp).agg(*_series_sums(is_b, ~is_b, raw)).select(*keys, imp, _hyperscore().alias("score"))


def _series_sums(is_b: Column, is_y: Column, raw: str) -> list[Column]:
    """Aggregates that ``_hyperscore`` takes: counts and sums of b and y matches, their least intensity."""
    value = F.col(raw)
    return [F.count_if(is_b).alias("_nb"), F.count_if(is_y).alias("_ny"), F.sum(F.when(is_b, value)).alias("_ib"), F.sum(F.when(is_y, value)).alias("_iy"), F.min(F.when(is_b | is_y, value)).alias("_least")]


def _hyperscore() -> Column:
    """The hyperscore from ``_series_sums``."""
    fine = F.when(F.col("_least") < 1, F.raise_error(F.lit("an intensity below 1")).cast("int")).when(F.greatest("_nb", "_ny") > 1000, F.raise_error(F.lit("more than 1000 ions of a series")).cast("int")).otherwise(0)
    fact = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + F.log10(i))
    term = lambda n, s: F.when(F.col(n) > 0, fact(F.col(n)) + F.log(s)).otherwise(0.0)
    return term("_nb", "_ib") + term("_ny", "_iy") + fine


#: Scores that penalties come from: four sums over a form's matches, four with the ladder (the first names how its
#: intensities are summed, see GRIDS), and the hyperscore.
SUMS = {"intens_sum": "s_norm", "log_intens_sum": "s_log", "sqrt_intens_sum": "s_sqrt", "exp_intens_sum": "s_exp"}
LADDERS = ("log_intens_ksdp", "sqrt_intens_ksdp", "exp_intens_ksdp", "sqrt_intens_ksdp_sqrt")
HYPERSCORE = "intens_hyperscore"
GRIDS = ("intens_sum", "log_intens_sum", "sqrt_intens_sum", "exp_intens_sum")


def form_scores(matches: DataFrame, keys: list[str], imp: str, mode: str, ion: str, kind: str, series: str, pos: str, norm: str, raw: str, grid: str = "intens_sum", theory: DataFrame | None = None) -> DataFrame:
    """(keys, imp, score) of every form with a match, by one of the nine modes.

    ``matches`` has a row for each form and matched ion: the ion, its kind (type
    and charge together), series (1 for b, 2 for y, others for neither), place,
    normalised and raw intensity.  ``theory`` (keys, kind, pos) are all ions.  The three first ladder modes only differ in
    their names, ``grid`` says how their normalised intensities are summed;
    ``sqrt_intens_ksdp_sqrt`` is the root of the score.  Summing exponentials,
    each match of the group that isn't the form's own counts 1, as exp(0);
    summing logarithms, it counts nothing.  The hyperscore counts b and y ions
    only, a form without any has the score 0.
    """
    return mode_scores(matches, keys, imp, {"score": (mode, grid)}, ion, kind, series, pos, norm, raw, theory)


def _kernel(window: int = 2, gamma: float = 0.9) -> Column:
    """Sum over the cells _kinds x _places of exp(-gamma * cells without one of _hits near in place), as in ``ksdp_scores``."""
    n = F.size("_places")

    def of_kind(k: Column) -> Column:
        own = F.transform(F.filter("_hits", lambda h: h["kind"] == k), lambda h: h["pos"])
        missed = F.transform("_places", lambda x: F.when(F.array_contains(own, x), 0).otherwise(1))
        begin = lambda i: F.greatest(i - window, F.lit(1))
        near = lambda i: F.slice(missed, begin(i), F.least(i + window, n) - begin(i) + 1)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + F.exp(-gamma * F.aggregate(near(i), F.lit(0), lambda s, x: s + x)))

    return F.aggregate("_kinds", F.lit(0.0), lambda acc, k: acc + of_kind(k))


def mode_scores(matches: DataFrame, keys: list[str], imp: str, modes: dict[str, tuple[str, str]], ion: str, kind: str, series: str, pos: str, norm: str, raw: str, theory: DataFrame | None = None) -> DataFrame:
    """(keys, imp and a score for each of ``modes``: name to mode and sum of a ladder's intensities), see ``form_scores``.

    All come from one aggregate of each form and one of each group, so matches
    that lie by ``keys`` stay where they are.
    """
    for mode, grid in modes.values():
        if mode not in (*SUMS, *LADDERS, HYPERSCORE):
            raise ValueError(f"unknown penalty {mode}")
        if mode in LADDERS and grid not in GRIDS:
            raise ValueError(f"unknown sum of intensities {grid}")
        if mode == "sqrt_intens_ksdp_sqrt" and grid == "log_intens_sum":
            raise ValueError("sums of logarithms are negative and have no root")
    value = {"log_intens_sum": F.log(norm), "sqrt_intens_sum": F.sqrt(norm), "exp_intens_sum": F.exp(norm), "intens_sum": F.col(norm)}
    used = {mode for mode, _ in modes.values()}
    grids = {grid for mode, grid in modes.values() if mode in LADDERS}
    sums = {"intens_sum": F.col(norm), "log_intens_sum": F.log(raw), "sqrt_intens_sum": F.sqrt(raw), "exp_intens_sum": F.exp(norm)}
    parts = [F.count("*").alias("_n")] + [F.sum(sums[m]).alias(f"_{SUMS[m]}") for m in sums if m in used] + [F.sum(value[g]).alias(f"_g_{g}") for g in sorted(grids)]
    if grids:
        parts.append(F.collect_set(F.struct(F.col(kind).alias("kind"), F.col(pos).alias("pos"))).alias("_hits"))
    if HYPERSCORE in used:
        is_b, is_y = (F.coalesce(F.col(series) == k, F.lit(False)) for k in (1, 2))
        parts += _series_sums(is_b, is_y, raw)
    forms = matches.groupBy(*keys, imp).agg(*parts)
    if grids:
        every = matches if theory is None else theory
        forms = forms.join(every.groupBy(*keys).agg(F.collect_set(kind).alias("_kinds"), F.sort_array(F.collect_set(pos)).alias("_places")), keys)
        forms = forms.withColumn("_root", F.sqrt(_kernel()) / (F.size("_kinds") * F.size("_places")))
    if "exp_intens_sum" in grids:
        # each match of the group that isn't the form's own counts exp(0)
        forms = forms.join(matches.groupBy(*keys).agg(F.countDistinct(ion).alias("_every")), keys).withColumn("_g_exp_intens_sum", F.col("_g_exp_intens_sum") + F.col("_every") - F.col("_n"))

    def score(mode: str, grid: str) -> Column:
        if mode in SUMS:
            return F.col(f"_{SUMS[mode]}")
        if mode == HYPERSCORE:
            return _hyperscore()
        ladder = F.col(f"_g_{grid}") * F.col("_root")
        return F.sqrt(ladder) if mode == "sqrt_intens_ksdp_sqrt" else ladder

    return forms.select(*keys, imp, *[score(*m).alias(n) for n, m in modes.items()])


def gram_matrix(terms: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """(keys, i, j, h): X'X of sparse rows (keys, row, col, value), i <= j.

    A row's entries are gathered and paired there, so terms that lie by ``keys`` stay where they are.
    """
    gathered = terms.dropna(subset=[*keys, row]).groupBy(*keys, row).agg(F.collect_list(F.struct(F.col(col).alias("i"), F.col(value).alias("v"))).alias("_all"))
    one = gathered.select(*keys, "_all", F.explode("_all").alias("_a"))
    pair = one.select(*keys, "_a", F.explode(F.filter("_all", lambda b: F.col("_a.i") <= b["i"])).alias("_b"))
    return pair.groupBy(*keys, F.col("_a.i").alias("i"), F.col("_b.i").alias("j")).agg(F.sum(F.col("_a.v") * F.col("_b.v")).alias("h"))


#: Row weights of the design: from the ion itself, or as one mean for its class.
WEIGHTS = ("self", "class", "observed", "log", "sqrt")


def row_weights(ions: DataFrame, observed: DataFrame, key: str, ion: str, cls: str, norm: str, raw: str, mode: str) -> DataFrame:
    """(key, ion, weight) for the squares of the design's rows; classes that nothing matches have none.

    ``ions`` (key, ion, cls) are all theoretical ions, ``observed`` (key, ion,
    norm, raw) the matched ones.  "self" takes an ion's normalised intensity (1
    where it is 0 or missing), the others one mean for each class: of normalised
    intensities over all its ions ("class") or the matched ones ("observed"), of
    log or root raw intensities, as shares of the spectrum's largest, over all.
    """
    rows = ions.join(observed.select(key, ion, F.col(norm).alias("_norm"), F.col(raw).alias("_raw")), [key, ion], "left")
    seen = F.count("_norm").over(Window.partitionBy(key, cls)) > 0
    if mode == "self":
        value = F.coalesce(F.nullif(F.col("_norm"), F.lit(0.0)), F.lit(1.0))
    else:
        scaled = {"log": F.log("_raw"), "sqrt": F.sqrt("_raw")}.get(mode)
        each = F.col("_norm") if scaled is None else scaled / F.nullif(F.max(scaled).over(Window.partitionBy(key)), F.lit(0.0))
        rows = rows.withColumn("_each", each)
        whole = Window.partitionBy(key, cls)
        value = F.sum("_each").over(whole) / F.count("_norm" if mode == "observed" else F.lit(1)).over(whole)
    return rows.withColumn("weight", value).withColumn("_seen", seen).where("_seen").select(key, ion, "weight")


def class_shares(observed: DataFrame, classes: DataFrame, key: str, ion: str, cls: str, norm: str) -> DataFrame:
    """(key, ion, y): each matched ion's share of its class, the right side of constant efficiencies."""
    rows = observed.join(classes.select(key, ion, cls), [key, ion])
    return rows.select(key, ion, F.coalesce(F.col(norm) / F.nullif(F.sum(norm).over(Window.partitionBy(key, cls)), F.lit(0.0)), F.lit(0.0)).alias("y"))


def variable_efficiency(incidence: DataFrame, ions: DataFrame, observed: DataFrame, key: str, ion: str, imp: str, cls: str, norm: str, lam: float = 0.0, penalties: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """((key, imp, abundance, kkt, rank_deficient), (key, cls, efficiency)): abundances with an efficiency of each ion class.

    The design has, beside the forms of an ion (``incidence``: key, ion, imp), a
    column for each matched class with minus the ion's intensity; its unknowns,
    inverse efficiencies, are 1 at least, those of forms 0; the right side is 0.
    Rows of classes that nothing matches are left out.  Efficiencies are scaled
    to a largest of 1; the penalty is on forms only, ``lam`` times 1 or times a
    form's own in ``penalties`` (key, imp, penalty).
    """
    rows = ions.select(key, ion, cls).join(observed.select(key, ion, F.col(norm).alias("_norm")), [key, ion], "left")
    rows = rows.withColumn("_seen", F.coalesce(F.sum("_norm").over(Window.partitionBy(key, cls)), F.lit(0.0)) > 0).where("_seen")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("_col")
    forms = incidence.select(key, ion, name("f", imp)).distinct().join(rows.select(key, ion), [key, ion]).withColumn("_x", F.lit(1.0))
    classes = rows.where("_norm > 0").select(key, ion, name("c", cls), (-F.col("_norm")).alias("_x"))
    zeros = rows.select(key, ion, F.lit(0.0).alias("_y"))
    lows = classes.select(key, "_col").distinct().withColumn("low", F.lit(1.0))
    penalties = forms.select(key, "_col").distinct().withColumn("penalty", F.lit(1.0)) if penalties is None else penalties.select(key, name("f", imp), "penalty")
    got = estimate_abundance(forms.unionByName(classes), zeros, key, ion, "_col", "_x", "_y", lam, penalties, lows=lows, **options)
    kinds = dict(incidence.dtypes)
    imps = got.where("_col like 'f%'").select(key, F.substring("_col", 2, 1000).cast(kinds[imp]).alias(imp), "abundance", "kkt", "rank_deficient")
    inverse = got.where("_col like 'c%'").select(key, F.substring("_col", 2, 1000).cast(dict(ions.dtypes)[cls]).alias(cls), (1 / F.col("abundance")).alias("_e"))
    return imps, inverse.select(key, cls, (F.col("_e") / F.max("_e").over(Window.partitionBy(key))).alias("efficiency"))


#: Outcomes of ``active_set``.
SOLVED, STOPPED = "ok", "not converged"


def active_set(h: np.ndarray, f: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """min x'Hx/2 + f'x over x >= low (0 if not given) of many systems at once: ``h`` is (systems, n, n), positive semidefinite, ``f`` and ``low`` (systems, n).

    Returns x, the scaled residual of the optimality conditions and whether it
    is within rounding.  Unknowns become free one at a time, the one with the
    steepest descent first; the free ones are solved for by a Cholesky factor of
    their part of H, scaled to a unit diagonal; a step stops where one of them
    would leave its bound, which then is fixed again.  All systems of a call go
    in step; those that are done are left out.  The residual of an unknown is
    its gradient over what rounding leaves of the terms that it sums.
    """
    if low is not None:
        x, residual, fine = active_set(h, f + np.einsum("bij,bj->bi", h, low))
        return low + x, residual, fine
    n_systems, n = f.shape
    diag = np.einsum("bii->bi", h)
    scale = np.where(diag > 0, 1 / np.sqrt(np.where(diag > 0, diag, 1)), 0.0)
    hs, fs = h * scale[:, :, None] * scale[:, None, :], f * scale
    size = np.abs(hs)
    x, free = np.zeros(f.shape), np.zeros(f.shape, bool)
    barred = scale == 0  # an unknown without a term stays at its bound
    on = np.arange(n_systems)
    noise = lambda rows, y: 64 * n * EPS * (np.einsum("bij,bj->bi", size[rows], np.abs(y)) + np.abs(fs[rows]))
    for _ in range(12 * n + 24):
        descent = -(np.einsum("bij,bj->bi", hs[on], x[on]) + fs[on])
        open_ = ~free[on] & ~barred[on] & (descent > noise(on, x[on]))
        some = open_.any(1)
        on, descent, open_ = on[some], descent[some], open_[some]
        if not len(on):
            break
        new = np.where(open_, descent, -np.inf).argmax(1)
        free[on, new] = True
        rows = on
        for turn in range(n + 1):
            z = _free_solution(hs[rows], fs[rows], free[rows])
            back = free[rows] & (z <= 0)
            if turn == 0:  # rounding says that the new one can't grow: it stays out until another one has moved
                useless = back[np.arange(len(rows)), new]
                free[rows[useless], new[useless]] = False
                barred[rows[useless], new[useless]] = True
                rows, z, back = rows[~useless], z[~useless], back[~useless]
            inside = ~back.any(1)
            x[rows[inside]] = np.where(free[rows[inside]], z[inside], 0.0)
            barred[rows[inside]] = scale[rows[inside]] == 0
            rows, z, back = rows[~inside], z[~inside], back[~inside]
            if not len(rows):
                break
            now = x[rows]
            part = np.where(back, now / np.where(back, now - z, 1.0), np.inf)
            step = part.min(1)
            x[rows] = np.where(free[rows], now + step[:, None] * (z - now), 0.0)
            leaves = back & (part <= step[:, None] * (1 + 1e-12))
            free[rows] &= ~leaves
            x[rows] = np.where(leaves, 0.0, np.maximum(x[rows], 0.0))
    every = np.arange(n_systems)
    gradient = np.einsum("bij,bj->bi", hs, x) + fs
    off = np.where(free, np.abs(gradient), np.maximum(-gradient, 0)) * (scale > 0)
    residual = (off / np.maximum(noise(every, x), 1e-300)).max(1, initial=0.0)
    return x * scale, residual, residual <= 16.0


def _free_solution(h: np.ndarray, f: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Solutions of the systems' free parts; a hair on the diagonal keeps singular ones apart, and two refinements take it back from the others."""
    both = free[:, :, None] & free[:, None, :]
    part = np.where(both, h, 0.0)
    one = np.eye(f.shape[1])
    factor = np.linalg.cholesky(part + one * (np.where(free, 1e-13, 1.0)[:, :, None]))
    right = np.where(free, -f, 0.0)
    solve = lambda r: np.linalg.solve(factor.transpose(0, 2, 1), np.linalg.solve(factor, r[:, :, None]))[:, :, 0]
    z = solve(right)
    for _ in range(2):
        z = z + solve(right - np.einsum("bij,bj->bi", part, z))
    return z


def estimate_abundance(terms: DataFrame, targets: DataFrame, key: str, row: str, col: str, value: str, target: str, lam: float = 0.0, penalties: DataFrame | None = None, weights: DataFrame | None = None, lows: DataFrame | None = None) -> DataFrame:
    """(key, col, abundance, xy, kkt, rank_deficient, status) of each spectrum: min |Xw - y|^2 / 2 + sum of penalties * w / 2, w >= 0.

    ``terms`` are the entries of X, ``targets`` (key, row, target) y.  The
    penalty of a form is ``lam``, or ``lam`` times its own in ``penalties``
    (key, col, penalty); ``weights`` (key, row, weight) multiply the squares of
    the rows; ``lows`` (key, col, low) are least values other than 0, of columns
    that keep their value and don't count as forms.  H and X'y come from Spark aggregates; a spectrum's system is one
    row, and a task solves the systems of a batch together, by their size.
    Abundances within 1e-8 of 0 are 0, the others sum to 1.  ``status`` says
    whether the optimality conditions hold up to rounding ("ok") or not ("not
    converged"); ``kkt`` is how far the gradient is from them.  A row without a
    target has the target 0.
    """
    if weights is not None:
        root = weights.select(key, row, F.sqrt("weight").alias("_root"))
        terms = terms.join(root, [key, row]).withColumn(value, F.col(value) * F.col("_root")).drop("_root")
        targets = targets.join(root, [key, row]).withColumn(target, F.col(target) * F.col("_root")).drop("_root")
    kind, aims = dict(terms.dtypes), dict(targets.dtypes)
    entry = F.struct(F.col(col).alias("i"), F.col(value).alias("v"))
    none = lambda like: F.lit(None).cast(like)
    entries = terms.select(key, row, entry.alias("_entry"), none(aims[target]).alias("_aim"))
    right = targets.select(key, row, none(f"struct<i:{kind[col]},v:{kind[value]}>").alias("_entry"), F.col(target).alias("_aim"))
    # terms and targets that lie by spectrum stay there; all that follows is by spectrum too
    both = entries.unionByName(right).dropna(subset=[key, row])
    gathered = both.groupBy(key, row).agg(F.collect_list("_entry").alias("_all"), F.coalesce(F.sum("_aim"), F.lit(0.0)).alias("_aim"))
    return estimate_rows(gathered, key, col, lam, penalties, lows)


def estimate_rows(gathered: DataFrame, key: str, col: str, lam: float = 0.0, penalties: DataFrame | None = None, lows: DataFrame | None = None) -> DataFrame:
    """``estimate_abundance`` from the rows of X and y: key, _all (an array of the entries (i, v) of a row, i the column), _aim; those that lie by ``key`` stay where they are."""
    kinds, of_col = dict(gathered.dtypes), gathered.schema["_all"].dataType.elementType["i"].dataType.simpleString()
    # products of a row's entries (one of each pair), and of each entry and the right side, are summed in one pass
    one = gathered.select(key, "_all", "_aim", F.explode("_all").alias("_a"))
    term = lambda h, j, v: F.struct(F.lit(h).alias("h"), F.col("_a.i").alias("i"), j.alias("j"), (F.col("_a.v") * v).cast("double").alias("v"))
    pairs = F.transform(F.filter("_all", lambda b: F.col("_a.i") <= b["i"]), lambda b: term(True, b["i"], b["v"]))
    summed = one.select(key, F.inline(F.concat(pairs, F.array(term(False, F.col("_a.i"), F.col("_aim")))))).groupBy(key, "h", "i", "j").agg(F.sum("v").alias("v"))
    xy = summed.groupBy(key).agg(F.collect_list(F.when(F.col("h"), F.struct("i", "j", "v"))).alias("h"), F.sort_array(F.collect_list(F.when(~F.col("h"), F.struct("i", "v")))).alias("xy"))
    of_form = {}
    for name, own, given in (("p", penalties, "penalty"), ("low", lows, "low")):
        of_form[name] = lambda i: F.lit(0.0)
        if own is not None:
            listed = own.dropna(subset=[key, col]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(col), F.col(given).cast("double")))).alias(f"_{name}"))
            xy = xy.join(listed, key, "left")
            of_form[name] = lambda i, at=f"_{name}": F.coalesce(F.try_element_at(F.col(at), i), F.lit(0.0))
    weight = (lambda i: F.lit(float(lam))) if penalties is None else (lambda i: lam * of_form["p"](i))
    xy = xy.select(key, "h", F.transform("xy", lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v"), weight(e["i"]).alias("p"), of_form["low"](e["i"]).alias("low"))).alias("xy"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            forms, pairs = batch.column("xy"), batch.column("h")
            sizes, filled = (pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (forms, pairs))
            begin = np.cumsum(sizes) - sizes
            names, right, extra, least = (forms.flatten().field(k) for k in ("i", "v", "p", "low"))
            right, extra, least = (c.to_numpy(zero_copy_only=False) for c in (right, extra, least))
            # each pair's places in its spectrum's list of forms
            coded = names.dictionary_encode(null_encoding="encode")
            code, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            owner = np.repeat(np.arange(len(sizes)), filled)
            by = np.repeat(np.arange(len(sizes)), sizes) * width + code
            order = np.argsort(by)
            entry = pairs.flatten()
            place = lambda c: order[np.searchsorted(by[order], owner * width + pc.index_in(c, value_set=coded.dictionary).to_numpy(zero_copy_only=False))] - begin[owner]
            row_at, col_at, value_at = place(entry.field("i")), place(entry.field("j")), entry.field("v").to_numpy(zero_copy_only=False)
            slot = np.zeros(len(sizes), np.int64)
            for n in np.unique(sizes):
                some = np.flatnonzero(sizes == n)
                slot[some] = np.arange(len(some))
                mine = sizes[owner] == n
                m, at = np.zeros((len(some), n, n)), slot[owner[mine]]
                m[at, row_at[mine], col_at[mine]] = m[at, col_at[mine], row_at[mine]] = value_at[mine]
                spots = begin[some][:, None] + np.arange(n)
                b, low = right[spots], least[spots]
                f = extra[spots] / 2 - b
                x, _, fine = active_set(m, f, low)
                grad = np.einsum("bij,bj->bi", m, x) + f
                kkt = np.maximum(np.abs(np.minimum(grad, 0)).max(1), np.abs(grad * (x - low)).max(1))
                x[np.abs(x) <= 1e-8] = 0
                form = low == 0
                whole = np.where(form, (x * form).sum(1, keepdims=True), 1.0)
                deficient = np.linalg.matrix_rank(m, hermitian=True) < n
                columns = [batch.column(key).take(pa.array(np.repeat(some, n))), names.take(pa.array(spots.ravel())), (x / np.where(whole == 0, 1, whole)).ravel(), b.ravel(), np.repeat(kkt, n), np.repeat(deficient, n), np.repeat(np.where(fine, SOLVED, STOPPED), n).astype(object)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[key, col, "abundance", "xy", "kkt", "rank_deficient", "status"])

    return xy.mapInArrow(solve, f"{key} {kinds[key]}, {col} {of_col}, abundance double, xy double, kkt double, rank_deficient boolean, status string")


def fragment_matrix(rows: DataFrame, ion: list[str], spectrum: str, spectra: list[str], value: str) -> DataFrame:
    """Ion by spectrum: a row an ion and a column a spectrum, of intensities or of efficiencies; 0 where nothing was seen."""
    return rows.groupBy(*ion).pivot(spectrum, spectra).agg(F.sum(value)).fillna(0.0, subset=list(spectra))
