"""Column functions: masses, tolerances, titles, sequence strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from modspec.functions.constants import PROTON, RESIDUES, WATER


def strip_tokens(text: Column, tokens: tuple[str, ...]) -> Column:
    """Removes each token literally, in order."""
    return reduce(lambda c, t: F.replace(c, F.lit(t), F.lit("")), tokens, text)


def neutral_mass(mz: Column, charge: Column) -> Column:
    return (mz - PROTON) * charge


def mz_of(mass: Column, charge: Column) -> Column:
    return (mass + charge * PROTON) / charge


def tolerance_da(center: Column, tol: float, is_ppm: bool, cap: float | None = None) -> Column:
    """Half-width in Da of a tolerance at ``center``."""
    width = center * tol * 1e-6 if is_ppm else F.lit(float(tol))
    return width if cap is None else F.least(width, F.lit(cap))


def scan_of_title(title: Column) -> Column:
    """The second dot token, or what follows a colon where there is no dot; null unless numeric."""
    token = F.when(F.contains(title, F.lit(".")), F.get(F.split(title, r"\."), F.lit(1))).otherwise(F.get(F.split(title, ":"), F.lit(1)))
    return F.try_to_number(F.trim(token), F.lit("9999999999")).cast("long")


#: The escapes of a title.
ESCAPES = {"%2e": ".", "%20": " ", "%3a": ":", "%3d": "=", "%22": '"', "%2c": ",", "%2d": "-"}


def decode_title(title: Column) -> Column:
    """A title with its escapes as characters."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES.items(), title)


def render_top1(sequence: Column, names: Column, places: Column) -> Column:
    """Letters with ``{name}``, each name up to its first blank, put in at 0-based ``places``; ``names`` run in parallel."""
    short = F.transform(F.arrays_zip(places.alias("p"), names.alias("n")), lambda x: F.struct(x["p"].alias("p"), F.substring_index(x["n"], " ", 1).alias("n")))
    put = lambda acc, x: F.concat(F.substr(acc, F.lit(1), x["p"]), F.lit("{"), x["n"], F.lit("}"), F.substr(acc, x["p"] + 1))
    # from the right, so that places left of it stay
    return F.aggregate(F.reverse(F.array_sort(short)), sequence, put)


def baseline_of(values: Column, step: float = 0.08, least: int = 100) -> Column:
    """Baseline of one spectrum's positive intensities: 10 ^ centre of the fullest bin of their log10, the first on ties; 0 for ``least`` values or fewer.

    Centres begin at the least value, in steps; one pass over the sorted array.
    """
    logs = F.sort_array(F.transform(values, lambda v: F.log10(v)))
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    start = F.struct(F.get(logs, F.lit(0)).alias("lo"), F.element_at(logs, -1).alias("hi"), none.alias("bin"), zero.alias("n"), none.alias("best"), zero.alias("most"))

    def put(acc: Column, x: Column) -> Column:
        at = F.least(F.floor((x - acc["lo"]) / step + 0.5), F.floor((acc["hi"] - acc["lo"]) / step + 1e-9)).cast("long")
        n = F.when(at == acc["bin"], acc["n"] + 1).otherwise(F.lit(1).cast("long"))
        more = n > acc["most"]
        return F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"), at.alias("bin"), n.alias("n"), F.when(more, at).otherwise(acc["best"]).alias("best"), F.when(more, n).otherwise(acc["most"]).alias("most"))

    centre = F.aggregate(logs, start, put, lambda acc: F.pow(F.lit(10.0), acc["lo"] + acc["best"] * step))
    return F.when(F.size(values) > least, centre).otherwise(0.0)


def max_fragment_charge(charge: Column) -> Column:
    return F.when(charge <= 2, 1).when(charge == 3, 2).otherwise(3)


def fragmentation_code(activation: Column, instrument: Column) -> Column:
    """(activation - 1) * 2 + instrument, with CID, ETD, HCD as 1 to 3 and IT, FT as 1, 2."""
    act = F.create_map(*[F.lit(x) for p in (("CID", 1), ("ETD", 2), ("HCD", 3)) for x in p])
    ins = F.create_map(*[F.lit(x) for p in (("IT", 1), ("FT", 2)) for x in p])
    return (F.try_element_at(act, activation) - 1) * 2 + F.try_element_at(ins, instrument)


def residue_sum(sequence: Column) -> Column:
    """Sum of residue masses; letters that aren't residues count 0."""
    masses = F.create_map(*[F.lit(x) for p in RESIDUES.items() for x in p])
    return F.aggregate(F.split(sequence, ""), F.lit(0.0), lambda acc, r: acc + F.coalesce(F.try_element_at(masses, r), F.lit(0.0)))


def peptide_mass(sequence: Column) -> Column:
    return residue_sum(sequence) + WATER


def imp_mass(imp: Column, mods: dict[str, float]) -> Column:
    """Mass of a form ``_AB{Mod}C_``; an unknown modification raises an error."""
    table = F.create_map(*[F.lit(x) for p in mods.items() for x in p])
    names = F.regexp_extract_all(imp, F.lit(r"\{([^}]*)\}"), F.lit(1))
    shift = F.aggregate(names, F.lit(0.0), lambda acc, m: acc + F.coalesce(F.try_element_at(table, m), F.raise_error(F.concat(F.lit("unknown modification "), m)).cast("double")))
    return peptide_mass(F.replace(F.regexp_replace(imp, r"\{[^}]*\}", ""), F.lit("_"), F.lit(""))) + shift


def render_imp(sequence: Column, sites: Column, names: Column) -> Column:
    """``_`` + letters with ``{name}`` after each 1-based site (0: before the first) + ``_``, behind which the names of the
    C-terminus (length + 1) stand; at one site in the order given; ``sites`` and ``names`` run in parallel."""
    at = lambda i: F.array_join(F.transform(F.filter(F.arrays_zip(sites.alias("s"), names.alias("n")), lambda x: x["s"] == i), lambda x: F.concat(F.lit("{"), x["n"], F.lit("}"))), "")
    letters = F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.concat(F.substr(sequence, i, F.lit(1)), at(i)))
    return F.concat(F.lit("_"), at(F.lit(0)), F.array_join(letters, ""), F.lit("_"), at(F.length(sequence) + 1))


def accurate_mz(center: Column, mono: Column, charge: Column, spacing: float, tol: float, low: int = -1, high: int = 8) -> Column:
    """Of mono + k * spacing / charge the one nearest to ``center`` within ``tol``, else ``center``."""
    tries = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.struct(F.abs(mono + k * spacing / charge - center).alias("d"), (mono + k * spacing / charge).alias("mz")))
    best = F.array_min(tries)
    return F.when(best["d"] <= tol, best["mz"]).otherwise(center)
