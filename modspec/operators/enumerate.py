"""Placements of modifications on peptides: specifications, compositions, arrangements.

Everything is done once per distinct peptide, with array functions; whatever
could blow up is counted in closed form before rows are made.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Caps of the method: sites of one specificity, and candidates of one peptide and mass.
MAX_SITES = 10
MAX_CANDIDATES = 5000


def parse_mod_spec(specs: DataFrame, spec: str, mods: DataFrame) -> DataFrame:
    """(ord, mod, specificity, alias, full_name, mono_mass) for each ``Name[Spec]`` or ``Name[Spec](Alias[Spec])`` of a ``;`` list.

    ``mods``: full_name, mono_mass.  Names may hold parentheses.  More than two
    brackets in an entry are an error.
    """
    one = specs.select("*", F.posexplode(F.split(spec, ";")).alias("ord", "entry")).withColumn("entry", F.trim("entry")).where("entry <> ''")
    brackets = F.size(F.split("entry", r"\[")) - 1
    checked = one.withColumn("entry", F.when(brackets > 2, F.raise_error(F.concat(F.lit("bad modification "), "entry")).cast("string")).otherwise(F.col("entry")))
    name, where = F.regexp_extract("entry", r"^([^\[]+)\[", 1), F.regexp_extract("entry", r"^[^\[]+\[([^\]]*)\]", 1)
    alias = F.nullif(F.regexp_extract("entry", r"\]\(([^\[]+)\[", 1), F.lit(""))
    parsed = checked.withColumn("mod", name).withColumn("specificity", where).withColumn("alias", alias)
    parsed = parsed.withColumn("full_name", F.concat(F.coalesce("alias", "mod"), F.lit("["), "specificity", F.lit("]")))
    return parsed.join(F.broadcast(mods), "full_name", "left")  # a modification library


def sites_of(sequence: Column, residues: str) -> Column:
    """1-based places of any of ``residues``."""
    return F.filter(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.instr(F.lit(residues), F.substr(sequence, i, F.lit(1))) > 0)


def variable_sites(peptides: DataFrame, rules: DataFrame, peptide: str = "peptide") -> DataFrame:
    """(peptide, residue, mods, sites): per residue specificity, the allowed modifications and the places; ``rules``: residue, mod."""
    letters = peptides.select(peptide, F.posexplode(F.split(F.col(peptide), "")).alias("at", "residue")).withColumn("site", F.col("at") + 1)
    places = letters.groupBy(peptide, "residue").agg(F.sort_array(F.collect_list("site")).alias("sites"))
    allowed = rules.groupBy("residue").agg(F.sort_array(F.collect_set("mod")).alias("mods"))
    return places.join(F.broadcast(allowed), "residue").select(peptide, "residue", "mods", "sites")  # a rule list


def fixed_mods(peptides: DataFrame, rules: DataFrame, peptide: str = "peptide") -> DataFrame:
    """(peptide, site, mod): fixed modifications; ``rules``: ord, kind (residue, n_term, c_term), residue (or null for any), mod; of several at a site the last rule stands."""
    letters = peptides.select(peptide, F.posexplode(F.split(F.col(peptide), "")).alias("at", "letter")).withColumn("site", F.col("at") + 1)
    hit = (F.col("kind") == "residue") & (F.col("residue") == F.col("letter"))
    first = (F.col("kind") == "n_term") & (F.col("site") == 1) & (F.col("residue").isNull() | (F.col("residue") == F.col("letter")))
    last = (F.col("kind") == "c_term") & (F.col("site") == F.length(peptide)) & (F.col("residue").isNull() | (F.col("residue") == F.col("letter")))
    slot = F.when((F.col("kind") == "n_term") & F.col("residue").isNull(), 0).when((F.col("kind") == "c_term") & F.col("residue").isNull(), F.length(peptide) + 1).otherwise(F.col("site"))
    met = letters.join(F.broadcast(rules), hit | first | last)  # a rule list
    return met.groupBy(peptide, slot.alias("site")).agg(F.max_by("mod", "ord").alias("mod"))


def compositions(peptides: DataFrame, mods: list[tuple[str, float, str]], peptide: str = "peptide", total: str = "n_sites") -> DataFrame:
    """(peptide, n_<mod>..., delta): all counts of the modifications on one kind of site, with at most ``total`` together."""
    out = peptides
    used = F.lit(0)
    for name, _, _ in mods:
        out = out.withColumn(f"n_{name}", F.explode(F.sequence(F.lit(0), (F.col(total) - used).cast("int"))))
        used = used + F.col(f"n_{name}")
    delta = sum((F.col(f"n_{name}") * mass for name, mass, _ in mods), F.lit(0.0))
    return out.withColumn("delta", delta)


def count_arrangements(n_sites: Column, counts: list[Column]) -> Column:
    """Multinomial number of ways to place the counts on the sites, without placing any."""
    table = F.array(*[F.lit(factorial(i)).cast("double") for i in range(MAX_SITES + 1)])
    fact = lambda c: F.get(table, c.cast("int"))
    rest = n_sites
    below = F.lit(1.0)
    for c in counts:
        below = below * fact(c)
        rest = rest - c
    return F.round(fact(n_sites) / (below * fact(rest))).cast("long")


def arrangements(df: DataFrame, sites: str, counts: dict[str, str], name: str = "placement") -> DataFrame:
    """One row per distinct placement: an array with the modification ('' for none) at each place of ``sites``.

    A fold over the places, keeping only prefixes that don't use more of a
    modification than there is and can still use up what is left.
    """
    spare = F.size(sites) - sum((F.col(c) for c in counts.values()), F.lit(0))
    choices = F.concat(F.array(F.struct(F.lit("").alias("m"), spare.cast("int").alias("k"))), *[F.array(F.struct(F.lit(m).alias("m"), F.col(c).cast("int").alias("k"))) for m, c in counts.items()])
    grow = lambda acc, _: F.flatten(F.transform(acc, lambda p: F.transform(F.filter(choices, lambda c: F.size(F.filter(p, lambda x: x == c["m"])) < c["k"]), lambda c: F.concat(p, F.array(c["m"])))))
    placed = F.aggregate(sites, F.array(F.array().cast("array<string>")), grow)
    return df.withColumn(name, F.explode(placed))


def render_placement(sequence: Column, sites: Column, placement: Column) -> Column:
    """Letters with ``{mod}`` behind each occupied site, between underscores."""
    mod_at = lambda i: F.coalesce(F.get(placement, (F.array_position(sites, i) - 1).cast("int")), F.lit(""))
    letters = F.transform(F.sequence(F.lit(1), F.length(sequence)), lambda i: F.concat(F.substr(sequence, i, F.lit(1)), F.when(mod_at(i) != "", F.concat(F.lit("{"), mod_at(i), F.lit("}"))).otherwise(F.lit(""))))
    return F.concat(F.lit("_"), F.array_join(letters, ""), F.lit("_"))


def fragment_ions(peptides: DataFrame, charges: list[int], mass_of: Column, proton: float, water: float, peptide: str = "peptide", also: tuple[str, ...] = ()) -> DataFrame:
    """(peptide, also, type, pos, z, mz): b ions from the left (1) and y ions from the right (2); ``mass_of`` is an array of residue masses by place."""
    rows = peptides.select(peptide, *also, mass_of.alias("_m")).select(peptide, *also, "_m", F.explode(F.sequence(F.lit(1), F.size("_m") - 1)).alias("pos")).where("size(_m) > 1")
    add = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)
    b, y = add(F.slice("_m", F.lit(1), F.col("pos"))), add(F.slice("_m", F.size("_m") - F.col("pos") + 1, F.col("pos"))) + water
    both = rows.select(peptide, *also, "pos", F.explode(F.array(F.struct(F.lit(1).alias("type"), b.alias("m")), F.struct(F.lit(2).alias("type"), y.alias("m")))).alias("i"))
    return both.withColumn("z", F.explode(F.array(*[F.lit(z) for z in charges]))).select(peptide, *also, "i.type", "pos", "z", ((F.col("i.m") + F.col("z") * proton) / F.col("z")).alias("mz"))


#: The nine ion types by number, each with the series whose places it has (1 b, 2 y) and the mass that it lacks (CO, NH3, H2O).
CO, NH3, H2O = 27.9949146, 17.0265491, 18.0105647
ION_TYPES = {1: (1, 0.0), 11: (1, NH3), 12: (1, H2O), 2: (2, 0.0), 21: (2, NH3), 22: (2, H2O), 3: (1, CO), 31: (1, CO + NH3), 32: (1, CO + H2O)}


def ion_types(ions: DataFrame, types: tuple[int, ...]) -> DataFrame:
    """Ions of the given types from b (1) and y (2) ions with type, z and mz."""
    wanted = F.array(*[F.struct(F.lit(ION_TYPES[t][0]).alias("_series"), F.lit(t).alias("_type"), F.lit(ION_TYPES[t][1]).alias("_lost")) for t in types])
    each = ions.select("*", F.inline(wanted)).where("type = _series")
    return each.withColumn("mz", F.round(F.col("mz") - F.col("_lost") / F.col("z"), 8)).withColumn("type", F.col("_type")).drop("_series", "_type", "_lost")


def discriminating_ions(placed: DataFrame, fragments: DataFrame, masses: dict[str, float], sites: str = "sites", placement: str = "placement", peptide: str = "peptide", also: tuple[str, ...] = ()) -> DataFrame:
    """(peptide, also, imp, type, pos, z, mz, n_mods): ions between neighbouring sites, shifted by what lies on their side.

    ``also`` are columns of both tables that tell equal peptides apart.
    """
    table = F.create_map(F.lit(""), F.lit(0.0), *[F.lit(x) for p in masses.items() for x in p])
    shift = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, m: acc + F.element_at(table, m))
    occupied = lambda part: F.size(F.filter(part, lambda m: m != ""))
    gaps = placed.select(peptide, *also, "imp", sites, placement, F.explode(F.sequence(F.lit(1), F.size(sites) - 1)).alias("gap")).where(f"size({sites}) > 1")
    left, right = F.slice(placement, F.lit(1), F.col("gap")), F.slice(placement, F.col("gap") + 1, F.size(placement))
    lo, hi = F.element_at(sites, F.col("gap")), F.element_at(sites, F.col("gap") + 1) - 1
    spans = gaps.select(peptide, *also, "imp", F.explode(F.array(
        F.struct(F.lit(1).alias("type"), lo.alias("from"), hi.alias("to"), shift(left).alias("shift"), occupied(left).alias("n_mods")),
        F.struct(F.lit(2).alias("type"), (F.length(peptide) - hi).alias("from"), (F.length(peptide) - lo).alias("to"), shift(right).alias("shift"), occupied(right).alias("n_mods")))).alias("s"))
    rows = spans.select(peptide, *also, "imp", "s.type", "s.shift", "s.n_mods", F.explode(F.sequence("s.from", "s.to")).alias("pos"))
    met = rows.join(fragments, [peptide, *also, "type", "pos"])
    return met.select(peptide, *also, "imp", "type", "pos", "z", F.round(F.col("mz") + F.col("shift") / F.col("z"), 8).alias("mz"), "n_mods")


def distinct_ions(ions: DataFrame, peptide: str = "peptide") -> DataFrame:
    """Distinct ions with the dense number of their class (type, pos, z) in sorted order, and how many forms have them."""
    once = ions.groupBy(peptide, "mz", "type", "pos", "z", "n_mods").agg(F.countDistinct("imp").alias("n_imps"))
    return once.withColumn("cls", F.dense_rank().over(Window.partitionBy(peptide).orderBy("type", "pos", "z")))
