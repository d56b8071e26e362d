"""Filters and status classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def relative_intensity(df: DataFrame, keys: list[str], value: str, alpha: float, strict: bool = False, name: str = "norm") -> DataFrame:
    """Rows with a value of at least (or more than) ``alpha`` times their group's maximum, and the value over it."""
    top = F.max(value).over(Window.partitionBy(*keys))
    kept = df.withColumn("_top", top)
    kept = kept.where(F.col(value) > alpha * F.col("_top")) if strict else kept.where(F.col(value) >= alpha * F.col("_top"))
    return kept.withColumn(name, F.col(value) / F.col("_top")).drop("_top")


def abundance_cut(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Values near 0 and below ``share`` of the group's largest become 0; the rest sums to 1."""
    w = Window.partitionBy(*keys)
    clean = F.when(F.abs(value) <= 1e-8, 0.0).otherwise(F.col(value))
    out = df.withColumn("_v", clean).withColumn("_v", F.when(F.col("_v") < share * F.max("_v").over(w), 0.0).otherwise(F.col("_v")))
    return out.withColumn("abundance", F.col("_v") / (F.sum("_v").over(w) + EPS)).drop("_v")


def min_rows(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def psm_status(n_candidates: Column, n_matched: Column, cap: int) -> Column:
    """Outcome of one spectrum before solving."""
    return F.when(n_candidates == 0, "no arrangement").when(n_candidates > cap, "too many").when(n_candidates == 1, "single").when(n_matched == 0, "failed").otherwise("solve")


def chem_prior(psms: DataFrame, mods: str, places: str, length: str, allowed: list[str], max_types: int = 2) -> DataFrame:
    """Rows with few enough distinct modifications, and only allowed ones at the last place where that is the C-terminal residue.

    ``mods`` and ``places`` are parallel arrays.
    """
    last = F.array_max(places)
    at_end = F.transform(F.filter(F.arrays_zip(F.col(places).alias("p"), F.col(mods).alias("m")), lambda x: x["p"] == last), lambda x: x["m"])
    fine = (last != F.col(length)) | F.forall(at_end, lambda m: m.isin(*allowed))
    return psms.where((F.size(F.array_distinct(mods)) <= max_types) & F.coalesce(fine, F.lit(True)))


def modified(modification: Column, labels: list[str] | None = None, separator: str = ";") -> Column:
    """Whether a modification string counts: not '-', no oxidation, and not isotope labels only."""
    keep = (modification != "-") & ~F.contains(modification, F.lit("Oxidation"))
    return keep & ~F.forall(F.split(modification, separator), lambda m: F.trim(m).isin(*labels)) if labels else keep


def decoy_and_group(protein: Column, tag: Column, decoy_tag: str, group_tags: list[str]) -> tuple[Column, Column]:
    """(target: the protein lacks the decoy tag in any case; in_group: ``tag`` has none of the group tags)."""
    held = F.exists(F.array(*[F.lit(t) for t in group_tags]), lambda t: F.contains(tag, t))
    return ~F.contains(F.upper(protein), F.lit(decoy_tag.upper())), ~held


def select_standard(psms: DataFrame, peptide: tuple[str, str], mass: tuple[str, float], tol: float = 1e-4, charge: tuple[str, int] | None = None, min_ions: tuple[str, int] | None = None) -> DataFrame:
    """Matches of one standard: exact peptide, mass within the tolerance, where given its charge and a floor of matched ions; each argument is a column and its value."""
    kept = psms.where((F.col(peptide[0]) == peptide[1]) & (F.abs(F.col(mass[0]) - mass[1]) < tol))
    kept = kept.where(F.col(charge[0]) == charge[1]) if charge else kept
    return kept.where(F.col(min_ions[0]) >= min_ions[1]) if min_ions else kept


def of_targets(psms: DataFrame, wanted: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is one of ``wanted``."""
    return psms.join(wanted.select(on), on, "left_semi")


def gather(rows: DataFrame, keys: list[str], value: str, own: Column) -> DataFrame:
    """Rows of groups in which the values of the rows that are ``own`` sum to more than 0."""
    total = rows.groupBy(*keys).agg(F.sum(F.when(own, F.col(value)).otherwise(0.0)).alias("_total")).where("_total > 0")
    return rows.join(total, keys, "left_semi")
