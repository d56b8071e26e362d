"""Site-level tables: parsing modified forms, totals, comparison of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspec.functions.scalars import strip_tokens


def parse_sites(imp_rows: DataFrame, proteins: DataFrame, mods: DataFrame, imp: str = "imp", protein: str = "protein", start: str = "start") -> DataFrame:
    """One row per (row, known modification): the input columns and site.

    ``{...}`` groups are walked in order; the place is the number of residues
    before the brace (0: N-term), behind the closing underscore the C-term.  Modifications missing from ``mods`` (mod,
    mod_abbr) are skipped; proteins missing from ``proteins`` (protein,
    prot_abbr) drop out (see ``uninterested``).  The initiator isn't counted.
    """
    groups = F.regexp_extract_all(F.col(imp), F.lit(r"\{([^}]*)\}"), F.lit(1))
    pieces = F.split(F.col(imp), r"\{[^}]*\}", -1)
    residues = F.aggregate(F.slice(pieces, F.lit(1), F.size(groups)), F.array().cast("array<int>"), lambda acc, p: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(F.replace(p, F.lit("_"), F.lit("")))).cast("int"))))
    # a group behind the closing underscore
    closed = F.transform(groups, lambda m, i: F.rlike(F.array_join(F.slice(pieces, F.lit(1), i + 1), ""), F.lit("[^_]_$")))
    letters = F.regexp_replace(F.regexp_replace(F.col(imp), r"\{[^}]*\}", ""), "_", "")
    walked = imp_rows.withColumn("_letters", letters).withColumn("_at", F.explode(F.arrays_zip(groups.alias("mod"), residues.alias("before"), closed.alias("closed")))).select("*", "_at.mod", "_at.before", F.col("_at.closed").alias("_closed")).drop("_at")
    known = walked.join(mods, "mod").join(proteins, protein)  # Spark broadcasts what is small enough
    place = (F.col(start) + F.col("before") - 2).cast("string")
    site = F.when(F.col("_closed"), F.concat("prot_abbr", F.lit("C-term_"), "mod_abbr")).when(F.col("before") == 0, F.concat("prot_abbr", F.lit("N-term_"), "mod_abbr")).otherwise(F.concat("prot_abbr", F.substr("_letters", F.greatest(F.col("before"), F.lit(1)), F.lit(1)), place, "mod_abbr"))
    return known.withColumn("site", site).drop("_letters", "before", "_closed")


def first_listed(imp_rows: DataFrame, proteins: DataFrame, line: str = "protein_line") -> DataFrame:
    """Rows with protein and start, of the first entry of their line (``name,start;`` each) that ``proteins`` has; null where none is."""
    each = imp_rows.select(line).distinct().select(line, F.posexplode(F.split(line, ";")).alias("_nth", "_entry")).where("_entry <> ''")
    named = each.select(line, "_nth", F.substring_index("_entry", ",", 1).alias("protein"), F.element_at(F.split("_entry", ","), -1).try_cast("int").alias("start"))
    met = named.join(proteins.select("protein").distinct(), "protein", "left_semi")
    first = met.groupBy(line).agg(F.min(F.struct("_nth", "protein", "start")).alias("_f")).select(line, "_f.protein", "_f.start")
    return imp_rows.join(first, line, "left")


def uninterested(imp_rows: DataFrame, proteins: DataFrame, protein: str = "protein") -> DataFrame:
    """Rows of proteins that nobody asked for."""
    return imp_rows.join(proteins, protein, "left_anti")


def site_summary(sited: DataFrame, area: str = "area") -> DataFrame:
    """Total area of each site; a form adds its whole area to every site that it carries."""
    return sited.groupBy("site").agg(F.sum(area).alias("total"), F.count("*").alias("n_rows"))


def sum_duplicates(rows: DataFrame, keys: list[str], area: str = "area", labels: tuple[str, ...] = ()) -> DataFrame:
    """Area of each (site, imp, charge), label strings removed, over all runs."""
    return rows.withColumn("imp", strip_tokens(F.col("imp"), labels)).groupBy(*keys, "imp", "charge").agg(F.sum(area).alias("area"))


def pair_intersect(left: DataFrame, right: DataFrame, labels: tuple[str, ...] = ()) -> DataFrame:
    """(site, imp, charge, q_left, q_right) of what both samples have."""
    a, b = (sum_duplicates(x, ["site"], labels=labels).withColumnRenamed("area", n) for x, n in ((left, "q_left"), (right, "q_right")))
    return a.join(b, ["site", "imp", "charge"])


def merge_pairs(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Wide table of all (site, imp, charge): <pair>_left and <pair>_right; an absent pair is null."""
    cell = lambda n, side: F.sum(F.when(F.col("pair") == n, F.col(f"q_{side}"))).alias(f"{n}_{side}")
    return pairs.groupBy("site", "imp", "charge").agg(*[cell(n, side) for n in names for side in ("left", "right")])


def pair_totals(pairs: DataFrame) -> DataFrame:
    """Per site and pair: sums and their ratio, null where the left sum is 0."""
    sums = pairs.groupBy("site", "pair").agg(F.sum("q_left").alias("sum_left"), F.sum("q_right").alias("sum_right"))
    return sums.withColumn("ratio", F.when(F.col("sum_left") != 0, F.col("sum_left") / F.col("sum_right")))


def mz_bounds(imps: DataFrame, keys: list[str], mass: str, charge: str, tol: float, is_ppm: bool, proton: float) -> DataFrame:
    """Per group and charge: least and largest (m + z p) / z, widened by the tolerance."""
    mz = (F.col(mass) + F.col(charge) * proton) / F.col(charge)
    wide: Column = F.col("mz") * tol * 1e-6 if is_ppm else F.lit(tol)
    rows = imps.withColumn("mz", mz).withColumn("_lo", F.col("mz") - wide).withColumn("_hi", F.col("mz") + wide)
    return rows.groupBy(*keys, charge).agg(F.min("_lo").alias("low"), F.max("_hi").alias("high"))


def attach_checked(imps: DataFrame, checked: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Left join of checked ranges; groups in which nothing has one drop out."""
    some = imps.join(checked.select(*keys).distinct(), keys, "left_semi").select(group).distinct()
    return imps.join(some, group, "left_semi").join(checked, keys, "left")
