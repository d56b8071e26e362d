"""Jobs: chains of operators from read tables to what the writers take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspec.functions.scalars import strip_tokens
from modspec.operators import enumerate as E
from modspec.operators import fdr, filters, joins, placements, sites, windows
from modspec.sources.store import stored


def prefilter_psms(psms: DataFrame, allowed: list[str], decoy_tag: str, group_tags: list[str], limit: float, labels: list[str] | None = None, max_types: int = 2) -> DataFrame:
    """Matches with few modification types and none but ``allowed`` ones at the C-terminus, accepted in their group, alone in their scan, modified.

    ``psms``: dataset, scan, spectrum, score, peptide, protein, modification and
    modificationlocation (comma lists, or ``-``).  A match is in the group whose
    modifications hold none of ``group_tags`` or in the rest; rates are of
    decoys over targets in each.  ``labels`` (full names) don't count as
    modifications.
    """
    bare = F.coalesce("modification", F.lit("-")) == "-"
    names = F.when(bare, F.array().cast("array<string>")).otherwise(F.transform(F.split("modification", ","), lambda m: F.substring_index(m, " ", 1)))
    places = F.when(bare, F.array().cast("array<int>")).otherwise(F.transform(F.split("modificationlocation", ","), lambda p: p.try_cast("int")))
    rows = psms.withColumn("_mods", names).withColumn("_places", places).withColumn("_length", F.length("peptide"))
    target, in_group = filters.decoy_and_group(F.col("protein"), F.coalesce("modification", F.lit("-")), decoy_tag, group_tags)
    rows = filters.chem_prior(rows, "_mods", "_places", "_length", allowed, max_types).withColumn("_decoy", ~target).withColumn("_group", in_group)
    rows = rows.withColumn("_tie", F.struct("dataset", "scan", "spectrum", "peptide", "modificationlocation"))
    accepted = fdr.separate_fdr(rows, limit, "_group", "score", "_tie", "_decoy").where("accepted")
    alone = windows.only_once(accepted, ["dataset", "scan"])
    return alone.where(filters.modified(F.coalesce("modification", F.lit("-")), labels, ",")).select(*psms.columns)


def prefilter_files(spark: SparkSession, folder: str, out: str, allowed: list[str], decoy_tag: str, group_tags: list[str], limit: float, labels: list[str] | None = None) -> None:
    """From a folder of search results to ``out``/psms, a table of the matches kept, and ``out``/pep_spec, their list by peptide."""
    from modspec.sources.readers import read_search_dat
    from modspec.sources.writers import write_pep_spec, write_psm_tsv

    kept = prefilter_psms(read_search_dat(spark, folder), allowed, decoy_tag, group_tags, limit, labels)
    write_psm_tsv(kept.orderBy("peptide", "dataset", "scan"), f"{out}/psms")
    write_pep_spec(kept.select("peptide", "dataset", F.col("spectrum").alias("title")), f"{out}/pep_spec")


def rules_of(spark: SparkSession, spec: str, library: DataFrame) -> list[placements.Rule]:
    """(modification, specificity, mass) of each entry of a ``;`` list, in its order; an error for one that the library lacks."""
    listed = E.parse_mod_spec(spark.createDataFrame([(spec,)], "spec string"), "spec", library.select("full_name", "mono_mass")).orderBy("ord").collect()  # a list that a user writes
    if missing := [r["full_name"] for r in listed if r["mono_mass"] is None]:
        raise ValueError(f"the library has no {', '.join(missing)}")
    return [(r["alias"] or r["mod"], r["specificity"], r["mono_mass"]) for r in listed]


def protein_ends(peptides: DataFrame, proteins: DataFrame) -> DataFrame:
    """(peptide, prot_n, prot_c) of distinct peptides by their first place in the proteins (protein, sequence); an error if one is nowhere."""
    wanted = peptides.select("peptide").distinct().withColumn("_needle", F.col("peptide"))
    found = joins.locate_substrings(wanted, proteins, "peptide", "_needle", "protein", "sequence").withColumn("_size", F.length("peptide"))
    flags = stored(joins.terminus_flags(found, proteins, "peptide", "_size", "protein", "sequence").select("peptide", F.col("is_n").alias("prot_n"), F.col("is_c").alias("prot_c")))
    if lost := [r[0] for r in wanted.join(flags, "peptide", "left_anti").select("peptide").limit(5).collect()]:
        raise ValueError(f"no protein has the peptides {', '.join(lost)}")
    return flags


def deconvolve_files(
    spark: SparkSession, mgf: str, fasta: str, library: str, pep_spec: str, out: str, variable: str, ms1_tol: float, ms2_tol: float, fixed: str = "", name_regex: str | None = None, **options
) -> tuple[DataFrame, DataFrame | None]:
    """From spectra, proteins, a modification library and a list of spectra by peptide to ``out``/report_msms and ``out``/report_spectra_may_FP.

    ``variable`` and ``fixed`` are lists such as ``Acetyl[K];Oxidation[M]`` of
    names in the library; the other options are those of
    ``placements.deconvolution``.  Datasets of the list are names of spectrum
    files, with or without their ending.  A spectrum that is listed under
    several peptides is solved for each; one that is in no file has no result.
    Returns (peptide, dataset, title, imp, abundance, rank_deficient, status) of
    every listed spectrum, and of the variable model (peptide, dataset, title,
    type, pos, z, intensity, efficiency), from which ``solve.fragment_matrix``
    makes tables of ions by spectra.
    """
    from modspec.sources import readers, writers

    masses = stored(readers.read_mod_library(spark, library))
    rules, always = rules_of(spark, variable, masses), rules_of(spark, fixed, masses)
    listed = readers.read_pep_spec(spark, pep_spec).where("peptide is not null").distinct()
    ends = protein_ends(listed, readers.read_fasta(spark, fasta, name_regex))
    numbered = stored(listed.join(ends, "peptide").withColumn("spectrum", F.monotonically_increasing_id()).withColumn("_file", F.regexp_replace("dataset", r"\.[mM][gG][fF]$", "")))
    read = readers.read_mgf(spark, mgf).select(F.col("dataset").alias("_file"), "title", "charge", "precursor_mz", "peaks")
    met = stored(numbered.join(read, ["_file", "title"]).select("spectrum", "peptide", "prot_n", "prot_c", "charge", "precursor_mz", "peaks"))
    got, parts = placements.deconvolution(met.drop("peaks"), met.select("spectrum", "peaks"), rules, ms1_tol, ms2_tol, {s: m for _, s, m in always}, fixed_names={s: n for n, s, _ in always}, **options)
    names = numbered.select("spectrum", "peptide", "dataset", "title")
    told = stored(names.join(got, "spectrum", "left").withColumn("status", F.coalesce("status", F.lit("no spectrum"))).drop("spectrum"))
    solved = told.where("status = 'ok'")
    writers.write_msms_report(solved, f"{out}/report_msms")
    writers.write_ambiguous_spectra(solved, f"{out}/report_spectra_may_FP")
    return told, None if parts is None else names.join(parts, "spectrum").drop("spectrum")


def summarise_files(spark: SparkSession, report: str, out: str, proteins: DataFrame, mods: DataFrame, labels: tuple[str, ...] = ()) -> None:
    """From a peptide report to ``out``/sites, the site report, and ``out``/others, the forms of lines without any of the proteins.

    ``proteins``: protein, prot_abbr; ``mods``: mod, mod_abbr.  Of a line's
    proteins the first that is wanted counts; ``labels`` are taken out of the
    names of forms.
    """
    from modspec.sources import readers, writers

    imps, _ = readers.read_peptide_report(spark, report)
    placed = stored(sites.first_listed(imps.withColumn("imp", strip_tokens(F.col("imp"), labels)), proteins))
    sited = sites.parse_sites(placed.where("protein is not null"), proteins, mods).select("site", "imp", "charge", "run", "area")
    others = placed.where("protein is null").select("protein_line", "imp", "charge", "run", "area")
    writers.write_sites(sited, others, f"{out}/sites", f"{out}/others")


def compare_files(spark: SparkSession, left: str, right: str, out: str, labels: tuple[str, ...] = (), titles: tuple[str, str] = ("left", "right")) -> None:
    """From two site reports to a pair report of what both have."""
    from modspec.sources import readers, writers

    rows = sites.pair_intersect(readers.read_site_report(spark, left), readers.read_site_report(spark, right), labels)
    writers.write_pair_report(rows, out, titles)


def merge_files(spark: SparkSession, reports: dict[str, str], out: str, titles: list[tuple[str, str]] | None = None) -> None:
    """From pair reports (name to path, in order) to the merged report, with its sums by site."""
    from modspec.sources import readers, writers

    pairs = None
    for name, path in reports.items():  # a list that a user writes
        one = readers.read_pair_report(spark, path).withColumn("pair", F.lit(name))
        pairs = one if pairs is None else pairs.unionByName(one)
    writers.write_merged_report(sites.merge_pairs(pairs, list(reports)), list(reports), out, titles)
