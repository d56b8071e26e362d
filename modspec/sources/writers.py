"""Writers of the text reports: rows of every level with sort keys, rendered and written in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sectioned_lines(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, level, line): union of rows of nested levels; each has the ``keys`` (null below its own) and ``line``."""
    out = None
    for level, df in enumerate(levels):
        one = df.select(*keys, F.lit(level).alias("level"), "line")
        out = one if out is None else out.unionByName(one)
    return out


def msms_lines(msms: DataFrame) -> DataFrame:
    """Lines of a deconvolution report (P, S and form rows) for peptide, dataset, title, imp, abundance; zero abundances are left out."""
    some = msms.where("abundance <> 0")
    keys = ["peptide", "dataset", "title", "imp"]
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    top = some.select("peptide").distinct().select("peptide", *none("dataset", "title", "imp"), F.concat(F.lit("P\t"), "peptide").alias("line"))
    mid = some.select("peptide", "dataset", "title").distinct().select("peptide", "dataset", "title", *none("imp"), F.concat_ws("\t", F.lit("S"), "dataset", "title").alias("line"))
    low = some.select(*keys, F.format_string("%s\t%f", "imp", "abundance").alias("line"))
    return sectioned_lines([top, mid, low], keys)


def write_lines(lines: DataFrame, keys: list[str], path: str, whole: Column | None = None) -> None:
    """Writes the lines in the order of their keys; the first key never crosses files.  ``whole`` makes a line of a row there."""
    ranged = lines.repartitionByRange(F.col(keys[0]).asc_nulls_first()).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], "level")
    ranged.select(F.col("line") if whole is None else whole.alias("line")).write.text(path)


def write_psm_tsv(psms: DataFrame, path: str) -> None:
    psms.write.option("sep", "\t").option("header", True).csv(path)


def write_pep_spec(pep_spec: DataFrame, path: str) -> None:
    """Peptide lines, each followed by its dataset and title lines."""
    keys = ["peptide", "dataset", "title"]
    top = pep_spec.select("peptide").distinct().select("peptide", F.lit(None).cast("string").alias("dataset"), F.lit(None).cast("string").alias("title"), F.col("peptide").alias("line"))
    low = pep_spec.select(*keys, F.concat_ws("\t", "dataset", "title").alias("line"))
    write_lines(sectioned_lines([top, low], keys), keys, path)


def write_msms_report(msms: DataFrame, path: str) -> None:
    write_lines(msms_lines(msms), ["peptide", "dataset", "title", "imp"], path)


def write_ambiguous_spectra(abundances: DataFrame, path: str, keys: tuple[str, ...] = ("dataset", "title")) -> None:
    """Spectra whose design is rank-deficient."""
    abundances.where("rank_deficient").select(F.concat_ws("\t", *keys).alias("line")).distinct().write.text(path)


def site_report_lines(sited: DataFrame) -> DataFrame:
    """Lines of a site report for site, imp, charge, run, area: a site with its total, then its ``*`` rows."""
    keys = ["site", "imp", "charge", "run"]
    none = [F.lit(None).cast("string").alias(k) for k in keys[1:]]
    top = sited.groupBy("site").agg(F.sum("area").alias("total")).select("site", *none, F.format_string("%s\t%f", "site", "total").alias("line"))
    low = sited.select(*keys, F.format_string("*\t%s\t%s\t%s\t%f", "imp", "charge", "run", "area").alias("line"))
    return sectioned_lines([top, low], keys)


def write_site_report(sited: DataFrame, path: str) -> None:
    write_lines(site_report_lines(sited), ["site", "imp", "charge", "run"], path)


def pair_report_lines(pairs: DataFrame) -> DataFrame:
    """Lines of a pair report for site, imp, charge, q_left, q_right; the site on the first row of its block only."""
    w = Window.partitionBy("site").orderBy("imp", "charge")
    shown = F.when(F.row_number().over(w) == 1, F.col("site")).otherwise("")
    return pairs.select("site", "imp", "charge", F.lit(1).alias("level"), F.format_string("%s\t%s\t%s\t%f\t%f", shown, "imp", "charge", "q_left", "q_right").alias("line"))


def write_pair_report(pairs: DataFrame, path: str, titles: tuple[str, str] = ("left", "right")) -> None:
    """One file a partition, each with the header."""
    lines = pair_report_lines(pairs).repartitionByRange("site").sortWithinPartitions("site", "imp", "charge")
    header = "\t".join(["site", "imp", "charge", *titles])
    lines.select(F.col("line").alias(header)).write.option("header", True).option("sep", "\x01").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_merged_pairs(wide: DataFrame, path: str) -> None:
    """The wide table of all pairs as tab-separated text with a header."""
    wide.sortWithinPartitions("site", "imp", "charge").write.option("sep", "\t").option("header", True).csv(path)


def merged_lines(wide: DataFrame, names: list[str], titles: list[tuple[str, str]] | None = None) -> DataFrame:
    """site, imp, charge, level, line of a merged table: a title line, then by site its rows and a SUM row.

    A pair has four columns: left, right and two for ratios, which only a SUM
    row fills, with left over right; it is blank where the left sum is 0.  The
    site stands on the first row of its block.  ``titles``: of left and right of
    each pair, else made from its name.
    """
    cell = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%f", c)).otherwise("")
    columns = [f"{n}_{side}" for n in names for side in ("left", "right")]
    first = F.row_number().over(Window.partitionBy("site").orderBy("imp", "charge")) == 1
    row = F.concat_ws("\t", F.when(first, F.col("site")).otherwise(""), "imp", "charge", *[x for n in names for x in (cell(f"{n}_left"), cell(f"{n}_right"), F.lit(""), F.lit(""))])
    rows = wide.select("site", "imp", "charge", F.lit(1).alias("level"), row.alias("line"))
    sums = wide.groupBy("site").agg(*[F.sum(c).alias(c) for c in columns])

    def total(n: str) -> list[Column]:
        left, right = F.coalesce(f"{n}_left", F.lit(0.0)), F.coalesce(f"{n}_right", F.lit(0.0))
        shown = lambda text: F.when(left != 0, text).otherwise("")
        ratio = F.when(right == 0, "Inf").otherwise(F.format_string("%f", left / F.nullif(right, F.lit(0.0))))
        return [shown(F.format_string("%f", left)), shown(F.format_string("%f", right)), shown(ratio), F.lit("")]

    none = F.lit(None).cast("string")
    line = F.concat_ws("\t", F.lit(""), F.lit("SUM"), F.lit(""), *[x for n in names for x in total(n)])
    head = "\t".join(["Sites", "Sequence", "Charge", *[x for pair in titles or [(f"{n}_left", f"{n}_right") for n in names] for x in (*pair, "Ratio", "Normalized ratio")]])
    top = wide.sparkSession.createDataFrame([(None, None, None, 0, head)], "site string, imp string, charge string, level int, line string")
    return top.unionByName(rows).unionByName(sums.select("site", none.alias("imp"), none.alias("charge"), F.lit(2).alias("level"), line.alias("line")))


def write_merged_report(wide: DataFrame, names: list[str], path: str, titles: list[tuple[str, str]] | None = None) -> None:
    """The titles, then the rows of each site in order and its sums; a site never crosses files."""
    ranged = merged_lines(wide, names, titles).repartitionByRange(F.col("site").asc_nulls_first())
    ranged.sortWithinPartitions(F.col("site").asc_nulls_first(), "level", "imp", "charge").select("line").write.text(path)


def write_sites(sited: DataFrame, others: DataFrame, path: str, others_path: str) -> None:
    """The site report, and rows of proteins that nobody asked for as tab-separated text."""
    write_site_report(sited, path)
    others.write.option("sep", "\t").option("header", True).csv(others_path)


def write_top1_msms(psms: DataFrame, path: str) -> None:
    """A deconvolution report of one form with abundance 1 for each match (peptide, dataset, title, imp)."""
    write_msms_report(psms.withColumn("abundance", F.lit(1.0)), path)


def write_requant_report(imp_rows: DataFrame, rt_ranges: DataFrame, path: str) -> None:
    """As the peptide report, with one ``@`` row of each form, that with the largest check label."""
    key = ["imp", "charge", "run"]
    key = [*key, "protein_line"] if "protein_line" in rt_ranges.columns else key
    best = rt_ranges.where("ratio <> 0").groupBy(*key).agg(F.max(F.struct("check_label", "rt_start", "rt_end", "ratio")).alias("b"))
    write_peptide_report(imp_rows, best.select(*key, "b.*"), path)


#: The title lines of a peptide report.
PEPTIDE_TITLES = ("Protein_name,Peptide_start_position_on_protein;", "*\tIMP\tCharge\tDataset\tMass_center\tLow_mass_bound\tHigh_mass_bound\tPeak_area", "@\tRT_start\tRT_end\tProportion\tCheck_label")


def write_peptide_report(imp_rows: DataFrame, rt_ranges: DataFrame, path: str) -> None:
    """Title lines, then protein lines, ``*`` rows and the ``@`` rows whose ratio isn't 0, in nested order.

    The title lines open the first of the ordered files.  ``rt_ranges`` may have
    the protein line; without it a form's ranges go to its rows of all proteins.
    """
    keys = ["protein_line", "imp", "charge", "run"]
    none = lambda names: [F.lit(None).cast("string").alias(n) for n in names]
    spark = imp_rows.sparkSession
    # levels count up from the titles, whose protein line is null and comes first
    head = spark.createDataFrame([(None, None, None, str(k), t) for k, t in enumerate(PEPTIDE_TITLES)], "protein_line string, imp string, charge string, run string, line string")
    top = imp_rows.select("protein_line").distinct().select("protein_line", *none(keys[1:]), F.col("protein_line").alias("line"))
    mid = imp_rows.select(*keys, F.format_string("%.4f\t%f\t%f\t%f", "mz_mid", "mz_lo", "mz_hi", "area").alias("line"))
    some = rt_ranges.where("ratio <> 0")
    placed = some if "protein_line" in some.columns else some.join(imp_rows.select(*keys), keys[1:])
    low = placed.select(*keys, F.format_string("@\t%f\t%f\t%f\t%d", "rt_start", "rt_end", "ratio", "check_label").alias("line"))
    # a form's keys are put in its line where it is written
    whole = F.when(F.col("level") == 2, F.concat(F.lit("*\t"), F.coalesce("imp", F.lit("null")), F.lit("\t"), F.coalesce("charge", F.lit("null")), F.lit("\t"), F.coalesce("run", F.lit("null")), F.lit("\t"), "line")).otherwise(F.col("line"))
    write_lines(sectioned_lines([head, top, mid, low], keys), keys, path, whole)
