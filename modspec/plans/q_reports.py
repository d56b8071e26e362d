"""Reports written as files and read again: what comes back is what the SQL says of the tables.

The files lie in the shared folder; a query writes its own and reads all of them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.plans.adapters import SITES_SQL, n_lines, peaks, site_rows, table
from modspec.plans.q_sites import PAIRS_SQL, SITED_SQL, pairs, sited
from modspec.plans.q_spectra import MATCH_SQL, matches
from modspec.plans.registry import query
from modspec.sources import readers, writers
from modspec.sources.store import shared_path, spread_beyond, written


def _msms(spark, folder):
    s = F.col("spectrum")
    rows = matches(spark, folder).groupBy(F.concat(F.lit("p"), (s % 97).cast("string")).alias("peptide"), F.concat(F.lit("d"), (s % 3).cast("string")).alias("dataset"), s.cast("string").alias("title"), F.col("imp").cast("string").alias("imp"))
    return rows.agg(F.sum("raw").alias("abundance"))


_MSMS_SQL = f"""WITH {MATCH_SQL}, r AS (SELECT 'p' || spectrum % 97 AS peptide, 'd' || spectrum % 3 AS dataset, spectrum::VARCHAR AS title, imp::VARCHAR AS imp, sum(raw) AS abundance FROM m GROUP BY ALL)"""


@query("report_msms", f"{_MSMS_SQL} SELECT peptide, dataset, title, imp, abundance FROM r WHERE abundance <> 0")
def report_msms(spark, folder):
    """A deconvolution report."""
    path = shared_path(spark, "msms")
    writers.write_msms_report(_msms(spark, folder), path)
    return readers.read_msms_report(spark, path)


@query("report_list", f"{_MSMS_SQL} SELECT DISTINCT peptide, dataset, title || ' of ' || peptide AS title FROM r")
def report_list(spark, folder):
    """A list of spectra by peptide, whose titles hold blanks."""
    path = shared_path(spark, "list")
    rows = _msms(spark, folder).select("peptide", "dataset", F.concat_ws(" of ", "title", "peptide").alias("title")).distinct()
    writers.write_pep_spec(rows, path)
    return readers.read_pep_spec(spark, path)


@query("report_sites", f"WITH {SITED_SQL} SELECT site, imp, charge, run, sum(area) AS area FROM sited GROUP BY ALL")
def report_sites(spark, folder):
    path = shared_path(spark, "sites")
    writers.write_site_report(sited(spark, folder).groupBy("site", "imp", "charge", "run").agg(F.sum("area").alias("area")), path)
    return readers.read_site_report(spark, path)


@query("report_pairs", f"WITH {PAIRS_SQL} SELECT site, imp, charge, q_left, q_right FROM pairs WHERE pair = 'A'")
def report_pairs(spark, folder):
    """Sites stand on the first row of their block; each file has a title line."""
    path = shared_path(spark, "pairs")
    writers.write_pair_report(pairs(spark, folder).where("pair = 'A'").drop("pair"), path)
    return readers.read_pair_report(spark, path).drop("pair")


@query("report_peptides", f"""WITH {SITES_SQL}, f AS (SELECT protein, imp, charge, run, sum(area) AS area, count(*) AS n, min(area) AS lo, max(area) AS hi FROM site_rows GROUP BY ALL),
last AS (SELECT imp, charge, run, max(protein) AS protein FROM f WHERE n % 3 <> 0 GROUP BY ALL)
SELECT protein || ',10;' AS protein_line, imp, charge, run, area, lo AS mz_lo, hi AS mz_hi, lo AS rt_start, hi + 1 AS rt_end, (n % 3) / 4 AS ratio, (n % 2)::INT AS check_label FROM f JOIN last USING (imp, charge, run, protein)""")
def report_peptides(spark, folder):
    """A peptide report: ranges of ratio 0 aren't written, a form without ranges drops out, of a repeated one the last stands."""
    path = shared_path(spark, "peptides")
    lines = spread_beyond(site_rows(spark, folder), n_lines(spark, folder), "protein")
    forms = lines.groupBy(F.concat("protein", F.lit(",10;")).alias("protein_line"), "imp", "charge", "run").agg(F.sum("area").alias("area"), F.count("*").alias("n"), F.min("area").alias("mz_lo"), F.max("area").alias("mz_hi"))
    forms = written(forms)
    ranges = forms.select("protein_line", "imp", "charge", "run", F.col("mz_lo").alias("rt_start"), (F.col("mz_hi") + 1).alias("rt_end"), (F.col("n") % 3 / 4).alias("ratio"), (F.col("n") % 2).alias("check_label"))
    writers.write_peptide_report(forms.withColumn("mz_mid", F.col("mz_lo")), ranges, path)
    imps, told = readers.read_peptide_report(spark, path)
    return imps.drop("mz_mid").join(told, ["imp", "charge", "run"])


def _text(lines, path):
    """Lines (key, block) as text, by key."""
    lines.repartitionByRange("key").sortWithinPartitions("key").select("block").write.text(path)


def _spectra(spark, folder):
    """key, precursor, charge and the peak lines of a spectrum, by m/z."""
    line = F.concat_ws(" ", F.format_string("%.2f", "mz"), F.format_string("%.2f", "intensity"))
    rows = peaks(spark, folder).groupBy(F.col("spectrum").alias("key")).agg(F.max("mz").alias("precursor"), F.sort_array(F.collect_list(F.struct("mz", line.alias("l")))).alias("p"))
    return rows.select("key", "precursor", (F.col("key") % 3 + 1).alias("charge"), F.array_join(F.transform("p", lambda x: x["l"]), "\n").alias("peaks"))


@query("file_mgf", """SELECT l_orderkey AS scan, (l_orderkey % 3 + 1)::INT AS charge, max(l_extendedprice) AS precursor_mz, count(*)::INT AS n_peaks, round(sum(l_quantity), 2) AS total, 'run.' || l_orderkey || '.' || l_orderkey || '.' || (l_orderkey % 3 + 1) || '.0.dta' AS title FROM lineitem GROUP BY l_orderkey""")
def file_mgf(spark, folder):
    """All spectra as MGF blocks, read again."""
    path = shared_path(spark, "mgf")
    k = F.col("key").cast("string")
    title = F.concat_ws(".", F.lit("run"), k, k, F.col("charge").cast("string"), F.lit("0"), F.lit("dta"))
    block = F.concat(F.lit("BEGIN IONS\nTITLE="), title, F.lit("\nCHARGE="), F.col("charge").cast("string"), F.lit("+\nPEPMASS="), F.format_string("%.2f", "precursor"), F.lit("\n"), F.col("peaks"), F.lit("\nEND IONS"))
    _text(_spectra(spark, folder).select("key", block.alias("block")), path)
    got = readers.read_mgf(spark, path)
    return got.select("title", "scan", "charge", "precursor_mz", F.size("peaks").alias("n_peaks"), F.round(F.aggregate("peaks", F.lit(0.0), lambda a, p: a + p["intensity"]), 2).alias("total"))


@query("file_ms2_map", "SELECT l_orderkey // 7 AS ms1_scan, l_orderkey AS ms2_scan FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY ALL")
def file_ms2_map(spark, folder):
    """Scans with their survey scans; every fifth doesn't say it."""
    path = shared_path(spark, "ms2")
    k = F.col("key").cast("string")
    parent = F.when(F.col("key") % 5 != 0, F.concat(F.lit("\nI\tPrecursorScan\t"), F.floor(F.col("key") / 7).cast("string"))).otherwise("")
    block = F.concat(F.lit("S\t"), k, F.lit("\t"), k, F.lit("\t"), F.format_string("%.2f", "precursor"), parent, F.lit("\n"), F.col("peaks"))
    _text(_spectra(spark, folder).select("key", block.alias("block")), path)
    return readers.read_ms2_map(spark, path).select("ms1_scan", "ms2_scan")


@query("file_fasta", "SELECT 'P' || p_partkey AS protein, upper(replace(p_name, ' ', '')) || upper(p_type[1:3]) AS sequence FROM part")
def file_fasta(spark, folder):
    """Sequences in two lines, names by a pattern."""
    path = shared_path(spark, "fasta")
    letters = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    block = F.concat(F.lit(">sp|P"), F.col("p_partkey").cast("string"), F.lit("| a part\n"), letters, F.lit("\n"), F.upper(F.substring("p_type", 1, 3)))
    _text(table(spark, folder, "part").select(F.col("p_partkey").alias("key"), block.alias("block")), path)
    return readers.read_fasta(spark, path, r"^>sp\|(\w+)\|")


_PEPTIDE_SQL = "translate(o_custkey::VARCHAR, '0123456789', 'AGVLAGVLAG')"


@query("job_deconvolve_files", f"""WITH o AS (SELECT o_orderkey AS k, {_PEPTIDE_SQL} AS mid, replace({_PEPTIDE_SQL}, 'V', 'V{{Label_13C(5)}}') AS shown, (o_orderkey % 9 + 1) / 10.0 AS share FROM orders)
SELECT 'AK' || mid || 'KG' AS peptide, 'run.' || k || '.' || k || '.2.0.dta' AS title, '_AK{{Acetyl}}' || shown || 'KG_' AS imp, round(share::DOUBLE, 3) AS abundance FROM o
UNION ALL SELECT 'AK' || mid || 'KG', 'run.' || k || '.' || k || '.2.0.dta', '_AK' || shown || 'K{{Acetyl}}G_', round(1 - share::DOUBLE, 3) FROM o""")
def job_deconvolve_files(spark, folder):
    """Spectra, proteins, a library and a list as files, to the deconvolution report read again.

    Each order is a spectrum of two forms of the peptide that its customer
    spells, in shares that its key says; every second peptide begins its
    protein, where a third form has the same mass, but fewer of the ions.  The
    letters are such that no b ion has the mass of a y ion.
    """
    from modspec.functions.constants import PROTON, WATER
    from modspec.operators import enumerate as E
    from modspec.operators.jobs import deconvolve_files
    from modspec.operators.placements import base_masses
    from modspec.sources.store import stored

    acetyl, label = 42.010565, 5.016774
    out = shared_path(spark, "deconvolution")
    k = F.col("key").cast("string")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("AK"), F.translate(F.col("o_custkey").cast("string"), "0123456789", "AGVLAGVLAG"), F.lit("KG")).alias("peptide"), (F.col("o_orderkey") % 9 + 1).alias("tenths"))
    orders = orders.withColumn("title", F.concat_ws(".", F.lit("run"), k, k, F.lit("2.0.dta")))
    masses = base_masses(F.col("peptide"), {"V": label})
    once = orders.select("peptide").distinct()
    mass = F.aggregate(masses, F.lit(WATER + acetyl), lambda acc, m: acc + m)
    size = F.length("peptide")
    ions = E.fragment_ions(once, [1], masses, PROTON, WATER)
    forms = F.array(F.struct(F.lit(2).alias("site"), F.lit(True).alias("first")), F.struct((size - 1).alias("site"), F.lit(False).alias("first")))
    shifted = ions.select("*", F.inline(forms)).withColumn("mz", F.col("mz") + F.when(F.col("pos") >= F.when(F.col("type") == 1, F.col("site")).otherwise(size - F.col("site") + 1), acetyl).otherwise(0.0))
    lists = shifted.groupBy("peptide").agg(F.sort_array(F.collect_list(F.struct("mz", "first"))).alias("ions"))
    line = lambda i: F.format_string("%.5f %d", i["mz"], F.when(i["first"], F.col("tenths")).otherwise(10 - F.col("tenths")) * 100)
    block = F.concat(F.lit("BEGIN IONS\nTITLE="), "title", F.lit("\nCHARGE=2+\nPEPMASS="), F.format_string("%.6f", (mass + 2 * PROTON) / 2), F.lit("\n"), F.array_join(F.transform("ions", line), "\n"), F.lit("\nEND IONS"))
    _text(orders.join(lists, "peptide").select("key", block.alias("block")), f"{out}/mgf")
    begins = F.pmod(F.xxhash64("peptide"), F.lit(2)) == 0
    proteins = F.concat(F.lit(">sp|"), "peptide", F.lit("| of one peptide\n"), F.when(begins, F.concat(F.lit("M"), "peptide", F.lit("GG"))).otherwise(F.concat(F.lit("GG"), "peptide")))
    _text(once.select(F.col("peptide").alias("key"), proteins.alias("block")), f"{out}/fasta")
    library = [f"Acetyl[K]=K NORMAL {acetyl} 42.0367 0", f"Acetyl[Protein N-term]=AGVLK PRO_N {acetyl} 42.0367 0", f"Label_13C(5)[V]=V NORMAL {label} 4.9633 0"]
    spark.createDataFrame([(x,) for x in library], "line string").write.text(f"{out}/library")
    # Spark names the files, so the list takes the names of datasets from them
    datasets = stored(readers.read_mgf(spark, f"{out}/mgf").select("dataset", "title"))
    writers.write_pep_spec(orders.select("peptide", "title").join(datasets, "title").select("peptide", "dataset", "title"), f"{out}/list")
    deconvolve_files(spark, f"{out}/mgf", f"{out}/fasta", f"{out}/library", f"{out}/list", out, "Acetyl[K];Acetyl[Protein N-term]", 0.01, 0.001, "Label_13C(5)[V]", r"^>sp\|(\w+)\|")
    got = readers.read_msms_report(spark, f"{out}/report_msms")
    return got.select("peptide", "title", "imp", F.round("abundance", 3).alias("abundance"))
