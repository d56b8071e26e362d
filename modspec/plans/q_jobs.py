"""Queries of the reports and of the jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.functions.scalars import render_top1
from modspec.operators import chrom, fdr, filters, jobs, review, windows
from modspec.plans.adapters import ions, peaks, psms, table, trace
from modspec.plans.q_chrom import KEYS, grid, hits
from modspec.plans.q_spectra import MATCH_SQL, matches
from modspec.plans.q_windows import COUNTS_SQL
from modspec.plans.registry import query
from modspec.sources.store import spread
from modspec.sources.writers import msms_lines


@query("render_sectioned", f"""WITH {MATCH_SQL}, r AS (SELECT 'p' || spectrum % 7 AS peptide, 'd' || spectrum % 3 AS dataset, spectrum::VARCHAR AS title, imp::VARCHAR AS imp, sum(raw) AS abundance FROM m GROUP BY ALL HAVING sum(raw) > 20)
SELECT 0 AS level, 'P' || chr(9) || peptide AS line FROM (SELECT DISTINCT peptide FROM r) UNION ALL SELECT 1, 'S' || chr(9) || dataset || chr(9) || title FROM (SELECT DISTINCT peptide, dataset, title FROM r) UNION ALL SELECT 2, imp || chr(9) || printf('%.6f', abundance) FROM r""")
def render_sectioned(spark, folder):
    s = F.col("spectrum")
    rows = matches(spark, folder).groupBy(F.concat(F.lit("p"), (s % 7).cast("string")).alias("peptide"), F.concat(F.lit("d"), (s % 3).cast("string")).alias("dataset"), s.cast("string").alias("title"), F.col("imp").cast("string").alias("imp")).agg(F.sum("raw").alias("abundance"))
    return msms_lines(rows.where("abundance > 20")).select("level", "line")


@query("top1_report", "SELECT p_partkey, substr(upper(replace(p_name, ' ', '')), 1, p_size % 5) || '{' || split_part(p_type || ' (K)', ' ', 1) || '}' || substr(upper(replace(p_name, ' ', '')), p_size % 5 + 1) AS imp, 1.0::DOUBLE AS abundance FROM part")
def top1_report(spark, folder):
    """The best form of each match with abundance 1: the modification's name up to its first blank, put at a 0-based place."""
    letters = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    imp = render_top1(letters, F.array(F.concat("p_type", F.lit(" (K)"))), F.array(F.col("p_size") % 5))
    return table(spark, folder, "part").select("p_partkey", imp.alias("imp"), F.lit(1.0).alias("abundance"))


@query("modlib_parse", """WITH l AS (SELECT DISTINCT p_brand || '[' || substr(p_name, 1, 1) || ']=' || upper(substr(p_name, 1, 1)) || ' NORMAL ' || p_size || '.5 ' || p_size || '.25 0' AS line FROM part)
SELECT split_part(line, '=', 1) AS full_name, split_part(line, '[', 1) AS name, regexp_extract(line, '\\[([^\\]]*)\\]', 1) AS specificity, split_part(split_part(line, '=', 2), ' ', 1) AS residues, split_part(split_part(line, '=', 2), ' ', 2) AS pos_class, split_part(split_part(line, '=', 2), ' ', 3)::DOUBLE AS mono_mass FROM l""")
def modlib_parse(spark, folder):
    from modspec.sources.readers import mod_library_rows

    first = F.substr("p_name", F.lit(1), F.lit(1))
    size = F.col("p_size").cast("string")
    line = F.concat("p_brand", F.lit("["), first, F.lit("]="), F.upper(first), F.lit(" NORMAL "), size, F.lit(".5 "), size, F.lit(".25 0"))
    return mod_library_rows(table(spark, folder, "part").select(line.alias("line")).distinct()).drop("avg_mass")


@query("review_scores", """WITH hit AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem JOIN part ON abs(l_extendedprice - p_retailprice) < 0.5),
base AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem),
p AS (SELECT b.*, h.l_orderkey IS NOT NULL AS matched FROM base b LEFT JOIN hit h USING (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)),
s AS (SELECT l_orderkey AS spectrum, sum(CASE WHEN matched THEN l_quantity ELSE 0 END) / sum(l_quantity) AS main, count(DISTINCT l_linenumber) FILTER (matched) AS n_hits FROM p GROUP BY 1),
g AS (SELECT spectrum, sum(brk) + (max(pos) < 7)::INT AS gaps FROM (SELECT l_orderkey AS spectrum, l_linenumber AS pos, (l_linenumber - coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 0) > 1)::INT AS brk FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM p WHERE matched)) GROUP BY 1),
b AS (SELECT spectrum, avg((NOT matched)::INT) AS miss FROM (SELECT l_orderkey AS spectrum, matched FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey, floor(l_extendedprice / 10000) ORDER BY l_quantity DESC, l_extendedprice, l_linenumber, l_partkey, l_suppkey) = 1) GROUP BY 1)
SELECT spectrum, round(main, 6) AS main, round((n_hits - 0.5 * coalesce(gaps, 0)) / 12, 6) AS ladder, round(miss, 6) AS miss FROM s LEFT JOIN g USING (spectrum) JOIN b USING (spectrum)""")
def review_scores(spark, folder):
    """Matched share of intensity, ladder score (hits less half the gaps over 2 (L - 1)), and the share of m/z bins whose highest peak is unmatched."""
    from modspec.operators.joins import band_join

    key = ["spectrum", "pos", "part", "supp", "mz", "intensity"]
    base = peaks(spark, folder).select(*key).distinct()
    hit = band_join(base, ions(spark, folder), "mz", "ion_mz", 0.5, inclusive=False).select(*key).distinct().withColumn("hit", F.lit(True))
    p = base.join(hit, key, "left").withColumn("matched", F.coalesce("hit", F.lit(False)))
    sums = p.groupBy("spectrum").agg((F.sum(F.when(F.col("matched"), F.col("intensity")).otherwise(0.0)) / F.sum("intensity")).alias("main"), F.countDistinct(F.when(F.col("matched"), F.col("pos"))).alias("n_hits"))
    gaps = windows.ladder_gaps(p.where("matched"), ["spectrum"], "pos", F.lit(7)).select("spectrum", "gaps")
    tops = windows.best_of(p.withColumn("bin", F.floor(F.col("mz") / 10000)), ["spectrum", "bin"], [F.desc("intensity"), F.col("mz"), F.col("pos"), F.col("part"), F.col("supp")])
    miss = tops.groupBy("spectrum").agg(F.avg((~F.col("matched")).cast("int")).alias("miss"))
    joined = sums.join(gaps, "spectrum", "left").join(miss, "spectrum")
    return joined.select("spectrum", F.round("main", 6).alias("main"), F.round((F.col("n_hits") - 0.5 * F.coalesce("gaps", F.lit(0))) / 12, 6).alias("ladder"), F.round("miss", 6).alias("miss"))


@query("job_prefilter", f"""WITH {COUNTS_SQL}, rated AS (SELECT *, g_decoys / greatest(g_targets::DOUBLE, 1e-6) AS ratio FROM counts), low AS (SELECT grp, min(score) AS threshold FROM rated WHERE ratio <= 0.1 GROUP BY 1),
ok AS (SELECT * FROM rated JOIN low USING (grp) WHERE NOT decoy AND score >= threshold) SELECT any_value(id) AS id, dataset, scan FROM ok GROUP BY dataset, scan HAVING count(*) = 1""")
def job_prefilter(spark, folder):
    """Matches within the error rate of their group, then scans with exactly one of them."""
    accepted = fdr.separate_fdr(psms(spark, folder), 0.1).where("accepted")
    return windows.only_once(accepted, ["dataset", "scan"]).select("id", "dataset", "scan")


@query("job_deconvolve")
def job_deconvolve(spark, folder):
    """Matched ions above a share of their spectrum, dominated forms dropped, abundances solved and cut (solutions of singular systems aren't unique)."""
    from modspec.operators.joins import drop_dominated
    from modspec.operators.solve import estimate_abundance

    kept = filters.relative_intensity(matches(spark, folder).drop("norm"), ["spectrum"], "raw", 0.05)
    forms = drop_dominated(kept, "spectrum", "imp", "ion")
    rows = kept.join(forms, ["spectrum", "imp"])
    x = rows.select("spectrum", "ion", "imp", F.lit(1.0).alias("x"))
    y = kept.groupBy("spectrum", "ion").agg(F.sum("norm").alias("y"))
    solved = estimate_abundance(x, y, "spectrum", "ion", "imp", "x", "y", 0.5).drop("abundance_")
    cut = filters.abundance_cut(solved.withColumnRenamed("abundance", "a"), ["spectrum"], "a", 0.1)
    return cut.where("abundance > 0").select("spectrum", "imp", F.round("abundance", 4).alias("abundance"), "rank_deficient")


@query("job_requantify")
def job_requantify(spark, folder):
    """Area of each form in its checked range, here from the first to the last match that is mostly of the form, and its share of the whole trace there."""
    psm = hits(spark, folder)
    ends = [F.min("rt").alias("rt_start"), F.max("rt").alias("rt_end")]
    checked = psm.withColumn("imp", F.when(F.col("r_A") >= F.col("r_B"), "A").otherwise("B")).groupBy("grp", "imp").agg(*ends)
    got = chrom.requantify(grid(spark, folder), psm, checked, KEYS, ["A", "B"])
    return got.select("grp", "imp", F.round("area", 4).alias("area"), F.round("share", 6).alias("share"))


@query("job_normalise")
def job_normalise(spark, folder):
    """Listed groups only, one form of ratio 1: the number of peaks and the area of the best."""
    listed = trace(spark, folder).where("run = 'purchase' and raw > 50").select("grp").distinct()
    psm = hits(spark, folder).join(listed, "grp", "left_semi").select("grp", "psm", "rt", F.lit(1.0).alias("r_T"))
    found, best = chrom.quantify(grid(spark, folder).join(listed, "grp", "left_semi"), psm, KEYS, ["T"])
    return found.groupBy("grp").agg(F.count("*").alias("n_peaks")).join(best, "grp").select("grp", "n_peaks", F.round("area", 3).alias("area"))


@query("job_top1")
def job_top1(spark, folder):
    """One form with abundance 1 per match, no deconvolution: the area of the best peak around a group's matches of a run, of which there must be five."""
    key = ["grp", "run"]
    kept = filters.relative_intensity(trace(spark, folder).where("run <> 'click'"), key, "raw", 0.05)
    psm = filters.min_rows(kept, key, 5).select(*key, F.col("id").alias("psm"), "rt", F.lit(1.0).alias("r_T"))
    counts = psm.groupBy(*key).agg(F.count("*").alias("n"))
    _, best = chrom.quantify(grid(spark, folder).join(counts.select(*[F.col(c).alias(c) for c in key]), "grp"), psm, key, ["T"])
    return best.join(counts, key).select(*key, F.round("area", 4).alias("area"), "n")


#: Orders as search results: peptide, protein and modifications made from the keys.
SEARCHED_SQL = """searched AS (SELECT o_orderkey AS id, o_orderpriority AS dataset, o_custkey AS scan, o_totalprice AS score, 'PEPTIDE' AS peptide, CASE WHEN o_custkey % 10 = 0 THEN 'rev_P' ELSE 'P' END AS protein,
  CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN 'Acetyl (K)' WHEN 2 THEN 'Acetyl (K),Oxidation (M)' WHEN 3 THEN 'Acetyl (K),Methyl (R),Trim (K)' WHEN 4 THEN 'Label (K)' ELSE 'Methyl (R),Label (K)' END AS m,
  CASE o_orderkey % 6 WHEN 0 THEN '-' WHEN 1 THEN (1 + o_custkey % 7)::VARCHAR WHEN 2 THEN '1,' || (2 + o_custkey % 6) WHEN 3 THEN '1,2,3' WHEN 4 THEN '7' ELSE '3,' || (4 + o_custkey % 4) END AS places FROM orders)"""


def searched(spark, folder):
    key, scan = F.col("id"), F.col("scan")
    kind = lambda *cases: F.element_at(F.array(*cases), (key % 6 + 1).cast("int"))
    text = lambda c: c.cast("string")
    m = kind(*[F.lit(x) for x in ("-", "Acetyl (K)", "Acetyl (K),Oxidation (M)", "Acetyl (K),Methyl (R),Trim (K)", "Label (K)", "Methyl (R),Label (K)")])
    places = kind(F.lit("-"), text(1 + scan % 7), F.concat(F.lit("1,"), text(2 + scan % 6)), F.lit("1,2,3"), F.lit("7"), F.concat(F.lit("3,"), text(4 + scan % 4)))
    return psms(spark, folder).select("id", "dataset", "scan", text(key).alias("spectrum"), "score", F.lit("PEPTIDE").alias("peptide"), F.when(scan % 10 == 0, "rev_P").otherwise("P").alias("protein"), m.alias("modification"), places.alias("modificationlocation"))


@query("job_prefilter_chain", f"""WITH {SEARCHED_SQL}, e AS (SELECT *, CASE WHEN m = '-' THEN [] ELSE [split_part(x, ' ', 1) for x in string_split(m, ',')] END AS mods FROM searched),
prior AS (SELECT *, starts_with(protein, 'rev') AS decoy, NOT contains(m, 'Acetyl') AS grp FROM e WHERE len(list_distinct(mods)) <= 2 AND (m = '-' OR string_split(places, ',')[-1] <> '7' OR mods[-1] IN ('Methyl', 'Label'))),
counts AS (SELECT *, sum((NOT decoy)::INT) OVER w AS t, sum(decoy::INT) OVER w AS d FROM prior WINDOW w AS (PARTITION BY grp ORDER BY score DESC, dataset, scan, id::VARCHAR, peptide, places ROWS UNBOUNDED PRECEDING)),
low AS (SELECT grp, min(score) AS threshold FROM counts WHERE d / greatest(t::DOUBLE, 1e-6) <= 0.11 GROUP BY 1),
ok AS (SELECT c.* FROM counts c JOIN low USING (grp) WHERE NOT decoy AND score >= threshold)
SELECT id, dataset, scan, m AS modification FROM (SELECT *, count(*) OVER (PARTITION BY dataset, scan) AS n FROM ok) WHERE n = 1 AND m <> '-' AND NOT contains(m, 'Oxidation') AND m <> 'Label (K)'""")
def job_prefilter_chain(spark, folder):
    """All steps of the job: chemical prior, flags, rates by group, lone scans, modified matches without labels."""
    kept = jobs.prefilter_psms(searched(spark, folder), ["Methyl", "Label"], "REV", ["Acetyl"], 0.11, ["Label (K)"])
    return kept.select("id", "dataset", "scan", "modification")


@query("review_all", """WITH pk AS (SELECT DISTINCT l_orderkey AS spectrum, l_linenumber AS pos, l_partkey AS part, l_suppkey AS supp, l_extendedprice / 50 AS mz, l_quantity AS intensity FROM lineitem),
psm AS (SELECT o_orderkey AS spectrum, any_value(1 - o_totalprice / 1000000) AS main, min(o_custkey) AS c FROM orders GROUP BY 1),
f AS (SELECT spectrum, 1 AS imp, 14.0 + c % 2 AS mass, [(spectrum % 10)::BIGINT, (1 + c % 8)::BIGINT] AS sites, [14.0 + c % 2, 42.0] AS masses FROM psm UNION ALL SELECT spectrum, 2, 42.0, [(1 + c % 8)::BIGINT], [42.0] FROM psm),
hit AS (SELECT DISTINCT spectrum, 1 + supp % 2 AS imp, 1 + part % 2 AS type, pos FROM pk WHERE part % 3 = 0),
g AS (SELECT spectrum, imp, type, count(*) AS n, sum(brk) + (max(pos) < 7)::INT AS gaps FROM (SELECT *, (pos - coalesce(lag(pos) OVER (PARTITION BY spectrum, imp, type ORDER BY pos), 0) > 1)::INT AS brk FROM hit) GROUP BY ALL),
l AS (SELECT spectrum, imp, sum(n - 0.5 * gaps) AS runs FROM g GROUP BY ALL),
u AS (SELECT f.spectrum, f.imp, least(greatest(s, 1), 8) AS s FROM f, unnest(f.sites) AS t(s)),
b AS (SELECT row_number() OVER () AS k, u.*, x.edge, CASE WHEN s - 1 + edge BETWEEN 1 AND 7 THEN 1 ELSE 0 END AS needed, s - 1 + edge AS border FROM u, (VALUES (0), (1)) x(edge)),
kn AS (SELECT b.k, any_value(b.spectrum) AS spectrum, any_value(b.imp) AS imp, any_value(b.needed) AS needed, count(h.pos) > 0 AS known FROM b LEFT JOIN hit h ON h.spectrum = b.spectrum AND h.imp = b.imp AND ((h.type = 1 AND h.pos = b.border) OR (h.type = 2 AND h.pos = 8 - b.border)) GROUP BY b.k),
loc AS (SELECT spectrum, imp, CASE WHEN sum(needed) > 0 THEN (sum(known::INT) / sum(needed) - 0.75) / 0.25 END AS localisation FROM kn GROUP BY ALL),
forms AS (SELECT f.spectrum, min(NOT (list_contains(f.sites, 8) AND f.masses[list_position(f.sites, 8)] < 14.0266)) AS enzyme, avg(coalesce(runs, 0) / 14) AS ladder, avg(localisation) AS localisation FROM f LEFT JOIN l USING (spectrum, imp) JOIN loc USING (spectrum, imp) GROUP BY 1),
z AS (SELECT pk.*, 400.0 + c % 800 AS pre, max(intensity) OVER (PARTITION BY spectrum) AS high FROM pk JOIN psm USING (spectrum)),
y AS (SELECT *, CASE WHEN mz < pre - 50 AND pre - 50 - 100 * (ceil((pre - 50 - mz) / 100) - 1) > 300 THEN -ceil((pre - 50 - mz) / 100) WHEN mz >= pre + 50 THEN floor((mz - pre - 50) / 100) END AS bin FROM z),
x AS (SELECT *, max(intensity) OVER (PARTITION BY spectrum, bin) AS top, CASE WHEN bin < 0 THEN 0.6 ELSE 0.3 END::DOUBLE AS share FROM y),
un AS (SELECT spectrum, 1 - coalesce(sum((intensity - share * top) / ((1 - share) * top)) FILTER (bin IS NOT NULL AND part % 3 <> 0 AND intensity > share * top AND intensity > 0.1::DOUBLE * high), 0) AS unmatched FROM x GROUP BY 1)
SELECT spectrum, enzyme, round(main, 8) AS main, round(ladder, 6) AS ladder, round(localisation, 6) AS localisation, round(unmatched, 5) + 0.0 AS unmatched FROM psm JOIN forms USING (spectrum) LEFT JOIN un USING (spectrum)""")
def review_all(spark, folder):
    """All five scores; orders are matches with two forms each, lines their peaks, every third part an ion that meets one."""
    lines = peaks(spark, folder).select("spectrum", "pos", "part", "supp", (F.col("mz") / 50).alias("mz"), "intensity")
    base = spread(lines, "spectrum").distinct()
    base = base.withColumn("peak", F.struct("pos", "part", "supp", "mz", "intensity"))
    hit = base.where("part % 3 = 0").select("spectrum", (1 + F.col("supp") % 2).alias("imp"), (1 + F.col("part") % 2).alias("type"), "pos", "peak")
    orders = table(spark, folder, "orders").groupBy(F.col("o_orderkey").alias("spectrum")).agg(F.max("o_totalprice").alias("score"), F.min("o_custkey").alias("c"))
    psm = orders.select("spectrum", "score", (400.0 + F.col("c") % 800).alias("precursor_mz"))
    place = 1 + F.col("c") % 8
    two = F.array(F.struct(F.lit(1).alias("imp"), F.array(F.col("spectrum") % 10, place).alias("sites"), F.array(14.0 + F.col("c") % 2, F.lit(42.0)).alias("masses")), F.struct(F.lit(2).alias("imp"), F.array(place).alias("sites"), F.array(F.lit(42.0)).alias("masses")))
    forms = orders.select("spectrum", F.inline(two)).withColumn("length", F.lit(8).cast("long"))
    got = review.review_scores(psm, forms, base, hit, 0.0, 1_000_000.0, high_is_better=False)
    return got.select("spectrum", (F.col("enzyme") > 0).alias("enzyme"), F.round("main", 8).alias("main"), *[F.round(c, 6).alias(c) for c in ("ladder", "localisation")], (F.round("unmatched", 5) + 0.0).alias("unmatched"))


@query("search_results", """WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 AS file, o_custkey AS c, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 8 <= 5)
SELECT 'f' || file AS file, 'f' || file || '.raw' AS dataset, c AS scan, 'run.' || c || '.' || k AS spectrum, (1 + k % 4)::INT AS charge, price AS calc_neutral_pepmass, round(price - 0.5, 2) AS precursor_neutral_mass, (k % 30)::INT AS num_match_ions,
  'P' || c || ',Q' || k AS protein, ['Carb (C),Tag (N-term)', 'Carb (C),Ox (M)', 'Carb (C),Tag (N-term),Ox (M)', 'Tag (N-term),Ox (M),Acetyl (K)'][1 + k % 4] AS modification, ['2,0', '2,0', '2,0,4', '0,2,4'][1 + k % 4] AS modificationlocation FROM o""")
def search_results(spark, folder):
    """Orders written as lines of result files, one file for each fiftieth of the customers, and parsed back; the N-terminal variable one replaces the fixed one."""
    from modspec.sources.readers import search_dat_rows

    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("file"), F.col("o_custkey").alias("c"), F.round("o_totalprice", 2).alias("price"))
    places = F.element_at(F.array(*[F.lit(x) for x in ("0000000", "1000000", "0000100", "0010200")]), (F.col("k") % 4 + 1).cast("int"))
    row = F.format_string('q%d_p1=%d,%.2f,-0.5,%d,ACDMK,8,%s,20.5,000,0,0;"P%d x":0:1:5:1,"Q%d":0:1:5:1', "k", F.col("k") % 8, "price", F.col("k") % 30, places, "c", "k")
    texts = [row, F.format_string('Content-Type: application/x-result; name="query%d"', "k"), F.format_string("title=run%%2e%d%%2e%d", "c", "k"), F.format_string("charge=%d+", 1 + F.col("k") % 4)]
    body = o.select("file", "k", F.posexplode(F.array(*texts)).alias("at", "line"))
    body = body.select("file", F.struct(F.when(F.col("at") == 0, 1).otherwise(2).alias("part"), "k", "at").alias("ord"), "line")
    head = o.select("file").distinct().select("file", F.posexplode(F.array(F.lit("MODS=Carb (C),Tag (N-term)"), F.concat(F.lit("FILE=D:\\in\\"), "file", F.lit(".raw")), F.lit("IT_MODS=Ox (M),Acetyl (K)"))).alias("at", "line"))
    head = head.select("file", F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("k"), "at").alias("ord"), "line")
    got = search_dat_rows(head.unionByName(body))
    return got.select("file", "dataset", "scan", "spectrum", "charge", "calc_neutral_pepmass", F.round("precursor_neutral_mass", 2).alias("precursor_neutral_mass"), "num_match_ions", "protein", "modification", "modificationlocation")


@query("job_deconvolve_spectra")
def job_deconvolve_spectra(spark, folder):
    """From spectra and peaks to shares of forms: compositions, placements, ions, matches, dominance, abundances (mixtures of known shares are in the tests).

    Each order is a spectrum of the peptide that its first part's name spells,
    with one acetylation; each of its lines is a peak of the b or y series,
    every third one shifted by the modification.
    """
    from modspec.functions.constants import PROTON, WATER
    from modspec.operators import enumerate as E
    from modspec.operators.placements import base_masses, deconvolve_msms

    rules = [("acetyl", "L", 42.010565), ("acetyl", "E", 42.010565), ("methyl", "E", 14.01565)]
    name = table(spark, folder, "part").select(F.col("p_partkey").alias("part"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("peptide"))
    lines = peaks(spark, folder)
    spectra = lines.groupBy("spectrum").agg(F.min("part").alias("part")).join(name, "part")
    whole = F.aggregate(base_masses(F.col("peptide")), F.lit(WATER + 42.010565), lambda acc, m: acc + m)
    spectra = spectra.select("spectrum", "peptide", ((whole + 2 * PROTON) / 2).alias("precursor_mz"), F.lit(2).alias("charge"))
    fragments = E.fragment_ions(spectra.select("peptide").distinct(), [1], base_masses(F.col("peptide")), PROTON, WATER)
    at = lines.select("spectrum", F.col("pos").cast("int").alias("pos"), (1 + F.col("supp") % 2).cast("int").alias("type"), (F.col("part") % 3 == 0).alias("shifted"), "intensity").join(spectra.select("spectrum", "peptide"), "spectrum")
    seen = at.join(fragments, ["peptide", "type", "pos"]).select("spectrum", (F.col("mz") + F.when(F.col("shifted"), 42.010565).otherwise(0.0)).alias("mz"), "intensity")
    got = deconvolve_msms(spectra, seen, rules, 0.01, 0.02, lam=0.1)
    return got.select("spectrum", "imp", F.round("abundance", 4).alias("abundance"), "status", "rank_deficient")
