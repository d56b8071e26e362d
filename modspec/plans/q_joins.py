"""Queries of the joins on nearness."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.operators import filters, joins
from modspec.plans.adapters import PEPTIDES_SQL, TRACE_SQL, ions, peaks, peptides, psms, table, trace
from modspec.plans.registry import query
from modspec.sources.runs import pair_files


@query("band_join", """SELECT l_orderkey AS spectrum, p_partkey AS ion, sum(l_quantity) AS intensity, count(*) AS n_peaks
FROM lineitem JOIN part ON abs(l_extendedprice - p_retailprice) <= 0.02 GROUP BY 1, 2""")
def band_join(spark, folder):
    met = joins.band_join(peaks(spark, folder), ions(spark, folder), "mz", "ion_mz", 0.02)
    return met.groupBy("spectrum", "ion").agg(F.sum("intensity").alias("intensity"), F.count("*").alias("n_peaks"))


@query("first_match", """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, p_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity ORDER BY p_type, p_size, p_partkey) AS r
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem) JOIN part ON abs(l_extendedprice - p_retailprice) < 0.15)
SELECT l_orderkey AS spectrum, l_linenumber AS pos, l_partkey AS part, l_suppkey AS supp, p_partkey AS ion FROM m WHERE r = 1""")
def first_match(spark, folder):
    key = ["spectrum", "pos", "part", "supp", "mz", "intensity"]
    found = joins.first_match(peaks(spark, folder).select(*key), ions(spark, folder), "mz", "ion_mz", 0.15, [F.col("type"), F.col("cls"), F.col("ion")])
    return found.select(*key, "ion").distinct().select("spectrum", "pos", "part", "supp", "ion")


@query("asof_join", f"""WITH {TRACE_SQL} SELECT v.id, c.id AS ms1_id, c.rt AS ms1_rt FROM (SELECT * FROM trace WHERE run = 'view') v ASOF JOIN (SELECT * FROM trace WHERE run = 'click') c ON v.grp = c.grp AND v.rt >= c.rt""")
def asof_join(spark, folder):
    t = trace(spark, folder)
    got = joins.asof_join(t.where("run = 'view'").select("id", "grp", "rt"), t.where("run = 'click'").withColumn("at", F.col("rt")), ["grp"], "rt", {"id": "ms1_id", "at": "ms1_rt"}, "id")
    return got.select("id", "ms1_id", "ms1_rt")


@query("nearest_join", f"""WITH {TRACE_SQL}, g AS (SELECT grp, rt, row_number() OVER (PARTITION BY grp ORDER BY rt, id) AS i FROM trace WHERE run = 'click'),
d AS (SELECT p.id, g.i, abs(p.rt - g.rt) AS err, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.rt - g.rt), g.i) AS r FROM (SELECT * FROM trace WHERE run = 'purchase') p JOIN g USING (grp))
SELECT id, CASE WHEN err <= 500 THEN i END AS i FROM d WHERE r = 1""")
def nearest_join(spark, folder):
    from pyspark.sql import Window

    t = trace(spark, folder)
    grid = t.where("run = 'click'").select("grp", "rt", F.row_number().over(Window.partitionBy("grp").orderBy("rt", "id")).alias("i"))
    return joins.nearest_join(t.where("run = 'purchase'").select("id", "grp", "rt"), grid, ["grp"], "rt", "i", 500.0).select("id", "i")


@query("subset_elimination", """WITH m AS (SELECT DISTINCT l_orderkey AS spectrum, l_linenumber AS imp, l_suppkey % 10 AS ion FROM lineitem),
s AS (SELECT spectrum, imp, list_sort(list(ion)) AS ions FROM m GROUP BY 1, 2)
SELECT spectrum, imp FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.spectrum = s.spectrum AND o.imp <> s.imp AND len(o.ions) > len(s.ions) AND list_has_all(o.ions, s.ions))""")
def subset_elimination(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("spectrum"), F.col("l_linenumber").alias("imp"), (F.col("l_suppkey") % 10).alias("ion"))
    return joins.drop_dominated(rows, "spectrum", "imp", "ion")


@query("locate_substring", """WITH hit AS (SELECT item_id, doc_id, b.text AS needle, d.text AS hay FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0)
SELECT item_id, doc_id, pos FROM (SELECT item_id, doc_id, needle, hay, unnest(list_filter(range(1, length(hay) - length(needle) + 2), lambda p: substr(hay, p, length(needle)) = needle)) AS pos FROM hit)""")
def locate_substring(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("needle")).where("length(needle) > 0")
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("hay"))
    return joins.locate_substrings(items, docs, "item_id", "needle", "doc_id", "hay").select("item_id", "doc_id", F.col("pos").cast("long").alias("pos"))


@query("terminus_flags", """WITH hit AS (SELECT item_id, doc_id, instr(d.text, b.text) AS pos, length(b.text) AS n, length(d.text) AS len, d.text LIKE 'M%' AS m FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY doc_id, pos) AS r FROM hit)
SELECT item_id, doc_id, pos = 1 OR (pos = 2 AND m) AS is_n, pos + n - 1 = len AS is_c FROM f WHERE r = 1""")
def terminus_flags(spark, folder):
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("needle")).where("length(needle) > 0")
    docs = table(spark, folder, "documents").select("doc_id", F.col("text").alias("hay"))
    found = joins.locate_substrings(items, docs, "item_id", "needle", "doc_id", "hay").join(items.select("item_id", F.length("needle").alias("n")), "item_id")
    return joins.terminus_flags(found, docs, "item_id", "n", "doc_id", "hay")


@query("locate_peptides", """WITH pep AS (SELECT DISTINCT split_part(p_name, ' ', 1)[1:2] AS peptide, p_brand AS protein FROM part UNION SELECT DISTINCT 'a', 'Brand#' || p_size FROM part),
prot AS (SELECT p_brand AS protein, string_agg(p_name, '' ORDER BY p_partkey) AS sequence FROM part GROUP BY 1),
j AS (SELECT pep.protein, peptide, sequence FROM pep LEFT JOIN prot USING (protein) WHERE length(peptide) > 0)
SELECT protein, peptide, unnest(list_filter(range(1, length(sequence) - length(peptide) + 2), lambda p: substr(sequence, p, length(peptide)) = peptide)) AS pos FROM j WHERE sequence IS NOT NULL
UNION ALL SELECT DISTINCT protein, NULL, NULL FROM j WHERE sequence IS NULL""")
def locate_peptides(spark, folder):
    """Beginnings of part names in the joined names of their brand, and listed brands that no part has (peptide and pos null)."""
    part = table(spark, folder, "part")
    listed = part.select(F.substring(F.substring_index("p_name", " ", 1), 1, 2).alias("peptide"), F.col("p_brand").alias("protein"))
    listed = listed.union(part.select(F.lit("a"), F.concat(F.lit("Brand#"), F.col("p_size").cast("string"))))
    peptides = listed.groupBy("peptide").agg(F.collect_set("protein").alias("proteins"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "")
    found, unknown = joins.locate_peptides(peptides, part.groupBy(F.col("p_brand").alias("protein")).agg(joined.alias("sequence")))
    return found.select("protein", "peptide", F.col("pos").cast("long").alias("pos")).union(unknown.select("protein", F.lit(None).cast("string"), F.lit(None).cast("long")))


@query("target_semi", "SELECT o_orderkey AS id, o_custkey AS scan FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def target_semi(spark, folder):
    wanted = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("scan"))
    return filters.of_targets(psms(spark, folder).where("grp = 'F'"), wanted, "scan").select("id", "scan")


@query("pair_keys", f"""WITH {PEPTIDES_SQL}, files AS (SELECT peptide, peptide || CASE length(peptide) % 3 WHEN 0 THEN '_HCDFT' WHEN 1 THEN '_CIDIT' ELSE '' END AS stem FROM peptides),
runs AS (SELECT peptide AS run FROM peptides WHERE length(peptide) % 2 = 0 UNION SELECT stem FROM files WHERE length(peptide) % 2 = 1)
SELECT stem, min(run) AS run, count(DISTINCT run) AS n_found FROM files LEFT JOIN runs ON run = stem OR run = regexp_replace(stem, '_(HCDFT|HCDIT|CIDFT|CIDIT)$', '') GROUP BY stem""")
def pair_keys(spark, folder):
    suffix = F.when(F.length("peptide") % 3 == 0, "_HCDFT").when(F.length("peptide") % 3 == 1, "_CIDIT").otherwise("")
    files = peptides(spark, folder).select("peptide", F.concat("peptide", suffix).alias("stem"))
    runs = files.where("length(peptide) % 2 = 0").select(F.col("peptide").alias("run")).union(files.where("length(peptide) % 2 = 1").select("stem")).distinct()
    return pair_files(files, runs)
