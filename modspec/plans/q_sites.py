"""Queries of the site tables and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.functions.constants import PROTON
from modspec.functions.scalars import strip_tokens
from modspec.operators import sites, windows
from modspec.plans.adapters import SITES_SQL, n_lines, site_rows, table
from modspec.plans.registry import query
from modspec.sources.store import spread_beyond

_WANTED = "CAST(replace(protein, 'Supplier#', '') AS INT) % 3 <> 0"
_KNOWN = "CAST(replace(brand, 'Brand#', '') AS INT) % 5 <> 0"
SITED_SQL = f"""{SITES_SQL}, sited AS (SELECT *, 'P' || CAST(replace(protein, 'Supplier#', '') AS INT) || substr(replace(split_part(imp, '{{', 1), '_', ''), length(split_part(imp, '{{', 1)) - 1, 1)
  || (10 + length(split_part(imp, '{{', 1)) - 1 - 2) || replace(brand, 'Brand#', 'm') AS site FROM site_rows WHERE {_WANTED} AND {_KNOWN})"""


def _wanted(spark, folder):
    supplier = table(spark, folder, "supplier").select(F.col("s_name").alias("protein"), F.replace("s_name", F.lit("Supplier#"), F.lit("")).cast("int").alias("n"))
    return supplier.where("n % 3 <> 0").select("protein", F.concat(F.lit("P"), F.col("n").cast("string")).alias("prot_abbr"))


def _mods(spark, folder):
    brands = table(spark, folder, "part").select(F.col("p_brand").alias("mod")).distinct()
    return brands.where("cast(replace(mod, 'Brand#', '') as int) % 5 <> 0").select("mod", F.replace("mod", F.lit("Brand#"), F.lit("m")).alias("mod_abbr"))


def sited(spark, folder):
    rows = site_rows(spark, folder).withColumn("start", F.lit(10))
    return sites.parse_sites(rows, _wanted(spark, folder), _mods(spark, folder))


@query("site_parse", f"WITH {SITED_SQL} SELECT site, imp, charge, run, count(*) AS n FROM sited GROUP BY ALL")
def site_parse(spark, folder):
    return sited(spark, folder).groupBy("site", "imp", "charge", "run").agg(F.count("*").alias("n"))


@query("site_summary", f"WITH {SITED_SQL} SELECT site, sum(area) AS total, count(*) AS n_rows FROM sited GROUP BY site")
def site_summary(spark, folder):
    return sites.site_summary(sited(spark, folder))


@query("site_uninterested", f"WITH {SITES_SQL} SELECT protein, imp, charge, run, sum(area) AS area FROM site_rows WHERE NOT ({_WANTED}) GROUP BY ALL")
def site_uninterested(spark, folder):
    left = sites.uninterested(site_rows(spark, folder), _wanted(spark, folder))
    return left.groupBy("protein", "imp", "charge", "run").agg(F.sum("area").alias("area"))


def _samples(spark, folder):
    rows = site_rows(spark, folder).withColumnRenamed("protein", "site")
    return rows.where("run = 'O'"), rows.where("run = 'F'")


_PAIR = """WITH {sites}, l AS (SELECT protein AS site, replace(imp, 'RING', '') AS imp, charge, sum(area) AS q_left FROM site_rows WHERE run = 'O' GROUP BY ALL),
r AS (SELECT protein AS site, replace(imp, 'RING', '') AS imp, charge, sum(area) AS q_right FROM site_rows WHERE run = 'F' GROUP BY ALL)"""


@query("pair_intersect", _PAIR.format(sites=SITES_SQL) + " SELECT site, imp, charge, q_left, q_right FROM l JOIN r USING (site, imp, charge)")
def pair_intersect(spark, folder):
    return sites.pair_intersect(*_samples(spark, folder), labels=("RING",))


PAIRS_SQL = f"""{SITES_SQL}, pairs AS (SELECT charge AS pair, protein AS site, imp, brand AS charge, sum(CASE WHEN run = 'O' THEN area ELSE 0 END) AS q_left, sum(CASE WHEN run = 'F' THEN area ELSE 0 END) AS q_right FROM site_rows GROUP BY ALL)"""


def pairs(spark, folder):
    side = lambda r: F.sum(F.when(F.col("run") == r, F.col("area")).otherwise(0.0))
    # sums by these and more columns are made where the rows lie
    rows = spread_beyond(site_rows(spark, folder), n_lines(spark, folder), "protein", "imp", "brand")
    return rows.groupBy(F.col("charge").alias("pair"), F.col("protein").alias("site"), "imp", F.col("brand").alias("charge")).agg(side("O").alias("q_left"), side("F").alias("q_right"))


@query("pairs_pivot", f"""WITH {PAIRS_SQL} SELECT site, imp, charge, {", ".join(f"sum(q_{s}) FILTER (pair = '{p}') AS {p}_{s}" for p in "ANR" for s in ("left", "right"))} FROM pairs GROUP BY ALL""")
def pairs_pivot(spark, folder):
    return sites.merge_pairs(pairs(spark, folder), ["A", "N", "R"])


@query("pair_totals", f"WITH {PAIRS_SQL} SELECT site, pair, sum(q_left) AS sum_left, sum(q_right) AS sum_right, round(CASE WHEN sum(q_left) <> 0 THEN sum(q_left) / sum(q_right) END, 9) AS ratio FROM pairs GROUP BY 1, 2")
def pair_totals(spark, folder):
    return sites.pair_totals(pairs(spark, folder)).withColumn("ratio", F.round("ratio", 9))


@query("site_union", f"WITH {SITES_SQL} SELECT protein AS site FROM site_rows WHERE charge = 'A' UNION SELECT protein FROM site_rows WHERE charge = 'R'")
def site_union(spark, folder):
    rows = site_rows(spark, folder)
    return rows.where("charge = 'A'").select(F.col("protein").alias("site")).union(rows.where("charge = 'R'").select("protein")).distinct()


@query("strip_labels", "SELECT p_partkey, replace(replace(replace(upper(p_name), 'RING', ''), 'BOLT', ''), ' ', '') AS stripped FROM part")
def strip_labels(spark, folder):
    return table(spark, folder, "part").select("p_partkey", strip_tokens(F.upper("p_name"), ("RING", "BOLT", " ")).alias("stripped"))


@query("mz_bounds", f"""WITH m AS (SELECT p_brand AS grp, p_size % 3 + 2 AS charge, (p_retailprice + (p_size % 3 + 2) * {PROTON}) / (p_size % 3 + 2) AS mz FROM part)
SELECT grp, charge, round(min(mz - mz * 10 * 1e-6), 8) AS low, round(max(mz + mz * 10 * 1e-6), 8) AS high FROM m GROUP BY 1, 2""")
def mz_bounds(spark, folder):
    imps = table(spark, folder, "part").select(F.col("p_brand").alias("grp"), (F.col("p_size") % 3 + 2).alias("charge"), F.col("p_retailprice").alias("mass"))
    return sites.mz_bounds(imps, ["grp"], "mass", "charge", 10.0, True, PROTON).select("grp", "charge", F.round("low", 8).alias("low"), F.round("high", 8).alias("high"))


@query("checked_lookup", f"""WITH {SITES_SQL}, imps AS (SELECT DISTINCT protein AS grp, imp, charge, run FROM site_rows), checked AS (SELECT imp, charge, run, min(area) AS rt_start, max(area) AS rt_end FROM site_rows WHERE area > 49 GROUP BY ALL),
have AS (SELECT DISTINCT grp FROM imps JOIN checked USING (imp, charge, run))
SELECT grp, imp, charge, run, rt_start, rt_end FROM imps JOIN have USING (grp) LEFT JOIN checked USING (imp, charge, run)""")
def checked_lookup(spark, folder):
    rows = site_rows(spark, folder)
    imps = rows.select(F.col("protein").alias("grp"), "imp", "charge", "run").distinct()
    checked = rows.where("area > 49").groupBy("imp", "charge", "run").agg(F.min("area").alias("rt_start"), F.max("area").alias("rt_end"))
    return sites.attach_checked(imps, checked, ["imp", "charge", "run"], "grp").select("grp", "imp", "charge", "run", "rt_start", "rt_end")


@query("best_checked", f"""WITH {SITES_SQL}, r AS (SELECT protein, imp, charge, run, area, area::INT % 4 AS label, row_number() OVER (PARTITION BY protein, imp, charge ORDER BY area::INT % 4 DESC, area, run) AS k FROM site_rows)
SELECT protein, imp, charge, area, label FROM r WHERE k = 1 AND label > 0""")
def best_checked(spark, folder):
    rows = site_rows(spark, folder).withColumn("label", F.col("area").cast("int") % 4)
    return windows.best_of(rows, ["protein", "imp", "charge"], [F.desc("label"), F.col("area"), F.col("run")]).where("label > 0").select("protein", "imp", "charge", "area", "label")
