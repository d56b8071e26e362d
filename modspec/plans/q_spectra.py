"""Queries on peaks, matches and abundances."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.operators import filters, solve
from modspec.plans.adapters import peaks, psms, table
from modspec.plans.registry import query
from modspec.sources.store import spread

MATCH_SQL = "matches AS (SELECT l_orderkey AS spectrum, l_suppkey % 10 AS ion, l_linenumber AS imp, sum(l_quantity) AS raw FROM lineitem GROUP BY ALL), m AS (SELECT *, raw / max(raw) OVER (PARTITION BY spectrum) AS norm FROM matches)"


def matches(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("spectrum"), (F.col("l_suppkey") % 10).alias("ion"), F.col("l_linenumber").alias("imp"), "l_quantity")
    rows = spread(lines, "spectrum").groupBy("spectrum", "ion", "imp").agg(F.sum("l_quantity").alias("raw"))
    return filters.relative_intensity(rows, ["spectrum"], "raw", 0.0)


@query("relative_intensity", "SELECT l_orderkey AS spectrum, l_partkey AS part, l_suppkey AS supp, round(l_quantity / top, 9) AS norm FROM (SELECT *, max(l_quantity) OVER (PARTITION BY l_orderkey) AS top FROM lineitem) WHERE l_quantity >= 0.3 * top")
def relative_intensity(spark, folder):
    return filters.relative_intensity(peaks(spark, folder), ["spectrum"], "intensity", 0.3).select("spectrum", "part", "supp", F.round("norm", 9).alias("norm"))


@query("min_rows", "SELECT l_orderkey AS spectrum, l_partkey AS part, l_suppkey AS supp FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey) >= 5")
def min_rows(spark, folder):
    return filters.min_rows(peaks(spark, folder), ["spectrum"], 5).select("spectrum", "part", "supp")


@query("abundance_cut", f"WITH {MATCH_SQL}, v AS (SELECT spectrum, ion, imp, CASE WHEN raw < 0.3 * max(raw) OVER (PARTITION BY spectrum) THEN 0 ELSE raw END AS v FROM matches) SELECT spectrum, ion, imp, round(v / (sum(v) OVER (PARTITION BY spectrum) + 2.220446049250313e-16), 9) AS abundance FROM v")
def abundance_cut(spark, folder):
    return filters.abundance_cut(matches(spark, folder), ["spectrum"], "raw", 0.3).select("spectrum", "ion", "imp", F.round("abundance", 9).alias("abundance"))


@query("psm_status", f"WITH {MATCH_SQL}, n AS (SELECT spectrum, count(DISTINCT imp) AS c, count(*) FILTER (raw > 40) AS k FROM matches GROUP BY 1) SELECT spectrum, CASE WHEN c = 0 THEN 'no arrangement' WHEN c > 6 THEN 'too many' WHEN c = 1 THEN 'single' WHEN k = 0 THEN 'failed' ELSE 'solve' END AS status FROM n")
def psm_status(spark, folder):
    n = matches(spark, folder).groupBy("spectrum").agg(F.countDistinct("imp").alias("c"), F.count_if(F.col("raw") > 40).alias("k"))
    return n.select("spectrum", filters.psm_status(F.col("c"), F.col("k"), 6).alias("status"))


@query("chem_prior", """WITH p AS (SELECT o_orderkey AS id, ['m' || o_custkey % 3, 'm' || o_custkey % 4, 'm' || o_custkey % 5] AS mods, [o_custkey % 7, o_custkey % 8, o_custkey % 9] AS places FROM orders),
q AS (SELECT *, list_max(places) AS last FROM p) SELECT id FROM q WHERE len(list_distinct(mods)) <= 2 AND (last <> 6 OR ((places[1] <> 6 OR mods[1] IN ('m1')) AND (places[2] <> 6 OR mods[2] IN ('m1')) AND (places[3] <> 6 OR mods[3] IN ('m1'))))""")
def chem_prior(spark, folder):
    mod = lambda n: F.concat(F.lit("m"), (F.col("scan") % n).cast("string"))
    rows = psms(spark, folder).select("id", F.array(mod(3), mod(4), mod(5)).alias("mods"), F.array(*[F.col("scan") % n for n in (7, 8, 9)]).alias("places"), F.lit(6).alias("len"))
    return filters.chem_prior(rows, "mods", "places", "len", ["m1"]).select("id")


@query("modified_filter", "WITH p AS (SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN '-' WHEN 1 THEN 'Oxidation (M)' WHEN 2 THEN 'Label;Label' ELSE 'Acetyl;Label' END AS m FROM orders) SELECT id, m FROM p WHERE m = 'Acetyl;Label'")
def modified_filter(spark, folder):
    m = F.when(F.col("scan") % 4 == 0, "-").when(F.col("scan") % 4 == 1, "Oxidation (M)").when(F.col("scan") % 4 == 2, "Label;Label").otherwise("Acetyl;Label")
    return psms(spark, folder).select("id", m.alias("m")).where(filters.modified(F.col("m"), ["Label"]))


@query("standard_filter", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND abs(o_totalprice - round(o_totalprice)) < 0.05 AND o_custkey % 3 = 1 AND o_custkey >= 100")
def standard_filter(spark, folder):
    """One standard: exact name, mass within a tolerance, charge and a floor of matched ions."""
    rows = psms(spark, folder).withColumn("off", F.col("score") - F.round("score")).withColumn("charge", F.col("scan") % 3)
    return filters.select_standard(rows, ("grp", "F"), ("off", 0.0), 0.05, ("charge", 1), ("scan", 100)).select("id")


@query("psm_flags", "SELECT s_suppkey, NOT contains(upper(s_name), '7') AS target, NOT (contains(s_name, '12') OR contains(s_name, '3')) AS in_group FROM supplier")
def psm_flags(spark, folder):
    target, group = filters.decoy_and_group(F.col("s_name"), F.col("s_name"), "7", ["12", "3"])
    return table(spark, folder, "supplier").select("s_suppkey", target.alias("target"), group.alias("in_group"))


@query("psm_projection", "SELECT o_orderkey AS id, o_orderpriority AS peptide, o_orderstatus AS protein, round(o_totalprice, 2) AS score FROM orders WHERE trim(o_orderpriority) <> ''")
def psm_projection(spark, folder):
    """Columns by name whatever their case, blank peptides dropped."""
    from modspec.sources.readers import column_named

    raw = table(spark, folder, "orders").toDF("Id", "Scan", "PROTEIN", "Score", "Date", "Peptide")
    return raw.where(F.trim(column_named(raw, "peptide")) != "").select(F.col("Id").alias("id"), column_named(raw, "peptide").alias("peptide"), column_named(raw, "protein").alias("protein"), F.round("Score", 2).alias("score"))


@query("protein_union", """WITH e AS (SELECT o_custkey AS peptide, o_orderkey AS ord, unnest(string_split(o_orderpriority || ',' || o_orderstatus || ', ', ',')) AS protein FROM orders),
f AS (SELECT peptide, trim(protein) AS protein, min(ord) AS first FROM e WHERE trim(protein) <> '' GROUP BY ALL) SELECT peptide, string_agg(protein, ';' ORDER BY first, protein) AS proteins FROM f GROUP BY 1""")
def protein_union(spark, folder):
    from modspec.sources.readers import peptide_proteins

    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("peptide"), F.col("o_orderkey").alias("ord"), F.concat("o_orderpriority", F.lit(","), "o_orderstatus", F.lit(", ")).alias("protein"))
    return peptide_proteins(rows).select("peptide", F.array_join("proteins", ";").alias("proteins"))


@query("histogram_mode", """WITH s AS (SELECT l_suppkey AS scan, log10(l_extendedprice) AS lg, l_extendedprice AS v FROM lineitem), b AS (SELECT scan, count(*) AS n, min(lg) AS lo, max(lg) AS hi FROM s GROUP BY 1),
k AS (SELECT scan, least(greatest(floor((lg - lo) / 0.08 + 0.5), 0), floor((hi - lo) / 0.08 + 1e-9))::BIGINT AS bin, count(*) AS c, any_value(lo) AS lo FROM s JOIN b USING (scan) WHERE n > 100 GROUP BY ALL),
r AS (SELECT scan, lo + bin * 0.08 AS center, row_number() OVER (PARTITION BY scan ORDER BY c DESC, bin) AS r FROM k)
SELECT scan, round(coalesce(10 ** center, 0), 4) AS baseline FROM b LEFT JOIN (SELECT * FROM r WHERE r = 1) USING (scan)""")
def histogram_mode(spark, folder):
    from modspec.operators.chrom import histogram_baseline

    rows = peaks(spark, folder).select(F.col("supp").alias("scan"), F.col("mz").alias("v"))
    return histogram_baseline(rows, ["scan"], "v").select("scan", F.round("baseline", 4).alias("baseline"))


@query("fragment_pivot", """SELECT l_linenumber AS pos, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS A, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS N, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS R FROM lineitem GROUP BY 1""")
def fragment_pivot(spark, folder):
    return solve.fragment_matrix(peaks(spark, folder), ["pos"], "l_returnflag", ["A", "N", "R"], "intensity")


@query("penalty_sdp", f"WITH {MATCH_SQL}, s AS (SELECT spectrum, imp, sum(norm) AS a, sum(ln(raw)) AS b, sum(sqrt(raw)) AS c, sum(exp(norm)) AS d FROM m GROUP BY 1, 2) SELECT spectrum, imp, round(a, 6) AS s_norm, round(b, 6) AS s_log, round(c, 6) AS s_sqrt, round(d, 6) AS s_exp, round(0.5 * (1 / a) / min(1 / a) OVER (PARTITION BY spectrum), 8) AS penalty FROM s")
def penalty_sdp(spark, folder):
    scored = solve.penalty(solve.sdp_scores(matches(spark, folder), ["spectrum"], "imp", "norm", "raw"), ["spectrum"], "s_norm", 0.5)
    return scored.select("spectrum", "imp", *[F.round(c, 6).alias(c) for c in ("s_norm", "s_log", "s_sqrt", "s_exp")], F.round("penalty", 8).alias("penalty"))  # at 6 digits some are ties


@query("penalty_ksdp", f"""WITH {MATCH_SQL}, q AS (SELECT *, ion % 2 AS kind, ion // 2 AS pos FROM m), i AS (SELECT spectrum, imp, sum(norm) AS s FROM q GROUP BY 1, 2),
g AS (SELECT i.spectrum, i.imp, s, kind, pos FROM i JOIN (SELECT DISTINCT spectrum, kind FROM q) USING (spectrum) JOIN (SELECT DISTINCT spectrum, pos FROM q) USING (spectrum)),
w AS (SELECT g.*, sum((h.spectrum IS NULL)::INT) OVER (PARTITION BY g.spectrum, g.imp, g.kind ORDER BY g.pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS miss FROM g LEFT JOIN (SELECT DISTINCT spectrum, imp, kind, pos FROM q) h USING (spectrum, imp, kind, pos))
SELECT spectrum, imp, round(any_value(s) * sqrt(sum(exp(-0.9 * miss))) / count(*), 6) AS score FROM w GROUP BY 1, 2""")
def penalty_ksdp(spark, folder):
    rows = matches(spark, folder).withColumn("kind", F.col("ion") % 2).withColumn("pos", F.floor(F.col("ion") / 2))
    return solve.ksdp_scores(rows, ["spectrum"], "imp", "kind", "pos", "norm").select("spectrum", "imp", F.round("score", 6).alias("score"))


@query("penalty_hyperscore", f"""WITH {MATCH_SQL}, s AS (SELECT spectrum, imp, count(*) FILTER (ion % 2 = 0) AS nb, count(*) FILTER (ion % 2 = 1) AS ny, sum(raw) FILTER (ion % 2 = 0) AS ib, sum(raw) FILTER (ion % 2 = 1) AS iy FROM m GROUP BY 1, 2)
SELECT spectrum, imp, round(CASE WHEN nb > 0 THEN log10(gamma(nb + 1)) + ln(ib) ELSE 0 END + CASE WHEN ny > 0 THEN log10(gamma(ny + 1)) + ln(iy) ELSE 0 END, 6) AS score FROM s""")
def penalty_hyperscore(spark, folder):
    return solve.hyperscores(matches(spark, folder), ["spectrum"], "imp", F.col("ion") % 2 == 0, "raw").select("spectrum", "imp", F.round("score", 6).alias("score"))


def _penalty_sql(score: str) -> str:
    least = f"min(1 / nullif({score}, 0)) OVER (PARTITION BY spectrum)"
    return f"round(CASE WHEN {score} <> 0 THEN 0.5 * (1 / nullif({score}, 0)) / {least} WHEN {least} IS NOT NULL THEN 1e30 ELSE 0.5 END, 8)"


@query("penalty_modes", f"""WITH {MATCH_SQL}, q AS (SELECT *, ion % 2 AS kind, ion // 2 AS pos, ion % 3 AS series FROM m),
f AS (SELECT spectrum, imp, sum(ln(raw)) AS logs, sum(sqrt(raw)) AS roots, sum(norm) AS norms, sum(sqrt(norm)) AS small_roots, sum(exp(norm)) AS exps, count(*) AS n,
count(*) FILTER (series = 1) AS nb, count(*) FILTER (series = 2) AS ny, sum(raw) FILTER (series = 1) AS ib, sum(raw) FILTER (series = 2) AS iy FROM q GROUP BY 1, 2),
a AS (SELECT spectrum, count(DISTINCT ion) AS n_all FROM q GROUP BY 1), g AS (SELECT f.spectrum, f.imp, k.kind, p.pos FROM f, range(2) k(kind), range(5) p(pos)),
w AS (SELECT g.*, sum((q.ion IS NULL)::INT) OVER (PARTITION BY g.spectrum, g.imp, g.kind ORDER BY g.pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS miss FROM g LEFT JOIN q USING (spectrum, imp, kind, pos)),
r AS (SELECT spectrum, imp, sqrt(sum(exp(-0.9 * miss))) / 10 AS root FROM w GROUP BY 1, 2),
s AS (SELECT spectrum, imp, logs, roots, small_roots * root AS ladder, (exps + n_all - n) * root AS ladder_exp, sqrt(norms * root) AS ladder_root,
CASE WHEN nb > 0 THEN log10(gamma(nb + 1)) + ln(ib) ELSE 0 END + CASE WHEN ny > 0 THEN log10(gamma(ny + 1)) + ln(iy) ELSE 0 END AS hyper FROM f JOIN r USING (spectrum, imp) JOIN a USING (spectrum))
SELECT spectrum, imp, {_penalty_sql('logs')} AS p_log, {_penalty_sql('roots')} AS p_sqrt, {_penalty_sql('ladder')} AS p_ladder, {_penalty_sql('ladder_exp')} AS p_ladder_exp, {_penalty_sql('ladder_root')} AS p_ladder_root, {_penalty_sql('hyper')} AS p_hyper FROM s""")
def penalty_modes(spark, folder):
    """Penalties of each form by six of the nine modes, the ladder over ten ions of two kinds in every spectrum."""
    rows = matches(spark, folder).withColumn("kind", F.col("ion") % 2).withColumn("pos", F.floor(F.col("ion") / 2)).withColumn("series", F.col("ion") % 3)
    grid = rows.select("spectrum").distinct().withColumn("ion", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("spectrum", (F.col("ion") % 2).cast("long").alias("kind"), F.floor(F.col("ion") / 2).alias("pos"))
    modes = {"p_log": ("log_intens_sum", ""), "p_sqrt": ("sqrt_intens_sum", ""), "p_ladder": ("sqrt_intens_ksdp", "sqrt_intens_sum"), "p_ladder_exp": ("exp_intens_ksdp", "exp_intens_sum"), "p_ladder_root": ("sqrt_intens_ksdp_sqrt", "intens_sum"), "p_hyper": (solve.HYPERSCORE, "")}
    out = solve.mode_scores(rows, ["spectrum"], "imp", modes, "ion", "kind", "series", "pos", "norm", "raw", grid)
    for name in modes:
        out = solve.penalty(out, ["spectrum"], name, 0.5, name)
    return out.select("spectrum", "imp", *[F.round(name, 8).alias(name) for name in modes])


@query("gram_matrix", f"WITH {MATCH_SQL} SELECT a.spectrum, a.imp AS i, b.imp AS j, round(sum(a.norm * b.norm), 6) AS h FROM m a JOIN m b ON a.spectrum = b.spectrum AND a.ion = b.ion AND a.imp <= b.imp GROUP BY 1, 2, 3")
def gram_matrix(spark, folder):
    return solve.gram_matrix(matches(spark, folder), ["spectrum"], "ion", "imp", "norm").select("spectrum", "i", "j", F.round("h", 6).alias("h"))


def _abundance(spark, folder):
    rows = matches(spark, folder)
    x = rows.select("spectrum", "ion", "imp", F.lit(1.0).alias("x"))
    y = rows.groupBy("spectrum", "ion").agg(F.sum("norm").alias("y"))
    return solve.estimate_abundance(x, y, "spectrum", "ion", "imp", "x", "y", 0.5)


@query("abundance_kkt", f"""WITH {MATCH_SQL}, y AS (SELECT spectrum, ion, sum(norm) AS y FROM m GROUP BY 1, 2), xy AS (SELECT m.spectrum, m.imp, sum(y) AS p FROM m JOIN y USING (spectrum, ion) GROUP BY 1, 2)
SELECT spectrum, count(*) AS n_forms, round(sum(p), 5) AS xy, round(max(p), 5) AS top, true AS kkt_ok, true AS sums_ok FROM xy GROUP BY 1""")
def abundance_kkt(spark, folder):
    """The right side X'y that the solver was given, a certificate that each spectrum's solution is optimal, and that its shares sum to 1 (or 0)."""
    s = F.sum("abundance")
    return _abundance(spark, folder).groupBy("spectrum").agg(
        F.count("*").alias("n_forms"), F.round(F.sum("xy"), 5).alias("xy"), F.round(F.max("xy"), 5).alias("top"), (F.max("kkt") < 1e-6).alias("kkt_ok"), ((F.abs(s - 1) < 1e-9) | (s == 0)).alias("sums_ok"))


@query("abundance_penalty", f"""WITH {MATCH_SQL}, s AS (SELECT spectrum, imp, sum(norm) AS a FROM m GROUP BY 1, 2), p AS (SELECT spectrum, imp, 0.5 * (1 / a) / min(1 / a) OVER (PARTITION BY spectrum) AS penalty FROM s)
SELECT spectrum, count(*) AS n_forms, round(max(penalty), 8) AS penalty, true AS kkt_ok, true AS sums_ok FROM p GROUP BY 1""")
def abundance_penalty(spark, folder):
    """Solutions whose penalty is each form's own, from its summed intensity, with their certificate."""
    rows = matches(spark, folder)
    x = rows.select("spectrum", "ion", "imp", F.lit(1.0).alias("x"))
    y = rows.groupBy("spectrum", "ion").agg(F.sum("norm").alias("y"))
    p = solve.penalty(solve.sdp_scores(rows, ["spectrum"], "imp", "norm", "raw"), ["spectrum"], "s_norm", 0.5)
    got = solve.estimate_abundance(x, y, "spectrum", "ion", "imp", "x", "y", 1.0, p).join(p.select("spectrum", "imp", "penalty"), ["spectrum", "imp"])
    s = F.sum("abundance")
    return got.groupBy("spectrum").agg(F.count("*").alias("n_forms"), F.round(F.max("penalty"), 8).alias("penalty"), (F.max("kkt") < 1e-6).alias("kkt_ok"), ((F.abs(s - 1) < 1e-9) | (s == 0)).alias("sums_ok"))


@query("row_weights", f"""WITH {MATCH_SQL}, o AS (SELECT spectrum, ion, sum(norm) AS norm, sum(raw) AS raw FROM m GROUP BY 1, 2), t AS (SELECT DISTINCT spectrum, k AS ion, k % 3 AS cls FROM m, range(10) r(k)),
j AS (SELECT t.*, norm, raw, sqrt(raw) / max(sqrt(raw)) OVER (PARTITION BY spectrum) AS root FROM t LEFT JOIN o USING (spectrum, ion)),
w AS (SELECT *, count(norm) OVER c AS seen, count(*) OVER c AS n, sum(norm) OVER c AS total, sum(root) OVER c AS roots FROM j WINDOW c AS (PARTITION BY spectrum, cls))
SELECT spectrum, ion, round(total / n, 6) AS w_class, round(total / seen, 6) AS w_observed, round(roots / n, 6) AS w_sqrt FROM w WHERE seen > 0""")
def row_weights(spark, folder):
    """Weights of the design's rows in three modes, ten ions in three classes for each spectrum."""
    rows = matches(spark, folder)
    seen = rows.groupBy("spectrum", "ion").agg(F.sum("norm").alias("norm"), F.sum("raw").alias("raw"))
    all_ions = rows.select("spectrum").distinct().withColumn("ion", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).withColumn("cls", F.col("ion") % 3)
    out = None
    for mode in ("class", "observed", "sqrt"):
        one = solve.row_weights(all_ions, seen, "spectrum", "ion", "cls", "norm", "raw", mode).select("spectrum", "ion", F.round("weight", 6).alias(f"w_{mode}"))
        out = one if out is None else out.join(one, ["spectrum", "ion"])
    return out


@query("abundance_efficiency")
def abundance_efficiency(spark, folder):
    """Abundances with an efficiency of each class of ions (two classes), and the certificate."""
    rows = matches(spark, folder)
    seen = rows.groupBy("spectrum", "ion").agg(F.sum("norm").alias("norm"))
    classed = seen.select("spectrum", "ion", (F.col("ion") % 2).alias("cls"))
    imps, efficiency = solve.variable_efficiency(rows.select("spectrum", "ion", "imp"), classed, seen, "spectrum", "ion", "imp", "cls", "norm")
    s = F.sum("abundance")
    tops = efficiency.groupBy("spectrum").agg(F.max("efficiency").alias("top"))
    got = imps.groupBy("spectrum").agg(F.count("*").alias("n_forms"), (F.max("kkt") < 1e-6).alias("kkt_ok"), ((F.abs(s - 1) < 1e-9) | (s == 0)).alias("sums_ok"))
    return got.join(tops, "spectrum", "left")


@query("abundance_2imp", f"""WITH {MATCH_SQL}, t AS (SELECT DISTINCT spectrum, ion, 1 + imp % 2 AS imp FROM m), y AS (SELECT spectrum, ion, sum(norm) AS y FROM m GROUP BY 1, 2),
c AS (SELECT t.spectrum, count(*) FILTER (imp = 1) AS a, count(*) FILTER (imp = 2) AS b, sum(y) FILTER (imp = 1) AS p, sum(y) FILTER (imp = 2) AS q FROM t JOIN y USING (spectrum, ion) GROUP BY 1),
o AS (SELECT x.spectrum, count(*) AS o FROM t x JOIN t z ON x.spectrum = z.spectrum AND x.ion = z.ion AND x.imp = 1 AND z.imp = 2 GROUP BY 1),
s AS (SELECT c.spectrum, a, b, p, q, coalesce(o, 0) AS o FROM c LEFT JOIN o USING (spectrum) WHERE a > 0 AND b > 0 AND NOT (a = b AND coalesce(o, 0) = a)),
u AS (SELECT *, (p * b - q * o) / (a * b - o * o) AS x1, (q * a - p * o) / (a * b - o * o) AS x2 FROM s),
w AS (SELECT *, CASE WHEN x1 < 0 THEN 0 WHEN x2 < 0 THEN p / a ELSE x1 END AS w1, CASE WHEN x2 < 0 THEN 0 WHEN x1 < 0 THEN q / b ELSE x2 END AS w2 FROM u)
SELECT spectrum, round(w1 / (w1 + w2), 8) AS share FROM w""")
def abundance_2imp(spark, folder):
    """Odd and even forms of each spectrum as two, whose ions differ, against the closed form."""
    rows = matches(spark, folder).withColumn("imp", 1 + F.col("imp") % 2)
    x = rows.select("spectrum", "ion", "imp", F.lit(1.0).alias("x")).distinct()
    y = rows.groupBy("spectrum", "ion").agg(F.sum("norm").alias("y"))
    got = solve.estimate_abundance(x, y, "spectrum", "ion", "imp", "x", "y")
    both = got.where("not rank_deficient").groupBy("spectrum").agg(F.count("*").alias("n"), F.sum(F.when(F.col("imp") == 1, F.col("abundance")).otherwise(0.0)).alias("share")).where("n = 2")
    return both.select("spectrum", F.round("share", 8).alias("share"))


@query("rank_deficient")
def rank_deficient(spark, folder):
    """Whether the rank of the 0/1 design of all forms is below their number, by spectrum."""
    rows = matches(spark, folder)
    x = rows.select("spectrum", "ion", "imp", F.lit(1.0).alias("x"))
    y = rows.groupBy("spectrum", "ion").agg(F.sum("norm").alias("y"))
    return solve.estimate_abundance(x, y, "spectrum", "ion", "imp", "x", "y").groupBy("spectrum").agg(F.max("rank_deficient").alias("rank_deficient"))


@query("gather_psms", f"WITH {MATCH_SQL} SELECT spectrum, ion, imp, raw FROM m QUALIFY sum(CASE WHEN imp % 2 = 0 THEN raw ELSE 0 END) OVER (PARTITION BY spectrum, ion) > 0")
def gather_psms(spark, folder):
    return filters.gather(matches(spark, folder), ["spectrum", "ion"], "raw", F.col("imp") % 2 == 0).select("spectrum", "ion", "imp", "raw")
