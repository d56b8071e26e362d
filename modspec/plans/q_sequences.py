"""Queries of the sequence, mass and enumeration operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.functions import constants as K
from modspec.functions import scalars as S
from modspec.operators import enumerate as E
from modspec.plans.adapters import PEPTIDES_SQL, ions, peaks, peptides, table
from modspec.plans.registry import query

_CASES = " ".join(f"WHEN '{r}' THEN {m!r}" for r, m in K.RESIDUES.items())
_MASS = f"(CASE c {_CASES} ELSE 0 END)::DOUBLE"
CHARS_SQL = f"{PEPTIDES_SQL}, chars AS (SELECT peptide, i, substr(peptide, i, 1) AS c FROM peptides, generate_series(1, 30) t(i) WHERE i <= length(peptide))"
MODS = {"acetyl": 42.010565, "methyl": 14.01565}


@query("mass_arith", f"SELECT l_orderkey, l_linenumber, round(avg((l_extendedprice - {K.PROTON}) * (l_linenumber % 3 + 1)), 6) AS neutral, round(avg((l_extendedprice + (l_linenumber % 3 + 1) * {K.PROTON}) / (l_linenumber % 3 + 1)), 6) AS mz FROM lineitem GROUP BY 1, 2")
def mass_arith(spark, folder):
    z = F.col("pos") % 3 + 1
    rows = peaks(spark, folder).select(F.col("spectrum").alias("l_orderkey"), F.col("pos").alias("l_linenumber"), S.neutral_mass(F.col("mz"), z).alias("a"), S.mz_of(F.col("mz"), z).alias("b"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("a"), 6).alias("neutral"), F.round(F.avg("b"), 6).alias("mz"))


@query("tolerance_bounds", "SELECT p_partkey AS ion, round(p_retailprice - least(p_retailprice * 400 * 1e-6, 0.3), 8) AS low, round(p_retailprice + least(p_retailprice * 400 * 1e-6, 0.3), 8) AS high FROM part")
def tolerance_bounds(spark, folder):
    width = S.tolerance_da(F.col("ion_mz"), 400.0, True, 0.3)
    return ions(spark, folder).select("ion", F.round(F.col("ion_mz") - width, 8).alias("low"), F.round(F.col("ion_mz") + width, 8).alias("high"))


@query("accurate_mz", f"""WITH c AS (SELECT p_partkey AS ion, p_retailprice AS center, p_retailprice - p_size % 4 * 0.5 + 0.004 AS mono FROM part),
t AS (SELECT ion, center, mono + k * {K.ISOTOPE_SPACING} / 2 AS mz, row_number() OVER (PARTITION BY ion ORDER BY abs(mono + k * {K.ISOTOPE_SPACING} / 2 - center), mono + k * {K.ISOTOPE_SPACING} / 2) AS r FROM c, generate_series(-1, 8) g(k))
SELECT ion, round(CASE WHEN abs(mz - center) <= 0.01 THEN mz ELSE center END, 8) AS mz FROM t WHERE r = 1""")
def accurate_mz(spark, folder):
    rows = ions(spark, folder).withColumn("mono", F.col("ion_mz") - F.col("cls") % 4 * 0.5 + 0.004)
    return rows.select("ion", F.round(S.accurate_mz(F.col("ion_mz"), F.col("mono"), F.lit(2), K.ISOTOPE_SPACING, 0.01), 8).alias("mz"))


@query("category_code", """SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 2 WHEN 'error' THEN 4 END + CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS code FROM events""")
def category_code(spark, folder):
    act = F.when(F.col("event_type") == "click", "CID").when(F.col("event_type") == "view", "ETD").when(F.col("event_type") == "error", "HCD")
    return table(spark, folder, "events").select("event_id", S.fragmentation_code(act, F.when(F.col("user_id") % 2 == 0, "IT").otherwise("FT")).alias("code"))


@query("title_scan", r"SELECT page_id, TRY_CAST(trim(CASE WHEN contains(x, '.') THEN split_part(x, '.', 2) ELSE split_part(x, ':', 2) END) AS BIGINT) AS scan FROM (SELECT page_id, 'run.' || regexp_extract(url, '([0-9]+)', 1) || '.2' AS x FROM pages)")
def title_scan(spark, folder):
    title = F.concat(F.lit("run."), F.regexp_extract("url", "([0-9]+)", 1), F.lit(".2"))
    return table(spark, folder, "pages").select("page_id", S.scan_of_title(title).alias("scan"))


@query("imp_mass", f"""WITH {CHARS_SQL}, masses AS (SELECT peptide, sum({_MASS}) AS m FROM chars GROUP BY 1)
SELECT peptide, round(m + {K.WATER!r} + 42.010565 + CASE WHEN length(peptide) % 2 = 0 THEN 14.01565 ELSE 0 END, 6) AS mass FROM masses""")
def imp_mass(spark, folder):
    form = F.concat(F.lit("_{acetyl}"), "peptide", F.when(F.length("peptide") % 2 == 0, "{methyl}_").otherwise("_"))
    return peptides(spark, folder).select("peptide", F.round(S.imp_mass(form, MODS), 6).alias("mass"))


@query("imp_render", f"WITH {PEPTIDES_SQL} SELECT peptide, '_{{a}}' || substr(peptide, 1, 2) || '{{b}}' || substr(peptide, 3) || '_' AS imp FROM peptides")
def imp_render(spark, folder):
    return peptides(spark, folder).select("peptide", S.render_imp(F.col("peptide"), F.array(F.lit(0), F.lit(2)), F.array(F.lit("a"), F.lit("b"))).alias("imp"))


@query("mod_spec", """WITH s AS (SELECT p_partkey, unnest(string_split('acetyl[' || substr(upper(p_name), 1, 1) || '];methyl[' || substr(upper(p_name), 2, 1) || '](heavy[' || substr(upper(p_name), 2, 1) || '])', ';')) AS entry FROM part),
p AS (SELECT p_partkey, regexp_extract(entry, '^([^\\[(]+)\\[', 1) AS mod, regexp_extract(entry, '^[^\\[(]+\\[([^\\]]*)\\]', 1) AS specificity, nullif(regexp_extract(entry, '\\(([^\\[]+)\\[', 1), '') AS alias FROM s)
SELECT p_partkey, mod, specificity, alias, coalesce(alias, mod) || '[' || specificity || ']' AS full_name, CASE WHEN coalesce(alias, mod) || specificity = 'acetylS' THEN 42.010565 END AS mono_mass FROM p""")
def mod_spec(spark, folder):
    letter = lambda i: F.substr(F.upper("p_name"), F.lit(i), F.lit(1))
    spec = F.concat(F.lit("acetyl["), letter(1), F.lit("];methyl["), letter(2), F.lit("](heavy["), letter(2), F.lit("])"))
    mods = spark.range(1).select(F.lit("acetyl[S]").alias("full_name"), F.lit(42.010565).alias("mono_mass"))
    return E.parse_mod_spec(table(spark, folder, "part").select("p_partkey", spec.alias("spec")), "spec", mods).select("p_partkey", "mod", "specificity", "alias", "full_name", "mono_mass")


def _rules(spark):
    return spark.createDataFrame([("L", "acetyl"), ("L", "methyl"), ("E", "methyl"), ("T", "phospho")], "residue string, mod string")


@query("variable_sites", f"""WITH {CHARS_SQL}, rules(residue, mod) AS (VALUES ('L', 'acetyl'), ('L', 'methyl'), ('E', 'methyl'), ('T', 'phospho'))
SELECT peptide, c AS residue, (SELECT string_agg(mod, ',' ORDER BY mod) FROM rules WHERE residue = c) AS mods, string_agg(i, ',' ORDER BY i) AS sites FROM chars WHERE c IN ('L', 'E', 'T') GROUP BY peptide, c""")
def variable_sites(spark, folder):
    rows = E.variable_sites(peptides(spark, folder), _rules(spark))
    return rows.select("peptide", "residue", F.array_join("mods", ",").alias("mods"), F.array_join(F.col("sites").cast("array<string>"), ",").alias("sites"))


@query("fixed_mods", f"""WITH {CHARS_SQL}, hits AS (
SELECT peptide, i AS site, 1 AS ord, 'carbam' AS mod FROM chars WHERE c = 'L' UNION ALL SELECT peptide, 0, 2, 'tag' FROM peptides UNION ALL SELECT peptide, 1, 3, 'pyro' FROM peptides WHERE peptide LIKE 'L%' UNION ALL SELECT peptide, length(peptide) + 1, 4, 'amide' FROM peptides)
SELECT peptide, site, max_by(mod, ord) AS mod FROM hits GROUP BY 1, 2""")
def fixed_mods(spark, folder):
    rules = spark.createDataFrame([(1, "residue", "L", "carbam"), (2, "n_term", None, "tag"), (3, "n_term", "L", "pyro"), (4, "c_term", None, "amide")], "ord int, kind string, residue string, mod string")
    return E.fixed_mods(peptides(spark, folder), rules)


def _masses():
    table_ = F.create_map(*[F.lit(x) for p in K.RESIDUES.items() for x in p])
    return F.transform(F.split("peptide", ""), lambda r: F.coalesce(F.try_element_at(table_, r), F.lit(0.0)))


@query("fragment_ions", f"""WITH {CHARS_SQL}, m AS (SELECT peptide, i, {_MASS} AS m, length(peptide) AS n FROM chars),
f AS (SELECT p.peptide, 1 AS type, p.i AS pos, sum(q.m) AS mass FROM m p JOIN m q ON p.peptide = q.peptide AND q.i <= p.i WHERE p.i < p.n GROUP BY 1, 2, 3
UNION ALL SELECT p.peptide, 2, p.i, sum(q.m) + {K.WATER!r}::DOUBLE FROM m p JOIN m q ON p.peptide = q.peptide AND q.i > q.n - p.i WHERE p.i < p.n GROUP BY 1, 2, 3)
SELECT peptide, type, pos, z, round((mass + z * {K.PROTON}) / z, 6) AS mz FROM f, (VALUES (1), (2)) t(z)""")
def fragment_ions(spark, folder):
    return E.fragment_ions(peptides(spark, folder), [1, 2], _masses(), K.PROTON, K.WATER).select("peptide", "type", "pos", "z", F.round("mz", 6).alias("mz"))


def _sited(spark, folder):
    sites = E.sites_of(F.col("peptide"), "LE")
    return peptides(spark, folder).withColumn("sites", sites).withColumn("n_sites", F.size("sites")).where("n_sites > 0")


_SITED_SQL = f"{CHARS_SQL}, sited AS (SELECT peptide, count(*) AS n_sites FROM chars WHERE c IN ('L', 'E') GROUP BY 1)"
_COMP_SQL = f"""{_SITED_SQL}, comps AS (SELECT peptide, n_sites, a AS n_acetyl, m AS n_methyl FROM sited, generate_series(0, 10) s(a), generate_series(0, 10) t(m) WHERE a + m <= n_sites)"""
_MOD_LIST = [("acetyl", 42.010565, "LE"), ("methyl", 14.01565, "LE")]


@query("compositions", f"WITH {_COMP_SQL} SELECT peptide, n_acetyl, n_methyl, round(n_acetyl * 42.010565 + n_methyl * 14.01565, 6) AS delta FROM comps")
def compositions(spark, folder):
    return E.compositions(_sited(spark, folder), _MOD_LIST).select("peptide", F.col("n_acetyl").cast("long").alias("n_acetyl"), F.col("n_methyl").cast("long").alias("n_methyl"), F.round("delta", 6).alias("delta"))


@query("composition_join", f"""WITH {_COMP_SQL} SELECT p_partkey, peptide, n_acetyl, n_methyl FROM comps JOIN part ON abs(n_acetyl * 42.010565 + n_methyl * 14.01565 - (p_retailprice - 900)) < 0.06""")
def composition_join(spark, folder):
    from modspec.operators.joins import band_join

    psms = table(spark, folder, "part").select("p_partkey", (F.col("p_retailprice") - 900).alias("dm"))
    met = band_join(psms, E.compositions(_sited(spark, folder), _MOD_LIST), "dm", "delta", 0.06, inclusive=False)
    return met.select("p_partkey", "peptide", "n_acetyl", "n_methyl")


@query("candidate_caps", f"""WITH {_COMP_SQL} SELECT peptide, n_acetyl, n_methyl, round(gamma(n_sites + 1) / (gamma(n_acetyl + 1) * gamma(n_methyl + 1) * gamma(n_sites - n_acetyl - n_methyl + 1)))::BIGINT AS n,
CASE WHEN n_sites > 10 THEN 'too many sites' WHEN gamma(n_sites + 1) / (gamma(n_acetyl + 1) * gamma(n_methyl + 1) * gamma(n_sites - n_acetyl - n_methyl + 1)) > 5 THEN 'too many candidates' ELSE 'ok' END AS status FROM comps""")
def candidate_caps(spark, folder):
    rows = E.compositions(_sited(spark, folder), _MOD_LIST)
    n = E.count_arrangements(F.col("n_sites"), [F.col("n_acetyl"), F.col("n_methyl")])
    status = F.when(F.col("n_sites") > E.MAX_SITES, "too many sites").when(n > 5, "too many candidates").otherwise("ok")
    return rows.select("peptide", "n_acetyl", "n_methyl", n.alias("n"), status.alias("status"))


def _placed(spark, folder):
    rows = _sited(spark, folder).withColumn("n_acetyl", F.lit(1)).withColumn("n_methyl", F.least(F.lit(1), F.col("n_sites") - 1))
    placed = E.arrangements(rows, "sites", {"acetyl": "n_acetyl", "methyl": "n_methyl"})
    return placed.withColumn("imp", E.render_placement(F.col("peptide"), F.col("sites"), F.col("placement")))


_PLACED_SQL = f"""{_SITED_SQL}, s AS (SELECT peptide, i FROM chars WHERE c IN ('L', 'E')),
placed AS (SELECT a.peptide, a.i AS ai, m.i AS mi FROM s a JOIN sited USING (peptide) LEFT JOIN s m ON m.peptide = a.peptide AND m.i <> a.i WHERE m.i IS NOT NULL OR n_sites = 1),
rendered AS (SELECT peptide, ai, mi, '_' || string_agg(c || CASE WHEN i = ai THEN '{{acetyl}}' WHEN i = mi THEN '{{methyl}}' ELSE '' END, '' ORDER BY i) || '_' AS imp FROM placed JOIN chars USING (peptide) GROUP BY 1, 2, 3)"""


@query("arrangements", f"WITH {_PLACED_SQL} SELECT peptide, imp FROM rendered")
def arrangements(spark, folder):
    return _placed(spark, folder).select("peptide", "imp")


@query("enzyme_cterm", f"""WITH {_PLACED_SQL} SELECT peptide, imp FROM rendered WHERE NOT (right(peptide, 1) IN ('L', 'E')) OR (CASE WHEN ai = length(peptide) THEN 42.010565 WHEN mi = length(peptide) THEN 14.01565 ELSE 0 END) < 0.01
OR (mi = length(peptide))""")
def enzyme_cterm(spark, folder):
    """Placements whose mass at a C-terminal site is none or one of the enzyme's limits."""
    last = F.element_at("placement", -1)
    at_end = F.element_at("sites", -1) == F.length("peptide")
    mass = F.when(last == "acetyl", 42.010565).when(last == "methyl", 14.01565).otherwise(0.0)
    ok = (mass < 0.01) | F.exists(F.array(F.lit(14.01565)), lambda x: F.abs(mass - x) < 0.01)
    return _placed(spark, folder).where(~at_end | ok).select("peptide", "imp")


_IONS_SQL = f"""{_PLACED_SQL}, m AS (SELECT peptide, i, {_MASS} AS m, length(peptide) AS n FROM chars),
f AS (SELECT p.peptide, 1 AS type, p.i AS pos, sum(q.m) AS mass FROM m p JOIN m q ON p.peptide = q.peptide AND q.i <= p.i WHERE p.i < p.n GROUP BY 1, 2, 3
UNION ALL SELECT p.peptide, 2, p.i, sum(q.m) + {K.WATER!r}::DOUBLE FROM m p JOIN m q ON p.peptide = q.peptide AND q.i > q.n - p.i WHERE p.i < p.n GROUP BY 1, 2, 3),
ends AS (SELECT peptide, min(i) AS lo, max(i) AS hi FROM s GROUP BY 1),
ions AS (SELECT r.peptide, r.imp, f.type, f.pos, round(f.mass + {K.PROTON} + CASE WHEN type = 1 THEN (ai <= pos)::INT * 42.010565 + coalesce(mi <= pos, false)::INT * 14.01565 ELSE (ai > length(r.peptide) - pos)::INT * 42.010565 + coalesce(mi > length(r.peptide) - pos, false)::INT * 14.01565 END, 5) AS mz,
CASE WHEN type = 1 THEN (ai <= pos)::INT + coalesce(mi <= pos, false)::INT ELSE (ai > length(r.peptide) - pos)::INT + coalesce(mi > length(r.peptide) - pos, false)::INT END AS n_mods
FROM rendered r JOIN f USING (peptide) JOIN ends USING (peptide) WHERE (type = 1 AND pos >= lo AND pos < hi) OR (type = 2 AND length(r.peptide) - pos >= lo AND length(r.peptide) - pos < hi))"""


def _ions(spark, folder):
    fragments = E.fragment_ions(peptides(spark, folder), [1], _masses(), K.PROTON, K.WATER)
    return E.discriminating_ions(_placed(spark, folder), fragments, MODS)


@query("discriminating_ions", f"WITH {_IONS_SQL} SELECT peptide, imp, type, pos, mz, n_mods FROM ions")
def discriminating_ions(spark, folder):
    return _ions(spark, folder).select("peptide", "imp", "type", "pos", F.round("mz", 5).alias("mz"), "n_mods")


_LOST = ", ".join(f"({t}, {series}, {lost!r}::DOUBLE)" for t, (series, lost) in E.ION_TYPES.items())


@query("ion_types", f"WITH {_IONS_SQL}, kinds(kind, series, lost) AS (VALUES {_LOST}) SELECT peptide, imp, kind AS type, pos, round(mz - lost, 5) AS mz, n_mods FROM ions JOIN kinds ON type = series")
def ion_types(spark, folder):
    """Discriminating ions of all nine types."""
    rows = _ions(spark, folder).withColumn("mz", F.round("mz", 5))
    return E.ion_types(rows, tuple(E.ION_TYPES)).select("peptide", "imp", "type", "pos", F.round("mz", 5).alias("mz"), "n_mods")


@query("distinct_ions", f"WITH {_IONS_SQL} SELECT peptide, type, pos, mz, n_mods, count(DISTINCT imp) AS n_imps, dense_rank() OVER (PARTITION BY peptide ORDER BY type, pos) AS cls FROM ions GROUP BY peptide, type, pos, mz, n_mods")
def distinct_ions(spark, folder):
    rows = _ions(spark, folder).withColumn("mz", F.round("mz", 5))
    return E.distinct_ions(rows).select("peptide", "type", "pos", "mz", "n_mods", "n_imps", "cls")


#: Rules of the composition search: whole masses, one of them negative, so that many counts meet a shift and hits lie behind hits.
SEARCH_RULES = [("a", "E", 14.0), ("b", "A", 20.0), ("c", "E", -20.0), ("d", "O", 6.0)]


@query("composition_search", """WITH s AS (SELECT o_orderkey AS spectrum, min(l_partkey) AS part, any_value(o_custkey % 47 - 12)::DOUBLE AS delta FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT p_partkey AS part, length(x) - length(replace(x, 'E', '')) AS e, length(x) - length(replace(x, 'A', '')) AS u, length(x) - length(replace(x, 'O', '')) AS o FROM (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS x FROM part)),
k AS (SELECT DISTINCT e, u, o FROM p), v AS (SELECT k.*, a, b, c, d FROM k, range(0, 40) t(a), range(0, 40) x(b), range(0, 40) y(c), range(0, 40) z(d) WHERE a + c <= e AND b <= u AND d <= o),
w AS (SELECT *, 14.0 * a + 20 * b - 20 * c + 6 * d AS m, list_transform(range(0, a + b + c + d), lambda n: 14.0 * least(n, a) + 20 * least(greatest(n - a, 0), b) - 20 * least(greatest(n - a - b, 0), c) + 6 * greatest(n - a - b - c, 0)) AS path FROM v),
h AS (SELECT spectrum, a, b, c, d, e, u, o FROM s JOIN p USING (part) JOIN w USING (e, u, o) WHERE abs(delta - m) < 0.5 AND len(list_filter(path, lambda x: abs(delta - x) < 0.5)) = 0),
n AS (SELECT *, factorial(e::INT) / (factorial(a::INT) * factorial(c::INT) * factorial((e - a - c)::INT)) * factorial(u::INT) / (factorial(b::INT) * factorial((u - b)::INT)) * factorial(o::INT) / (factorial(d::INT) * factorial((o - d)::INT)) AS f FROM h),
t AS (SELECT *, sum(f) OVER (PARTITION BY spectrum) AS total FROM n)
SELECT spectrum, CASE WHEN total <= 20 THEN a || '/' || b || '/' || c || '/' || d END AS counts, CASE WHEN total <= 20 THEN f ELSE total END::BIGINT AS n_forms FROM t GROUP BY ALL""")
def composition_search(spark, folder):
    """Counts of four rules, one of them negative, whose mass is the shift of an order on its first part's name; orders with over 20 forms say how many."""
    from modspec.operators.compositions import find_compositions
    from modspec.operators.placements import n_slots, slots

    first = peaks(spark, folder).groupBy("spectrum").agg(F.min("part").alias("p_partkey"))
    shift = table(spark, folder, "orders").groupBy(F.col("o_orderkey").alias("spectrum")).agg((F.min("o_custkey") % 47 - 12).cast("double").alias("delta"))
    name = table(spark, folder, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("peptide"))
    rows = first.join(shift, "spectrum").join(name, "p_partkey").withColumn("slots", slots(F.col("peptide"), SEARCH_RULES))
    room = F.array(*[n_slots(k) for k in "EAO"])
    targets = rows.select("spectrum", "delta", F.array(*[n_slots(k) for _, k, _ in SEARCH_RULES]).alias("most"), room.alias("room"))
    hits = find_compositions(targets, [m for _, _, m in SEARCH_RULES], [0, 1, 0, 2], 0.5, "spectrum", cap=20)
    return hits.select("spectrum", F.array_join("counts", "/").alias("counts"), "n_forms")
