"""Queries on chromatograms: events as traces of two forms, A and B."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.functions.constants import AVERAGINE, AVERAGINE_MASS, isotope_pattern
from modspec.operators import chrom, windows
from modspec.plans.adapters import TRACE_SQL, ions, n_lines, peaks, table, trace
from modspec.plans.registry import query
from modspec.sources.store import spread_beyond, stored

KEYS = ["grp"]
#: The grid of clicks by group, smoothed; ranges of five points; purchases as matches with ratios of A and B.
XIC_SQL = f"""{TRACE_SQL}, g AS (SELECT grp, id, rt, raw, row_number() OVER (PARTITION BY grp ORDER BY rt, id) AS i FROM trace WHERE run = 'click'),
xic AS (SELECT *, avg(raw) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth, (id % 10) / 10.0::DOUBLE AS r_A, 1 - (id % 10) / 10.0::DOUBLE AS r_B FROM g),
ranges AS (SELECT grp, (i - 1) // 5 AS peak_no, min(i) AS left_i, max(i) AS right_i FROM g GROUP BY 1, 2),
inside AS (SELECT r.*, x.* EXCLUDE grp FROM ranges r JOIN xic x ON r.grp = x.grp AND x.i BETWEEN left_i AND right_i)"""


def xic(spark, folder):
    grid = chrom.grid_index(trace(spark, folder).where("run = 'click'"), KEYS, ["rt", "id"])
    smooth = windows.moving_mean(grid, KEYS, ["i"], "raw")
    ratio = (F.col("id") % 10) / F.lit(10.0)
    return smooth.select("grp", "id", "rt", "raw", "i", "smooth", ratio.alias("r_A"), (1 - ratio).alias("r_B"))


def grid(spark, folder):
    """The smoothed grid of clicks by group, without ratios."""
    return xic(spark, folder).select("grp", "i", "rt", "raw", "smooth")


def hits(spark, folder):
    """Purchases as matches with ratios of A and B, those below 5 % of their group's largest dropped."""
    from modspec.operators.filters import relative_intensity

    ratio = (F.col("id") % 10) / F.lit(10.0)
    kept = relative_intensity(trace(spark, folder).where("run = 'purchase'"), KEYS, "raw", 0.05)
    return kept.select("grp", F.col("id").alias("psm"), "rt", ratio.alias("r_A"), (1 - ratio).alias("r_B"))


def ranges(x):
    return x.groupBy("grp", F.floor((F.col("i") - 1) / 5).alias("peak_no")).agg(F.min("i").alias("left_i"), F.max("i").alias("right_i"))


def areas_sql(value: str, name: str) -> str:
    return f"""{name}_p AS (SELECT r.grp, r.peak_no, x.i, x.rt, CASE WHEN x.i BETWEEN left_i AND right_i THEN {value} ELSE 0 END AS v FROM ranges r JOIN xic x ON r.grp = x.grp AND x.i BETWEEN left_i - 1 AND right_i + 1),
{name}_s AS (SELECT *, (rt - lag(rt) OVER w) * (v + lag(v) OVER w) / 2 AS s FROM {name}_p WINDOW w AS (PARTITION BY grp, peak_no ORDER BY i)),
{name} AS (SELECT grp, peak_no, coalesce(sum(s), 0) * 60 AS area FROM {name}_s GROUP BY 1, 2)"""


@query("closed_auc", f"WITH {XIC_SQL}, {areas_sql('smooth', 'a')} SELECT grp, peak_no, round(area, 4) AS area FROM a")
def closed_auc(spark, folder):
    x = xic(spark, folder)
    return chrom.closed_auc(x, ranges(x), KEYS, ["peak_no"], "smooth").select("grp", "peak_no", F.round("area", 4).alias("area"))


FWHM_SQL = """half AS (SELECT *, max(smooth * r_A) OVER w / 2 AS h, row_number() OVER o AS k, count(*) OVER w AS n, smooth * r_A AS v, lag(rt) OVER o AS prt, lag(smooth * r_A) OVER o AS pv, lead(rt) OVER o AS nrt, lead(smooth * r_A) OVER o AS nv, min(rt) OVER w AS lo, max(rt) OVER w AS hi
  FROM inside WINDOW w AS (PARTITION BY grp, peak_no), o AS (PARTITION BY grp, peak_no ORDER BY i)),
l AS (SELECT grp, peak_no, arg_min(CASE WHEN k > 1 THEN prt + (h - pv) * (rt - prt) / (v - pv) ELSE lo END, k) AS x FROM half WHERE v > h GROUP BY 1, 2),
r AS (SELECT grp, peak_no, arg_max(CASE WHEN k + 1 < n THEN nrt - (h - nv) * (nrt - rt) / (v - nv) ELSE hi END, k) AS x FROM half WHERE v > h GROUP BY 1, 2),
widths AS (SELECT b.grp, b.peak_no, CASE WHEN b.h = 0 THEN 0 ELSE r.x - l.x END AS fwhm FROM (SELECT grp, peak_no, any_value(h) AS h FROM half GROUP BY 1, 2) b LEFT JOIN l USING (grp, peak_no) LEFT JOIN r USING (grp, peak_no))"""


@query("fwhm", f"WITH {XIC_SQL}, {FWHM_SQL} SELECT grp, peak_no, round(fwhm, 4) AS fwhm FROM widths")
def fwhm(spark, folder):
    x = xic(spark, folder).withColumn("y", F.col("smooth") * F.col("r_A"))
    return chrom.fwhm(x, ranges(x), KEYS, ["peak_no"], "y").select("grp", "peak_no", F.round("fwhm", 4).alias("fwhm"))


FEATURES_SQL = f"""{XIC_SQL}, {areas_sql('smooth * r_A', 'aa')}, {areas_sql('smooth * r_B', 'ab')}, tops AS (SELECT grp, peak_no, max(r_A) AS ma, max(r_B) AS mb, min(rt) AS lo, max(rt) AS hi FROM inside GROUP BY 1, 2),
features AS (SELECT grp, peak_no, 'A' AS imp, ma AS max_ratio, area, lo AS rt_start, hi AS rt_end FROM tops JOIN aa USING (grp, peak_no) UNION ALL SELECT grp, peak_no, 'B', mb, area, lo, hi FROM tops JOIN ab USING (grp, peak_no))"""


def features(spark, folder):
    x = xic(spark, folder)
    return chrom.peak_features(x, ranges(x), KEYS, ["A", "B"])


@query("peak_features", f"WITH {FEATURES_SQL} SELECT grp, peak_no, imp, max_ratio, round(area, 4) AS area, rt_start, rt_end FROM features")
def peak_features(spark, folder):
    return features(spark, folder).select("grp", "peak_no", "imp", "max_ratio", F.round("area", 4).alias("area"), "rt_start", "rt_end")


BEST_SQL = f"{FEATURES_SQL}, best AS (SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY grp, imp ORDER BY round(area * max_ratio, 3) DESC, peak_no) = 1)"


def best(spark, folder):
    return windows.best_of(features(spark, folder), ["grp", "imp"], [F.round(F.col("area") * F.col("max_ratio"), 3).desc(), F.col("peak_no")])


@query("best_peak", f"WITH {BEST_SQL} SELECT grp, imp, peak_no FROM best")
def best_peak(spark, folder):
    return best(spark, folder).select("grp", "imp", "peak_no")


@query("final_area", f"WITH {BEST_SQL} SELECT grp, imp, round(area, 4) AS area FROM best")
def final_area(spark, folder):
    return chrom.final_areas(features(spark, folder), best(spark, folder), KEYS).select("grp", "imp", F.round("area", 4).alias("area"))


@query("nonzero_area", f"WITH {BEST_SQL} SELECT grp, imp, peak_no FROM features WHERE (grp, imp) IN (SELECT (grp, imp) FROM best WHERE round(area, 6) <> 0)")
def nonzero_area(spark, folder):
    return chrom.nonzero_forms(features(spark, folder), best(spark, folder), KEYS).select("grp", "imp", "peak_no")


@query("area_share", f"WITH {XIC_SQL}, {areas_sql('smooth * r_A', 'aa')}, {areas_sql('smooth', 't')} SELECT aa.grp, aa.peak_no, round(aa.area, 4) AS area, round(aa.area / nullif(t.area, 0), 6) AS share FROM aa JOIN t USING (grp, peak_no)")
def area_share(spark, folder):
    x = xic(spark, folder).withColumn("y", F.col("smooth") * F.col("r_A"))
    own, whole = chrom.closed_auc(x, ranges(x), KEYS, ["peak_no"], "y"), chrom.closed_auc(x, ranges(x), KEYS, ["peak_no"], "smooth", "total")
    return own.join(whole, ["grp", "peak_no"]).select("grp", "peak_no", F.round("area", 4).alias("area"), F.round(F.col("area") / F.nullif("total", F.lit(0.0)), 6).alias("share"))


@query("peak_filter", f"WITH {FEATURES_SQL}, k AS (SELECT *, CASE WHEN area >= 0.3 * max(area) OVER (PARTITION BY grp, peak_no) THEN area ELSE 0 END AS a FROM features) SELECT grp, peak_no, imp, round(coalesce(a / nullif(sum(a) OVER (PARTITION BY grp, peak_no), 0), 0), 6) AS share FROM k")
def peak_filter(spark, folder):
    return chrom.filter_peak_shares(features(spark, folder), KEYS, 0.3).select("grp", "peak_no", "imp", F.round("share", 6).alias("share"))


@query("selected_only", f"WITH {BEST_SQL} SELECT x.grp, x.i, round(CASE WHEN b.peak_no IS NOT NULL THEN r_A ELSE 0 END, 6) AS r_A FROM inside x LEFT JOIN best b ON b.grp = x.grp AND b.imp = 'A' AND b.peak_no = x.peak_no")
def selected_only(spark, folder):
    x = xic(spark, folder)
    kept = chrom.keep_selected_peak(chrom.points_of(x, ranges(x), KEYS), best(spark, folder).where("imp = 'A'"), KEYS, "r_A")
    return kept.select("grp", "i", F.round("r_A", 6).alias("r_A"))


@query("imp_traces", f"WITH {BEST_SQL} SELECT x.grp, x.i, x.rt, round(CASE WHEN x.i BETWEEN r.left_i AND r.right_i THEN smooth * r_A ELSE 0 END, 6) AS y FROM best b JOIN ranges r ON r.grp = b.grp AND r.peak_no = b.peak_no JOIN xic x ON x.grp = b.grp AND x.i BETWEEN left_i - 1 AND right_i + 1 WHERE b.imp = 'A'")
def imp_traces(spark, folder):
    """The deconvolved trace of form A in its selected peak, closed by zeros."""
    x = xic(spark, folder)
    return chrom.reconstruct_xic(x, ranges(x), best(spark, folder).where("imp = 'A'"), KEYS, "r_A").select("grp", "i", "rt", F.round("y", 6).alias("y"))


@query("kernel_ratio", f"""WITH {XIC_SQL}, psm AS (SELECT grp, id, rt AS t, (id % 10) / 10.0::DOUBLE AS r_A, 1 - (id % 10) / 10.0::DOUBLE AS r_B FROM trace WHERE run = 'purchase'),
ends AS (SELECT grp, peak_no, min(rt) AS lo, max(rt) AS hi FROM inside GROUP BY 1, 2), near AS (SELECT p.*, e.peak_no, lo, hi FROM psm p JOIN ends e ON p.grp = e.grp AND t BETWEEN lo - 1e-4 AND hi + 1e-4),
st AS (SELECT grp, peak_no, pow(4 / (3 * count(*)), 0.2) * coalesce(stddev_samp(t), 0) AS bw FROM near GROUP BY 1, 2), na AS (SELECT grp, count(*) AS n_all FROM psm GROUP BY 1),
pr AS (SELECT x.grp, x.peak_no, x.i, x.rt, n.t, n.r_A AS a, n.r_B AS b, n.lo, n.hi, bw, n_all FROM inside x JOIN near n ON n.grp = x.grp AND n.peak_no = x.peak_no JOIN st ON st.grp = x.grp AND st.peak_no = x.peak_no JOIN na ON na.grp = x.grp),
se AS (SELECT grp, peak_no, i, max(CASE WHEN bw > 0 THEN exp(-0.5 * pow((rt - t) / bw, 2)) / sqrt(2 * pi()) END) AS most, any_value(n_all) AS n_all FROM pr GROUP BY 1, 2, 3),
po AS (SELECT grp, peak_no, max(coalesce(most < 1e-15 / n_all, true)) AS poor FROM se GROUP BY 1, 2),
w AS (SELECT pr.*, exp(-0.5 * pow((rt - t) / CASE WHEN poor THEN least(hi - lo, 1.0) ELSE bw END, 2)) / sqrt(2 * pi()) AS w FROM pr JOIN po USING (grp, peak_no) WHERE NOT poor OR hi > lo),
o AS (SELECT grp, i, sum(w * a) / (sum(w) + 2.220446049250313e-16) AS r_A, sum(w * b) / (sum(w) + 2.220446049250313e-16) AS r_B FROM w GROUP BY grp, i)
SELECT grp, i, round(r_A / (r_A + r_B + 2.220446049250313e-16), 6) AS r_A, round(r_B / (r_A + r_B + 2.220446049250313e-16), 6) AS r_B FROM o""")
def kernel_ratio(spark, folder):
    x = xic(spark, folder)
    ratio = (F.col("id") % 10) / F.lit(10.0)
    psms = trace(spark, folder).where("run = 'purchase'").select("grp", F.col("id").alias("psm"), "rt", ratio.alias("r_A"), (1 - ratio).alias("r_B"))
    got = chrom.kernel_ratio(x.select("grp", "i", "rt"), ranges(x), psms, KEYS, ["A", "B"])
    return got.select("grp", "i", F.round("r_A", 6).alias("r_A"), F.round("r_B", 6).alias("r_B")).where("r_A is not null")


@query("xic_peaks")
def xic_peaks(spark, folder):
    """A walk that depends on its own past; SQL doesn't express it."""
    psms = trace(spark, folder).where("run = 'purchase'").select("grp", "rt")
    return chrom.detect_xic_peaks(xic(spark, folder).select("grp", "i", "rt", "raw", "smooth"), psms, KEYS)


_PATTERN = [round(p, 6) for p in isotope_pattern(1000.0)]
_COLS = ["b", "c0", "c1", "c2", "c3", "c4"]


@query("isotope_gate", f"""WITH {TRACE_SQL}, g AS (SELECT id, raw AS c0, coalesce(lag(raw) OVER w, 0) AS b, coalesce(lead(raw, 1) OVER w, 0) AS c1, coalesce(lead(raw, 2) OVER w, 0) AS c2, coalesce(lead(raw, 3) OVER w, 0) AS c3, coalesce(lead(raw, 4) OVER w, 0) AS c4 FROM trace WINDOW w AS (PARTITION BY run, grp ORDER BY rt, id)),
d AS (SELECT *, {" + ".join(f"c{i} * {p!r}::DOUBLE" for i, p in enumerate(_PATTERN))} AS dot, sqrt({" + ".join(f"c{i} * c{i}" for i in range(5))}) * {sum(p * p for p in _PATTERN) ** 0.5!r}::DOUBLE AS size FROM g)
SELECT id, CASE WHEN b > c0 OR size = 0 OR dot / nullif(size, 0) < 0.6 THEN 0 ELSE c0 END AS mono FROM d""")
def isotope_gate(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("run", "grp").orderBy("rt", "id")
    at = lambda k: F.coalesce(F.lead("raw", k).over(w), F.lit(0.0))
    rows = trace(spark, folder).select("id", F.coalesce(F.lag("raw").over(w), F.lit(0.0)).alias("b"), F.col("raw").alias("c0"), *[at(k).alias(f"c{k}") for k in (1, 2, 3, 4)])
    return chrom.isotope_gate(rows, _COLS, _PATTERN).select("id", "mono")


@query("xic_extract", """WITH w AS (SELECT p_partkey AS win, p_size AS grp, p_retailprice - 0.5 AS low, p_retailprice + 0.5 AS high FROM part)
SELECT win, l_orderkey AS scan, arg_max(l_quantity, l_extendedprice * 1000000 + l_quantity) AS intensity FROM w JOIN lineitem ON l_linenumber = grp % 7 + 1 AND l_extendedprice > low AND l_extendedprice < high GROUP BY 1, 2""")
def xic_extract(spark, folder):
    win = ions(spark, folder).select(F.col("ion").alias("window"), (F.col("cls") % 7 + 1).alias("run"), (F.col("ion_mz") - 0.5).alias("low"), (F.col("ion_mz") + 0.5).alias("high"))
    got = chrom.xic_extract(peaks(spark, folder).withColumnRenamed("pos", "run"), win, ["run"], "spectrum", "mz", "intensity", 1.0)
    return got.select(F.col("window").alias("win"), F.col("spectrum").alias("scan"), "intensity")


@query("precursor_profile", f"""WITH {TRACE_SQL}, v AS (SELECT v.id, v.grp, v.raw, c.id AS ms1, c.rt AS rt FROM (SELECT * FROM trace WHERE run = 'view') v ASOF JOIN (SELECT * FROM trace WHERE run = 'click') c ON v.grp = c.grp AND v.rt >= c.rt)
SELECT v.id, v.ms1, v.rt, coalesce(max(t.raw) FILTER (abs(t.raw - v.raw) <= 0.3), 0) AS intensity FROM v LEFT JOIN trace t ON t.grp = v.grp AND t.run = 'click' GROUP BY 1, 2, 3""")
def precursor_profile(spark, folder):
    """Scan and time of each spectrum's parent, and the largest peak near its precursor (0 without one)."""
    from modspec.operators.joins import asof_join, precursor_profile

    t = trace(spark, folder)
    parents = t.where("run = 'click'").withColumn("at", F.col("rt"))
    spectra = asof_join(t.where("run = 'view'").select("id", "grp", "rt", "raw"), parents, ["grp"], "rt", {"id": "ms1", "at": "ms1_rt"}, "id")
    got = precursor_profile(spectra, t.where("run = 'click'").select("grp", F.col("raw").alias("mz"), "raw"), "id", ["grp"], "raw", "mz", "raw", 0.3)
    return got.select("id", "ms1", F.col("ms1_rt").alias("rt"), "intensity")


@query("ingest_scan_filter", "SELECT l_orderkey AS scan, count(*) AS n_peaks, max(l_extendedprice) - min(l_extendedprice) AS width FROM lineitem WHERE l_quantity > 0 GROUP BY 1 HAVING max(l_extendedprice) - min(l_extendedprice) >= 10")
def ingest_scan_filter(spark, folder):
    rows = peaks(spark, folder).where("intensity > 0").groupBy(F.col("spectrum").alias("scan")).agg(F.count("*").alias("n_peaks"), (F.max("mz") - F.min("mz")).alias("width"))
    return rows.where("width >= 10")


@query("ingest_blocks", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages")
def ingest_blocks(spark, folder):
    html = F.col("html")
    return table(spark, folder, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, 'lang="([a-z]+)"', 1).alias("lang"), F.regexp_count(html, F.lit("<a href=")).cast("long").alias("n_links"))


@query("ingest_fasta", r"SELECT doc_id, regexp_extract(text, '^([^\n]*)', 1) AS header, regexp_replace(regexp_replace(text, '^[^\n]*', ''), '[ \t\n\r\f\v]', '', 'g') AS sequence FROM documents")
def ingest_fasta(spark, folder):
    text = F.col("text")
    return table(spark, folder, "documents").select("doc_id", F.regexp_extract(text, r"^([^\n]*)", 1).alias("header"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"[ \t\n\r\f\x0B]", "").alias("sequence"))


@query("job_quantify")
def job_quantify(spark, folder):
    """Traces to one area per form: peaks around the matches, their ratios spread over the peaks, the best peak, its area, nonzero only."""
    from pyspark.sql import Window

    _, chosen = chrom.quantify(grid(spark, folder), hits(spark, folder), KEYS, ["A", "B"])
    share = F.coalesce(F.col("area") / F.nullif(F.sum("area").over(Window.partitionBy("grp")), F.lit(0.0)), F.lit(0.0))
    return chosen.select("grp", "imp", F.round("area", 4).alias("area"), F.round(share, 6).alias("share"))


_HEIGHTS = """[1, l1, l1 * l1 / 2 + l2, l1 * l1 * l1 / 6 + l1 * l2, l1 * l1 * l1 * l1 / 24 + l1 * l1 * l2 / 2 + l2 * l2 / 2]"""
_MEANS = [sum(a[0] * a[k] for a in AVERAGINE.values()) / AVERAGINE_MASS for k in (1, 2)]


@query("xic_traces", f"""WITH pk AS (SELECT l_orderkey AS scan, l_linenumber AS pos, 900 + 5 * (l_orderkey % 40) + (l_linenumber - 2) * 0.501675::DOUBLE AS mz, max(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY ALL),
g AS (SELECT scan, scan % 7 AS run, scan / 1000.0::DOUBLE AS rt, row_number() OVER (PARTITION BY scan % 7 ORDER BY scan) AS i, count(*) OVER (PARTITION BY scan % 7) AS n FROM (SELECT DISTINCT scan FROM pk)),
w AS (SELECT s_suppkey AS grp, s_nationkey % 7 AS run, 900 + 5 * (s_suppkey % 40) - 0.05 - 0.3 * (s_suppkey % 3) AS low, 900 + 5 * (s_suppkey % 40) + 0.05 + 0.3 * (s_suppkey % 3) AS high FROM supplier),
fan AS (SELECT grp, run, round((low::DOUBLE + high::DOUBLE) / 2) AS mid, k, low::DOUBLE + k * 1.00335::DOUBLE / 2 AS low, high::DOUBLE + k * 1.00335::DOUBLE / 2 AS high FROM w, range(-1, 5) t(k)),
hit AS (SELECT grp, f.run, scan, any_value(mid) AS mid, {", ".join(f"coalesce(arg_max(v, pos) FILTER (k = {k}), 0) AS c{k + 1}" for k in range(-1, 5))} FROM fan f JOIN g ON g.run = f.run JOIN pk USING (scan) WHERE mz > low AND mz < high GROUP BY 1, 2, 3),
l AS (SELECT *, mid * {_MEANS[0]!r}::DOUBLE AS l1, mid * {_MEANS[1]!r}::DOUBLE AS l2 FROM hit), h AS (SELECT *, {_HEIGHTS} AS h, [c1, c2, c3, c4, c5] AS c FROM l),
raw AS (SELECT grp, run, scan, CASE WHEN c0 <= c1 AND list_dot_product(c::DOUBLE[], h::DOUBLE[]) >= 0.6 * sqrt(list_dot_product(c::DOUBLE[], c::DOUBLE[])) * sqrt(list_dot_product(h::DOUBLE[], h::DOUBLE[])) THEN c1 ELSE 0 END AS raw FROM h WHERE greatest(c1, c2, c3, c4, c5) > 0),
dense AS (SELECT w.grp, g.run, g.i, g.rt, coalesce(raw.raw, 0) AS raw FROM w JOIN g USING (run) LEFT JOIN raw ON raw.grp = w.grp AND raw.run = w.run AND raw.scan = g.scan),
s AS (SELECT *, avg(raw) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth, max(raw) OVER (PARTITION BY grp ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM dense)
SELECT grp, run, i, round(rt, 6) AS rt, raw, round(smooth, 6) AS smooth FROM s WHERE near > 0""")
def xic_traces(spark, folder):
    """Orders as survey scans of seven runs, their lines as isotope ladders of charge 2; each supplier a window, whose trace the SQL makes on the dense grid."""
    from modspec.operators.traces import scan_grid
    from modspec.operators.traces import xic_traces as traces

    order, slot = F.col("spectrum"), F.col("s_suppkey") % 40
    rows = peaks(spark, folder).select("spectrum", "pos", "intensity")
    lines = spread_beyond(rows, n_lines(spark, folder), "spectrum").groupBy("spectrum", "pos").agg(F.max("intensity").cast("double").alias("v"))
    mz = 900 + 5 * (order % 40) + (F.col("pos") - 2) * 0.501675
    each = lines.groupBy("spectrum").agg(F.sort_array(F.collect_list(F.struct("pos", mz.alias("mz"), F.col("v").alias("intensity")))).alias("peaks"))
    scans = each.select((order % 7).alias("run"), order.alias("scan"), (order / 1000.0).alias("rt_min"), F.transform("peaks", lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity"))).alias("peaks"))
    wide = 0.05 + 0.3 * (F.col("s_suppkey") % 3)
    fans = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("grp"), (F.col("s_nationkey") % 7).alias("run"), F.lit(2).alias("charge"), (900 + 5 * slot - wide).alias("low"), (900 + 5 * slot + wide).alias("high"))
    told = rows.select("spectrum").distinct().select((order % 7).alias("run"), order.alias("scan"), (order / 1000.0).alias("rt_min"))
    got = traces(scans, stored(scan_grid(told)), fans, ["grp"], 0.2)
    return got.select("grp", "run", "i", F.round("rt", 6).alias("rt"), "raw", F.round("smooth", 6).alias("smooth"))
