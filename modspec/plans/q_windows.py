"""Queries of the window and target-decoy operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from modspec.operators import fdr, windows
from modspec.plans.adapters import TRACE_SQL, micros, psms, table, trace
from modspec.plans.registry import query

PSMS_SQL = """psms AS (SELECT o_orderkey AS id, o_totalprice AS score, o_orderpriority AS dataset, o_custkey AS scan, o_custkey % 10 = 0 AS decoy, o_orderstatus AS grp, o_orderdate FROM orders)"""
_ORDER = "ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING"
COUNTS_SQL = f"""{PSMS_SQL}, counts AS (SELECT *, sum((NOT decoy)::INT) OVER ({_ORDER})::BIGINT AS n_targets, sum(decoy::INT) OVER ({_ORDER})::BIGINT AS n_decoys,
  sum((NOT decoy)::INT) OVER (PARTITION BY grp {_ORDER})::BIGINT AS g_targets, sum(decoy::INT) OVER (PARTITION BY grp {_ORDER})::BIGINT AS g_decoys FROM psms)"""


@query("target_decoy", f"WITH {COUNTS_SQL} SELECT id, n_targets, n_decoys, g_targets, g_decoys FROM counts")
def target_decoy(spark, folder):
    return fdr.target_decoy_counts(psms(spark, folder)).select("id", "n_targets", "n_decoys", "g_targets", "g_decoys")


@query("fdr_global", f"""WITH {COUNTS_SQL}, rated AS (SELECT *, n_decoys / greatest(n_targets::DOUBLE, 1e-6) AS ratio FROM counts),
low AS (SELECT min(score) AS threshold FROM rated WHERE ratio <= 0.1)
SELECT id, round(ratio, 9) AS ratio, threshold, coalesce((SELECT round(min(ratio), 9) FROM rated, low WHERE score = threshold), 1.0) AS final_fdr,
  coalesce(NOT decoy AND score >= threshold, false) AS accepted FROM rated, low""")
def fdr_global(spark, folder):
    return fdr.global_fdr(psms(spark, folder), 0.1).select("id", F.round("ratio", 9).alias("ratio"), "threshold", F.round("final_fdr", 9).alias("final_fdr"), "accepted")


@query("fdr_separate", f"""WITH {COUNTS_SQL}, rated AS (SELECT *, g_decoys / greatest(g_targets::DOUBLE, 1e-6) AS ratio FROM counts),
low AS (SELECT grp, min(score) AS threshold FROM rated WHERE ratio <= 0.1 GROUP BY 1)
SELECT id, round(ratio, 9) AS ratio, threshold, coalesce(NOT decoy AND score >= threshold, false) AS accepted FROM rated LEFT JOIN low USING (grp)""")
def fdr_separate(spark, folder):
    return fdr.separate_fdr(psms(spark, folder), 0.1).select("id", F.round("ratio", 9).alias("ratio"), "threshold", "accepted")


@query("monotone_q", f"""WITH {COUNTS_SQL} SELECT id, round(least(1.0, min(g_decoys / greatest(g_targets::DOUBLE, 1e-6)) OVER (PARTITION BY grp ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM counts""")
def monotone(spark, folder):
    return fdr.separate_fdr(psms(spark, folder), 0.1).select("id", F.round("q", 9).alias("q"))


@query("fdr_transfer")
def fdr_transfer(spark, folder):
    return fdr.transfer_fdr(psms(spark, folder), 0.1, "F").select("id", F.round("ratio", 6).alias("ratio"), F.round("q", 6).alias("q"), "accepted")


@query("robust_line")
def robust_line(spark, folder):
    """The share of the group's decoys among all decoys, by score, and the line through it."""
    counts = fdr.target_decoy_counts(psms(spark, folder)).where("grp = 'F' and decoy").withColumn("share", F.col("g_decoys") / F.col("n_decoys"))
    slope, intercept = fdr.robust_line(counts, "score", "share")
    return counts.groupBy("grp").agg(F.count("*").alias("n"), F.lit(round(slope, 12)).alias("slope"), F.lit(round(intercept, 9)).alias("intercept"))


@query("fdr_summary", f"""WITH {COUNTS_SQL}, rated AS (SELECT *, g_decoys / greatest(g_targets::DOUBLE, 1e-6) AS ratio FROM counts),
low AS (SELECT grp, min(score) AS threshold FROM rated WHERE ratio <= 0.1 GROUP BY 1)
SELECT dataset, grp, count(*) AS n_in_group, count(*) FILTER (NOT decoy AND score >= threshold) AS n_accepted FROM rated LEFT JOIN low USING (grp) GROUP BY 1, 2""")
def fdr_summary(spark, folder):
    return fdr.summary(fdr.separate_fdr(psms(spark, folder), 0.1), ["dataset", "grp"])


@query("gap_cluster", f"""WITH {PSMS_SQL}, stepped AS (SELECT id, dataset, score, CASE WHEN score - lag(score) OVER w > lag(score) OVER w * 1e-5 THEN 1 WHEN lag(score) OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM psms WINDOW w AS (PARTITION BY dataset ORDER BY score, id))
SELECT id, (sum(cut) OVER (PARTITION BY dataset ORDER BY score, id ROWS UNBOUNDED PRECEDING))::BIGINT AS cluster FROM stepped""")
def gap_cluster(spark, folder):
    return windows.gap_clusters(psms(spark, folder), ["dataset"], "score", "id", F.col("_prev") * 1e-5).select("id", "cluster")


@query("unique_scans", f"WITH {PSMS_SQL} SELECT any_value(id) AS id, dataset, scan FROM psms GROUP BY dataset, scan HAVING count(*) = 1")
def unique_scans(spark, folder):
    return windows.only_once(psms(spark, folder), ["dataset", "scan"]).select("id", "dataset", "scan")


@query("merge_intervals", f"""WITH {PSMS_SQL}, wide AS (SELECT dataset, scan, epoch_us(o_orderdate) / 86400000000.0 - 10 * 0.2 AS a, epoch_us(o_orderdate) / 86400000000.0 + 10 + 10 * 0.2 AS b FROM psms),
marked AS (SELECT *, max(b) OVER (PARTITION BY scan ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide),
islands AS (SELECT *, sum((reach IS NULL OR a > reach)::INT) OVER (PARTITION BY scan ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT scan, round(min(a), 6) AS lo, round(max(b), 6) AS hi, count(*) AS n_members FROM islands GROUP BY scan, island""")
def merge_intervals(spark, folder):
    day = micros("o_orderdate") / F.lit(86400000000.0)
    ranges = psms(spark, folder).select("scan", day.alias("start"), (day + 10).alias("stop"))
    return windows.merge_intervals(ranges, ["scan"], "start", "stop").select("scan", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_members")


@query("moving_mean", f"WITH {TRACE_SQL} SELECT id, round(avg(raw) OVER (PARTITION BY run, grp ORDER BY rt, id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM trace")
def moving_mean(spark, folder):
    return windows.moving_mean(trace(spark, folder), ["run", "grp"], ["rt", "id"], "raw").select("id", F.round("smooth", 6).alias("smooth"))


@query("ingest_dedupe_consecutive", f"""WITH {TRACE_SQL}, p AS (SELECT *, lag(run) OVER (PARTITION BY grp ORDER BY rt, id) AS prev FROM trace) SELECT id, grp, run FROM p WHERE prev IS NULL OR prev <> run""")
def dedupe_consecutive(spark, folder):
    return windows.drop_consecutive_repeats(trace(spark, folder), ["grp"], ["rt", "id"], "run").select("id", "grp", "run")


@query("ladder_gaps", """WITH h AS (SELECT DISTINCT l_orderkey AS spectrum, l_returnflag AS type, l_linenumber AS pos FROM lineitem),
s AS (SELECT *, (pos - coalesce(lag(pos) OVER (PARTITION BY spectrum, type ORDER BY pos), 0) > 1)::BIGINT AS brk FROM h)
SELECT spectrum, type, count(*) AS n_hits, (sum(brk) + (max(pos) < 7)::BIGINT)::BIGINT AS gaps FROM s GROUP BY 1, 2""")
def ladder_gaps(spark, folder):
    rows = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("spectrum"), F.col("l_returnflag").alias("type"), F.col("l_linenumber").alias("pos"))
    return windows.ladder_gaps(rows, ["spectrum", "type"], "pos", F.lit(7))


SECTIONS_SQL = """SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER w AS peptide,
  last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS spectrum, text AS imp, role FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)"""


@query("sectioned_fill", f"WITH f AS ({SECTIONS_SQL}) SELECT conv_id, turn, peptide, spectrum, imp FROM f WHERE role = 'assistant' AND spectrum IS NOT NULL")
def sectioned_fill(spark, folder):
    lines = table(spark, folder, "conversations")
    level = lambda r: F.when(F.col("role") == r, F.col("text"))
    filled = windows.forward_fill(lines, ["conv_id"], ["turn", "role", "text"], {"peptide": level("system"), "spectrum": level("user")})
    return filled.where("role = 'assistant' and spectrum is not null").select("conv_id", "turn", "peptide", "spectrum", F.col("text").alias("imp"))


@query("sectioned_header_join", """SELECT a.conv_id, a.turn, u.text AS title, length(a.text) AS n_chars FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'""")
def sectioned_header_join(spark, folder):
    """Answer rows with the header of the section before them: an equi-join on the section's number."""
    rows = table(spark, folder, "conversations")
    heads = rows.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("title"))
    return rows.where("role = 'assistant'").join(heads, ["conv_id", "turn"]).select("conv_id", "turn", "title", F.length("text").cast("long").alias("n_chars"))
