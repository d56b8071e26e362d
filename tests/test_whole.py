"""Queries that must cover their whole tables, on small fixtures."""

from __future__ import annotations

from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from modspec.plans.registry import ORACLES, QUERIES
from tests.test_oracles import rows

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
MATCHED = "render_sectioned abundance_cut psm_status penalty_sdp penalty_ksdp penalty_hyperscore gram_matrix abundance_kkt abundance_2imp gather_psms".split()


def spectra(keys):
    """Lines of spectra with two to seven forms over ten ions."""
    return [(k, 1, (k * 3 + form * form + n * (k % 4 + form)) % 10, form, float(5 + (k * 7 + form * 11 + n * 13) % 46), 1.0) for k in keys for form in range(1, 2 + k % 7 or 2) for n in range(3)]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A folder whose spectra lie on both sides of key 2000."""
    folder = str(tmp_path_factory.mktemp("far"))
    spark.createDataFrame(spectra([3, 1999, 2000, 2001, 2002, 2003, 2004, 5005, 900_006]), LINES).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("name", MATCHED)
def test_spectra_of_every_key(spark, far, name):
    """Spectra with keys on both sides of a former cut."""
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{far}/lineitem.parquet/*.parquet'")
    want = duck.sql(ORACLES[name])
    got = QUERIES[name](spark, far)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_deconvolution_of_every_key(spark, far):
    keys = {r[0] for r in spark.read.parquet(f"{far}/lineitem.parquet").select("l_orderkey").distinct().collect()}
    got = QUERIES["job_deconvolve"](spark, far).groupBy("spectrum").agg(F.sum("abundance").alias("s")).collect()
    assert {r["spectrum"] for r in got} == keys and all(abs(r["s"] - 1) < 1e-3 for r in got)


def test_extraction_windows_of_every_part(spark, tmp_path):
    parts = [(k, k * 3, 900.0 + k * 0.3) for k in range(1, 31)]
    lines = [(s, 1, 1, 1 + (s + k) % 7, float(1 + (s * 7 + k * 5) % 50), 899.5 + ((s * 37 + k * 91) % 1100) / 100) for s in range(1, 41) for k in range(12)]
    spark.createDataFrame(parts, "p_partkey long, p_size int, p_retailprice double").withColumn("p_type", F.lit("x")).write.parquet(f"{tmp_path}/part.parquet")
    wide = spark.createDataFrame(lines, LINES)
    for c in ("l_returnflag", "l_linestatus", "l_discount"):
        wide = wide.withColumn(c, F.lit("x"))
    wide.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for part, size, price in parts:
        for scan, _, _, number, quantity, mz in lines:
            if number == size % 7 + 1 and price - 0.5 < mz < price + 0.5:
                want[part, scan] = max(want.get((part, scan), (0, 0)), (mz, quantity))
    got = {(r["win"], r["scan"]): r["intensity"] for r in QUERIES["xic_extract"](spark, str(tmp_path)).collect()}
    assert len({p for p, _ in want}) == 30 and got == {k: v[1] for k, v in want.items()}


def independent(columns):
    """Whether 0/1 columns, sets of ions, are linearly independent: exact elimination."""
    left = [[Fraction(int(i in c)) for i in range(10)] for c in columns]
    for k in range(len(left)):
        at = next((i for i, v in enumerate(left[k]) if v), None)
        if at is None:
            return False
        for other in left[k + 1 :]:
            by = other[at] / left[k][at]
            other[:] = [a - by * b for a, b in zip(other, left[k])]
    return True


def test_rank_of_all_forms(spark, tmp_path):
    designs = {1: [{0, 1}, {2}], 2: [{0, 1}, {2}, {0, 1, 2}], 3: [{0}, {1}, {2, 3}, {2, 3}], 4: [{0}, {0}], 2001: [{0, 1}, {1, 2}, {2, 3}, {3, 0}], 2002: [{0, 1}, {1, 2}, {0, 2}], 2003: [set(), set(), {5}, {6}, {5, 6}], 2004: [set(), set(), {5}, {6}]}
    designs |= {3000 + n: [{(n * 7 + f * f + j * (n + f)) % 10 for j in range(1 + (n + f) % 4)} for f in range(2 + n % 6)] for n in range(30)}
    lines = [(k, 1, ion, f + 1, float(1 + ion + f), 1.0) for k, forms in designs.items() for f, ions in enumerate(forms) for ion in ions]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {k: not independent([c for c in forms if c]) for k, forms in designs.items()}
    got = {r["spectrum"]: r["rank_deficient"] for r in QUERIES["rank_deficient"](spark, str(tmp_path)).collect()}
    assert got == want and want[2] and want[3] and want[2001] and want[2003] and not want[2002] and not want[2004]


def trapezoid(rt, y, a, b):
    at = [(rt[k], y[k] if a <= k <= b else 0.0) for k in range(max(a - 1, 0), min(b + 2, len(rt)))]
    return sum((t - s) * (v + u) / 2 for (s, u), (t, v) in zip(at, at[1:])) * 60


@pytest.fixture(scope="module")
def broad(spark, tmp_path_factory):
    """One group whose peak is 17 points long and lies across strides of five, six purchases of form A around its top, and a group without purchases."""
    folder = str(tmp_path_factory.mktemp("broad"))
    y = [0.0] * 6 + [4.0, 8.0, 15.0, 25.0, 40.0, 60.0, 80.0, 95.0, 100.0, 95.0, 80.0, 60.0, 40.0, 25.0, 15.0, 8.0, 4.0] + [0.0] * 7
    lines = [(1000 + k, 60 * k, user, "click", v) for user in (1, 2) for k, v in enumerate(y)]
    lines += [(9 + 10 * (200 + k), 60 * (11 + k) + 1, 1, "purchase", 60.0) for k in range(6)]
    spark.createDataFrame(lines, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "cast(timestamp_seconds(1704067200 + s) as timestamp_ntz) ts", "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    smooth = [sum(w) / len(w) for k in range(len(y)) for w in [y[max(k - 2, 0) : k + 3]]]
    top = max(range(len(y)), key=lambda k: smooth[k])
    left, right = top, top
    while smooth[left - 1] >= 0.1 * smooth[top]:
        left -= 1
    while smooth[right + 1] >= 0.1 * smooth[top]:
        right += 1
    return folder, trapezoid([float(k) for k in range(len(y))], smooth, left, right), right - left + 1


def test_jobs_take_whole_peaks(spark, broad):
    """Ratios are 0.9 and 0.1 of each match, so of each point; the walls of the peak are where it falls below a tenth of its top."""
    folder, area, points = broad
    assert points > 10
    got = {(r["grp"], r["imp"]): (r["area"], r["share"]) for r in QUERIES["job_quantify"](spark, folder).collect()}
    assert set(got) == {(1, "A"), (1, "B")}
    assert got[1, "A"] == pytest.approx((0.9 * area, 0.9), abs=1e-3) and got[1, "B"] == pytest.approx((0.1 * area, 0.1), abs=1e-3)
    assert [tuple(r) for r in QUERIES["job_normalise"](spark, folder).collect()] == [(1, 1, pytest.approx(area, abs=1e-2))]
    assert [tuple(r) for r in QUERIES["job_top1"](spark, folder).collect()] == [(1, "purchase", pytest.approx(area, abs=1e-2), 6)]


def test_requantification_takes_the_checked_range(spark, broad):
    """The matches of form A lie at minutes 11 to 16, a second late; their ratios are 0.9 of it."""
    folder, _, _ = broad
    y = [0.0] * 6 + [4.0, 8.0, 15.0, 25.0, 40.0, 60.0, 80.0, 95.0, 100.0, 95.0, 80.0, 60.0, 40.0, 25.0, 15.0, 8.0, 4.0] + [0.0] * 7
    smooth = [sum(w) / len(w) for k in range(len(y)) for w in [y[max(k - 2, 0) : k + 3]]]
    area = trapezoid([float(k) for k in range(len(y))], smooth, 11, 16)
    got = [tuple(r) for r in QUERIES["job_requantify"](spark, folder).collect()]
    assert got == [(1, "A", pytest.approx(0.9 * area, abs=1e-3), pytest.approx(0.9, abs=1e-6))]


def test_efficiencies_of_classes_are_found(spark):
    """Two forms with ions of their own in two classes, the second of which shows half of what is there."""
    from modspec.operators import solve

    rows = [(1, 0, 1, 0.8, 0), (1, 1, 2, 0.2, 0), (1, 2, 1, 0.4, 1), (1, 3, 2, 0.1, 1)]
    df = spark.createDataFrame(rows, "s long, ion long, imp int, norm double, cls int")
    # the ray of solutions is cut by the least inverse efficiency, 1
    imps, efficiency = solve.variable_efficiency(df.select("s", "ion", "imp"), df.select("s", "ion", "cls"), df.select("s", "ion", "norm"), "s", "ion", "imp", "cls", "norm")
    assert {r["imp"]: round(r["abundance"], 6) for r in imps.collect()} == {1: 0.8, 2: 0.2}
    assert {r["cls"]: round(r["efficiency"], 6) for r in efficiency.collect()} == {0: 1.0, 1: 0.5}
    # class 2 matches nothing, so its ion has no row
    ions = df.select("s", "ion", "cls").union(spark.createDataFrame([(1, 9, 2)], "s long, ion long, cls int"))
    weights = {r["ion"]: round(r["weight"], 6) for r in solve.row_weights(ions, df.withColumn("raw", F.col("norm") * 100), "s", "ion", "cls", "norm", "raw", "class").collect()}
    assert weights == {0: 0.5, 1: 0.5, 2: 0.25, 3: 0.25}


def test_reports_with_sums_and_largest_labels(spark, tmp_path):
    from modspec.sources import readers, writers

    wide = spark.createDataFrame([("s1", "i1", "+2", 1.0, 2.0, None, None), ("s1", "i2", "+2", 3.0, 4.0, 5.0, 6.0)], "site string, imp string, charge string, p_left double, p_right double, q_left double, q_right double")
    writers.write_merged_report(wide, ["p", "q"], f"{tmp_path}/merged")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/merged").collect()]
    title = "Sites\tSequence\tCharge\tp_left\tp_right\tRatio\tNormalized ratio\tq_left\tq_right\tRatio\tNormalized ratio"
    assert lines == [title, "s1\ti1\t+2\t1.000000\t2.000000\t\t\t\t\t\t", "\ti2\t+2\t3.000000\t4.000000\t\t\t5.000000\t6.000000\t\t", "\tSUM\t\t4.000000\t6.000000\t0.666667\t\t5.000000\t6.000000\t0.833333\t"]
    none = wide.select("site", "imp", "charge", F.lit(0.0).alias("p_left"), "p_right", "q_left", F.lit(0.0).alias("q_right"))
    writers.write_merged_report(none, ["p", "q"], f"{tmp_path}/blank")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/blank").collect()][-1] == "\tSUM\t\t\t\t\t\t5.000000\t0.000000\tInf\t"
    imps = spark.createDataFrame([("P", "_A_", "+2", "r", 1.0, 1.0, 1.0, 9.0)], "protein_line string, imp string, charge string, run string, mz_mid double, mz_lo double, mz_hi double, area double")
    ranges = spark.createDataFrame([("_A_", "+2", "r", 1.0, 2.0, 0.5, 0), ("_A_", "+2", "r", 3.0, 4.0, 0.5, 2)], "imp string, charge string, run string, rt_start double, rt_end double, ratio double, check_label int")
    writers.write_requant_report(imps, ranges, f"{tmp_path}/requant")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/requant").collect()][-1:] == ["@\t3.000000\t4.000000\t0.500000\t2"]
    (tmp_path / "f.fasta").write_text(">a>b c\nMK\n>d\nAA\n>a>b c\nLL\n")
    assert {tuple(r) for r in readers.read_fasta(spark, f"{tmp_path}/f.fasta").collect()} == {("a>b c", "LL"), ("d", "AA")}


def test_scalars_of_titles_and_top1(spark):
    from modspec.functions import scalars

    df = spark.createDataFrame([("a%2e12%20b%3a%3d%22%2c%2d", "PEPTIDE", ["Acetyl (K)", "Phospho (S)"], [2, 5])], "t string, s string, n array<string>, p array<int>")
    got = df.select(scalars.decode_title(F.col("t")), scalars.render_top1(F.col("s"), F.col("n"), F.col("p"))).first()
    assert tuple(got) == ('a.12 b:=",-', "PE{Acetyl}PTI{Phospho}DE")


def test_orders_without_a_date_or_a_customer_count_as_in_sql(spark, tmp_path):
    """The SQL puts nulls last: an order without a date is in its customer's last interval, or alone where no order has one."""
    c = duckdb.connect()
    c.execute("""create table orders as select i::bigint as o_orderkey, case when i % 11 = 0 then null else i % 7 end::bigint as o_custkey, 'O' as o_orderstatus, i::double as o_totalprice,
      case when i % 7 = 3 or i % 5 = 0 then null else timestamp '1995-01-01' + to_days((i * 9)::int) end as o_orderdate, '1-URGENT' as o_orderpriority from range(120) t(i)""")
    c.execute(f"copy orders to '{tmp_path}/orders.parquet'")
    got, want = QUERIES["merge_intervals"](spark, str(tmp_path)), c.sql(ORACLES["merge_intervals"])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
