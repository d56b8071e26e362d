"""The driver's tables under the names that the operators' columns have in the domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modspec.sources.store import spread_beyond


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since the epoch of a time without zone (the session runs in UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks: lineitem with spectrum, mz, intensity, pos."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("spectrum"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").alias("intensity"), F.col("l_linenumber").alias("pos"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), "l_returnflag", "l_linestatus", "l_discount")


def ions(spark: SparkSession, folder: str) -> DataFrame:
    """Theoretical ions: part with ion, ion_mz, cls, type."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("ion"), F.col("p_retailprice").alias("ion_mz"), F.col("p_size").alias("cls"), F.col("p_type").alias("type"))


def psms(spark: SparkSession, folder: str) -> DataFrame:
    """Matches: orders with id, score, dataset, scan, decoy, grp."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("scan"),
        (F.col("o_custkey") % 10 == 0).alias("decoy"), F.col("o_orderstatus").alias("grp"), "o_orderdate")


def trace(spark: SparkSession, folder: str) -> DataFrame:
    """Chromatogram points: events with id, run, grp, rt (minutes since 2024 began), raw."""
    minutes = (micros("ts") - F.lit(1704067200000000)) / F.lit(60000000.0)
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("run"), F.col("user_id").alias("grp"), minutes.alias("rt"), F.col("value").alias("raw"))


TRACE_SQL = "trace AS (SELECT event_id AS id, event_type AS run, user_id AS grp, (epoch_us(ts) - 1704067200000000) / 60000000.0 AS rt, value AS raw FROM events)"


def peptides(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct letter sequences: part names in capitals without blanks."""
    return table(spark, folder, "part").select(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit(""))).alias("peptide")).distinct()


PEPTIDES_SQL = "peptides AS (SELECT DISTINCT upper(replace(p_name, ' ', '')) AS peptide FROM part)"


def n_lines(spark: SparkSession, folder: str) -> int:
    """Rows of lineitem, which the file says."""
    return table(spark, folder, "lineitem").count()


def site_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Quantified forms: protein, imp, charge, run, area, brand."""
    li = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    letters = F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("")))
    cut = (F.length("p_brand") - 4).cast("int")
    imp = F.concat(F.lit("_"), F.substr(letters, F.lit(1), cut), F.lit("{"), F.col("p_brand"), F.lit("}"), F.substr(letters, cut + 1), F.lit("_"))
    # long names come last, to parts that don't grow with the table
    named = li.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    joined = spread_beyond(named, n_lines(spark, folder), "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("s_name").alias("protein"), imp.alias("imp"), F.col("l_returnflag").alias("charge"), F.col("l_linestatus").alias("run"), F.col("l_quantity").alias("area"), F.col("p_brand").alias("brand"))


SITES_SQL = """site_rows AS (SELECT s_name AS protein, '_' || substr(upper(replace(p_name, ' ', '')), 1, length(p_brand) - 4) || '{' || p_brand || '}' || substr(upper(replace(p_name, ' ', '')), length(p_brand) - 3) || '_' AS imp,
  l_returnflag AS charge, l_linestatus AS run, l_quantity AS area, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
