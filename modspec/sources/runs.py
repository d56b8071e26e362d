"""Which survey-scan file belongs to which spectrum file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of spectrum files that their survey files don't have.
SUFFIXES = ("_HCDFT", "_HCDIT", "_CIDFT", "_CIDIT")


def pair_files(files: DataFrame, runs: DataFrame, stem: str = "stem", run: str = "run", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """stem, run, n_found: of the survey files named like the spectrum file, with or without its suffix, the first by name; null and 0 without one."""
    clean = F.regexp_replace(stem, f"({'|'.join(suffixes)})$", "")
    known = runs.select(run).distinct().withColumn("_found", F.col(run))
    keyed = files.select(stem).distinct().select(stem, F.explode(F.array_distinct(F.array(F.col(stem), clean))).alias(run)).join(known, run, "left")
    return keyed.groupBy(stem).agg(F.min("_found").alias(run), F.countDistinct("_found").alias("n_found"))


def paired(files: DataFrame, runs: DataFrame, stem: str = "stem", run: str = "run", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``pair_files``; an error that names up to ten spectrum files without a survey file, if there are any."""
    pairs = pair_files(files, runs, stem, run, suffixes)
    lost = [r[0] for r in pairs.where("n_found = 0").select(stem).orderBy(stem).limit(10).collect()]
    if lost:
        raise ValueError(f"no survey file for {', '.join(lost)}")
    return pairs
