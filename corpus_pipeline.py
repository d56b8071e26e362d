"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``; the last has the mixed corpus: each document that the mix takes,
with its size, its source's size and target, and the words taken.

Rows that repeat a doc_id, or have none, are documents of their own in every
stage: what goes is told by id and text.  Null texts count as empty; empty
documents stay until the mix, which takes no words of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspec.llm._shared import fresh, stored, table
from modspec.llm.decontaminate import decontaminate
from modspec.llm.exact_dedup import exact_dedup
from modspec.llm.mixing import taken_words
from modspec.llm.ngram_join import one_of_each_group
from modspec.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = fresh(docs, "_doc")
    scored = toxicity_scores(docs.withColumn(whole, F.struct(*docs.columns)), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(f"{whole}.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, directly or through others, the one with the smallest id stays."""
    return one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are numbered in a stored table; the documents that the mix takes move once, to their counts; columns
    of their names are replaced."""
    row = fresh(docs, "_row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = taken_words(numbered, row_col=row).where("taken > 0").select(F.col("row").alias(row), "size", "source_size", "target", "taken")
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return numbered.select(row, *own).join(stored(taken, "taken").hint("merge"), row).drop(row)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix),
]

#: The toxicity stage has a trained model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
