"""Connected components by contraction, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import stored


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; root is the smallest node that it reaches.

    Each round gives every node its smallest neighbour (or itself) as parent,
    follows the parents to their ends, and replaces edges by those between
    ends, so a star of any size folds in one round and a path in a logarithmic
    number.  Minima combine before the shuffle, so a hot node costs no more
    than others.  Every round is a table in the shared folder; nothing but a
    count comes to the driver.  Self-loops are nodes of their own, nulls are dropped.
    """
    edges = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna()
    edges = stored(edges.distinct(), "edges")
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parent = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stored(parent.join(up, "root", "left").select("node", "root", F.coalesce("next", "root").alias("next")), "jumps")
            moved = jumped.where("next <> root").limit(1).count()
            parent = jumped.select("node", F.col("next").alias("root"))
            if not moved:
                break
        labels = parent if labels is None else stored(
            labels.join(parent.withColumnRenamed("root", "end").withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("end", "root").alias("root")), "labels")
        ends = lambda c: parent.select(F.col("node").alias(c), F.col("root").alias(f"{c}_end"))
        edges = stored(edges.join(ends("a"), "a").join(ends("b"), "b").where("a_end <> b_end").select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "edges")
        if not edges.limit(1).count():
            return labels
