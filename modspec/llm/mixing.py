"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in an order permuted by a hash, form a line of words,
repeated as often as its target asks for.  The line is cut in blocks, and a
splitting tree deals the blocks of all sources among the output shards: a node
takes half of its blocks without replacement (a multivariate hypergeometric
draw of quotas by source), until each leaf, one shard, has exact quotas.
Shards then draw their quotas as disjoint runs of each source's permuted blocks
and shuffle what they hold.  A document belongs to the block in which it
starts, and only the one that crosses the end of its source's target is cut,
to the words that are left.  What is taken of a document is the sum of what
the shards draw of it.

Sources are few: their totals and the blocks of the mix (BLOCKS_PER_SHARD for
each shard) are small tables whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspec.llm._shared import stored, tasks, text_hash

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents that one task puts in order at a time.
RUN = 10_000
#: At least 2 ** 4 shards, or as many as shuffle partitions.
SHARDS_LOG2 = 4
BLOCKS_PER_SHARD = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(*parts: Column) -> Column:
    """60 hashed bits of the parts, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, rank, source_size, target): ``sizes`` has source and size.

    Sources by code point, null last, have the weights in turn.  A target stops
    at ``most`` times its source's size; what is above goes to the others by
    weight.  That is one water level: targets are least(cap, level * weight),
    found over the sources in the order of cap / weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1).alias("rank")
    ranked = totals.select("source", "source_size", rank)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("final", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final.level"), F.lit(0.0)) * F.col("weight"))
    return leveled.select("source", "rank", "source_size", target.alias("target"))


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(shard, rank, n_blocks): deals the blocks of ``quotas`` (rank, n_blocks) among 2 ** levels shards.

    A node is one row: its shard prefix and an array of quotas by source.  Its
    blocks are put in a hashed order and the first half goes left.  The arrays
    are bounded by the number of blocks, a parameter of the mix.
    """
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "n_blocks"))), lambda x: x["n_blocks"].cast("int"))
    nodes = quotas.groupBy().agg(listed.alias("quotas")).select(F.lit(0).alias("node"), "quotas")
    for level in range(levels):
        units = F.flatten(F.transform("quotas", lambda q, i: F.array_repeat(i, q)))
        shuffled = F.array_sort(F.transform(units, lambda s, j: F.struct(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), j).alias("k"), s.alias("s"))))
        nodes = nodes.withColumn("units", F.transform(shuffled, lambda x: x["s"]))
        half = F.floor(F.size("units") / 2).cast("int")
        counted = lambda taken: F.aggregate(taken, F.transform("quotas", lambda _: F.lit(0)), lambda acc, s: F.transform(acc, lambda v, i: v + (i == s).cast("int")))
        nodes = nodes.withColumn("left", counted(F.slice("units", F.lit(1), half)))
        right = F.transform("quotas", lambda q, i: q - F.get(F.col("left"), i))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))
        nodes = nodes.select(F.inline(sides))
    return nodes.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("rank", "n_blocks"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[int, ...] = WEIGHTS,
                most: int = MOST_COPIES, levels: int | None = None, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, pieces, quotas).

    sizes: row, doc_id, source, size, source_size, target, one row for each row of ``docs``.
    pieces: row, doc_id, source, copy, words (of its start), block, shard, draw: one row for each time that a
    document is taken.  The targets share the words of all documents.
    quotas: shard, source, n_blocks, what the splitting tree gives each shard.

    ``row`` is a number of the row, or ``row_col`` where ``docs`` has one.  A
    null text has no words and is never taken; a null source is a source; a
    text of any length is counted whole.  Rows that repeat a doc_id are
    documents of their own.  Reruns agree: the order is by hash, doc_id and
    text, so only rows that repeat all of these may change places.  An empty
    table gives empty results; further columns are ignored.
    """
    levels = max(SHARDS_LOG2, (tasks(docs.sparkSession) - 1).bit_length()) if levels is None else levels
    sizes = docs.select(F.col(row_col or id_col).cast("long").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), text_hash(text_col).alias("text_hash"))
    sizes = (sizes if row_col else sizes.withColumn("row", F.monotonically_increasing_id())).withColumn("perm", _draw(F.lit(seed), F.col("doc_id")))
    sizes = stored(sizes, "sizes")
    targets = stored(source_targets(sizes, weights, most), "targets").withColumnRenamed("source", "s")
    placed = sizes.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # two-level running sums: runs of the permuted order, then rows within a run
    bits = min(40, max(0, (sizes.count() // RUN).bit_length()))
    placed = placed.withColumn("run", F.shiftrightunsigned("perm", 60 - bits))
    runs = placed.groupBy("rank", "run").agg(F.sum("size").alias("run_size"))
    earlier = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("rank", "run", F.coalesce(F.sum("run_size").over(earlier), F.lit(0)).alias("run_start"))
    inside = Window.partitionBy("rank", "run").orderBy("perm", "doc_id", "text_hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    line = placed.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(runs, ["rank", "run"])
    goal = F.floor("target")
    block_words = targets.agg(F.greatest(F.ceil(F.sum(goal) / ((1 << levels) * blocks_per_shard)), F.lit(1)).alias("block_words"))
    quotas = targets.select("rank", goal.alias("goal")).crossJoin(F.broadcast(block_words))  # one row
    dealt = stored(split_quotas(quotas.select("rank", F.ceil(F.col("goal") / F.col("block_words")).alias("n_blocks")), levels, seed), "dealt")
    # the n-th of a source's permuted blocks goes to the shard whose quota covers n
    last = F.sum("n_blocks").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    turns = dealt.withColumn("last", last).where("n_blocks > 0").select("rank", "shard", F.explode(F.sequence(F.col("last") - F.col("n_blocks") + 1, F.col("last"))).alias("turn"))
    blocks = quotas.where("goal > 0").select("rank", "block_words", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("goal") / F.col("block_words")) - 1)).alias("block"))
    permuted = F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), F.lit("blocks"), "rank", "block"), "block")).cast("long")
    owners = stored(blocks.withColumn("turn", permuted).join(turns, ["rank", "turn"]).select("rank", "block_words", "block", "shard"), "owners")
    words = owners.select("rank", "block_words").distinct()
    copies = line.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("start", F.col("copy") * F.col("source_size") + F.col("run_start") + F.col("before"))
    copies = copies.where((F.col("size") > 0) & (F.col("start") < goal)).withColumn("words", F.least("size", goal - F.col("start")))
    copies = copies.join(words, "rank").withColumn("block", F.floor(F.col("start") / F.col("block_words")))
    pieces = copies.join(owners.drop("block_words"), ["rank", "block"])
    pieces = pieces.select("row", "doc_id", "source", "copy", "words", "block", "shard", _draw(F.lit(seed), F.lit("shuffle"), F.col("doc_id"), F.col("copy")).alias("draw"))
    quotas = dealt.join(targets.select("rank", F.col("s").alias("source")), "rank").select("shard", "source", "n_blocks")
    return placed.select("row", "doc_id", "source", "size", "source_size", "target"), pieces, quotas


def in_shards(pieces: DataFrame) -> DataFrame:
    """The pieces by shard, each shard in its drawn order; a large shard is several partitions, by draw."""
    return pieces.repartitionByRange(tasks(pieces.sparkSession), "shard", "draw").sortWithinPartitions("shard", "draw", "doc_id", "copy")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """row, doc_id, source, size, source_size, target, taken (the sum of what the shards draw) for each row of ``docs``."""
    sizes, pieces, _ = mix_sources(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return sizes.join(taken, "row", "left").select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
