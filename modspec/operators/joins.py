"""Joins on nearness: bands, ranges, as-of, nearest, containment, dominance.

Inequalities alone would make Spark compare all pairs.  Here a bucket of the
value becomes an equi-join key (the side that is exploded to its neighbour
buckets is the smaller one) and the exact predicate filters what meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tol: float, keys: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """All pairs with |left - right| <= tol (or < tol), many to many, within equal ``keys``."""
    bucket = lambda c: F.floor(F.col(c) / tol).cast("long")
    a = left.withColumn("_bucket", bucket(left_value))
    b = right.withColumn("_bucket", F.explode(F.sequence(bucket(right_value) - 1, bucket(right_value) + 1)))
    apart = F.abs(F.col(left_value) - F.col(right_value))
    return a.join(b, ["_bucket", *keys]).where(apart <= tol if inclusive else apart < tol).drop("_bucket")


def band_sums(points: DataFrame, items: DataFrame, group: str, at: str, value: str, item_at: str, tol: float, name: str) -> DataFrame:
    """``items`` with the sum of the values of the points of their group with |at - item_at| <= tol; null without one.

    As ``band_join`` and a sum, but one window over both, so rows that lie by ``group`` stay where they are.
    """
    bucket = lambda c: F.floor(F.col(c) / tol).cast("long").alias("_bucket")
    item = F.struct(*[c for c in items.columns if c != group])
    point = F.struct(F.col(at).cast("double").alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    kept = items.select(group, bucket(item_at), item.alias("_item"))
    both = kept.withColumn("_point", F.lit(None).cast("struct<at:double,v:double>")).unionByName(points.select(group, bucket(at), F.lit(None).cast(kept.schema["_item"].dataType).alias("_item"), point.alias("_point")))
    near = both.withColumn("_near", F.collect_list("_point").over(Window.partitionBy(group).orderBy("_bucket").rangeBetween(-1, 1))).where("_item is not null")
    fine = F.filter("_near", lambda p: F.abs(p["at"] - F.col(f"_item.{item_at}")) <= tol)
    total = F.aggregate("_met", F.lit(0.0), lambda acc, p: acc + p["v"])
    return near.withColumn("_met", fine).select(group, "_item.*", F.when(F.size("_met") > 0, total).alias(name))


def range_join(points: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float, keys: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """All pairs with low < value < high (or with both ends); ``width`` is about the length of a range."""
    a = points.withColumn("_bucket", F.floor(F.col(value) / width).cast("long"))
    b = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))))
    inside = (F.col(value) > F.col(low)) & (F.col(value) < F.col(high)) if strict else F.col(value).between(F.col(low), F.col(high))
    return a.join(b, ["_bucket", *keys]).where(inside).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str, take: dict[str, str], tie: str, hot: bool | None = None) -> DataFrame:
    """Each left row with the columns ``take`` (name in right to new name) of the last right row at or before it; without one it is dropped.

    Union and last non-null value: one shuffle on the keys, no range join; large
    groups go in runs of ``on`` (``windows.carried``).
    """
    from modspec.operators.windows import carried

    side = F.struct(*[F.col(c).alias(n) for c, n in take.items()])
    rows = left.select(*left.columns, F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType).alias("_right"), F.lit(1).alias("_side"))
    others = right.select(*[F.col(c) if c in keys or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], side.alias("_right"), F.lit(0).alias("_side"))
    joined = carried(rows.unionByName(others), keys, on, [on, "_side", tie], {"_last": F.col("_right")}, hot=hot).where("_side = 1 and _last is not null")
    return joined.select(*left.columns, *[F.col(f"_last.{n}").alias(n) for n in take.values()])


def precursor_profile(spectra: DataFrame, peaks: DataFrame, key: str, keys: list[str], precursor: str, mz: str, intensity: str, tol: float) -> DataFrame:
    """``spectra`` with intensity: the largest peak within ``tol`` of the precursor among the peaks of equal ``keys``, 0 without one."""
    at = peaks.select(*keys, F.col(mz).alias("_mz"), F.col(intensity).alias("_intensity"))
    # peaks of one m/z differ in their largest only
    at = at.groupBy(*keys, "_mz").agg(F.max("_intensity").alias("_intensity"))
    near = band_join(spectra.select(key, *keys, F.col(precursor).alias("_precursor")), at, "_precursor", "_mz", tol, tuple(keys))
    top = near.groupBy(key).agg(F.max("_intensity").alias("intensity"))
    return spectra.join(top, key, "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def nearest_join(points: DataFrame, grid: DataFrame, keys: list[str], on: str, index: str, max_err: float, hot: bool | None = None) -> DataFrame:
    """Index of the grid value nearest to each point, the first on ties; null beyond ``max_err``.

    ``grid`` has keys, ``on`` and ``index``.  The last grid value at or before
    the point and the first after it come from one pass in each direction, in
    runs of ``on`` for large groups.
    """
    from modspec.operators.windows import RUN_ROWS, carried, is_hot

    at = F.struct(F.col(on).alias("v"), F.col(index).alias("i"))
    rows = points.select(*points.columns, F.lit(None).cast(grid.select(at.alias("s")).schema["s"].dataType).alias("_g"), F.lit(1).alias("_side"))
    others = grid.select(*[F.col(c) if c in keys or c == on else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], at.alias("_g"), F.lit(0).alias("_side"))
    both = rows.unionByName(others).withColumn("_gi", F.col("_g.i"))
    hot = is_hot(both, keys, RUN_ROWS) if hot is None else hot
    order = [on, "_side", "_gi"]
    both = carried(both, keys, on, order, {"_value": F.col("_g.v")}, hot=hot)
    both = carried(both, keys, on, order, {"_after": F.col("_g")}, back=True, hot=hot)
    # of equal grid values the first index stands
    firsts = grid.groupBy(*keys, F.col(on).alias("_value")).agg(F.min(index).alias("_before_i"))
    found = both.where("_side = 1").join(firsts, [*keys, "_value"], "left")
    below, above = F.col(on) - F.col("_value"), F.col("_after.v") - F.col(on)
    pick = F.when(F.col("_after").isNull() | (below <= above), F.col("_before_i")).otherwise(F.col("_after.i"))
    err = F.least(below, above)
    return found.select(*points.columns, F.when(err <= max_err, pick).alias(index))


def _grams(text: str, k: int) -> Column:
    """All overlapping strings of ``k`` characters, in order."""
    at_once = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    # a pattern steps by UTF-16 units, so texts beyond the basic plane are cut by characters
    bound = F.transform(F.array(F.split(F.col(text), "")), lambda chars: F.transform(F.sequence(F.lit(1), F.size(chars) - k + 1), lambda i: F.array_join(F.slice(chars, i, k), "")))
    cut = F.when(F.length(text) >= k, F.get(bound, F.lit(0)))
    return F.when(F.rlike(F.col(text), F.lit(r"[\x{10000}-\x{10FFFF}]")), cut).otherwise(at_once)


#: Characters of needles, and needles, up to which they are sent to every task; an automaton takes some 100 bytes a character.
BROADCAST_CHARACTERS = 1_000_000


def locate_substrings(needles: DataFrame, texts: DataFrame, needle_key: str, needle: str, text_key: str, text: str, seeds: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12), small: int = BROADCAST_CHARACTERS) -> DataFrame:
    """(needle_key, text_key, pos): all occurrences, overlapping ones too, 1-based in characters.

    Needles of up to ``small`` characters together, counted first, are an
    automaton that reads each text once where it lies; of more, seeds meet in an
    equi-join (``seeded_substrings``).  Null and empty needles are found nowhere.
    """
    some = needles.where(F.length(needle) > 0)
    n, characters = some.agg(F.count("*"), F.sum(F.length(needle))).first()
    if n and max(n, characters) <= small:
        return _by_automaton(some, texts, needle_key, needle, text_key, text)
    return seeded_substrings(some, texts, needle_key, needle, text_key, text, seeds)


def occurrences(words: list[str]):
    """A column function of a text: array of (number of the word) * 2^32 + its place from 1, for all occurrences."""

    @F.pandas_udf("array<long>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(word, (k, len(word)))
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([[(k << 32) + end - size + 2 for end, (k, size) in automaton.iter(text)] if text else [] for text in batch])

    return find


def _by_automaton(needles: DataFrame, texts: DataFrame, needle_key: str, needle: str, text_key: str, text: str) -> DataFrame:
    """``locate_substrings`` for needles that fit the driver and every task."""
    listed = needles.select(F.col(needle_key).alias("key"), F.col(needle).alias("word")).collect()
    number = {w: k for k, w in enumerate(sorted({r["word"] for r in listed}))}
    kind = needles.schema[needle_key].dataType
    keys = needles.sparkSession.createDataFrame([(number[r["word"]], r["key"]) for r in listed], StructType([StructField("_number", LongType()), StructField(needle_key, kind)]))
    found = texts.select(text_key, F.explode(occurrences(list(number))(F.col(text))).alias("_hit"))
    placed = found.select(text_key, F.shiftright("_hit", 32).alias("_number"), F.col("_hit").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    return placed.join(F.broadcast(keys), "_number").select(needle_key, text_key, "pos")  # at most BROADCAST_CHARACTERS keys


def locate_peptides(peptides: DataFrame, proteins: DataFrame, peptide: str = "peptide", names: str = "proteins", protein: str = "protein", sequence: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """((peptide, protein, pos), (protein)): places of peptides in the proteins that they are listed with, and listed names without a sequence.

    ``peptides`` has an array of names a row; names meet sequences in an
    equi-join, and only such pairs are searched.  All occurrences count,
    overlapping ones too, 1-based.
    """
    listed = peptides.where(F.length(peptide) > 0).select(peptide, F.explode(names).alias(protein)).distinct()
    unknown = listed.select(protein).distinct().join(proteins.select(protein), protein, "left_anti")
    pairs = listed.join(proteins.select(protein, sequence), protein)
    return pairs.select(peptide, protein, F.explode(_places(F.col(sequence), F.col(peptide))).alias("pos")), unknown


@F.pandas_udf(ArrayType(IntegerType()))
def _places(texts: pd.Series, words: pd.Series) -> pd.Series:
    def of(text: str | None, word: str) -> list[int]:
        found, at = [], (text or "").find(word)
        while at >= 0:
            found.append(at + 1)
            at = text.find(word, at + 1)
        return found

    return pd.Series([of(t, w) for t, w in zip(texts, words)])


def terminus_flags(found: DataFrame, texts: DataFrame, needle_key: str, size: str, text_key: str, text: str) -> DataFrame:
    """needle_key, text_key, is_n, is_c of each needle's first place (least text key, then place): whether it begins or ends the text.

    ``found`` has the place as pos and the needle's length as ``size``.  A
    needle at the second character is at the beginning where the first is the
    initiator M.
    """
    ends = texts.select(text_key, F.length(text).alias("_len"), F.coalesce(F.startswith(text, F.lit("M")), F.lit(False)).alias("_m"))
    first = found.groupBy(needle_key).agg(F.min(F.struct(text_key, "pos", size)).alias("f")).select(needle_key, "f.*").join(ends, text_key)
    return first.select(needle_key, text_key, ((F.col("pos") == 1) | ((F.col("pos") == 2) & F.col("_m"))).alias("is_n"), (F.col("pos") + F.col(size) - 1 == F.col("_len")).alias("is_c"))


def seeded_substrings(needles: DataFrame, texts: DataFrame, needle_key: str, needle: str, text_key: str, text: str, seeds: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12)) -> DataFrame:
    """``locate_substrings`` for any number of needles.

    Needles are classed by the longest seed that they can have; for each class
    that occurs, every place of a text meets the beginnings of the class's
    needles in an equi-join, so a short needle doesn't loosen the others'
    seeds.  Candidates longer than their seed are compared in full.
    """
    size = F.length(needle)
    seed = F.greatest(*[F.when(size >= k, k).otherwise(0) for k in seeds]) if len(seeds) > 1 else F.when(size >= seeds[0], seeds[0]).otherwise(0)
    classed = needles.where(size > 0).withColumn("_k", seed)
    found = None
    for k in [r[0] for r in classed.select("_k").distinct().collect()]:  # as many as seeds
        places = texts.select(text_key, F.posexplode(_grams(text, k)).alias("_at", "_g")).select(text_key, "_at", F.xxhash64("_g").alias("_gram"))
        heads = classed.where(F.col("_k") == k).select(needle_key, needle, F.xxhash64(F.substring(needle, 1, k)).alias("_gram"))
        met = places.join(heads, "_gram").select(needle_key, needle, text_key, (F.col("_at") + 1).alias("pos"))
        found = met if found is None else found.union(met)
    if found is None:
        found = needles.where("false").join(texts.select(text_key), F.lit(False)).select(needle_key, needle, text_key, F.lit(1).alias("pos"))
    checked = found.join(texts.select(text_key, text), text_key)
    return checked.where(F.substr(F.col(text), F.col("pos"), F.length(needle)) == F.col(needle)).select(needle_key, text_key, "pos")


def drop_dominated(members: DataFrame, group: str, owner: str, item: str) -> DataFrame:
    """Owners (group, owner) whose item set is no proper subset of another owner's in the group.

    Rows move once, by group, and a group's sets are compared where they lie;
    proper containment is transitive, so order doesn't matter.  A null is an item
    that no other owner shares, and null groups and owners stay.
    """
    rows = members.select(group, owner, item).repartition(group)
    sets = rows.groupBy(group, owner).agg(F.collect_set(item).alias("items"), F.max(F.col(item).isNull().cast("int")).alias("other"))
    every = sets.groupBy(group).agg(F.collect_list(F.struct(F.col(owner).alias("owner"), "items", "other")).alias("_sets"))
    beats = lambda o, s: (o["owner"] != s["owner"]) & (F.size(o["items"]) + o["other"] > F.size(s["items"])) & (F.size(F.array_except(s["items"], o["items"])) == 0)
    beaten = lambda s: F.col(group).isNotNull() & (s["other"] == 0) & F.coalesce(F.exists("_sets", lambda o: beats(o, s)), F.lit(False))
    return every.select(group, F.explode(F.filter("_sets", lambda s: ~beaten(s))).alias("_s")).select(group, F.col("_s.owner").alias(owner))


def first_match(peaks: DataFrame, ions: DataFrame, peak_value: str, ion_value: str, tol: float, priority: list[Column]) -> DataFrame:
    """Each peak with the first ion, by the rising ``priority`` of its columns, strictly within the tolerance.

    Of ions of one value only the first can be met, and peaks of one value meet
    the same: distinct values meet, so that neither side's repeats multiply.
    """
    rank = F.struct(*priority)
    best = ions.groupBy(F.col(ion_value).alias("_value")).agg(F.min_by(F.struct(*ions.columns), rank).alias("_ion"), F.min(rank).alias("_rank"))
    met = band_join(peaks.select(F.col(peak_value).alias("_at")).distinct(), best, "_at", "_value", tol, inclusive=False)
    first = met.groupBy("_at").agg(F.min_by("_ion", "_rank").alias("_ion"))
    return peaks.join(first, F.col(peak_value) == F.col("_at")).select(*peaks.columns, "_ion.*")
