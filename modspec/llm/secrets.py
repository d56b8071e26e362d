"""Secret scans, with DataFrame functions only.

Three base patterns (assignments, access keys, hex runs) give base spans.  Two
character Markov models, of random strings and of ordinary identifiers, are
trained from labelled samples in the same texts: the values that the base
patterns found are random; long tokens outside of them that fall into words
and numbers between separators are ordinary.  A long token elsewhere whose
log-likelihood ratio of the two exceeds MARGIN is one more span, of kind
``random``.  A sample of one's own (token, random) can be given instead.

Texts are scanned once; later steps see only spans and long tokens, and what
comes to the driver is one count for each pair of alphabet characters.  The
work on a text grows with its length and matches, whatever their number.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspec.llm._shared import stored

KINDS = ("assign", "access", "hex")
#: The base patterns; each kind with the least length of the group that must be that long.
PATTERNS = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: The same matches with the length in the pattern, where that can't change what is matched.
_SCANNED = {"assign": PATTERNS["assign"][0], "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Tokens that the models judge.
LONG_TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Nats by which the model of random strings must be likelier.
MARGIN = 10.0
#: Counts that a character's overall share weighs in the models.
BACKOFF = 20.0
#: Places of matches are summed in blocks of so many.
BLOCK = 256
#: Pairs of spans and long tokens that are compared within a row; texts with more go by a sorted pass over their spans.
PAIRS_IN_ROW = 100_000
#: Words and numbers between separators.
ORDINARY = r"^[+/_=-]*([A-Za-z]+|[0-9]+)([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*$"
_SPAN = "array<struct<start:int,no:int,kind:string,stop:int,value:string>>"


def _bound(value: Column, f) -> Column:
    """``f(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running_sums(sizes: Column) -> Column:
    """Running sums of an array of whole numbers, not empty, in two levels: within blocks, and over the blocks' ends."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)), empty, step, lambda acc: acc["out"]))

    def joined(parts: Column) -> Column:
        ends = F.aggregate(F.transform(parts, lambda p: F.element_at(p, -1)), empty, step, lambda acc: acc["out"])
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        return F.flatten(F.zip_with(parts, before, lambda p, o: F.transform(p, lambda x: x + o)))

    return _bound(blocks, joined)


def find_spans(text: Column, pattern: str, kind: str, no: int, group: int = 0) -> Column:
    """All matches, leftmost and not overlapping, with their places in code points.

    The pieces between matches and the matches themselves come in order, so
    running sums of their lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def spans(found: Column) -> Column:
        sizes = F.zip_with(F.slice(found["p"], F.lit(1), F.size(found["w"])), found["w"], lambda p, w: F.length(p) + F.length(w))
        zipped = F.arrays_zip(running_sums(sizes).alias("stop"), found["w"].alias("w"), found["v"].alias("v"))
        return F.transform(zipped, lambda x: F.struct((x["stop"] - F.length(x["w"])).alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), x["stop"].alias("stop"), x["v"].alias("value")))

    matched = F.struct(F.split(text, pattern, -1).alias("p"), whole.alias("w"), value.alias("v"))
    return F.when(text.rlike(pattern), _bound(matched, spans)).otherwise(F.array().cast(_SPAN))


def _apart(rows: DataFrame) -> DataFrame:
    """(row, tokens): the long tokens that overlap no base span, found in one sorted pass over the spans of each text."""
    span = lambda c, is_base: rows.select("row", F.explode(c).alias("s"), F.lit(is_base).alias("is_base"))
    spans = span("base", True).union(span("tokens", False)).withColumn("start", F.col("s.start"))
    order = Window.partitionBy("row").orderBy("start", F.desc("is_base"))
    stop = F.max(F.when(F.col("is_base"), F.col("s.stop"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.first(F.when(F.col("is_base"), F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = spans.withColumn("before", stop).withColumn("after", begin).where("not is_base and coalesce(before <= start, true) and coalesce(after >= s.stop, true)")
    return free.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("tokens"))


def _pairs(token: Column) -> Column:
    return F.when(F.length(token) > 1, F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.substr(token, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def train_models(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of alphabet characters, random over ordinary; ``samples``: token, random (boolean).

    A first-order model that backs off, with a weight of BACKOFF counts, to how
    often its sample has the second character at all (plus one), so characters
    that one sample lacks speak for the other.  Without samples all ratios are 0.
    """
    size = len(ALPHABET)
    counts = samples.select("random", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").count()
    seen = {(r["random"], r["pair"]): r["count"] for r in counts.collect()}  # twice the square of the alphabet at most

    def model(kind: bool) -> list[float]:
        pairs = [[seen.get((kind, a + b), 0) for b in ALPHABET] for a in ALPHABET]
        single = [sum(row[k] for row in pairs) + 1 for k in range(size)]
        total = sum(single)
        return [log((n + BACKOFF * single[k] / total) / (sum(row) + BACKOFF)) for row in pairs for k, n in enumerate(row)]

    return [x - y for x, y in zip(model(True), model(False))]


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    value = lambda p: F.coalesce(F.get(table, place(F.substr(p, F.lit(1), F.lit(1))) * len(ALPHABET) + place(F.substr(p, F.lit(2), F.lit(1)))), F.lit(0.0))
    return F.aggregate(_pairs(token), F.lit(0.0), lambda acc, p: acc + value(p))


def _at_least(least: int):
    return lambda span: F.length(span["value"]) >= least


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN, samples: DataFrame | None = None) -> DataFrame:
    """doc_id, base, added: arrays of spans (start, no, kind, stop, value), by start, for each row of ``docs``.

    Places are code points, the end exclusive.  A null text is empty; texts
    without secrets have empty arrays; a text of any length is scanned whole.
    Rows that repeat an id stay rows of their own, further columns are
    ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    found = []
    for no, kind in enumerate(KINDS):
        _, group, least = PATTERNS[kind]
        found.append(F.filter(find_spans(F.col("text"), _SCANNED[kind], kind, no, group), _at_least(least)))
    scanned = scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.array_sort(F.concat(*found)).alias("base"), find_spans(F.col("text"), LONG_TOKEN, "random", len(KINDS)).alias("tokens"))
    scanned = stored(scanned, "spans")
    pairs = F.size("base").cast("long") * F.size("tokens")
    apart = lambda t: ~F.exists("base", lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))
    few = scanned.where(pairs <= PAIRS_IN_ROW).withColumn("tokens", F.filter("tokens", apart)).drop("row")
    many = scanned.where(pairs > PAIRS_IN_ROW)
    if many.limit(1).count():
        free = stored(_apart(many), "apart")
        few = few.union(many.drop("tokens").join(free, "row", "left").select("doc_id", "base", F.coalesce("tokens", F.array().cast(_SPAN)).alias("tokens")))
    scanned = few
    if samples is None:
        secret = scanned.select(F.explode("base.value").alias("token"), F.lit(True).alias("random"))
        ordinary = scanned.select(F.explode("tokens.value").alias("token"), F.lit(False).alias("random")).where(F.rlike("token", F.lit(ORDINARY)))
        samples = secret.union(ordinary)
    ratios = train_models(samples)
    added = F.filter("tokens", lambda t: likelihood_ratio(t["value"], ratios) > margin)
    return scanned.select("doc_id", "base", added.alias("added"))


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    every = F.array_sort(F.concat("base", "added"))
    return scan_secrets(docs, **options).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(every).alias("spans"))
