"""Toxicity by weak supervision.

Voters are lexicon entries (words and word beginnings that labelled toxic
texts have far more often) and a few patterns of shouting.  A generative label
model estimates the accuracy of each voter by EM, with strongly correlated
voters (a word and its own beginning) tied into one vote, and the given label
as one more, imperfect voter.  A linear classifier is trained on the posterior
labels and scores whole texts; neither labels nor ids, sources or languages
are inputs of a score.

Training uses at most MAX_TRAIN labelled rows outside the held-out fold,
chosen by hash; votes of those rows (MAX_TRAIN by MAX_VOTERS bits) are the only
thing gathered at the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import stored

MAX_TRAIN = 20_000
MAX_VOTERS = 256
#: Toxic labelled texts that must have a lexicon entry.
LEAST_SUPPORT = 4
STEMS = (4, 5)
#: Voters whose votes have at least this cosine count as one.
TIED = 0.6

_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {
    "!shouting": re.compile(r"(?:\b[A-Z]{4,}\b[^a-z]*){5,}"),
    "!marks": re.compile(r"[!?]{3,}"),
}


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    out = words | {f"^{w[:k]}" for k in STEMS for w in words if len(w) > k}
    return out | {name for name, p in _PATTERNS.items() if p.search(text)}


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        weights, bias = self.weights, self.bias
        lexicon = {w for w in weights if w[0] not in "^!"}
        stems = [(k, {w[1:] for w in weights if w[0] == "^" and len(w) == k + 1}) for k in STEMS]
        patterns = [(n, p) for n, p in _PATTERNS.items() if weights.get(n)]

        def score(text: str) -> float:
            words = set(_WORD.findall(text.lower()))
            z = bias + sum(weights[w] for w in words & lexicon)
            for k, known in stems:
                z += sum(weights[f"^{s}"] for s in {w[:k] for w in words if len(w) > k} & known)
            z += sum(weights[n] for n, p in patterns if p.search(text))
            return 1 / (1 + np.exp(-min(50.0, max(-50.0, z))))

        return score


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row of the 0/1 matrix ``votes``.

    Voters with correlated votes are tied; then EM over a two-class model with
    the rates at which each tied vote fires in either class, begun from the
    given labels, which stay in as a voter of their own.
    """
    v = votes.astype(np.float32)
    norm = np.sqrt(np.maximum(v.sum(0), 1))
    alike = (v.T @ v) / norm[:, None] / norm[None, :] >= TIED
    tie = np.arange(v.shape[1])
    for _ in range(len(tie)):
        new = np.array([tie[alike[j]].min() if alike[j].any() else tie[j] for j in range(len(tie))], int)
        if (new == tie).all():
            break
        tie = new
    groups = np.stack([v[:, tie == g].max(1) for g in np.unique(tie)], 1) if len(tie) else np.zeros((len(v), 0), np.float32)
    groups = np.concatenate([groups, labels[:, None].astype(np.float32)], 1)
    q = np.where(labels == 1, 0.95, 0.05)
    for _ in range(rounds):
        prior = (q.sum() + 1) / (len(q) + 2)
        on = (q @ groups + 0.1) / (q.sum() + 0.2)
        off = ((1 - q) @ groups + 0.1) / ((1 - q).sum() + 0.2)
        on[-1], off[-1] = np.clip(on[-1], 0.6, 0.99), np.clip(off[-1], 0.01, 0.4)
        z = np.log(prior / (1 - prior)) + groups @ np.log(on / off) + (1 - groups) @ np.log((1 - on) / (1 - off))
        q = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return q


def linear_classifier(votes: np.ndarray, posterior: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by damped Newton steps."""
    x = np.concatenate([votes.astype(np.float64), np.ones((len(votes), 1))], 1)
    w = np.zeros(x.shape[1])
    damp = np.full(len(w), ridge * max(1, len(x)) / 100 + 0.05)
    damp[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(damp), x.T @ (posterior - p) - damp * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Classifier:
    """Trains on labelled rows outside the held-out fold, ``max_train`` at most; without both labels, all scores are 0.

    The classifier has at most MAX_VOTERS weights, those of the entries that tell the classes best apart.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(stored(known, "known")), "doc_id").select("text", "label"), "sample")  # max_train rows at most are broadcast

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(_features(text))
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], ["feature", "on", "off"])

    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return Classifier({}, -50.0)
    counts = sample.mapInArrow(count, "feature string, on long, off long").groupBy("feature").agg(F.sum("on").alias("on"), F.sum("off").alias("off"))
    odds = F.log((F.col("on") + 0.5) / (n[1] + 1) / ((F.col("off") + 0.5) / (n[0] + 1)))
    best = counts.where((F.col("on") >= LEAST_SUPPORT) & (odds > 1)).orderBy((F.col("on") * odds).desc(), "feature").limit(MAX_VOTERS - len(_PATTERNS))
    voters = sorted({r["feature"] for r in best.select("feature").collect()} | set(_PATTERNS))
    place = {f: i for i, f in enumerate(voters)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = [[place[f] for f in _features(t) if f in place] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(fired, pa.list_(pa.int32())), batch.column(1)], ["fired", "label"])

    rows = sample.mapInArrow(vote, "fired array<int>, label int").collect()
    rows = sorted((sorted(r["fired"]), r["label"]) for r in rows)
    votes = np.zeros((len(rows), len(voters)), np.uint8)
    for i, (fired, _) in enumerate(rows):
        votes[i, fired] = 1
    weights, bias = linear_classifier(votes, label_model(votes, np.array([y for _, y in rows])))
    return Classifier({f: round(float(w), 6) for f, w in zip(voters, weights) if abs(w) > 1e-6}, round(bias, 6))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """All columns of ``docs`` and: held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts count as empty, which have a score as others do.  Labels that
    are null or neither 0 nor 1 are left out; of differing labels of a document
    1 counts, and documents that repeat its id all have it.  A text of any length is
    scored whole; an empty table gives an empty result.  Columns of ``docs`` with these names are replaced.
    """
    model = train(docs, labels, id_col, text_col, label_col, max_train)

    @F.pandas_udf("double")
    def score(texts):
        of = model.scorer()
        return texts.fillna("").map(of).astype(float)

    scored = docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("score", score(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
