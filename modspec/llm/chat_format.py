"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

States are (first line or later line of a turn) x (system, user, assistant).
Lines emit a speaker marker, a blank flag, an ending and a length class; start,
transition and emission rates are counted, with add-one smoothing, over all
labelled conversations.  Viterbi runs by conversation, in chunks of CHUNK
turns: a chunk of a longer conversation is first boiled down to the best score
between each pair of states, the short sequence of such matrices fixes the
states at the chunks' ends, and then all chunks are decoded on their own.  So
a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modspec.llm._shared import stored, tasks

ROLES = ("system", "user", "assistant")
STATES = [(first, role) for first in (True, False) for role in ROLES]
CHUNK = 1024
#: Speaker names of each role, and a marker at the start of a line.
SPEAKERS = {"system": "system|instruction|context", "user": "user|human|question|q|customer", "assistant": "assistant|ai|bot|answer|a|model|gpt"}
MARKER = r"^\s*(?:#+\s*|\[|<\|?|\*\*)?(?:(?<system>%(system)s)|(?<user>%(user)s)|(?<assistant>%(assistant)s))(?:\||\*\*)?\s*[:>\]]+(?:\*\*)?[ \t]?" % SPEAKERS
_MARKER = re.compile(MARKER.replace("(?<", "(?P<"), re.I)
#: Values of each feature.
WIDTHS = (len(ROLES) + 1, 2, 3, 3)
LINES = "conv_id long, chunk long, turn long, pos int, line string"


def _features(line: str) -> tuple[int, int, int, int]:
    m = _MARKER.match(line)
    rest = line[m.end() :] if m else line
    marker = 1 + ROLES.index(m.lastgroup) if m else 0
    stripped = rest.rstrip()
    return marker, int(not stripped), 2 if stripped.endswith("?") else 1 if stripped.endswith((".", "!")) else 0, min(2, len(stripped) // 80)


def transcript_lines(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, turn, pos, line): the lines of each piece of transcript; a null text is one blank line."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("turn"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / chunk))
    return rows.select("conv_id", "chunk", "turn", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))


class Model:
    """Log-probabilities of starts, transitions and emissions."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        norm = lambda x: np.log((x + 1) / (x + 1).sum(-1, keepdims=True))
        self.start, self.move, self.emit = norm(start), norm(move), [norm(e) for e in emit]

    def scores(self, lines: list[str]) -> np.ndarray:
        """Log-likelihood of each line in each state."""
        features = np.array([_features(x) for x in lines]).reshape(-1, len(WIDTHS))
        return sum(e[:, features[:, i]].T for i, e in enumerate(self.emit))

    def matrix(self, scores: np.ndarray, first: bool) -> np.ndarray:
        """Best score from each state before the lines to each state at their end."""
        out = np.where(np.eye(len(STATES), dtype=bool), 0.0, -np.inf)
        for i, s in enumerate(scores):
            step = np.broadcast_to(self.start, self.move.shape) if first and not i else self.move
            out = (out[:, :, None] + step[None, :, :]).max(1) + s
        return out

    def decode(self, scores: np.ndarray, before: int | None, at_end: int | None) -> list[int]:
        """Best states of the lines, given those before the first line and at the last, where known."""
        best = (self.start if before is None else self.move[before]) + scores[0]
        back = []
        for s in scores[1:]:
            total = best[:, None] + self.move
            back.append(total.argmax(0))
            best = total.max(0) + s
        path = [int(best.argmax()) if at_end is None else at_end]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def train(labelled: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Model:
    """Counts over all labelled turns; a turn's first line has its speaker marker.  Only counts come to the driver."""
    rows = labelled.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.lower(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("role").isin(*ROLES))
    state = {s: i for i, s in enumerate(STATES)}
    n = len(STATES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple[str, int, int], int] = {}

        def add(kind: str, a: int, b: int, by: int = 1) -> None:
            kinds[kind, a, b] = kinds.get((kind, a, b), 0) + by

        for batch in batches:
            for role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = re.split(r"\r?\n", text)
                first, later = state[True, role], state[False, role]
                for i, line in enumerate(lines):
                    for k, value in enumerate(_features(line)):
                        add(f"emit{k}", first if not i else later, value)
                if len(lines) > 1:
                    add("move", first, later)
                    add("move", later, later, len(lines) - 2)
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kinds]), pa.array([k[1] for k in kinds], pa.int32()), pa.array([k[2] for k in kinds], pa.int32()), pa.array(list(kinds.values()), pa.int64())], ["kind", "a", "b", "n"])

    counts = rows.select("role", "text").mapInArrow(count, "kind string, a int, b int, n long")
    ends = rows.select("conv_id", "turn", "role", F.size(F.split("text", r"\r?\n")).alias("lines"))
    after = ends.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    number = lambda c: F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col(c)) - 1
    last = (number("role") + F.when(F.col("lines") > 1, len(ROLES)).otherwise(0)).cast("int")
    moves = ends.join(after, ["conv_id", "turn"]).groupBy(last.alias("a"), number("next_role").cast("int").alias("b")).agg(F.count("*").alias("n")).select(F.lit("move").alias("kind"), "a", "b", "n")
    starts = ends.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("first")).groupBy(number("first.role").cast("int").alias("b")).agg(F.count("*").alias("n")).select(F.lit("start").alias("kind"), F.lit(0).alias("a"), "b", "n")
    tables = {"start": np.zeros((1, n)), "move": np.zeros((n, n)), **{f"emit{k}": np.zeros((n, w)) for k, w in enumerate(WIDTHS)}}
    for r in counts.union(moves).union(starts).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect():
        tables[r["kind"]][r["a"], r["b"]] += r["n"]
    return Model(tables["start"][0], tables["move"], [tables[f"emit{k}"] for k in range(len(WIDTHS))])


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of rows with equal keys, which may cross batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        frame = batch.to_pandas() if held is None else pd.concat([held, batch.to_pandas()], ignore_index=True)
        same = (frame[keys].shift(-1) == frame[keys]).all(axis=1).to_numpy()
        cuts = np.flatnonzero(~same[:-1]) + 1
        start = 0
        for cut in cuts:
            yield frame.iloc[start:cut]
            start = cut
        held = frame.iloc[start:]
    if held is not None:
        yield held


def decode_lines(transcripts: DataFrame, model: Model, chunk: int = CHUNK, **columns) -> DataFrame:
    """conv_id, chunk, turn, pos, local (number of the recovered turn in its chunk), role, line (without its marker)."""
    lines = transcript_lines(transcripts, chunk=chunk, **columns).where("conv_id is not null")
    order = ["conv_id", "chunk", "turn", "pos", "line"]
    firsts = lines.groupBy("conv_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last")
    long = lines.join(firsts, "conv_id").select(*order, (F.col("chunk") == F.col("first")).alias("begins"))
    n = len(STATES)

    def boil(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["conv_id", "chunk"]):
            m = model.matrix(model.scores(g["line"].tolist()), bool(g["begins"].iloc[0]))
            yield pa.RecordBatch.from_pydict({"conv_id": [g["conv_id"].iloc[0]], "chunk": [g["chunk"].iloc[0]], "matrix": [m.ravel().tolist()]})

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        best, back = np.zeros(n), []
        for m in pdf["matrix"]:
            total = best[:, None] + np.array(m).reshape(n, n)
            back.append(total.argmax(0))
            best = total.max(0)
        ends = [int(best.argmax())]
        for b in reversed(back[1:]):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        return pd.DataFrame({"conv_id": pdf["conv_id"], "chunk": pdf["chunk"], "before": [-1, *ends[:-1]], "at_end": ends})

    dealt = lambda df: df.repartition(tasks(df.sparkSession), "conv_id", "chunk").sortWithinPartitions(*order)
    matrices = dealt(long).mapInArrow(boil, "conv_id long, chunk long, matrix array<double>")
    joints = stored(matrices.groupBy("conv_id").applyInPandas(link, "conv_id long, chunk long, before int, at_end int"), "joints")
    known = lines.join(joints, ["conv_id", "chunk"], "left").select(*order, F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("at_end", F.lit(-1)).alias("at_end"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["conv_id", "chunk"]):
            given = [None if g[c].iloc[0] < 0 else int(g[c].iloc[0]) for c in ("before", "at_end")]
            texts = g["line"].tolist()
            states = [STATES[s] for s in model.decode(model.scores(texts), *given)]
            local = np.cumsum([first for first, _ in states])
            clean = [_MARKER.sub("", x, count=1) if first else x for x, (first, _) in zip(texts, states)]
            yield pa.RecordBatch.from_arrays([pa.array(g["conv_id"], pa.int64()), pa.array(g["chunk"], pa.int64()), pa.array(g["turn"], pa.int64()), pa.array(g["pos"], pa.int32()),
                pa.array(local, pa.int64()), pa.array([r for _, r in states]), pa.array(clean, pa.string())], ["conv_id", "chunk", "turn", "pos", "local", "role", "line"])

    return stored(dealt(known).mapInArrow(decode, "conv_id long, chunk long, turn long, pos int, local long, role string, line string"), "decoded")


def role_agreement(conversations: DataFrame, transcripts: DataFrame, model: Model, **options) -> DataFrame:
    """role, marked, n, n_right: of the turns of ``conversations``, with and without a marker in ``transcripts``, how many have their own role."""
    first = decode_lines(transcripts, model, **options).where("pos = 0").select("conv_id", "turn", F.col("role").alias("found"))
    marked = transcripts.select("conv_id", "turn", F.rlike("text", F.lit("(?i)" + MARKER)).alias("marked"))
    both = conversations.select("conv_id", "turn", F.lower("role").alias("role")).join(marked, ["conv_id", "turn"]).join(first, ["conv_id", "turn"])
    return both.groupBy("role", "marked").agg(F.count("*").alias("n"), F.count_if(F.col("role") == F.col("found")).alias("n_right"))


def format_chats(transcripts: DataFrame, model: Model, chunk: int = CHUNK, **columns) -> DataFrame:
    """conv_id, turn_no, role, content, rendered: the recovered turns of each conversation.

    ``transcripts`` has pieces of text in the order of their turns; null texts
    are blank lines, a null conv_id is left out, pieces of a repeated turn
    follow one another by text.  A turn of any length is decoded whole, in the
    task of its chunk; an empty table gives an empty result.  Further columns
    are ignored.
    """
    decoded = decode_lines(transcripts, model, chunk, **columns)
    totals = decoded.groupBy("conv_id", "chunk").agg(F.max("local").alias("turns"))
    # one row for each chunk: a window over them is small
    before = totals.select("conv_id", "chunk", F.sum("turns").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    numbered = decoded.join(before, ["conv_id", "chunk"], "left").withColumn("turn_no", F.coalesce("earlier", F.lit(0)) + F.col("local"))
    lines_of = F.sort_array(F.collect_list(F.struct("turn", "pos", "line")))
    turns = numbered.groupBy("conv_id", "turn_no").agg(F.min("role").alias("role"), F.array_join(F.transform(lines_of, lambda x: x["line"]), "\n").alias("content"))
    return turns.select("conv_id", "turn_no", "role", "content", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("content"), F.lit("<|end|>\n")).alias("rendered"))


def held_out(conv_id: Column) -> Column:
    """A fifth of the conversations, by hash; a null id isn't held out."""
    return F.coalesce(F.pmod(F.xxhash64(conv_id.cast("long")), F.lit(5)) == 0, F.lit(False))


def marked_transcripts(conversations: DataFrame, unmarked: float = 0.2) -> DataFrame:
    """Conversations as transcripts: each turn's text behind a speaker marker, in one of four styles by conversation.

    The markers are made from the role column; a share of ``unmarked`` turns,
    by hash, has none, so that what surrounds them has to give their role.
    """
    role = F.lower("role")
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    marker = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit(": "))).when(style == 2, F.concat(F.lit("["), role, F.lit("] ")))
    marker = marker.otherwise(F.concat(F.lit("<|"), role, F.lit("|> ")))
    marker = F.when(F.pmod(F.xxhash64("conv_id", "turn", F.lit("unmarked")), F.lit(1000)) >= int(1000 * unmarked), marker)
    return conversations.withColumn("text", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))))
