"""Periodic runs of words by a dictionary of basic factors.

The basic factors of a text are its stretches of 1, 2, 4, ... words; a factor of
length 2L is named by the names of its halves.  Where the next occurrence of a
factor of length L lies p <= 2L words on, and the one after that p words further,
the occurrences form an arithmetic progression that proposes the period p.  A run
of smallest period q and at least 4q words has such a progression for the factor
at its start with q <= L < 2q, for a factor of at least q words can't recur
sooner than q within the run, and none is proposed but smallest periods.  The
proposals are extended to both sides as far as words p apart agree, and equal
runs are one.

A factor that occurs once can't be half of one that recurs, so each level only
keeps the places whose factors recur; on ordinary text little is left after a
few levels.  Whole texts are worked on in blocks, each word and each text with
numbers of its own, so no factor of two texts is the same.  There is no shuffle.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Words that are worked on together (a longer text is a block of its own).
BLOCK = 200_000
#: Words that an extension compares in its first step.
STRIDE = 64


def proposals(names: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(L, first place, period) of the progressions of three and more occurrences, for L = 1, 2, 4, ...

    ``names`` are the names of single words; places that share no name stay out.
    """
    length, places, names = 1, np.arange(len(names), dtype=np.int64), names.astype(np.int64)
    total = len(names)
    while len(places):
        order = np.argsort(names, kind="stable")  # by name, then by place
        sorted_names, sorted_places = names[order], places[order]
        same = sorted_names[1:] == sorted_names[:-1]
        recurs = np.zeros(len(places), bool)
        recurs[1:] |= same
        recurs[:-1] |= same
        gap = np.where(same, sorted_places[1:] - sorted_places[:-1], 0)  # to the successor
        third = np.flatnonzero((gap[:-1] > 0) & (gap[:-1] == gap[1:]) & (gap[:-1] <= 2 * length))
        if len(third):
            opens = np.ones(len(third), bool)  # the first of a progression stands for it
            opens[1:] = (third[1:] != third[:-1] + 1) | (gap[third[1:]] != gap[third[:-1]])
            yield length, sorted_places[third[opens]], gap[third[opens]]
        names, places = np.empty(recurs.sum(), np.int64), np.sort(sorted_places[recurs])
        if not len(places):
            return
        rank = np.cumsum(np.concatenate([[0], ~same]))
        by_place = np.full(total, -1, np.int64)
        by_place[sorted_places[recurs]] = rank[recurs]
        places = places[places + length < total]
        places = places[by_place[places + length] >= 0]
        pair = by_place[places] * (int(rank[-1]) + 1) + by_place[places + length]
        names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        length *= 2


def _agree(words: np.ndarray, at: int, period: int, end: int) -> int:
    """How many words from ``at`` on equal those a period later, before ``end``."""
    begin, stride = at, STRIDE
    while at < end:
        stop = min(at + stride, end)
        differ = words[at:stop] != words[at + period : stop + period]
        if differ.any():
            return at + int(differ.argmax()) - begin
        at, stride = stop, 2 * stride
    return at - begin


def _agree_back(words: np.ndarray, at: int, period: int, begin: int) -> int:
    """How many words before ``at`` equal those a period later, from ``begin`` on."""
    end, stride = at, STRIDE
    while at > begin:
        start = max(at - stride, begin)
        differ = (words[start:at] != words[start + period : at + period])[::-1]
        if differ.any():
            return end - at + int(differ.argmax())
        at, stride = start, 2 * stride
    return end - at


def runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``least`` words and ``times`` (4 or more) periods, sorted."""
    found: set[tuple[int, int, int]] = set()
    covered: dict[int, list[tuple[int, int]]] = {}  # by period: runs in the order of their discovery
    for _, places, periods in proposals(words):
        order = np.lexsort((places, periods))
        for at, p in zip(places[order].tolist(), periods[order].tolist()):
            known = covered.setdefault(p, [])
            if any(s <= at and at + 2 * p <= e for s, e in known[-1:]):
                continue
            after = _agree(words, at, p, len(words) - p)
            start, end = at - _agree_back(words, at, p, 0), at + after + p
            known.append((start, end))
            if end - start >= max(least, times * p):
                found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words of a text; those of every tenth hash of an id repeat a stretch of the text from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _digest(words: list[str], found: list[tuple[int, int, int]]) -> tuple:
    best = None
    for s, n, p in found:  # by start, then period, so only a greater exponent wins
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    kept = words
    if found:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, n, p in found:
            drop[s + p] += 1
            drop[s + n] -= 1
        kept = [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(kept))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for each row of ``docs``.

    A run is a stretch of words with smallest period q and at least max(6, 4q)
    words that no neighbour extends.  start, length and period are of the run
    with the greatest length / period (ties: smallest start, then period), null
    without one.  Collapsed texts lack what runs repeat: a word goes if any run
    has it after its first period.  With ``plant``, texts are changed first by a
    rule on their ids (``planted``); a null id changes nothing.

    Null, empty and blank texts have no words and no runs.  A text of any length
    is one task's, in memory that grows with its words.  Rows that repeat an id
    or have none stay rows, further columns are ignored, an empty table gives an
    empty result.
    """

    def blocks(batches: Iterator[pd.DataFrame]):
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = WORD.findall(text or "")
                words = planted(words, doc_id) if plant else words
                if size and size + len(words) > BLOCK:
                    yield rows
                    rows, size = [], 0
                rows.append((doc_id, words))
                size += len(words)
        if rows:
            yield rows

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in blocks(batches):
            number: dict[str, int] = {}
            # texts are parted by numbers that no word has
            names = np.array([x for k, (_, words) in enumerate(rows) for x in (*[number.setdefault(w, len(number)) for w in words], -1 - k)], np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(words) + 1 for _, words in rows])])
            by_row: list[list] = [[] for _ in rows]
            for s, n, p in runs(names):
                k = int(np.searchsorted(bounds, s, "right")) - 1
                by_row[k].append((s - int(bounds[k]), n, p))
            out = pd.DataFrame([(doc_id, *_digest(words, by_row[k])) for k, (doc_id, words) in enumerate(rows)], columns=COLUMNS)
            yield out.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})

    out = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(work, out)
