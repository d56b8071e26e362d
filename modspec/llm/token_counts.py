"""Token counts under a unigram reading of a public vocabulary.

A pre-token (a run without white space, opened by the vocabulary's word mark)
is cut into pieces so that the sum of their scores is largest; bytes that no
piece covers are tokens of their own at a low score.  The distinct pre-tokens
of a slice of texts form a trie, walked one depth at a time: a node's forward
score is computed once, from those of its ancestors and the piece that ends at
it, whatever number of words share the prefix; a word's count stands at its
terminal node.  Words of more than LONG bytes, which share little, are cut one
by one by the same sums.  There is no shuffle.

The vocabulary file (its path is a parameter) lists pieces by rank; scores are
those of a Zipf law over ranks, -log(rank + 2).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._shingles import U, mix, slices, string_buffers, word_bounds, word_hashes

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SPACE = b"\t\n\x0b\x0c\r "
#: Added to the score of the rarest piece for a byte without a piece.
UNKNOWN = -8.0
#: Bytes of text whose distinct words share a trie.
TRIE_BYTES = 4 << 20
#: Bytes of a word beyond which it has no place in the trie.
LONG = 256

with np.errstate(over="ignore"):
    _BASE = U(0x9E3779B97F4A7C15)
    _BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -log(rank + 2) for rank, i in enumerate(ids)}


class PieceTable:
    """Scores of pieces by their length in bytes and hash."""

    def __init__(self, pieces: dict[str, float]):
        self.unknown = min(pieces.values(), default=0.0) + UNKNOWN
        self.pieces = {p.encode(): s for p, s in pieces.items()}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[int, list[tuple[int, float]]] = {}
        with np.errstate(over="ignore"):
            for piece, score in pieces.items():
                data, h = piece.encode(), U(0)
                for b in data:
                    h = h * _BASE + _BYTES[b]
                groups.setdefault(len(data), []).append((int(h), score))
            self.lengths = sorted(groups, reverse=True)
            self.power = {n: np.array([1], U) for n in self.lengths}
            for n in self.lengths:
                for _ in range(n):
                    self.power[n] = self.power[n] * _BASE
                hashes = np.array([h for h, _ in groups[n]], U)
                order = np.argsort(hashes)
                self.by_length[n] = hashes[order], np.array([s for _, s in groups[n]])[order]

    def score(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Score of each hash among pieces of n bytes; minus infinity without one."""
        known, scores = self.by_length[n]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, scores[at], -np.inf)


def count_tokens(words: list[bytes], table: PieceTable) -> np.ndarray:
    """Tokens of each of the sorted distinct ``words``."""
    count = len(words)
    lengths = np.array([len(w) for w in words])
    flat = np.frombuffer(b"".join(words), np.uint8)
    start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    out = np.zeros(count, np.int64)
    # node of each word, and score, tokens and prefix hash of each node, for the last few depths
    root = (np.zeros(count, np.int64), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, U))
    levels = [root]
    reach = max(table.lengths, default=1)
    alive = np.arange(count)
    above = np.zeros(count, np.int64)
    with np.errstate(over="ignore"):
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            keep = lengths[alive] >= depth
            alive, above = alive[keep], above[keep]
            byte = flat[start[alive] + depth - 1]
            new = np.ones(len(alive), bool)
            new[1:] = (above[1:] != above[:-1]) | (byte[1:] != byte[:-1])
            node = np.cumsum(new) - 1
            first = alive[new]
            node_of, score_of, tokens_of, hash_of = levels[-1]
            parent = node_of[first]
            hashes = hash_of[parent] * _BASE + _BYTES[byte[new]]
            best = np.full(len(first), -np.inf)
            tokens = np.zeros(len(first), np.int64)
            for n in table.lengths:
                if n > depth:
                    continue
                node_back, score_back, tokens_back, hash_back = levels[-n]
                ancestor = node_back[first]
                total = score_back[ancestor] + table.score(n, hashes - hash_back[ancestor] * table.power[n])
                better = total > best
                best[better] = total[better]
                tokens[better] = tokens_back[ancestor[better]] + 1
            total = score_of[parent] + table.unknown
            better = total > best
            best[better] = total[better]
            tokens[better] = tokens_of[parent[better]] + 1
            placed = np.zeros(count, np.int64)
            placed[alive] = node
            levels.append((placed, best, tokens, hashes))
            if len(levels) > reach:
                levels.pop(0)
            ends = lengths[alive] == depth
            out[alive[ends]] = tokens[node[ends]]
            above = node
    return out


def count_one(word: bytes, table: PieceTable) -> int:
    """Tokens of one word."""
    lengths, pieces = table.lengths, table.pieces
    reach = max(lengths, default=1)
    # scores and tokens of the last prefixes, by length modulo a little more than the longest piece
    ring = reach + 1
    scores, tokens = [0.0] * ring, [0] * ring
    for end in range(1, len(word) + 1):
        best, count = -np.inf, 0
        for n in lengths:
            if n <= end and (s := pieces.get(word[end - n : end])) is not None:
                total = scores[(end - n) % ring] + s
                if total > best:
                    best, count = total, tokens[(end - n) % ring] + 1
        total = scores[(end - 1) % ring] + table.unknown
        if total > best:
            best, count = total, tokens[(end - 1) % ring] + 1
        scores[end % ring], tokens[end % ring] = best, count
    return tokens[len(word) % ring]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words (pre-tokens), n_tokens for each row of ``docs``.

    Null, empty and white-space texts have no tokens.  Of equally good cuts the
    one whose last piece is longest counts.  A text of any length is counted
    whole, by one task, in time that grows with its length.  Rows that repeat
    an id stay rows, further columns are ignored, an empty table gives an empty
    result.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))  # a vocabulary, whatever the size of the input
    mark = MARK.encode()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(pieces.value)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j in slices(offsets, TRIE_BYTES):
                part, ends = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, before = word_hashes(part, ends, lower=False)
                starts, _ = word_bounds(part, ends)
                _, some, inverse = np.unique(hashes, return_index=True, return_inverse=True)
                raw = part.tobytes()
                # a word ends at white space or where the next row begins
                row_end = ends[np.searchsorted(before, some, "right")] if len(some) else some
                words = [mark + raw[a:b].rstrip(SPACE) for a, b in zip(starts[some].tolist(), np.minimum(row_end, np.append(starts, len(part))[some + 1]).tolist())]
                order = sorted((k for k in range(len(words)) if len(words[k]) <= LONG), key=words.__getitem__)
                counts = np.zeros(len(words), np.int64)
                for k in (k for k in range(len(words)) if len(words[k]) > LONG):
                    counts[k] = count_one(words[k], table)
                counts[order] = count_tokens([words[k] for k in order], table)
                sums = np.concatenate([[0], np.cumsum(counts[inverse])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(before), pa.int64()), pa.array(sums[before[1:]] - sums[before[:-1]], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
