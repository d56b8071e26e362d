"""Byte-pair encoding and decoding with a public vocabulary, by tree concatenation.

A long text is cut into leaves at any character; the leaves are encoded on their
own and joined in pairs, level by level.  ``a + b`` isn't what its halves say
around the join, so a window is encoded again there, and grows until it agrees
with both sides:

* Over pre-tokens.  The split pattern reads from left to right and never looks
  back, so a scan that starts where a pre-token starts is right, but for what
  lies within MARGIN bytes of the end of what it sees.  The window begins at the
  last sure pre-token of the left half and grows into the right half until one
  of its sure pre-tokens begins where one of the right half does.
* Within a pre-token that crosses the join.  Tokens are the encoding of their
  text when every two neighbours are that of theirs: the first merge over a
  border would also happen in the two alone.  So the window of tokens grows
  until its first token is the left half's and its last one the right half's.

Texts of up to ``leaf`` characters are one leaf.  Texts of over ``spread``
characters are cut into parts, rows of their own dealt to the tasks; each part
is a tree in a task, and further rounds join FAN neighbouring parts at a time.

Leaves are split by the public pattern and the tokens of a pre-token remembered;
those with characters that versions of Unicode may class differently, or with
special tokens, are the library's own to encode.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspec.llm._shared import stored, tasks

VOCABULARY = "byte_bpe_50k.json"
LEAF, SPREAD = 16_384, 65_536
#: Bytes before the end of a scan within which its pre-tokens may still change: an apostrophe looks two characters on, white space one.
MARGIN = 16
#: Parts that a task joins in one round.
FAN = 8
#: Characters that are encoded in one call.
BATCH = 1 << 20

#: Pre-tokens whose tokens a process remembers.
KNOWN = 1 << 19
#: Characters outside blocks that have been full for long: Latin, Cyrillic, quotes and dashes, common Han.
UNSURE = re.compile("[^\x00-\u024f\u0400-\u045f\u2010-\u2027\u4e00-\u9fa5]")

Node = tuple[np.ndarray, np.ndarray]  # ids, and whether a token opens a pre-token


class Codec:
    """The vocabulary in one process."""

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.least_special = min(self.special.values(), default=0)
        n = max(self.tokenizer.get_vocab().values()) + 1
        self.marks = [self.tokenizer.id_to_token(i) or "" for i in range(n)]  # in the byte alphabet: a character is a byte
        self.length = np.array([len(m) for m in self.marks], np.int64)
        self.alphabet = _byte_alphabet()
        self.byte = {c: b for b, c in enumerate(self.alphabet)}
        made = json.loads(content)
        kind = made["pre_tokenizer"] or {}
        self.by_pattern = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not made["normalizer"]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.plain(t) for t in texts]
        rest = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        known, word = self.known.get, self.word
        return [np.array([i for w in self.split(t) for i in known(w) or word(w)] if p else next(rest).ids, np.uint32) for t, p in zip(texts, plain)]

    def leaves(self, texts: list[str]) -> list[Node]:
        plain = [self.plain(t) for t in texts]
        rest = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))  # the fast one doesn't number pre-tokens
        return [self._leaf([self.word(w) for w in self.split(t)]) if p else self._numbered(next(rest)) for t, p in zip(texts, plain)]

    def _leaf(self, words: list[list[int]]) -> Node:
        ids = np.array([i for w in words for i in w], np.uint32)
        opens = np.zeros(len(ids), bool)
        opens[np.cumsum([0, *map(len, words[:-1])])[: len(ids)]] = True
        return ids, opens

    def _numbered(self, encoding) -> Node:
        words = np.array([-1 if w is None else w for w in encoding.word_ids], np.int64)
        ids = np.array(encoding.ids, np.uint32)
        opens = np.ones(len(ids), bool)
        opens[1:] = (words[1:] != words[:-1]) | self.is_special(ids[1:]) | self.is_special(ids[:-1])
        return ids, opens

    def plain(self, text: str) -> bool:
        """Whether the public pattern splits ``text`` as the library does, whatever their versions of Unicode."""
        return self.by_pattern and (text.isascii() or not UNSURE.search(text)) and not any(s in text for s in self.special)

    def word(self, text: str) -> list[int]:
        """Tokens of one pre-token; distinct ones are merged once."""
        ids = self.known.get(text)
        if ids is None:
            ids = self.merge("".join(self.alphabet[b] for b in text.encode()))
            if len(text) <= 64:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[text] = ids
        return ids

    def is_special(self, ids: np.ndarray) -> np.ndarray:
        return ids >= self.least_special if self.least_special == len(self.marks) - len(self.special) else np.isin(ids, list(self.special.values()))

    def raw(self, ids: np.ndarray) -> bytes:
        return bytes(self.byte[c] for i in ids.tolist() for c in self.marks[i])

    def merge(self, marks: str) -> list[int]:
        """Tokens of one pre-token, given in the byte alphabet."""
        return [t.id for t in self.tokenizer.model.tokenize(marks)]

    def pre_tokens(self, text: str) -> list[str]:
        return [m for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


_codecs: dict[str, Codec] = {}


def _codec(content) -> Codec:
    """One codec a process and vocabulary, ``content`` its broadcast."""
    if content.value not in _codecs:
        _codecs.clear()
        _codecs[content.value] = Codec(content.value)
    return _codecs[content.value]


def _byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def join_tokens(a: list[int], b: list[int], codec: Codec) -> list[int]:
    """Tokens of one pre-token from those of its halves: a window grows until its outer tokens are the halves' own."""
    w = 4
    while True:
        i, j = min(w, len(a)), min(w, len(b))
        window = codec.merge("".join(codec.marks[t] for t in a[len(a) - i :] + b[:j]))
        if (i == len(a) or window[0] == a[-i]) and (j == len(b) or window[-1] == b[j - 1]):
            return a[: len(a) - i] + window + b[j:]
        w *= 2


def _sure_start(a: Node, codec: Codec) -> int:
    """Index of the last pre-token of ``a`` that text after it can't change."""
    ids, opens = a
    w = 64
    while True:
        tail = max(0, len(ids) - w)
        left = np.cumsum(codec.length[ids[tail:]][::-1])[::-1]  # bytes from a token's start to the end
        sure = np.flatnonzero(opens[tail:] & (left >= MARGIN))
        if len(sure):
            return tail + int(sure[-1])
        if not tail:
            return 0
        w *= 2


def _join_plain(a: Node, b: Node, codec: Codec) -> Node:
    """Joins two texts without special tokens."""
    if not len(a[0]) or not len(b[0]):
        return b if not len(a[0]) else a
    p = _sure_start(a, codec)
    middle = codec.raw(a[0][p:])
    cut = len(middle)
    w = 32
    while True:
        ends = np.flatnonzero(b[1][w:])
        q = w + int(ends[0]) if len(ends) else len(b[0])
        at = np.concatenate([[0], np.cumsum(codec.length[b[0][:q]])]) + cut  # starts of b's tokens, and the window's end
        ids_at = {int(x): k for k, x in enumerate(at[:-1]) if b[1][k]}
        if q == len(b[0]):
            ids_at[int(at[-1])] = q
        found = codec.pre_tokens((middle + codec.raw(b[0][:q])).decode())
        starts = np.concatenate([[0], np.cumsum([len(m) for m in found])]).tolist()
        sure = at[-1] if q == len(b[0]) else at[-1] - MARGIN
        n = next((k for k, s in enumerate(starts) if cut <= s <= sure and s in ids_at), None)
        if n is not None:
            break
        w = 2 * q
    r = ids_at[starts[n]]
    ids, opens = [], []
    for marks, start in zip(found[:n], starts):
        if start < cut < start + len(marks):
            begin = p + int(np.searchsorted(np.concatenate([[0], np.cumsum(codec.length[a[0][p:]])]), start))
            whole = begin < len(a[0]) and codec.length[a[0][begin:]].sum() == cut - start and a[1][begin] and not a[1][begin + 1 :].any()
            if whole and start + len(marks) == starts[n] and not b[1][1:r].any():  # one pre-token on either side
                tokens = join_tokens(a[0][begin:].tolist(), b[0][:r].tolist(), codec)
            else:
                tokens = codec.merge(marks)
        else:
            tokens = codec.merge(marks)
        ids += tokens
        opens += [True] + [False] * (len(tokens) - 1)
    return np.concatenate([a[0][:p], np.array(ids, np.uint32), b[0][r:]]), np.concatenate([a[1][:p], np.array(opens, bool), b[1][r:]])


def join(a: Node, b: Node, codec: Codec) -> Node:
    """The encoding of two neighbouring texts from theirs; a special token splits a text before anything else does."""
    last, first = np.flatnonzero(codec.is_special(a[0])), np.flatnonzero(codec.is_special(b[0]))
    i, j = last[-1] + 1 if len(last) else 0, first[0] if len(first) else len(b[0])
    ids, opens = _join_plain((a[0][i:], a[1][i:]), (b[0][:j], b[1][:j]), codec)
    return np.concatenate([a[0][:i], ids, b[0][j:]]), np.concatenate([a[1][:i], opens, b[1][j:]])


def tree(nodes: list[Node], codec: Codec) -> Node:
    while len(nodes) > 1:
        nodes = [join(*nodes[k : k + 2], codec) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0]


def cuts(text: str, size: int, special: list[str]) -> list[str]:
    """Pieces of about ``size`` characters; a cut may fall anywhere but in a special token."""
    out, begin = [], 0
    while begin < len(text):
        end = min(begin + size, len(text))
        for s in special:
            at = text.find(s, max(begin, end - len(s) + 1), end + len(s) - 1)
            if begin < at < end:
                end = at
            elif at == begin < end < begin + len(s):
                end = begin + len(s)
        out.append(text[begin:end])
        begin = end
    return out or [""]


def encode_long(text: str, codec: Codec, leaf: int) -> Node:
    return tree(codec.leaves(cuts(text, leaf, list(codec.special))), codec)


def _digest(ids: np.ndarray, codec: Codec) -> tuple[int, str, str]:
    decoded = codec.decode(ids.tolist()).encode()
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


DIGEST = ["n_tokens", "ids_sha256", "decoded_sha256"]


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``.

    Ids are those of the vocabulary's own encoder without added special tokens
    (a special token that the text spells out is one), decoded with special
    tokens kept.  ``vocabulary`` is the path of a byte-level file on the driver,
    from where its content travels to the tasks.  A null text counts as empty
    and has no tokens; equal texts have equal results; rows that repeat an id,
    or have none, stay rows of their own; further columns, whatever their names,
    are ignored; an empty table gives an empty result.  A text of any length is
    encoded whole; the task that hashes its ids holds them, four bytes a token.
    """
    spark = docs.sparkSession
    if vocabulary is None:
        from public_tokenizers import path

        vocabulary = path(VOCABULARY)
    with open(vocabulary, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())  # a vocabulary, whatever the size of the input

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(content)
        special = list(codec.special)
        for batch in batches:
            rows, short = [], []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                text = text or ""
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if len(text) > spread:
                    key = uuid.uuid4().hex
                    for no, part in enumerate(cuts(text, spread, special)):
                        yield pd.DataFrame([(doc_id, key, no, part, None, None, None)], columns=["doc_id", "key", "no", "part", *DIGEST])
                elif len(text) > leaf:
                    rows.append((doc_id, None, None, None, *_digest(encode_long(text, codec, leaf)[0], codec)))
                else:
                    short.append((doc_id, text))
            at = 0
            while at < len(short):
                end, size = at, 0
                while end < len(short) and size < BATCH:
                    size += len(short[end][1])
                    end += 1
                for (doc_id, _), ids in zip(short[at:end], codec.encode([t for _, t in short[at:end]])):
                    rows.append((doc_id, None, None, None, *_digest(ids, codec)))
                at = end
            yield pd.DataFrame(rows, columns=["doc_id", "key", "no", "part", *DIGEST], dtype=object)

    out = "doc_id long, key string, no int, part string, n_tokens long, ids_sha256 string, decoded_sha256 string"
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # the key of a text's parts is drawn once, for the table is written
    done = stored(texts.mapInPandas(first, out), "bpe")
    whole = done.where("key is null").select("doc_id", *DIGEST)
    parts = done.where("key is not null").select("doc_id", "key", "no", "part")
    most = parts.agg(F.max("no")).first()[0]
    if most is None:
        return whole

    node = "doc_id long, key string, no int, ids binary, opens binary"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(content)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, opens = encode_long(row.part, codec, leaf)
                yield pd.DataFrame([(row.doc_id, row.key, row.no, ids.tobytes(), opens.tobytes())], columns=["doc_id", "key", "no", "ids", "opens"]).astype({"doc_id": "Int64"})

    def join_round(group: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(content)
        group = group.sort_values("no")
        ids, opens = tree([(np.frombuffer(i, np.uint32), np.frombuffer(o, bool)) for i, o in zip(group["ids"], group["opens"])], codec)
        top = group.iloc[:1].assign(no=group["no"].iloc[0] // FAN, ids=[ids.tobytes()], opens=[opens.tobytes()])
        return top.astype({"doc_id": "Int64"})

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(content)
        for batch in batches:
            rows = [(d, *_digest(np.frombuffer(i, np.uint32), codec)) for d, i in zip(batch["doc_id"], batch["ids"])]
            yield pd.DataFrame(rows, columns=["doc_id", *DIGEST]).astype({"doc_id": "Int64"})

    nodes = parts.repartition(tasks(spark), "key", "no").mapInPandas(encode, node)
    while most > 0:
        nodes = nodes.groupBy("key", F.expr(f"no div {FAN}")).applyInPandas(join_round, node)
        most //= FAN
    return whole.unionByName(nodes.select("doc_id", "ids").mapInPandas(last, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
