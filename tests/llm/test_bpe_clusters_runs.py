"""Byte-pair encoding against the library, clusters and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from modspec.llm import bpe, centroids, periodic_runs

public_tokenizers = pytest.importorskip("public_tokenizers")
STUFF = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "ll", "the ", "é", "漢", "字", "🙂", "1", "23", "...", "<|endoftext|>", "<|endof", "　", "\x85", "᠎", "n't", "'LL", "ab" * 20, "a" * 30, "\t", " \n "]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(public_tokenizers.path(bpe.VOCABULARY), encoding="utf-8").read())


def odd_texts(rng, n, most=100):
    return ["".join(rng.choice(sub) for _ in range(rng.randrange(most))) for sub in (rng.sample(STUFF, rng.randrange(1, 6)) for _ in range(n))]


@pytest.mark.parametrize("leaf", [1, 4, 25])
def test_trees_equal_the_library(codec, leaf):
    for text in odd_texts(random.Random(leaf), 60):
        ids, opens = bpe.encode_long(text, codec, leaf)
        want = codec.leaves([text])[0]
        assert ids.tolist() == codec.tokenizer.encode(text, add_special_tokens=False).ids and opens.tolist() == want[1].tolist()


def test_windows_within_a_long_word(codec):
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("ab") for _ in range(rng.randrange(2, 300)))
        at = rng.randrange(1, len(word))
        assert bpe.join_tokens(codec.merge(word[:at]), codec.merge(word[at:]), codec) == codec.merge(word)


def test_parts_in_rows_equal_the_library(spark, codec):
    rng = random.Random(3)
    texts = [None, "", " ", "<|endoftext|>", "x" * 5000, " ".join(["word"] * 3000), *odd_texts(rng, 25, 400)]
    rows = [(k // 2 if k % 7 else None, t, "k", k, "p") for k, t in enumerate(texts + texts[:3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, no int, part string").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digest(docs, leaf=7, spread=40).collect())
    want = []
    for doc_id, text, *_ in rows:
        ids = codec.tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = codec.tokenizer.decode(ids, skip_special_tokens=False).encode()
        want.append((doc_id or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert got == sorted(want)
    assert bpe.encode_digest(docs.limit(0)).collect() == []


def brute_clusters(vectors, k, rounds):
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    key = lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    cs = [list(v) for _, v in sorted(vectors, key=key)[:k]]
    near = lambda v: min(range(len(cs)), key=lambda c: (dist(v, cs[c]), c))
    for _ in range(rounds):
        at = [near(v) for _, v in vectors]
        cs = [[sum(x) // len(own) for x in zip(*own)] if (own := [v for (_, v), a in zip(vectors, at) if a == c]) else cs[c] for c in range(len(cs))]
    return [(i, near(v), dist(v, cs[near(v)]), hashlib.sha256(",".join(map(str, cs[near(v)])).encode()).hexdigest()) for i, v in vectors]


def test_clusters_equal_brute_force(spark):
    """Few distinct values, so ties and equal vectors abound."""
    rng = random.Random(7)
    rows = [(k, [rng.choice([-0.5, 0.01, 0.25, 0.5]) for _ in range(4)]) for k in range(300)]
    rows += [(5, rows[5][1]), (None, rows[6][1]), (301, None), (302, []), (303, [0.1] * 3), (304, [0.1] * 5), (305, [0.1, None, 0.1, 0.1]), (306, [0.1, math.nan, 0.1, 0.1]), (307, [math.inf, 0.1, 0.1, 0.1])]
    table = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    got = centroids.cluster_vectors(table, components=4, clusters=9).collect()
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows[:302]]
    want = brute_clusters(kept, 9, 3)
    some = lambda i: -1 if i is None else i
    assert sorted((some(r["vec_id"]), r["cluster"], r["distance"], r["centroid_sha256"]) for r in got) == sorted((some(i), *rest) for i, *rest in want)
    assert {r["inertia"] for r in got} == {sum(w[2] for w in want)}
    assert {(r["cluster"], r["cluster_inertia"]) for r in got} == {(c, sum(w[2] for w in want if w[1] == c)) for c in {w[1] for w in want}}
    assert centroids.cluster_vectors(table.limit(0), components=4).collect() == []
    assert {r["cluster"] for r in centroids.cluster_vectors(table.where("vec_id in (8, 9)"), components=4).collect()} <= {0, 1}


def test_orchard_visits_ties():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cs, vs = rng.integers(-2, 3, (12, 3)), rng.integers(-2, 3, (200, 3))
        at, best = centroids.orchard(vs, cs, *centroids.neighbours(cs))
        every = ((vs[:, None] - cs[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (best == every.min(1)).all()
        large = [centroids._exact(x * 2**40, cs.astype(object) * 2**40) for x in (vs, cs)]  # squares beyond 64 bits
        at_large, best_large = centroids.orchard(large[0][0], large[0][1], *centroids.neighbours(large[0][1]))
        assert large[0][0].dtype == object and (at_large == at).all() and (best_large == best.astype(object) * 2**80).all()


def brute_runs(w):
    out, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        for i in range(n - q):
            if w[i] == w[i + q] and (i == 0 or w[i - 1] != w[i - 1 + q]):
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                length = j - i + q
                if length >= max(6, 4 * q) and all(any(w[i + x] != w[i + x + p] for x in range(length - p)) for p in range(1, q)):
                    out.add((i, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    a = rng.randrange(1, 4)
    w = [rng.randrange(a) for _ in range(rng.randrange(50))]
    for _ in range(rng.randrange(4)):
        u = [rng.randrange(a + 1) for _ in range(rng.randrange(1, 14))]
        w += (u * 8)[: rng.randrange(3, 8) * len(u) + rng.randrange(len(u))]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(500):
        w = repetitive(rng)
        assert periodic_runs.runs(np.array(w, np.int64)) == brute_runs(w)


@pytest.mark.parametrize("plant", [False, True])
def test_run_digest_equals_brute_force(spark, plant):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "a b a b", "x " * 20000] + [rng.choice([" ", "\t ", "\n"]).join(f"w{x}" for x in repetitive(rng)) for _ in range(60)]
    rows = [(k if k % 9 else None, t, 1, "s") for k, t in enumerate(texts)] + [(1, "again " * 7, 1, "s"), (1, "again " * 7, 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, period string").repartition(3)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, periodic_runs.periodic_runs(docs, plant=plant).collect()))
    want = []
    for doc_id, text, *_ in rows:
        w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
        if plant and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = brute_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
        kept = [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in found)]
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((-1 if doc_id is None else doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(kept))))
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
