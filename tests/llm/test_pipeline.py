"""The pipeline against a brute-force version of its five stages."""

from __future__ import annotations

import hashlib
import random

import corpus_pipeline
from tests.llm.test_llm_operators import WORD, brute_components, brute_sets


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(500)]
    texts, toxic = [], []
    for k in range(300):
        words = [rng.choice(vocab) for _ in range(rng.choice([6, 20, 60, 150]))]
        if k % 9 == 1:
            words = texts[rng.randrange(k)].split(" ")
        if k % 9 == 2:
            words = texts[rng.randrange(k)].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocab)
        bad = k % 6 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "nastyterm"])
        texts.append(" ".join(words))
        toxic.append("vileword" in words or "nastyterm" in words)
    items = [" ".join(rng.choice(vocab) for _ in range(30)) for _ in range(6)]
    for k, item in enumerate(items):
        at = rng.choice([i for i in range(300) if not toxic[i]])
        texts[at] += " " + item
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(b)) for i, b in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = {i: t for i, t in enumerate(texts) if not toxic[i]}
    last = {}
    for i, t in docs.items():
        last[t] = max(i, last.get(t, i))
    docs = {i: t for i, t in docs.items() if last[t] == i}
    ids = sorted(docs)
    root = brute_components(brute_sets([docs[i] for i in ids]))
    docs = {i: docs[i] for k, i in enumerate(ids) if root[k] == k}
    bench = brute_sets(items)
    docs = {i: t for i, t in docs.items() if not any(100 * len(s & b) >= 80 * len(b) for s in brute_sets([t]) for b in bench)}
    size = {i: len(WORD.findall(t)) for i, t in docs.items()}
    total = {}
    for i in docs:
        total[f"s{i % 4}"] = total.get(f"s{i % 4}", 0) + size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total))}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        free = [s for s in total if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {**share, **{s: 3 * total[s] for s in capped}}
    want = {}
    for s in total:
        at = 0
        for i in sorted((i for i in docs if f"s{i % 4}" == s), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest()[:15]):
            taken = sum(max(0, min(size[i], int(target[s]) - copy * total[s] - at)) for copy in range(3))
            at += size[i]
            if taken:
                want[i] = (size[i], total[s], taken)
    got = {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(got) > 50


def test_pipeline_on_clashing_columns_nulls_and_repeats(spark, tmp_path):
    """Helper names as the user's own columns, null and empty texts, null and repeated ids, an empty table."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, _id string, _HASH int, _row int, _doc string, _least string, _all int"
    extra = ("x", 1, 7, "d", "l", 3)
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, plain, "en", "a", 1, *extra), (1, plain, "en", "a", 1, *extra), (1, plain, "en", "b", 2, *extra), (1, "other words under the same id", "en", "a", 1, *extra), (None, "no id at all here", None, None, None, *(None,) * 6)]
    rows += [(2, plain, "en", "a", 1, *extra), (3, None, "en", "a", 1, *extra), (4, "", "en", "b", 1, *extra), (None, None, "en", "b", 1, *extra), (5, "some item of a benchmark with ten words in it " + plain[:20], "en", "b", 1, *extra)]
    docs = spark.createDataFrame(rows, kind)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0, "c"), (None, 1, 1, "c"), (2, None, None, "c")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some item of a benchmark with ten words in it", 1), (2, None, 2), (None, "", 3)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) <= set(out.columns)
    got = sorted((r["doc_id"] or -1, r["text"], r["_row"]) for r in out.collect())
    assert got == [(-1, "no id at all here", None), (1, "other words under the same id", 7), (2, plain, 7)]
    empty = tmp_path / "empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
