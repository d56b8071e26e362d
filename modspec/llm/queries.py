"""The numbered queries over the given tables, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modspec.llm._shared import table


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations are decoded; a fifth of the turns has no marker, and a fifth of the conversations isn't trained on."""
    from modspec.llm.chat_format import format_chats, held_out, marked_transcripts, train

    transcripts = marked_transcripts(table(spark, folder, "conversations"))
    return format_chats(transcripts, train(transcripts.where(~held_out(F.col("conv_id")))))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.decontaminate import contained_items

    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("text_hash")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.mixing import taken_words

    return taken_words(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.warc import convert_pages

    kind = F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type")
    return convert_pages(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", kind, "refers_to")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.secrets import secret_digest

    return secret_digest(table(spark, folder, "documents"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.token_counts import token_counts

    return token_counts(table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.suffix_dedup import repeat_digest

    return repeat_digest(table(spark, folder, "documents"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, folder, "documents")).drop("key")


def op11_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.bpe import encode_digest

    return encode_digest(table(spark, folder, "documents"))


def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, folder, "embeddings"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    from modspec.llm.periodic_runs import periodic_runs

    return periodic_runs(table(spark, folder, "documents"), plant=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_chat_format": op2_chat_format,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe": op11_bpe,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: doc_id and its distinct 5-word shingles; {docs} has doc_id and text.
SHINGLES = """
words_{tag} AS (SELECT {key}, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + """, '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
sets_{tag} AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words_{tag}),
sizes_{tag} AS (SELECT {key}, count(s) AS n FROM words_{tag} LEFT JOIN sets_{tag} USING ({key}) GROUP BY 1)"""

COMPONENTS = """
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM sets_d x JOIN sets_d y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN sizes_d nx ON nx.doc_id = x.doc_id JOIN sizes_d ny ON ny.doc_id = y.doc_id
  WHERE 100 * least(nx.n, ny.n) >= 80 * greatest(nx.n, ny.n)
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 80 * (any_value(nx.n) + any_value(ny.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)"""

LEAKS = """,
leaks AS (SELECT doc_id, item_id, any_value(n) AS n_item, count(*) AS n_common FROM sets_d JOIN sets_i USING (s) JOIN sizes_i USING (item_id)
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(n))"""

#: Documents table {docs} -> targets and taken words.
MIX = """
mix_sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
  ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS perm FROM {docs}),
mix_totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM mix_sizes GROUP BY source),
mix_weights AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM mix_totals),
mix_levels AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
  / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM mix_weights),
mix_targets AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM mix_levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1), 0) * weight) AS target FROM mix_levels),
mix_line AS (SELECT m.doc_id, m.source, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY m.source ORDER BY perm, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM mix_sizes m JOIN mix_targets t ON m.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT doc_id, source, size::BIGINT AS size, source_size, target, (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - source_size - before))
  + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - before)))::BIGINT AS taken FROM mix_line)"""

def _assigned(k: int) -> str:
    """Vectors with the nearest of the centroids c{k}; then the next centroids, where a cluster has vectors."""
    return f"""
near{k} AS (SELECT rid, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT AS d FROM vecs, c{k}),
at{k} AS (SELECT rid, c, d FROM near{k} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)"""


def _moved(k: int) -> str:
    return f"""
sum{k} AS (SELECT c, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM at{k} JOIN vecs USING (rid), range(1, 65) t(i) GROUP BY c, i),
c{k + 1} AS (SELECT c{k}.c, coalesce(o.m, c{k}.m) AS m FROM c{k} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM sum{k} GROUP BY c) o ON o.c = c{k}.c)"""


CLUSTERS = (
    """WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
vecs AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM kept),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, 'null')), x) - 1 AS c, x AS m FROM vecs QUALIFY c < 16),"""
    + ",".join(_assigned(k) + "," + _moved(k) for k in range(3)) + "," + _assigned(3)
    + """ SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM at3 JOIN vecs USING (rid) JOIN c3 USING (c)"""
)

ORACLES: dict[str, str] = {
    "op1_ngram_join": "WITH RECURSIVE " + SHINGLES.format(tag="d", key="doc_id", docs="documents").strip() + "," + COMPONENTS
    + " SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id FROM sizes_d LEFT JOIN reach ON a = doc_id GROUP BY doc_id, n",
    "op3_decontamination": "WITH " + SHINGLES.format(tag="d", key="doc_id", docs="documents").strip() + "," + SHINGLES.format(tag="i", key="item_id", docs="benchmark") + LEAKS
    + " SELECT doc_id, item_id, n_item, n_common FROM leaks",
    "op4_mixing": "WITH " + MIX.format(docs="documents").strip() + " SELECT doc_id, size, source_size, target, taken FROM mixed",
    "op5_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, ((5 * k) // 4 + 1)::INT, 2))::INT >> (3 - (5 * k) % 4)::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM r""",
    "op10_exact_dedup": """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op12_centroid_clusters": CLUSTERS,
}
