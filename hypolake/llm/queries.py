"""Queries of the training-data operators, one for each, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolake.llm import bpe, chat, language, licenses, mixing, periodic, quality, secrets, simhash, substrings, topk, toxicity, whitening
from hypolake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings(spark))).drop("value")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, and conversation -7 made of control strings, are read as records, formatted, and read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    records = chat.gathered(turns).unionByName(chat.gathered(spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)))
    out = chat.format_turns(chat.canonical_turns(records, "record", messages_col="messages"))
    back = chat.read_back(F.col("formatted"))
    said = F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = chat.masked_text(F.col("formatted"), F.col("loss_mask"))
    return out.select("conv_id", F.size(back).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"), F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.component_rows(vectors, whitening.fit(vectors))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of whole texts, a tenth of which are made periodic first."""
    return periodic.digests(periodic.with_runs(periodic.with_planted_runs(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Query]:
    every = (op1_secret_scan, op2_quality_rules, op3_mixing, op4_simhash_near_dedup, op5_bpe_encode_decode, op6_toxicity, op7_license_scan, op8_exact_top_k, op9_substring_dedup, op10_chat_formatting, op11_embedding_whitening, op12_language_id, op13_periodic_runs)
    return {f.__name__: f for f in every}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SUBSTRINGS_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows
), gone AS (
  SELECT DISTINCT doc_id, s + j AS p FROM (SELECT doc_id, s, unnest(range(0, 20)) AS j FROM ranked WHERE n > 1)
), places AS (
  SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), rest AS (
  SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM places x LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p WHERE g.p IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN rest r USING (doc_id)
"""


CHAT_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[ROLE][/ROLE]</s>') + 1 + length(regexp_replace(role || text, '[<\\[\\\\]', '__', 'g'))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_top_k": TOP_K_SQL, "op9_substring_dedup": SUBSTRINGS_SQL, "op10_chat_formatting": CHAT_SQL}
