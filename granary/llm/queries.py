"""The queries op1 to op10 over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.anisotropic import nearest
from granary.llm.bpe import encode_documents
from granary.llm.common import held_out, read_table
from granary.llm.exact_dedup import exact_dedup
from granary.llm.language_id import fit_languages, with_language
from granary.llm.mixing import mix_plan
from granary.llm.order_minhash import near_duplicates
from granary.llm.pseudo_likelihood import score_corpus
from granary.llm.sharding import assign_shards
from granary.llm.toxicity import fit_toxicity, with_toxicity
from granary.llm.url_filters import filter_urls


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    sharded = assign_shards(docs.select("*", crc), 8)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(url, '/robots\.txt$') THEN 'allow'
  WHEN regexp_matches(url, '://([^/?#]*\.)?spam-farm\.') OR regexp_matches(url, '://([^/?#]*\.)?(ads|adserver|doubleclick)\.')
    OR regexp_matches(url, '[?&]utm_source=(spam|casino)\b') OR regexp_matches(url, '/(wp-login|xmlrpc)\.php') THEN 'block'
  ELSE 'allow' END AS verdict
FROM r
"""


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "vec_id % 20 = 0", k=20)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded", packed=True, keep=["doc_id"])
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"))
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels").filter(~held))
    score = F.col("toxic_score")
    return with_toxicity(docs, model).select("doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudo_likelihood": op1_pseudo_likelihood,
    "op2_sampled_splitters": op2_sampled_splitters,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_anisotropic_search": op5_anisotropic_search,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_order_minhash": op10_order_minhash,
}
ORACLE = {"op4_url_filters": OP4_SQL, "op7_exact_dedup": OP7_SQL}
