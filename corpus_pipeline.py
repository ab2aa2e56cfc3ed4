"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE.

Each stage takes what its predecessor kept and, but for the last, returns the columns of documents. All stages take null
and empty texts, very long ones, repeated rows, null ids and further columns of any name, which stay as they were; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bpe import encode_documents
from granary.llm.common import held_out, shared_folder
from granary.llm.exact_dedup import keep_first_copies
from granary.llm.language_id import UNKNOWN, fit_languages, with_language, with_letters
from granary.llm.mixing import mix
from granary.llm.order_minhash import keep_one_of_each


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter go, null and empty ones too, and only those where no
    language is known. Repeated rows go or stay together; of very long texts all words count."""
    model = fit_languages(docs.filter(~held_out(F.col("doc_id"))))
    if not model.langs:
        return with_letters(docs)
    return with_language(docs, model).filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one of largest id; of repeated rows the last, where all ids are null likewise."""
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document of least id; of rows that share it, and where all are null, the first."""
    return keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix takes them, up to twice.

    Sources of null are a source; texts without words are never taken; a document that is cut counts from half on.
    """
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as ids of the word-level BPE vocabulary; a row stands alone, and one without text has no ids."""
    encoded = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "lang", "source"])
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL expresses neither the language model nor the sketches.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again.

    Once a stage is written, what its predecessor left goes, so that two stages' rows are kept at most.
    """
    folder = shared_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
