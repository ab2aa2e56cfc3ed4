"""Extra columns with the names of the operators' own helpers, empty tables, repeated rows and very long texts."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import common
from granary.llm.bpe import encode_documents
from granary.llm.exact_dedup import keep_first_copies
from granary.llm.language_id import fit_languages, with_language
from granary.llm.mixing import mix, mix_plan
from granary.llm.order_minhash import keep_one_of_each, near_duplicates
from granary.llm.pseudo_likelihood import count_words, fit_network, score_corpus, with_hashes, with_pseudo_likelihood
from granary.llm.sharding import assign_shards
from granary.llm.toxicity import fit_toxicity, with_toxicity
from granary.llm.url_filters import filter_urls

PATH = public_tokenizers.path("word_bpe_49k.json")
HELPERS = (
    "_language_", "_toxicity_", "_score_", "_hashes", "_bytes", "_rows", "_at", "_r", "_range", "_h", "_i", "_row", "_rank", "_own", "_found", "_hits", "_fits", "_url", "_place", "_times", "_copy", "_uid", "_key", "_text", "_word", "_bit", "_mask", "_salt", "place", "h", "i", "r",
)
TEXTS = ["a plain text of a few words", "a plain text of a few words", None, "", "12 !!", "one more text that is not like it", "very long words " * 40_000]


def table(spark):
    df = spark.createDataFrame([(k, t, ("en", None)[k % 2], "src", k % 2) for k, t in enumerate(TEXTS)] + [(None, "x y z", None, None, None)] * 2, "doc_id long, text string, lang string, source string, toxic int")
    return df.select("*", *[F.lit(f"{c}!").alias(c) for c in HELPERS], F.lit("http://ads.q.com/x").alias("url"))


def network(df):
    hashed = with_hashes(df)
    v = count_words(hashed, groups=4, per_group=16, bins=16)
    return fit_network(hashed, v), v


OPERATORS = {
    "op1": lambda df: with_pseudo_likelihood(df, *network(df)),
    "op1 corpus": lambda df: score_corpus(df),
    "op2": lambda df: assign_shards(df, 3),
    "op3": lambda df: with_language(df, fit_languages(df)),
    "op4": lambda df: filter_urls(df),
    "op4 joined": lambda df: filter_urls(df, max_inline=0),
    "op6": lambda df: mix(df),
    "op7": lambda df: keep_first_copies(df),
    "op8": lambda df: encode_documents(df, PATH, decoded_col="decoded"),
    "op9": lambda df: with_toxicity(df, fit_toxicity(df, df)),
    "op10": lambda df: keep_one_of_each(df),
}
KEEPS = {"op6": None, "op7": 6, "op10": 6}


@pytest.mark.parametrize("name", OPERATORS)
def test_helper_names_stay_as_they_were(spark, name):
    df = table(spark).repartition(2).cache()
    rows = OPERATORS[name](df).collect()
    want = KEEPS.get(name, 9)
    assert want is None or len(rows) == want
    assert all(r[c] == f"{c}!" for r in rows for c in HELPERS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, name):
    assert OPERATORS[name](table(spark).limit(0)).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in KEEPS])
def test_repeated_rows_get_equal_results(spark, name):
    rows = [r for r in OPERATORS[name](table(spark).select("doc_id", "text", "lang", "source", "toxic", "url").repartition(2)).collect() if r.doc_id is None]
    drop = ("slot",)
    assert len(rows) == 2 and len({str([r[c] for c in r.__fields__ if c not in drop]) for r in rows}) == 1


def test_long_texts_in_mixing_and_near_dedup(spark):
    df = table(spark).cache()
    assert {r.doc_id: r.size for r in mix_plan(df).collect()}[6] == 120_000
    classes = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert classes[6] == 6 and classes[1] == 0


def write(df, folder):
    df.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_pipeline_runs_on_extra_columns_and_on_nothing(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.select("*", *[F.lit(1).alias(c) for c in HELPERS])
    rows = corpus_pipeline.run(spark, write(more, tmp_path / "more")).collect()
    plain = corpus_pipeline.run(spark, write(docs, tmp_path / "plain")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == sorted((r.doc_id, r.n_tokens) for r in plain) and len(plain) > 100
    assert corpus_pipeline.run(spark, write(docs.limit(0), tmp_path / "none")).collect() == []
    assert corpus_pipeline.run(spark, write(docs.limit(3).withColumn("text", F.lit(None).cast("string")), tmp_path / "null")).collect() == []


def test_joins_of_groups_and_likely_members(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert common.join_groups(rows, groups, "k", F.col("n"), 3000).agg(F.sum("n"), F.count(F.lit(1))).first() == (1500 * 1500 + 1500, 3000)
    members = spark.range(0, 3000, 50).select(F.col("id").alias("v"))
    got = {r.v for r in common.likely_in(rows, members, 60, "v").collect()}
    assert got >= set(range(0, 3000, 50)) and len(got) < 600


def test_no_local_folder_stands_in_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_folder(Session)
