import duckdb
import pytest

import corpus_pipeline
from granary.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want))


def test_pipeline_stages_keep_columns_and_effects(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
    extra = spark.createDataFrame([(10**6, "12 ... !!", "en", "src0", 9), (10**6 + 1, None, None, None, None)], spark.read.parquet(f"{SF}/documents.parquet").schema)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(extra)
    columns, seen = docs.columns, {}
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.count()
        if name != "bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert docs.filter("doc_id >= 1000000").count() == 0
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert seen["language_id"] == 200 and seen["exact_dedup"] >= seen["near_dedup"] and seen["mixing"] == seen["bpe"]
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_documents_stay_where_no_language_is_known(spark):
    rows = [(k, t, None, "s", 1) for k, t in enumerate(["a text", "12 ... _ ²", None, "", "日本語", "3 x"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5] and kept.columns == docs.columns
