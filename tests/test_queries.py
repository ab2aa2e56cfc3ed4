import math

import duckdb
import pytest

import __spark_entry__
from granary.queries import all_oracle_sql, all_queries

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "labels", "pages", "conversations")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if not isinstance(v, int) or isinstance(v, bool) else round(float(v), 9)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = all_queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({all_oracle_sql()[name]})").fetchall()
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(str(tuple(map(plain, r))) for r in want)


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_statistics_of_null_keys_and_values_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT * FROM (VALUES ('a', 1.0), ('a', NULL), ('a', 3.0), ('a', 4.0), (NULL, 1.0), (NULL, 5.0), ('b', NULL), ('b', NULL), ('c', 2.5)) t(event_type, value)")
    con.execute("CREATE OR REPLACE TABLE events AS SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' AS ts, 1::bigint AS user_id, event_type, value::double AS value, '{\"k\": 1}' AS props FROM events")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = all_queries()["descriptive_stats"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({all_oracle_sql()['descriptive_stats']})").fetchall()
    assert len(want) == 4
    assert sorted(str(tuple(map(plain, r))) for r in got.collect()) == sorted(str(tuple(map(plain, r))) for r in want)
