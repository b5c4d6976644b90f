"""Runs with more records than their total, or with none of their own; questions without a word."""

import duckdb
import pytest

from sparkloom.operators import evaluation
from sparkloom.plans import catalogue


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, f"file://{folder}").select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("ids", [(0, 1_000_003, 1), (0, 900, 1), (1, 9, 2)])
def test_progress_is_as_the_sql_has_it(spark, tmp_path, ids):
    spark.range(*ids, numPartitions=2).selectExpr("id AS event_id", "CAST(id % 7 AS DOUBLE) AS value").write.parquet(f"file://{tmp_path}/events.parquet")
    same_as_sql(spark, tmp_path, "run_progress", "events")


def test_each_question_that_is_not_blank_has_a_hit(spark, tmp_path):
    spark.createDataFrame([(d, f"Some words of text {d}.", "en", "web") for d in range(1, 5)], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"Some text {i}. Llción ciónjaci enció.") for i in range(1, 8)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    same_as_sql(spark, tmp_path, "search_guards", "documents", "benchmark")


def test_more_records_than_the_total(spark):
    rows = spark.createDataFrame([(False, 2.0), (False, 4.0), (True, 9.0)], "resumed boolean, seconds double")
    got = evaluation.progress(rows, 1).first()
    assert (got["done"], got["executed"], got["remaining"], got["eta_seconds"]) == (3, 2, -2, -6.0)
