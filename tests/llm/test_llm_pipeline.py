"""The pipeline's stages on the smallest documents against what their operators decide."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bagminhash, bpe_stream, fertility, registry
from sparkloom.llm.common import vocabulary

SF = "/root/testdata/sf0.001"
CLEAN = (
    "Nobody in the village could say who had first lit the lamp on the hill, but everyone agreed that it had burned through the worst storm of that long winter. "
    "Fishermen steered by it, children counted its turns before they slept, and the old keeper, whose hands shook when he poured the oil, wrote each night in a small brown book what the sea had done. "
)


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality, near, mixed, encoded = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, docs, SF).cache()
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in fertility.quality(docs).where("kept").collect()}
    one = near(spark, good, SF).cache()
    classes = bagminhash.classes(good).collect()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["class_id"] for r in classes})
    ordered = mixed(spark, one, SF).cache()
    assert sorted(map(tuple, ordered.collect())) == sorted(map(tuple, one.collect()))
    assert good.columns == one.columns == ordered.columns == docs.columns
    want = sorted(map(tuple, bpe_stream.round_trip(one).collect()))
    assert sorted(map(tuple, encoded(spark, ordered, SF).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_handle_odd_and_empty_tables(spark, odd, empty):
    """All stages in turn, each on what the one before kept: exact rows and values, whatever the columns are called."""
    (_, quality), (_, near), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    as_rows = lambda df: sorted(map(str, df.collect()))
    more = odd.union(odd.withColumn("text", F.concat(F.lit(CLEAN), F.coalesce("text", F.lit(""))))).union(odd.where("doc_id = 7")).withColumn("raw", F.lit("r"))
    kept = quality(spark, more, SF).cache()
    verdicts = {(r["doc_id"], r["n_words"]): r["kept"] for r in fertility.quality(more).collect()}
    words = lambda t: len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w])
    want = sorted(str(r) for r in more.collect() if verdicts[r["doc_id"], words(r["text"])])
    assert as_rows(kept) == want and 0 < len(want) < more.count()
    one = near(spark, kept, SF).cache()
    groups = {(r["doc_id"], r["class_id"]) for r in bagminhash.classes(kept).collect()}
    left = one.collect()
    assert set(map(str, left)) <= set(want) and sorted(str(r["doc_id"]) for r in left) == sorted({str(c) for _, c in groups})
    ordered = mixed(spark, one, SF).cache()
    assert as_rows(ordered) == as_rows(one) and ordered.columns == odd.columns + ["raw"]
    out = {r["doc_id"]: r for r in encoded(spark, ordered, SF).collect()}
    word = Tokenizer.from_file(vocabulary(bpe_stream.MODEL))
    for r in left:
        ids = word.encode(r["text"] or "", add_special_tokens=False).ids
        assert out[r["doc_id"]]["n_tokens"] == len(ids) and out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "conversations"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_registry_names_every_operator():
    names = registry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
