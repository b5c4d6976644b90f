"""The engine's systems: one plan for all depths, what it took, its guards."""

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import Engine, Settings
from sparkloom.functions.scoring import SYSTEMS
from sparkloom.operators import dense, fusion, lexical, questions
from sparkloom.operators.ranking import top_k, within
from sparkloom.sources import tables

ASKED = [
    (1, "what is StandardScaler?"),
    (2, "how do I use KMeans?"),
    (3, "compare Ridge vs Lasso"),
    (4, "How do Pipeline, GridSearchCV and cross-validation work together?"),
    (5, "how do preprocessing, pipelines, and model selection work together with overfitting?"),
    (6, "  "),
    (7, "PCA"),
]
WORDS = ["ridge", "lasso", "pipeline", "gridsearchcv", "kmeans", "pca", "scaler", "model", "selection", "work", "together", "the", "of", "to"]


@pytest.fixture(scope="module")
def engine(spark):
    texts = [(f"c{i:02d}", " ".join(WORDS[(i * k + k * k) % len(WORDS)] for k in range(3, 9))) for i in range(40)]
    return Engine.build(spark.createDataFrame(texts, "chunk_id string, content string"))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, query string")


def one_by_one(engine, asked, system):
    """Each question alone, with numbers for depths."""
    out = []
    plans = {r["query_id"]: r for r in engine.route(asked).collect()}
    for i, q in ASKED:
        if not q.strip():
            continue
        me = asked.where(F.col("query_id") == i)
        p = plans[i]
        strategy, c, f = {"basic_rag": ("DENSE", 5, 5), "hybrid_rag": ("HYBRID", 20, 5)}.get(system, (p["strategy"], p["candidate_top_k"], p["final_top_k"]))
        if system == "adaptive_rag" and strategy == "MULTI_STEP":
            strategy = "HYBRID"
        if strategy == "DENSE":
            rows = engine.search(me, "dense", f)
        elif strategy == "HYBRID":
            rows = engine.hybrid(me, c, f)
        else:
            parts = questions.decompose(engine.route(me)).select(F.col("sub_query_id").alias("query_id"), F.col("query_text").alias("query"))
            pooled = engine.hybrid(parts, c, c).groupBy("chunk_id").agg(F.max("score").alias("score")).withColumn("query_id", F.lit(i).cast("long"))
            rows = fusion.rerank(top_k(pooled, c), me, engine.chunks, limit=f)
        out += [(i, r["rank"], r["chunk_id"], r["score"]) for r in rows.select("rank", "chunk_id", "score").collect()]
    return sorted(out)


def test_systems_are_one_plan_of_all_depths(engine, asked):
    got = engine.systems(asked)
    rows = got.hits.collect()
    assert {r["system"] for r in rows} == set(SYSTEMS)
    for system in ("adaptive_rag", "full_rag"):
        assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in rows if r["system"] == system) == one_by_one(engine, asked, system)
    work = {(r["system"], r["query_id"]): (r["retrieval_calls"], r["chunks_processed"], r["escalation_count"]) for r in got.work.collect()}
    assert len(work) == 24 and work["basic_rag", 1] == (1, 5, 0) and work["hybrid_rag", 1] == (2, 40, 0)
    calls, seen, escalated = work["full_rag", 5]
    assert calls == 8 and seen > 30 and escalated == 0


def test_systems_of_no_question(engine, asked):
    none = engine.systems(asked.where("query_id = 6"))
    assert none.hits.count() == 0 and none.work.count() == 0
    assert none.hits.columns == ["system", "query_id", "rank", "chunk_id", "score"]


def test_scarce_evidence_escalates(spark, asked):
    small = Engine.build(spark.createDataFrame([("only", "a pipeline of model selection")], "chunk_id string, content string"))
    work = {r["query_id"]: r for r in small.systems(asked, ("full",)).work.collect()}
    assert (work[5]["retrieval_calls"], work[5]["escalation_count"], work[5]["chunks_processed"]) == (16, 1, 4)
    assert work[1]["escalation_count"] == 0 and work[1]["chunks_processed"] == 1


def test_records_count_what_ran(spark):
    small = Engine.build(spark.createDataFrame([("only", "a pipeline of model selection", "T", "S", "d")], "chunk_id string, content string, doc_title string, section_title string, doc_id string"))
    b = spark.createDataFrame([(f"q{i}", q, "r", ["only"], "MULTI_CONCEPT", "COMPLEX", "MULTI_STEP") for i, q in ASKED[3:5]], "question_id string, query string, reference_answer string, truth array<string>, expected_intent string, expected_complexity string, expected_strategy string")
    rows = small.run(b, ("full", "hybrid")).collect()
    full = {r["question_id"]: r for r in rows if r["system"] == "full_rag"}
    assert full["q5"]["escalation_count"] == 1 and full["q5"]["retrieval_calls"] == 16 and full["q5"]["judge_total_tokens"] > 0
    assert {r["retrieval_calls"] for r in rows if r["system"] == "hybrid_rag"} == {2} and {r["chunks_processed"] for r in rows if r["system"] == "hybrid_rag"} == {2}


def test_a_chunk_is_encoded_once_for_an_index_at_a_path(spark, tmp_path):
    """The check of the vectors' lengths and their writing share one encoding; the manifest's smoke question is one text more."""
    log = tmp_path / "encoded"

    def encoder(texts):
        import numpy as np

        with open(log, "a") as f:
            f.write("x" * len(texts))
        return np.ones((len(texts), 2), np.float32)

    chunks = spark.createDataFrame([(f"c{i}", f"word {i}") for i in range(20)], "chunk_id string, content string")
    Engine.build(chunks, encoder, Settings(dimension=2), f"file://{tmp_path}/index")
    assert log.stat().st_size == 20 + 1


def test_plan_driven_retrieval_refuses_other_strategies(engine, asked):
    plans = engine.route(asked)
    able = plans.where("strategy <> 'MULTI_STEP'")
    assert {r["query_id"] for r in engine.planned(able).collect()} == {1, 2, 3, 7}
    with pytest.raises(Exception, match="no plan-driven retrieval for MULTI_STEP"):
        engine.planned(plans).collect()


def test_guards(engine, asked, spark):
    for k in (0, 21, -1):
        with pytest.raises(ValueError):
            engine.retrieve(asked, "full", k)
    with pytest.raises(ValueError):
        engine.retrieve(asked, "nothing known")
    with pytest.raises(ValueError):
        engine.search(asked, "magic")
    with pytest.raises(ValueError):
        lexical.search(engine.index, asked, 0)
    with pytest.raises(ValueError):
        dense.search(engine.vectors, asked.withColumn("embedding", F.array().cast("array<float>")), 0)
    assert engine.search(spark.createDataFrame([(1, "   "), (2, None)], asked.schema), "hybrid").count() == 0


def test_within_takes_a_number_or_a_column(spark):
    hits = spark.createDataFrame([(q, r) for q in (1, 2) for r in (1, 2, 3)], "query_id long, rank int")
    own = spark.createDataFrame([(1, 2), (2, 1)], "query_id long, depth int")
    assert within(hits, own, 2).count() == 4
    assert sorted(map(tuple, within(hits, own, "depth").collect())) == [(1, 1), (1, 2), (2, 1)]


def test_plans_of_unknown_kinds_raise(spark):
    bad = spark.createDataFrame([(1, "q", "SMALL_TALK", "MEDIUM", 0.9, 0.9)], "query_id long, query string, intent string, complexity string, complexity_confidence double, intent_confidence double")
    with pytest.raises(Exception, match="unknown intent"):
        questions.route(bad).collect()


def test_output_paths(spark):
    cases = [(["a/b", "a//b"], [], "outputs must differ"), (["a/../b", "c"], ["./b"], "protected input: b"), (["/a/./b"], ["/a/b"], "protected input: /a/b"), (["a", "b"], ["c"], None), (["../x", "x"], [], "outputs must differ")]
    rows = spark.createDataFrame([(i, o, p) for i, (o, p, _) in enumerate(cases)], "i int, o array<string>, p array<string>")
    got = {r["i"]: r["problem"] for r in rows.select("i", tables.output_problem(F.col("o"), F.col("p")).alias("problem")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]
    with pytest.raises(ValueError):
        tables.check_outputs("a/x/../b", "a/b")
