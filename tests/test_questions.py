import pytest
from pyspark.sql import functions as F

from sparkloom.operators import questions as Q

#: The last three are fixed values: goldens of the rules' border cases.
EXPECTED = [
    ("what are transformers?", "FACT_LOOKUP", "SIMPLE"),
    ("parameters of RandomForestClassifier for a first try", "FACT_LOOKUP", "SIMPLE"),
    ("what is UserWarning?", "FACT_LOOKUP", "SIMPLE"),
    ("why would TruncatedSVD keep fewer columns?", "EXPLANATION", "MEDIUM"),
    ("the theory behind hinge loss, please", "EXPLANATION", "MEDIUM"),
    ("how can I fit an IterativeImputer to my table?", "PROCEDURE", "MEDIUM"),
    ("tutorial on TimeSeriesSplit for monthly sales", "PROCEDURE", "MEDIUM"),
    ("distinguish between KernelPCA and PCA", "COMPARISON", "MEDIUM"),
    ("SVC versus LinearSVC on small samples", "COMPARISON", "MEDIUM"),
    ("why does my OneHotEncoder crash on new categories?", "TROUBLESHOOTING", "MEDIUM"),
    ("can I resolve a ValueError raised by SimpleImputer?", "TROUBLESHOOTING", "MEDIUM"),
    ("how do feature selection, class weights and GridSearchCV relate to each other?", "MULTI_CONCEPT", "COMPLEX"),
    ("interplay between overfitting and dimensionality reduction", "MULTI_CONCEPT", "COMPLEX"),
    ("compare KMeans with DBSCAN in the presence of noise, and explain how both pick groups", "COMPARISON", "COMPLEX"),
    ("words without meaning for a rule", "FACT_LOOKUP", "SIMPLE"),
    ("what is StandardScaler?", "FACT_LOOKUP", "SIMPLE"),
    ("why is my StandardScaler pipeline failing?", "TROUBLESHOOTING", "MEDIUM"),
    ("How do cross-validation, hyperparameter tuning with GridSearchCV, and Pipeline interact in scikit-learn?", "MULTI_CONCEPT", "COMPLEX"),
]


@pytest.fixture(scope="module")
def analyzed(spark):
    rows = [(i, q) for i, (q, _, _) in enumerate(EXPECTED)] + [(90, "  "), (91, None), (92, "how do they work together with data leakage?")]
    return Q.analyze(spark.createDataFrame(rows, "query_id int, query string")).cache()


def test_intents_and_complexities(analyzed):
    got = {r["query_id"]: r for r in analyzed.collect()}
    for i, (query, intent, complexity) in enumerate(EXPECTED):
        assert intent in (None, got[i]["intent"]), query
        assert complexity in (None, got[i]["complexity"]), query
    assert 90 not in got and 91 not in got


def test_policy(spark):
    rows = [(f"{c}{i}", c, i, 0.9, 0.5 if i == "PROCEDURE" else 0.9) for c, i in Q.POLICY]
    plans = {(r["complexity"], r["intent"]): r for r in Q.route(spark.createDataFrame(rows, "query_id string, complexity string, intent string, complexity_confidence double, intent_confidence double")).collect()}
    assert len(plans) == 18
    assert (plans["SIMPLE", "FACT_LOOKUP"]["candidate_top_k"], plans["SIMPLE", "FACT_LOOKUP"]["final_top_k"]) == (5, 3)
    assert plans["COMPLEX", "MULTI_CONCEPT"]["strategy"] == "MULTI_STEP" and plans["COMPLEX", "MULTI_CONCEPT"]["candidate_top_k"] == 30
    assert plans["MEDIUM", "PROCEDURE"]["low_confidence"] and not plans["MEDIUM", "COMPARISON"]["low_confidence"]
    bad = spark.createDataFrame([("x", "HARD", "FACT_LOOKUP", 0.9, 0.9)], "query_id string, complexity string, intent string, complexity_confidence double, intent_confidence double")
    with pytest.raises(Exception, match="unknown intent"):
        Q.route(bad).collect()


def test_concepts_drop_parts(spark):
    row = spark.createDataFrame([("l2 regularization in ridge",)], "query string").select(Q.terms(F.col("query")).alias("t")).withColumn("c", Q.concepts(F.col("t"))).first()
    assert row["t"] == ["l2 regularization", "regularization", "ridge"] and row["c"] == ["l2 regularization", "ridge"]


def test_decomposition(analyzed):
    rows = Q.decompose(analyzed).orderBy("query_id", "sub_query_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r)
    assert [r["sub_query_type"] for r in by[0]] == ["original"]
    assert [r["sub_query_id"] for r in by[11]] == ["sub_01", "sub_02", "sub_03", "sub_04"]
    assert by[11][-1]["sub_query_type"] == "interaction" and by[11][-1]["target_concept"].count(" + ") == 2
    assert all(1 <= len(v) <= 4 for v in by.values())


def test_stream_routes_each_question_once(spark, tmp_path):
    from sparkloom.streaming import questions as S

    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(f'{{"query_id": {i}, "query": "what is StandardScaler?", "category": "c"}}\n')
    for _ in range(2):
        S.write_plans(S.routed(S.read_questions(spark, f"file://{tmp_path}/in", 1)), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out")
    assert got.count() == 3 and {r["strategy"] for r in got.collect()} == {"DENSE"}


def test_decomposition_without_an_analysis(spark):
    asked = ["pca and kmeans", "pca, kmeans", "ridge with lasso and pca", "only pca and nothing else", "  ", None]
    parts = Q.decompose(spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")).collect()
    kinds = {}
    for r in sorted(parts, key=lambda r: (r["query_id"], r["sub_query_id"])):
        kinds.setdefault(r["query_id"], []).append(r["sub_query_type"])
    one, two = ["original"], ["individual_concept"] * 2 + ["interaction"]
    assert kinds == {0: two, 1: one, 2: ["individual_concept"] * 3 + ["interaction"], 3: one}
