import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scoring
from sparkloom.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a b, c_1!", 5), ("Étude über 3", 3), (" x ", 1)])
def test_count_tokens(spark, text, n):
    assert one(spark, X.count_tokens("t"), t=text) == n


def test_lexical_tokens(spark):
    assert one(spark, X.lexical_tokens("t"), t="LogisticRegression(solver='lbfgs', max_iter=100) Étion") == ["logisticregression", "solver", "lbfgs", "max_iter", "100"]


def test_paragraphs_and_sentences(spark):
    assert one(spark, X.paragraphs("t"), t="a\n\n b \n \n\nc\n") == ["a", "b", "c"]
    assert one(spark, X.sentences("t"), t="One. Two! three? 4 is. `x` e.g. no") == ["One.", "Two! three?", "4 is.", "`x` e.g. no"]


def test_clean_heading_snippet(spark):
    assert one(spark, X.clean_text("t"), t="  a \n b # ¶ ") == "a b"
    assert one(spark, X.heading("t"), t="## A title ").asDict() == {"level": 2, "title": "A title"}
    assert one(spark, X.heading("t"), t="# a\nb") is None
    assert one(spark, X.snippet("t"), t="a\nb") == "a b"
    assert one(spark, X.snippet("t"), t="x" * 151) == "x" * 150 + "..."


def test_nulls_stay_null(spark):
    assert one(spark, X.clean_text("t"), t=None) is None
    assert one(spark, X.heading("t"), t=None) is None


@pytest.mark.parametrize(("score", "band"), [(0.0, "does not satisfy"), (0.5, "very poor"), (1.0, "partially satisfies"), (2.5, "mostly satisfactory"), (4.0, "strongly satisfies")])
def test_bands(spark, score, band):
    assert one(spark, scoring.score_band(F.col("s")), s=score) == band


def test_bad_score_and_name_raise(spark):
    with pytest.raises(Exception, match="between 0 and 4"):
        one(spark, scoring.score_band(F.col("s")), s=4.5)
    with pytest.raises(Exception, match="unknown system"):
        one(spark, scoring.system_name(F.col("s")), s="nothing")
    assert one(spark, scoring.system_name(F.col("s")), s=" Full-RAG ") == "full_rag"


def test_judge_reply(spark):
    got = one(spark, scoring.judged(F.col("r")), r='x ```json\n{"correctness": 3, "faithfulness": 9, "relevance": -2, "reason": "r"}\n```')
    assert got.asDict() == {"correctness": 3.0, "faithfulness": 4.0, "relevance": 0.0, "overall": 2.3333, "reason": "r"}
    bad = one(spark, scoring.judged(F.col("r")), r="nothing")
    assert bad["overall"] == 0 and bad["reason"].startswith(scoring.JUDGE_FAILURE)


def test_overall_and_delay(spark):
    assert one(spark, scoring.overall(F.col("g"), F.col("a"), F.col("b"), F.col("c")), g=0.0, a=1.0, b=2.0, c=4.0) == 2.3333
    assert one(spark, scoring.retry_delay(F.col("h"), F.col("b"), F.col("n")), h=None, b="try again in 12.1s", n=0) == 12.6
    assert one(spark, scoring.retry_delay(F.col("h"), F.col("b"), F.col("n")), h="90", b="", n=0) == 60
    assert one(spark, scoring.retry_delay(F.col("h"), F.col("b"), F.col("n")), h=None, b="", n=3) == 16
    assert one(spark, scoring.quota_spent(F.col("b")), b="Limit (TPD) reached")


@pytest.mark.parametrize(("s", "text"), [(-1.0, "--"), (45.2, "45s"), (754.0, "12m 34s"), (3723.0, "1h 02m 03s")])
def test_duration(spark, s, text):
    assert one(spark, scoring.duration(F.col("s")), s=s) == text


def test_sigmoid_and_vectors(spark):
    assert one(spark, scoring.sigmoid(F.col("x")), x=99.0) == pytest.approx(1 / (1 + math.exp(-5)))
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>").select(scoring.normalised(F.col("v")).alias("v"), scoring.normalised(F.col("z")).alias("z")).first()
    assert row["v"] == pytest.approx([0.6, 0.8]) and row["z"] == [0, 0]


def test_fingerprint_ignores_underscored(spark):
    d = spark.createDataFrame([("q", "a", "x"), ("q", "a", "y")], "question_id string, b string, _note string")
    assert d.select(scoring.fingerprint("question_id", "b", "_note").alias("f")).distinct().count() == 1
