import json

import pytest

from sparkloom.engine import Engine, Settings
from sparkloom.operators import answers, evaluation
from sparkloom.plans import evaluation_queries
from sparkloom.reports import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("c1", "Ridge regression has an alpha penalty"), ("c2", "StandardScaler removes the mean"), ("c3", "MinMaxScaler maps to a range"), ("c4", "Pipelines chain preprocessing and model selection")]
    chunks = spark.createDataFrame([(c, c, "Doc", "Section", t) for c, t in rows], "chunk_id string, doc_id string, doc_title string, section_title string, content string")
    return Engine.build(chunks, settings=Settings(dimension=2048))


def asked(spark):
    return spark.createDataFrame([(1, "what is StandardScaler?"), (2, "compare StandardScaler and MinMaxScaler"), (3, "How do preprocessing, pipelines, and model selection work together?"), (4, " ")], "query_id int, query string")


@pytest.mark.parametrize("system", ["basic", "hybrid", "adaptive", "Full RAG"])
def test_systems(spark, engine, system):
    hits = engine.retrieve(asked(spark), system)
    assert {r["query_id"] for r in hits.collect()} == {1, 2, 3}
    assert hits.where("rank = 1 and query_id = 1").first()["chunk_id"] == "c2"


def test_unknown_system_and_k(spark, engine):
    with pytest.raises(ValueError, match="unknown system"):
        engine.retrieve(asked(spark), "other")
    with pytest.raises(ValueError, match="between"):
        engine.retrieve(asked(spark), "basic", 21)


def test_prompt_and_answer(spark, engine):
    got = {r["query_id"]: r for r in engine.answer(asked(spark), "basic", answers.FixedAnswer(make=lambda p: p)).collect()}
    assert "[Source 1] (Document: Doc | Section: Section)" in got[1]["answer"] and got[1]["answer"].endswith("Question:\nwhat is StandardScaler?\n\nAnswer:")
    assert answers.NOTHING_FOUND in got[4]["answer"]
    assert got[1]["total_tokens"] == 2 * got[1]["prompt_tokens"]


def test_compare_isolates_failures(spark, engine):
    def broken(prompts):
        raise RuntimeError("down")

    rows = engine.compare(asked(spark), ("basic_rag", "nothing"), broken).collect()
    assert {(r["system"], r["status"]) for r in rows} == {("basic_rag", "failed"), ("nothing", "failed")}
    assert all("down" in r["error"] or "unknown" in r["error"] for r in rows)


def test_judge_skips_blank_answers(spark):
    rows = spark.createDataFrame([(1, "q", "r", "e", "a"), (2, "q", "r", "e", "  ")], "query_id int, question string, reference string, evidence string, answer string")
    got = {r["query_id"]: r["scores"] for r in answers.judge(rows, answers.FixedAnswer('{"correctness": 4, "faithfulness": 4, "relevance": 1}')).collect()}
    assert got[1]["overall"] == 3.0 and got[2]["overall"] == 0 and got[2]["reason"] == "Blank answer."


def reply(text):
    return 200, {}, json.dumps({"choices": [{"message": {"content": text}}]})


def test_chat_provider_retries():
    waits, replies = [], [(429, {"Retry-After": "3"}, ""), (503, {}, ""), reply(" "), reply("yes")]
    model = answers.ChatProvider("https://host/v1", "key", "m", send=lambda *_: replies.pop(0), sleep=waits.append)
    assert model(["q"]) == ["yes"] and waits == [3.0, 4.0, 8.0]
    with pytest.raises(RuntimeError, match="quota"):
        answers.ChatProvider("u", "k", "m", send=lambda *_: (429, {}, "tokens per day (TPD)"))(["q"])
    with pytest.raises(RuntimeError, match="status 400"):
        answers.ChatProvider("u", "k", "m", send=lambda *_: (400, {}, "bad"))(["q"])
    with pytest.raises(RuntimeError, match="no answer after 2"):
        answers.ChatProvider("u", "k", "m", retries=1, send=lambda *_: (500, {}, ""), sleep=waits.append)(["q"])
    with pytest.raises(ValueError, match="key"):
        answers.ChatProvider("u", "", "m")
    with pytest.raises(ValueError, match="unknown provider"):
        answers.provider("other")
    got = answers.GenerateContentProvider("u", "k", "m", send=lambda *_: (200, {}, json.dumps({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]})))(["q"])
    assert got == ["ab"]


def test_records(spark):
    r = evaluation_queries.records(spark, SF)
    summary = evaluation.system_summary(r)
    assert summary.count() == 4 and "basic_rag" in table(summary.select("system", "question_count"), order="system")
    none = evaluation.system_summary(r.where("false"))
    assert none.count() == 0
    failed = evaluation.system_summary(r.where("error is not null")).first()
    assert failed["successful_count"] == 0 and failed["mrr"] == 0 and failed["prompt_tokens"] is None


def test_efficiency_defaults(spark):
    rows = spark.createDataFrame([('{"latency_ms": 2.5, "retrieval_calls": 3, "token_usage": {"total_tokens": 7}}',), (None,)], "metadata string")
    got = evaluation.efficiency_of(rows).collect()
    assert (got[0]["latency_ms"], got[0]["retrieval_calls"], got[0]["total_tokens"]) == (2.5, 3, 7)
    assert (got[1]["latency_ms"], got[1]["retrieval_calls"], got[1]["total_tokens"]) == (0.0, 1, None)


def test_reports(spark):
    rows = {r["report"]: r["text"] for r in evaluation_queries.reports(spark, SF).collect()}
    assert "| fixed |" in rows["chunking"] and "full_rag" in rows["evaluation"] and rows["evaluation"].count("## ") == 4


def test_evidence_as_hits(spark):
    from sparkloom.operators import evidence

    pooled = spark.createDataFrame([(1, "c", ["sub_01"], 0.5, 1)], "query_id int, chunk_id string, retrieved_by array<string>, initial_score double, overlap_count long")
    scores = spark.createDataFrame([(1, "x", 2.0)], "query_id int, chunk_id string, rerank_score double")
    assert evidence.as_hits(evidence.reranked(pooled, scores)).first()["score"] == 0.5
    assert evidence.as_hits(pooled).first()["retrieval_method"] == "multi_step"


def test_run_resumes_and_stops_on_a_spent_quota(spark):
    from sparkloom.engine import Engine
    from sparkloom.operators import answers

    chunks = spark.createDataFrame([(f"c{i}", f"d{i}", "t", "s", f"text of number {w}") for i, w in enumerate(["one", "two", "three"])], "chunk_id string, doc_id string, doc_title string, section_title string, content string")
    engine = Engine.build(chunks)
    expected = ", 'FACT_LOOKUP' expected_intent, 'SIMPLE' expected_complexity, 'DENSE' expected_strategy"
    b = spark.sql(f"SELECT q question_id, t query, 'r' reference_answer, array('c0') truth{expected} FROM VALUES ('q1', 'what is one?'), ('q2', 'what is two?'), ('q3', '?') AS x(q, t)")

    def spent(prompt: str) -> str:
        raise RuntimeError("daily quota spent: tokens per day (TPD)")

    first = engine.run(b, ("basic", "hybrid"), answers.FixedAnswer(make=spent))
    assert {r["system"] for r in first.collect()} == {"basic_rag"}  # hybrid isn't begun
    second = engine.run(b, ("basic", "hybrid"), answers.FixedAnswer("fine"), answers.FixedAnswer('{"correctness": 4, "faithfulness": 4, "relevance": 4}'), done=first)
    rows = second.collect()
    assert len(rows) == 6 and all(r["generated_answer"] == "fine" and r["overall"] == 4 for r in rows)
    assert {(r["system"], len(r["previous_errors"])) for r in rows} == {("basic_rag", 1), ("hybrid_rag", 0)}
    third = engine.run(b, ("basic",), answers.FixedAnswer("other"), done=second)
    assert sorted(map(str, third.collect())) == sorted(map(str, second.collect()))
    assert engine.run(b, ("full",), most=2).count() == 2
    assert engine.run(b.where("false"), ("basic",)).count() == 0


def test_entry_without_a_needed_module(monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.startswith("tokenizers"):
            raise ModuleNotFoundError(name)
        return real(name, *args, **kwargs)

    for name in [n for n in sys.modules if n.startswith(("sparkloom.llm", "corpus_pipeline", "tokenizers"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", missing)
    assert "bm25_topk" in entry.queries() and not [n for n in entry.queries() if n.startswith("op")]
