"""Logs of tries, fingerprints of sets, phrases in chunks, the report's lines, and a run that is stopped and resumed."""

import pytest
from pyspark.sql import functions as F

from sparkloom import reports
from sparkloom.engine import Engine
from sparkloom.operators import answers, chunking, evaluation
from sparkloom.streaming import runs


def test_the_last_try_counts_and_earlier_errors_stay(spark):
    log = spark.createDataFrame([("q1", "a", 0, "late"), ("q1", "a", 1, "busy"), ("q1", "a", 2, None), ("q2", "a", 0, None), ("q1", "b", 0, "x")], "question_id string, system string, try int, error string")
    got = {(r["question_id"], r["system"]): (r["error"], r["previous_errors"]) for r in evaluation.of_tries(log).collect()}
    assert got == {("q1", "a"): (None, ["late", "busy"]), ("q2", "a"): (None, []), ("q1", "b"): ("x", [])}


def test_set_fingerprint_takes_rows_in_any_order(spark):
    rows = [(i, f"t{i % 5}") for i in range(40)]
    make = lambda r, n: evaluation.set_fingerprint(spark.createDataFrame(r, "a long, b string").repartition(n), ("a", "b")).first()[0]
    whole = make(rows, 1)
    assert whole == make(rows[::-1], 7) and len(whole) == 64
    others = {make(rows[:-1], 2), make(rows + rows[:1], 2), make(rows[:-1] + [(39, "t0")], 2), make([], 1)}
    assert whole not in others and len(others) == 4


def test_phrases_without_a_document_are_sought_everywhere(spark):
    chunks = spark.createDataFrame([("s", "d1", "Alpha beta gamma"), ("s", "d2", "alpha BETA"), ("t", "d1", "delta İx"), ("t", "d3", None)], "strategy string, doc_id string, content string")
    probes = [("own", "d1", ["alpha", "gamma"]), ("apart", "d1", ["alpha", "delta"]), ("lost", "d9", ["beta"]), ("none", None, ["delta"]), ("empty", "d2", [""]), ("null", "d1", None), ("hole", None, ["alpha", None]), ("overlap", None, ["alpha be", "pha beta", "a"])]
    table = spark.createDataFrame([(q, "c", d, p) for q, d, p in probes], "question_id string, category string, target_doc_id string, key_phrases array<string>")
    got = {(r["question_id"], r["strategy"]): r["preserved"] for r in chunking.preservation(chunks, table).collect()}
    # in t, d2 has no chunk, so an empty phrase is sought everywhere
    want = {("own", "s"), ("lost", "s"), ("none", "t"), ("empty", "s"), ("empty", "t"), ("overlap", "s")}
    assert got == {(q, s): (q, s) in want for q, _, _ in probes for s in ("s", "t")}


def test_phrases_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PROBES", 2)
    chunks = spark.createDataFrame([("s", "d", "one two three four")], "strategy string, doc_id string, content string")
    table = spark.createDataFrame([(str(i), "c", "d", [w]) for i, w in enumerate(["one", "five", "three", "fo", "x"])], "question_id string, category string, target_doc_id string, key_phrases array<string>")
    assert {r["question_id"] for r in chunking.preservation(chunks, table).where("preserved").collect()} == {"0", "2", "3"}


def test_question_lines(spark):
    p = spark.createDataFrame([("q1", 1.0, 2.5), ("q2", 3.0, 3.0), ("q3", None, 0.25), ("q4", None, None)], "question_id string, a double, b double")
    lines = {r["question_id"]: r["line"] for r in reports.question_lines(p, ("a", "b")).collect()}
    assert lines == {"q1": "| q1 | 1.00 | 2.50 | b |", "q2": "| q2 | 3.00 | 3.00 | a |", "q3": "| q3 | - | 0.25 | b |", "q4": "| q4 | - | - | - |"}
    assert reports.question_head(("a", "b")).split("\n")[0] == "| question | a | b | best |"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(f"c{i}", f"chunk {i} of words", "T", "S", "d") for i in range(6)]
    return Engine.build(spark.createDataFrame(rows, "chunk_id string, content string, doc_title string, section_title string, doc_id string"))


def test_a_stopped_run_goes_on_where_it_was(spark, engine, tmp_path):
    names = "question_id string, query string, reference_answer string, truth array<string>, expected_intent string, expected_complexity string, expected_strategy string"
    b = spark.createDataFrame([(f"q{i}", f"chunk {i} words", "r", [f"c{i}"], "FACT_LOOKUP", "SIMPLE", "DENSE") for i in range(4)], names)
    folder, log, state, sent = (f"file://{tmp_path}/{n}" for n in ("benchmark", "log", "state", "sent"))
    path = sent.removeprefix("file://")

    def spent(prompt):
        if "chunk 2 words" in prompt.rsplit("Question:", 1)[1]:
            raise RuntimeError("tokens per day (TPD)")
        return "an answer"

    def told(prompt):
        with open(path, "a") as f:
            f.write(prompt.rsplit("Question:", 1)[1].split("\n")[1] + "\n")
        return "an answer"

    runs.lay_out(b, folder, 2)
    assert runs.records(spark, log) is None
    assert not runs.run(engine, folder, log, state, ("basic", "hybrid"), answers.FixedAnswer(make=spent))
    half = runs.records(spark, log).collect()
    assert {(r["question_id"], r["system"]) for r in half if r["error"]} == {("q2", "basic_rag")}
    assert not [r for r in half if r["question_id"] in ("q2", "q3") and r["system"] == "hybrid_rag"]  # not begun
    assert runs.run(engine, folder, log, state, ("basic", "hybrid"), answers.FixedAnswer(make=told))
    rows = runs.records(spark, log).collect()
    assert len(rows) == 8 and not [r for r in rows if r["error"]]
    assert {tuple(r["previous_errors"]) for r in rows if (r["question_id"], r["system"]) == ("q2", "basic_rag")} == {("RuntimeError: tokens per day (TPD)",)}
    with open(path) as f:
        again = sorted(f.read().split("\n")[:-1])
    succeeded = {(r["question_id"], r["system"]) for r in half if not r["error"]}
    assert len(again) == 8 - len(succeeded)  # nothing that succeeded is sent again
    undisturbed = engine.run(b, ("basic", "hybrid"), answers.FixedAnswer("an answer")).collect()
    key = lambda r: (r["question_id"], r["system"], r["generated_answer"], r["recall_at_5"], r["mrr"], r["retrieval_calls"], r["chunks_processed"])
    assert sorted(map(key, rows)) == sorted(map(key, undisturbed))


def test_strategies_without_a_chunk_have_zeros(spark):
    none = chunking.chunk(spark.createDataFrame([], "doc_id string, title string, content string"), "fixed")
    rows = chunking.chunk_stats(none, strategies=("fixed", "structure_aware")).collect()
    assert sorted(r["strategy"] for r in rows) == ["fixed", "structure_aware"] and all(v == 0 for r in rows for c, v in r.asDict().items() if c != "strategy")
    assert chunking.chunk_stats(none).count() == 0


def test_a_run_is_timed_by_its_events(spark):
    rows = [("a", "start", 0, 5.0), ("a", "retrieval", -3, 6.5), ("a", "retrieval", 4, 7.0), ("a", "stop", 0, 9.25), ("b", "tokens", 7, 1.0), ("b", "tokens", None, 3.0), ("c", "stop", 0, 1.0), ("c", "start", 0, 2.0)]
    events = spark.createDataFrame(rows, "run string, kind string, amount long, at double").withColumn("at", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    got = {r["run"]: (r["latency_ms"], r["retrieval_calls"], r["chunks_processed"], r["total_tokens"]) for r in evaluation.tracked(events, "run", "at").collect()}
    assert got == {"a": (4250.0, 2, 4, None), "b": (2000.0, 0, 0, 7), "c": (0.0, 0, 0, None)}


def test_phrases_read_the_chunks_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("s", "d1", "one two"), ("t", "d2", "two")], "strategy string, doc_id string, content string")
    table = spark.createDataFrame([("p", "c", "d1", ["two"]), ("q", "c", "d9", ["two"])], "question_id string, category string, target_doc_id string, key_phrases array<string>")
    got = chunking.preservation(rows.mapInArrow(count, rows.schema), table).collect()
    assert sorted((r["question_id"], r["strategy"], r["preserved"]) for r in got) == [("p", "s", True), ("p", "t", True), ("q", "s", True), ("q", "t", True)]
    assert reads.value == 2
