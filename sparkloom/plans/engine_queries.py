"""The engine from end to end, its tables written and read, and its guards: documents as chunks, passages as questions."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.engine import Engine, Settings
from sparkloom.functions import scoring
from sparkloom.functions import text as X
from sparkloom.operators import answers, chunking, dense, evaluation, evidence, fusion, lexical
from sparkloom.operators import questions as Q
from sparkloom.plans import question_queries
from sparkloom.plans.common import lexical_sql, longs, quoted, read
from sparkloom.plans.evaluation_queries import SQL as EVALUATION_SQL
from sparkloom.plans.evaluation_queries import set_sql
from sparkloom.plans.evaluation_queries import system_summary as summary_query
from sparkloom.plans.retrieval_queries import _BASE, _OVERLAP, _PARTS, _POOL, _RRF, _TRUTH, _measures, _pooled, _ranked, chunks, passages, shared, tails, truth
from sparkloom.plans.text_queries import FIXED_CTE, documents
from sparkloom.session import table_path
from sparkloom.sources import tables

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_encoder(texts: list[str]) -> np.ndarray:
    """Counts of the letters a to z: an encoder that SQL can repeat."""
    out = np.zeros((len(texts), len(LETTERS)), np.float32)
    for i, text in enumerate(texts):
        low = text.lower()
        out[i] = [low.count(x) for x in LETTERS]
    return out


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    """Documents as chunks, indexed at a path and read from there."""
    engine = Engine.build(chunks(spark, sf_dir), letter_encoder, Settings(dimension=len(LETTERS)), table_path(spark, "index"))
    engine.scorer = shared
    return engine


def index_manifest(spark, sf_dir):
    path = table_path(spark, "index")
    Engine.build(chunks(spark, sf_dir), letter_encoder, Settings(dimension=len(LETTERS)), path)
    return longs(Engine.manifest(spark, path))


def retrieved_hits(spark, sf_dir):
    """The lexical index written and read; hits with their method and their chunk's metadata."""
    hits = _engine(spark, sf_dir).retrieved(passages(spark, sf_dir), "bm25", 3)
    return longs(hits.select("query_id", "rank", "chunk_id", "score", "retrieval_method", "doc_id", "doc_title", "section_title", "content_snippet"))


def hybrid_dense_bm25(spark, sf_dir):
    """Dense and BM25 rankings of one question fused and reranked."""
    hits = _engine(spark, sf_dir).hybrid(tails(spark, sf_dir), 10, 5)
    return longs(hits.select("query_id", "rank", "chunk_id", "rrf_score", "rerank_score"))


def opened_tails(spark, sf_dir):
    """Each passage's last sentence behind an opening, or alone: questions of every strategy."""
    key = F.col("query_id")
    return tails(spark, sf_dir).select("query_id", question_queries.opened(key, F.lit(2) - key % 2, F.col("query")).alias("query"))


def engine_systems(spark, sf_dir):
    """The four systems over the same questions, all depths and complex questions' parts included."""
    return longs(_engine(spark, sf_dir).systems(opened_tails(spark, sf_dir)).hits)


def engine_work(spark, sf_dir):
    """What each question took in each system: searches, rows gone through, escalations."""
    return _engine(spark, sf_dir).systems(opened_tails(spark, sf_dir), ("basic", "hybrid", "full")).work


def vector_index_round_trip(spark, sf_dir):
    path = table_path(spark, "vectors")
    dense.build(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), path)
    v = dense.load(spark, path)
    return longs(dense.search(v, v.where(F.col("chunk_id") % 100 == 0).withColumnRenamed("chunk_id", "query_id"), 3))


def bm25_index_round_trip(spark, sf_dir):
    path = table_path(spark, "lexical")
    lexical.build(chunks(spark, sf_dir), path=path, by_id=False)
    return longs(lexical.search(lexical.LexicalIndex.read(spark, path), tails(spark, sf_dir), 3))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = truth(spark, sf_dir).groupBy("query_id").agg(F.sort_array(F.collect_list("chunk_id")).alias("truth"))
    b = tails(spark, sf_dir).join(held, "query_id", "left")
    expected = {"expected_intent": "FACT_LOOKUP", "expected_complexity": "SIMPLE", "expected_strategy": "DENSE"}
    return b.select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question_id"), "query", F.lit("the passage").alias("reference_answer"), F.coalesce("truth", F.array().cast("array<long>")).alias("truth"), *(F.lit(v).alias(k) for k, v in expected.items()))


def _fails_on_long(prompt: str) -> str:
    if "Question:" in prompt and len(prompt.rsplit("Question:", 1)[1]) > 120:
        raise RuntimeError("too long")
    return "An answer."


def evaluation_run(spark, sf_dir):
    """Two runs: the second resumes what failed in the first, and keeps its errors; then the summary of a system."""
    engine, b = _engine(spark, sf_dir), _benchmark(spark, sf_dir)
    first = engine.run(b, ("basic",), answers.FixedAnswer(make=_fails_on_long), answers.FixedAnswer('{"correctness": 3, "faithfulness": 4, "relevance": 2}'))
    again = engine.run(b, ("basic",), answers.FixedAnswer("Another answer."), answers.FixedAnswer('{"correctness": 1, "faithfulness": 1, "relevance": 4}'), done=first)
    columns = ["question_id", "system", "generated_answer", "error", "recall_at_1", "recall_at_5", "mrr", "ndcg_at_5", "correctness", "overall", "chunks_processed", "strategy_match"]
    return longs(again.select(*columns, F.array_join("previous_errors", "; ").alias("previous_errors")))


def _quota(prompt: str) -> str:
    if "Question:" in prompt and len(prompt.rsplit("Question:", 1)[1]) > 120:
        raise RuntimeError("rate limit reached: tokens per day (TPD)")
    return "An answer."


def stream_evaluation_run(spark, sf_dir):
    """A run in batches that a spent quota stops amid a system, and that is resumed to its end: its records are those of a run without a stop."""
    from sparkloom.streaming import runs

    folder, log, state = (table_path(spark, n) for n in ("stream-benchmark", "stream-log", "stream-state"))
    engine, judge = _engine(spark, sf_dir), answers.FixedAnswer('{"correctness": 3, "faithfulness": 4, "relevance": 2}')
    runs.lay_out(_benchmark(spark, sf_dir), folder, 15)
    stopped = not runs.run(engine, folder, log, state, ("basic",), answers.FixedAnswer(make=_quota), judge)
    ended = runs.run(engine, folder, log, state, ("basic",), answers.FixedAnswer("An answer."), judge)
    columns = ["question_id", "system", "generated_answer", "error", "recall_at_5", "mrr", "overall", "retrieval_calls", "chunks_processed"]
    return longs(runs.records(spark, log).select(*columns, F.lit(stopped).alias("stopped"), F.lit(ended).alias("ended")))


def evaluation_run_summary(spark, sf_dir):
    """The records of a run in the summary: a model that fails on long questions counts as failing."""
    records = _engine(spark, sf_dir).run(_benchmark(spark, sf_dir), ("basic",), answers.FixedAnswer(make=_fails_on_long), answers.FixedAnswer('{"correctness": 3, "faithfulness": 4, "relevance": 2}'))
    s = evaluation.system_summary(records)
    return longs(s.select("system", "question_count", "successful_count", "failure_count", "error_rate", "judge_successful_count", "recall_at_5", "mrr", "ndcg_at_10", "strategy_accuracy", "total_retrieval_calls", "total_chunks_processed", "mean_correctness", "mean_overall"))


def system_comparison(spark, sf_dir):
    """Systems side by side, one of whose models fails: its rows tell so, the other's stay."""
    engine, q = _engine(spark, sf_dir), tails(spark, sf_dir)
    good = engine.compare(q, ("basic",), answers.FixedAnswer("fine"))
    bad = engine.compare(q, ("no such system",), answers.FixedAnswer("fine"))
    return good.unionByName(bad).groupBy("system", "status").agg(F.count("*").alias("rows"), F.max("error").alias("error"))


def judge_scores(spark, sf_dir):
    """Each document's first words graded; a blank answer isn't sent."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.lit("q").alias("question"), F.lit("r").alias("reference"), F.lit("e").alias("evidence"), F.when(F.col("doc_id") % 3 == 0, "  ").otherwise("an answer").alias("answer"))
    out = answers.judge(d, answers.FixedAnswer('```json\n{"correctness": 9, "faithfulness": "2.5", "relevance": 0, "reason": " fine "}\n```'))
    return out.select("query_id", "scores.correctness", "scores.faithfulness", "scores.relevance", "scores.overall", "scores.reason")


def provider_replies(spark, sf_dir):
    """Both endpoint formats over a sender without a network: a spent quota is no retry, a busy server is."""

    def chat(url: str, headers: dict, body: dict):
        n = len(body["messages"][0]["content"])
        if n % 5 == 0:
            return 429, {}, "rate limit reached: tokens per day (TPD)"
        return 200, {}, f'{{"choices": [{{"message": {{"content": "chat {n}"}}}}]}}'

    def content(url: str, headers: dict, body: dict):
        n = len(body["contents"][0]["parts"][0]["text"])
        if n % 7 == 0:
            return 400, {}, "bad request"
        return 200, {}, f'{{"candidates": [{{"content": {{"parts": [{{"text": "part "}}, {{"text": "{n}"}}]}}}}]}}'

    prompts = read(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("prompt"))
    options = {"url": "https://model.invalid/v1", "key": "k", "model": "m"}
    both = [("openai", chat), ("gemini", content)]
    out = [answers.generate(prompts, answers.provider(name, send=send, **options)).select("query_id", F.lit(name).alias("provider"), "answer", F.col("error").isNotNull().alias("failed")) for name, send in both]
    return out[0].unionByName(out[1])


def fetched_pages(spark, sf_dir):
    """Pages through the cache: fetched once, read from it by a fetcher that would fail, and fetched anew when forced."""
    path = table_path(spark, "raw")
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")

    def first(url: str) -> str:
        if url.endswith("3"):
            raise OSError("unreachable")
        return f"<p>{url}</p>"

    def never(url: str) -> str:
        raise OSError("down")

    tables.fetch_pages(pages, path, first)
    cached = tables.fetch_pages(pages, path, never).withColumn("run", F.lit("cached"))
    forced = tables.fetch_pages(pages, path, lambda url: f"<b>{url}</b>", force=True).withColumn("run", F.lit("forced"))
    return cached.unionByName(forced).select("run", "doc_id", "html", F.col("error").isNotNull().alias("failed"))


def document_round_trip(spark, sf_dir):
    path = table_path(spark, "documents")
    d = documents(spark, sf_dir)
    tables.write_documents(d, path, "json")
    back = tables.read_documents(spark, path, "doc_id string, source_url string, title string, category string, content string")
    return back.select("doc_id", "source_url", "title", "category", F.sha2("content", 256).alias("content_sha256"))


def chunk_round_trip(spark, sf_dir):
    path = table_path(spark, "chunks")
    tables.write_chunks(chunking.chunk(documents(spark, sf_dir), "fixed"), path)
    return longs(tables.read_chunks(spark, path).select("strategy", "chunk_id", "doc_id", "token_count"))


def benchmark_round_trip(spark, sf_dir):
    path = table_path(spark, "benchmark")
    b = passages(spark, sf_dir).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question_id"), "query", F.array(F.lit("x"), F.col("query_id").cast("string")).alias("target_doc_ids"))
    b.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias("value")).write.text(path)  # one array, as the file is
    back = tables.filter_benchmark(tables.read_benchmark(spark, path))
    return back.select("question_id", F.sha2("query", 256).alias("query_sha256"), F.array_join("target_doc_ids", ",").alias("targets"), F.col("reference_answer").isNull().alias("no_answer"))


def results_round_trip(spark, sf_dir):
    """Results stamped with the benchmark's fingerprint where they have none, written, and read."""
    path = table_path(spark, "results")
    b = passages(spark, sf_dir).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("question_id"), "query")
    r = b.select("question_id", F.when(F.col("question_id").endswith("1"), "old").alias("benchmark_fingerprint"))
    tables.write_results(r, path, evaluation.benchmark_fingerprint(b, ("question_id", "query")))
    return tables.read_results(spark, path, "question_id string, benchmark_fingerprint string, later_column string")


def summary_round_trip(spark, sf_dir):
    path = table_path(spark, "summary")
    s = summary_query(spark, sf_dir)
    tables.write_summary(s, path)
    return tables.read_summary(spark, path, s.schema)


def output_guard(spark, sf_dir):
    """Of each page two outputs, at times one path in two spellings or a protected one, with what is wrong with them."""
    p = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3).alias("way"), F.concat(F.lit("out/"), F.col("page_id").cast("string")).alias("own"))
    second = F.when(F.col("way") == 0, F.concat(F.lit("out/./x/../"), F.col("page_id").cast("string"))).when(F.col("way") == 1, F.lit("in/a/../raw")).otherwise(F.lit("out//other"))
    return p.select("page_id", tables.output_problem(F.array("own", second), F.array(F.lit("in/raw"), F.lit("in/labels"))).alias("problem"))


def sample_questions(spark, sf_dir):
    """A sample question for each passage, and whether it is routed."""
    s = F.broadcast(tables.sample_questions(spark).withColumn("n", F.substring("question_id", -2, 2).cast("long")))  # one row a kind
    b = passages(spark, sf_dir).select(F.col("query_id").alias("item_id"), (F.col("query_id") % len(tables.SAMPLES) + 1).alias("n"))
    asked = b.join(s, "n").select("item_id", "question_id", "kind", "query")
    plans = Q.route(Q.analyze(asked.withColumnRenamed("item_id", "query_id"))).select(F.col("query_id").alias("item_id"), "strategy")
    return asked.join(plans, "item_id")


def canonical_fields(spark, sf_dir):
    """The fields of events without those that start with an underscore."""
    e = read(spark, sf_dir, "events")
    fields = F.create_map(F.lit("type"), F.col("event_type"), F.lit("_at"), F.col("ts").cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.lit("__x"), F.lit("y"))
    return e.select("event_id", F.to_json(evaluation.canonical(fields)).alias("fields"))


def evidence_hits(spark, sf_dir):
    hits = evidence.as_hits(_pooled(spark, sf_dir)[1])
    return longs(hits.select("query_id", "chunk_id", "score", "retrieval_method", "overlap_count", F.array_join("retrieved_by", ",").alias("retrieved_by")))


def pool_rerank(spark, sf_dir):
    """Pooled evidence with the reranker's score for the even documents; the others keep their first."""
    pooled = _pooled(spark, sf_dir)[1]
    scored = fusion.rerank(pooled.select("query_id", "chunk_id", F.col("initial_score").alias("score")), passages(spark, sf_dir), chunks(spark, sf_dir), shared).where(F.col("chunk_id") % 2 == 0)
    return evidence.reranked(pooled, scored.select("query_id", "chunk_id", "rerank_score")).select("query_id", "chunk_id", "initial_score", "rerank_score", "final_score")


def pool_counts(spark, sf_dir):
    parts, pooled = _pooled(spark, sf_dir)
    seen = pooled.select("query_id", "chunk_id", F.explode("retrieved_by").alias("sub_query_id"))
    return longs(evidence.pool_counts(seen, pooled))


def route_guard(spark, sf_dir):
    """Which pairs of intent and complexity a plan can be made of, some of them unknown."""
    e = read(spark, sf_dir, "events").select("event_id", F.array(*(F.lit(x) for x in (*Q.INTENTS, "SMALL_TALK", None)))[(F.col("event_id") % 8).cast("int")].alias("intent"), F.array(*(F.lit(x) for x in (*Q.STRATEGIES, "HARD")))[(F.col("event_id") % 4).cast("int")].alias("complexity"))
    return e.select("event_id", Q.plannable(F.col("intent"), F.col("complexity")).alias("routed"))


def plain_decompose(spark, sf_dir):
    """Questions without an analysis: two concepts and a connecting word set them apart."""
    parts = Q.decompose(question_queries.questions(spark, sf_dir).select("query_id", "query"))
    return longs(parts.groupBy("query_id").agg(F.count("*").alias("parts"), F.min("sub_query_type").alias("least_type")))


def run_progress(spark, sf_dir):
    """Progress of a run whose records are the events: odd ones are resumed, their value is the seconds. As in the SQL, a time below
    zero is given in seconds, and there is none before the first record."""
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 2 == 1).alias("resumed"), F.abs("value").alias("seconds"))
    p = evaluation.progress(e, 1_000_000)
    left = F.floor("eta_seconds")
    eta = F.when(left < 0, F.concat(left.cast("string"), F.lit("s"))).when(left >= 0, scoring.duration(left))
    return longs(p.select("done", "executed", "remaining", F.round("mean_seconds", 4).alias("mean_seconds"), eta.alias("eta")))


def search_guards(spark, sf_dir):
    """Every third question is blank or null: it has no hit by any method, the others have one. The others are whole passages, as a last
    sentence may be without a word that BM25 knows, and then it has no hit there."""
    engine = _engine(spark, sf_dir)
    key = F.col("query_id")
    asked = passages(spark, sf_dir).withColumn("query", F.when(key % 6 == 0, F.lit("   ")).when(key % 6 == 3, F.lit(None).cast("string")).otherwise(F.col("query")))
    out = [engine.search(asked, m, 1).groupBy(F.lit(m).alias("method")).agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("questions")) for m in ("dense", "bm25", "hybrid")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def word_lists(spark, sf_dir):
    """Texts with a lexical token, told without making the list of them."""
    return read(spark, sf_dir, "documents").select("doc_id", X.has_token("text").alias("has_token"))


QUERIES = {
    f.__name__: f
    for f in (
        index_manifest, retrieved_hits, hybrid_dense_bm25, engine_systems, engine_work, vector_index_round_trip, bm25_index_round_trip, evaluation_run, stream_evaluation_run, evaluation_run_summary, system_comparison, judge_scores, provider_replies, fetched_pages, document_round_trip, chunk_round_trip,
        benchmark_round_trip, results_round_trip, summary_round_trip, output_guard, sample_questions, canonical_fields, evidence_hits, pool_rerank, pool_counts, route_guard, plain_decompose, run_progress, search_guards, word_lists,
    )
}


@cache
def _vector(c: str) -> str:
    low = f"lower({c})"
    counts = ", ".join(f"(length({low}) - length(replace({low}, '{x}', '')))::DOUBLE" for x in LETTERS)
    return f"[{counts}]"


#: Vectors as single precision, as they are kept.
_UNIT = "list_transform(v, lambda x: CASE WHEN list_sum(list_transform(v, lambda y: y * y)) > 0 THEN (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT::DOUBLE ELSE x END)"


def _dense(name: str, questions: str, k: int) -> str:
    return f"""
{name}_d AS (SELECT doc_id, {_UNIT} AS e FROM (SELECT doc_id, {_vector('text')} AS v FROM documents)),
{name}_q AS (SELECT item_id, {_UNIT} AS e FROM (SELECT item_id, {_vector('q')} AS v FROM {questions} WHERE trim(q) <> '')),
{name} AS (SELECT item_id, doc_id, round(list_inner_product(q.e, d.e), 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(list_inner_product(q.e, d.e), 6) DESC, doc_id) AS rank FROM {name}_q q, {name}_d d QUALIFY rank <= {k})
"""


_RUN = f"""{_BASE}, {_dense('hits', 'tail', 5)}, {_TRUTH}, {_measures()},
  long AS (SELECT item_id, length(' ' || 'Question:' || chr(10) || trim(q) || chr(10) || chr(10) || 'Answer:') - 10 > 120 AS bad FROM tail),
  used AS (SELECT item_id, count(*) AS n FROM hits GROUP BY 1)"""
_CONNECTED = " OR ".join(f"contains(lower(query), {quoted(x)})" for x in Q.CONNECTORS)

_SAMPLES = ", ".join(f"({i}::BIGINT, 'sample_{i:02d}', {quoted(k)}, {quoted(q)})" for i, (k, q) in enumerate(tables.SAMPLES, 1))
_ASKED = f"asked AS (SELECT item_id AS query_id, {question_queries.opened_sql('item_id', '2 - item_id % 2', 'q')} AS query, NULL AS category FROM tail)"
_SYSTEM_JOBS = f"""{_BASE}, {_ASKED}, {question_queries.ANALYSIS}, {question_queries.ROUTED}, {question_queries.PARTS},
  jobs AS (SELECT 'basic_rag' AS system, query_id, 'DENSE' AS strategy, 5::BIGINT AS c, 5::BIGINT AS f FROM said UNION ALL SELECT 'hybrid_rag', query_id, 'HYBRID', 20, 5 FROM said
    UNION ALL SELECT 'adaptive_rag', query_id, CASE strategy WHEN 'MULTI_STEP' THEN 'HYBRID' ELSE strategy END, candidate_top_k, final_top_k FROM plans UNION ALL SELECT 'full_rag', query_id, strategy, candidate_top_k, final_top_k FROM plans),
  every AS (SELECT query_id::VARCHAR AS item_id, query AS q FROM said UNION ALL SELECT query_id || '/' || sub_query_id, query_text FROM parts JOIN plans USING (query_id) WHERE strategy = 'MULTI_STEP'),
  {_dense('den', 'every', 30)}, {_ranked('lex', 'every', 30)},
  needs AS (SELECT system, query_id, query_id::VARCHAR AS item_id, NULL AS part, c, f FROM jobs WHERE strategy = 'HYBRID' UNION ALL SELECT system, query_id, query_id || '/' || sub_query_id, sub_query_id, c, c FROM jobs JOIN parts USING (query_id) WHERE strategy = 'MULTI_STEP'),
  da AS (SELECT n.*, doc_id, rank FROM needs n JOIN den USING (item_id) WHERE rank <= c), lb AS (SELECT n.*, doc_id, rank FROM needs n JOIN lex USING (item_id) WHERE rank <= c)"""
_SYSTEM_HITS = f"""{_SYSTEM_JOBS},
  fused AS (SELECT coalesce(a.system, b.system) AS system, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.c, b.c) AS c, coalesce(a.f, b.f) AS f, coalesce(a.part, b.part) AS part, round({_RRF}, 9) AS score
    FROM da a FULL OUTER JOIN lb b ON a.system = b.system AND a.item_id = b.item_id AND a.doc_id = b.doc_id),
  best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY system, item_id ORDER BY score DESC, doc_id) <= c),
  again AS (SELECT b.system, b.query_id, b.item_id, b.part, b.c, b.f, b.doc_id, {_OVERLAP('e.q', 'd.text')} AS score FROM best b JOIN every e USING (item_id) JOIN documents d USING (doc_id)),
  pooled AS (SELECT system, query_id, doc_id, max(score) AS score, any_value(c) AS c FROM again WHERE part IS NOT NULL GROUP BY ALL),
  cut AS (SELECT * FROM pooled QUALIFY row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, doc_id) <= c),
  whole_q AS (SELECT p.system, p.query_id, p.doc_id, j.f, {_OVERLAP('e.query', 'd.text')} AS score FROM cut p JOIN said e USING (query_id) JOIN documents d USING (doc_id) JOIN jobs j ON j.system = p.system AND j.query_id = p.query_id),
  got AS (SELECT j.system, j.query_id, doc_id, score, f FROM jobs j JOIN den ON den.item_id = j.query_id::VARCHAR WHERE strategy = 'DENSE' AND rank <= f
    UNION ALL SELECT system, query_id, doc_id, score, f FROM again WHERE part IS NULL UNION ALL SELECT system, query_id, doc_id, score, f FROM whole_q)"""

SQL = {
    "index_manifest": f"""{_BASE} SELECT 26::BIGINT AS dimension, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM documents) AS vectors, (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM post) AS postings, 1::BIGINT AS dense_smoke_hits, 1::BIGINT AS bm25_smoke_hits""",
    "retrieved_hits": f"""{_BASE}, {_ranked('hits', 'whole', 3)} SELECT item_id AS query_id, rank, doc_id AS chunk_id, score, 'bm25' AS retrieval_method, doc_id::VARCHAR AS doc_id, source AS doc_title, lang AS section_title,
      regexp_replace(replace(substring(text, 1, 150), chr(10), chr(32)), '^\\s+|\\s+$', '', 'g') || CASE WHEN length(text) > 150 THEN '...' ELSE '' END AS content_snippet FROM hits JOIN documents USING (doc_id)""",
    "hybrid_dense_bm25": f"""{_BASE}, {_dense('a', 'tail', 10)}, {_ranked('b', 'tail', 10)},
      f AS (SELECT coalesce(a.item_id, b.item_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS chunk_id, round({_RRF}, 9) AS rrf_score FROM a FULL OUTER JOIN b ON a.item_id = b.item_id AND a.doc_id = b.doc_id),
      c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) <= 10),
      r AS (SELECT c.*, {_OVERLAP('w.q', 'd.text')} AS rerank_score FROM c JOIN tail w ON w.item_id = c.query_id JOIN documents d ON d.doc_id = c.chunk_id)
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank, chunk_id, rrf_score, rerank_score FROM r QUALIFY rank <= 5""",
    "engine_systems": f"{_SYSTEM_HITS} SELECT system, query_id, row_number() OVER (PARTITION BY system, query_id ORDER BY score DESC, doc_id) AS rank, doc_id AS chunk_id, score FROM got QUALIFY rank <= f",
    "engine_work": f"""{_SYSTEM_JOBS},
      seen AS (SELECT system, query_id, item_id, 1 AS one FROM da UNION ALL SELECT system, query_id, item_id, 1 FROM lb),
      fused AS (SELECT coalesce(a.system, b.system) AS system, coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.c, b.c) AS c, count(*) AS n FROM da a FULL OUTER JOIN lb b ON a.system = b.system AND a.item_id = b.item_id AND a.doc_id = b.doc_id WHERE coalesce(a.part, b.part) IS NOT NULL GROUP BY ALL)
      SELECT system, query_id, CASE strategy WHEN 'DENSE' THEN 1 WHEN 'HYBRID' THEN 2 ELSE 2 * (SELECT count(*) FROM parts p WHERE p.query_id = j.query_id) END::BIGINT AS retrieval_calls,
        CASE strategy WHEN 'DENSE' THEN (SELECT count(*) FROM den WHERE item_id = j.query_id::VARCHAR AND rank <= j.f) WHEN 'HYBRID' THEN (SELECT count(*) FROM seen s WHERE s.system = j.system AND s.query_id = j.query_id)
          ELSE (SELECT sum(least(n, c)) FROM fused x WHERE x.system = j.system AND x.query_id = j.query_id) END::BIGINT AS chunks_processed, 0::BIGINT AS escalation_count
      FROM jobs j WHERE system <> 'adaptive_rag'""",
    "vector_index_round_trip": """SELECT query_id, rank, chunk_id, score FROM (
      SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank
      FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 3""",
    "bm25_index_round_trip": f"{_BASE}, {_ranked('hits', 'tail', 3)} SELECT item_id AS query_id, rank, doc_id AS chunk_id, score FROM hits",
    "evaluation_run": f"""{_RUN}
      SELECT 'q' || p.query_id AS question_id, 'basic_rag' AS system, CASE WHEN bad THEN 'Another answer.' ELSE 'An answer.' END AS generated_answer, NULL::VARCHAR AS error, recall_at_1, recall_at_5, mrr, ndcg_at_5,
        CASE WHEN bad THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS correctness, CASE WHEN bad THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS overall, coalesce(n, 0) AS chunks_processed, true AS strategy_match, CASE WHEN bad THEN 'RuntimeError: too long' ELSE '' END AS previous_errors
      FROM per p JOIN long l ON l.item_id = p.query_id LEFT JOIN used u ON u.item_id = p.query_id""",
    "stream_evaluation_run": f"""{_RUN} SELECT 'q' || p.query_id AS question_id, 'basic_rag' AS system, 'An answer.' AS generated_answer, NULL::VARCHAR AS error, recall_at_5, mrr, 3.0::DOUBLE AS overall, 1::BIGINT AS retrieval_calls, coalesce(n, 0) AS chunks_processed,
      (SELECT bool_or(bad) FROM long) AS stopped, true AS ended FROM per p LEFT JOIN used u ON u.item_id = p.query_id""",
    "evaluation_run_summary": f"""{_RUN}
      SELECT 'basic_rag' AS system, count(*) AS question_count, count(*) FILTER (NOT bad) AS successful_count, count(*) FILTER (bad) AS failure_count, round(count(*) FILTER (bad) / count(*), 4) AS error_rate, count(*) FILTER (NOT bad) AS judge_successful_count,
        round(coalesce(avg(recall_at_5) FILTER (NOT bad), 0), 4) AS recall_at_5, round(coalesce(avg(mrr) FILTER (NOT bad), 0), 4) AS mrr, round(coalesce(avg(ndcg_at_10) FILTER (NOT bad), 0), 4) AS ndcg_at_10, round(coalesce(avg(1.0::DOUBLE) FILTER (NOT bad), 0), 4) AS strategy_accuracy,
        count(*) FILTER (NOT bad) AS total_retrieval_calls, coalesce(sum(n) FILTER (NOT bad), 0)::BIGINT AS total_chunks_processed, round(coalesce(avg(3.0::DOUBLE) FILTER (NOT bad), 0), 4) AS mean_correctness, round(coalesce(avg(3.0::DOUBLE) FILTER (NOT bad), 0), 4) AS mean_overall
      FROM per p JOIN long l ON l.item_id = p.query_id LEFT JOIN used u ON u.item_id = p.query_id""",
    "system_comparison": "SELECT 'basic' AS system, 'ok' AS status, count(*) AS rows, NULL::VARCHAR AS error FROM benchmark UNION ALL SELECT 'no such system', 'failed', count(*), 'ValueError: unknown system: no such system' FROM benchmark",
    "judge_scores": """SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END AS correctness, CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE 2.5::DOUBLE END AS faithfulness, 0.0::DOUBLE AS relevance,
      CASE WHEN doc_id % 3 = 0 THEN 0.0::DOUBLE ELSE round(6.5::DOUBLE / 3, 4) END AS overall, CASE WHEN doc_id % 3 = 0 THEN 'Blank answer.' ELSE 'fine' END AS reason FROM documents""",
    "provider_replies": """SELECT conv_id || '/' || turn AS query_id, 'openai' AS provider, CASE WHEN length(text) % 5 <> 0 THEN 'chat ' || length(text) END AS answer, length(text) % 5 = 0 AS failed FROM conversations
      UNION ALL SELECT conv_id || '/' || turn, 'gemini', CASE WHEN length(text) % 7 <> 0 THEN 'part ' || length(text) END, length(text) % 7 = 0 FROM conversations""",
    "fetched_pages": """SELECT 'cached' AS run, page_id::VARCHAR AS doc_id, CASE WHEN NOT ends_with(url, '3') THEN '<p>' || url || '</p>' END AS html, ends_with(url, '3') AS failed FROM pages
      UNION ALL SELECT 'forced', page_id::VARCHAR, '<b>' || url || '</b>', false FROM pages""",
    "document_round_trip": "SELECT doc_id::VARCHAR AS doc_id, 'doc:' || doc_id AS source_url, source AS title, lang AS category, sha256(text) AS content_sha256 FROM documents",
    "chunk_round_trip": f"WITH RECURSIVE {FIXED_CTE} SELECT 'fixed' AS strategy, doc_id || '_fixed_' || lpad(k::VARCHAR, 4, '0') AS chunk_id, doc_id::VARCHAR AS doc_id, token_count FROM chunks WHERE token_count > 0",
    "benchmark_round_trip": "SELECT 'q' || item_id AS question_id, sha256(text) AS query_sha256, 'x,' || item_id AS targets, true AS no_answer FROM benchmark",
    "results_round_trip": f"""WITH one AS (SELECT 'q' || item_id AS question_id, sha256('{{"query":' || to_json(text) || ',"question_id":"q' || item_id || '"}}') AS f FROM benchmark)
      SELECT question_id, CASE WHEN ends_with(question_id, '1') THEN 'old' ELSE (SELECT {set_sql('f')} FROM one) END AS benchmark_fingerprint, NULL::VARCHAR AS later_column FROM one""",
    "summary_round_trip": EVALUATION_SQL["system_summary"],
    "output_guard": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'outputs must differ' WHEN 1 THEN 'protected input: in/raw' END AS problem FROM pages",
    "sample_questions": f"""WITH picked AS (SELECT item_id, question_id, kind, query FROM benchmark JOIN (VALUES {_SAMPLES}) t(n, question_id, kind, query) ON item_id % {len(tables.SAMPLES)} + 1 = n),
      asked AS (SELECT item_id AS query_id, query, kind AS category FROM picked), {question_queries.ANALYSIS}, {question_queries.ROUTED} SELECT item_id, question_id, kind, p.query, strategy FROM picked p JOIN plans ON item_id = query_id""",
    "canonical_fields": """SELECT event_id, '{"type":"' || event_type || '","user":"' || user_id || '"}' AS fields FROM events""",
    "evidence_hits": f"{_BASE}, {_PARTS}, {_POOL} SELECT item_id AS query_id, doc_id AS chunk_id, initial_score AS score, 'multi_step' AS retrieval_method, overlap_count, retrieved_by FROM pool",
    "pool_rerank": f"""{_BASE}, {_PARTS}, {_POOL}, r AS (SELECT p.*, CASE WHEN p.doc_id % 2 = 0 THEN {_OVERLAP('w.q', 'd.text')} END AS s FROM pool p JOIN whole w ON w.item_id = p.item_id JOIN documents d ON d.doc_id = p.doc_id)
      SELECT item_id AS query_id, doc_id AS chunk_id, initial_score, s AS rerank_score, coalesce(s, initial_score) AS final_score FROM r""",
    "pool_counts": f"{_BASE}, {_PARTS}, {_POOL} SELECT item_id AS query_id, sum(overlap_count)::BIGINT AS examined, count(*) AS unique FROM pool GROUP BY 1",
    "route_guard": f"SELECT event_id, event_id % 8 < {len(Q.INTENTS)} AND event_id % 4 < {len(Q.STRATEGIES)} AS routed FROM events",
    "plain_decompose": f"""WITH {question_queries._ANALYSIS}, a AS (SELECT query_id, len(concepts) AS n, len(concepts) >= 2 AND ({_CONNECTED}) AS d FROM analysis)
      SELECT query_id, CASE WHEN d THEN least(n, 3) + 1 ELSE 1 END AS parts, CASE WHEN d THEN 'individual_concept' ELSE 'original' END AS least_type FROM a""",
    "run_progress": """SELECT n AS done, e AS executed, 1000000 - n AS remaining, round(m, 4) AS mean_seconds, CASE WHEN t < 60 THEN t || 's' WHEN t < 3600 THEN (t // 60) || 'm ' || lpad((t % 60)::VARCHAR, 2, '0') || 's' ELSE (t // 3600) || 'h ' || lpad((t % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((t % 60)::VARCHAR, 2, '0') || 's' END AS eta
      FROM (SELECT *, floor(round(m * (1000000 - n), 4))::BIGINT AS t FROM (SELECT count(*) AS n, count(*) FILTER (event_id % 2 = 0) AS e, avg(abs(value)) FILTER (event_id % 2 = 0) AS m FROM events))""",
    "search_guards": "WITH n AS (SELECT count(*) AS n FROM benchmark WHERE item_id % 3 <> 0) SELECT method, n AS hits, n AS questions FROM n, (VALUES ('dense'), ('bm25'), ('hybrid')) t(method)",
    "word_lists": f"SELECT doc_id, len({lexical_sql('text')}) > 0 AS has_token FROM documents",
}
