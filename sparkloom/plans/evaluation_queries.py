"""Evaluation records and what is made of them: labelled documents stand for questions, each with a record of four systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scoring
from sparkloom.operators import evaluation as E
from sparkloom.plans.common import longs, read

SYSTEMS = scoring.SYSTEMS
INTENTS = ("FACT_LOOKUP", "EXPLANATION", "PROCEDURE", "COMPARISON", "TROUBLESHOOTING", "MULTI_CONCEPT")
LEVELS = ("SIMPLE", "MEDIUM", "COMPLEX")
PLANS = ("DENSE", "HYBRID", "MULTI_STEP")

#: The records' columns, in expressions that Spark and DuckDB read alike: d is the document, s the system from 0.
_COLUMNS = {
    "recall_at_1": "((d * 3 + s) % 5) / CAST(4 AS DOUBLE)",
    "recall_at_3": "((d * 5 + s) % 5) / CAST(4 AS DOUBLE)",
    "recall_at_5": "((d * 7 + s * 3) % 11) / CAST(10 AS DOUBLE)",
    "recall_at_10": "((d * 11 + s) % 9) / CAST(8 AS DOUBLE)",
    "mrr": "1 / CAST(1 + (d + s) % 6 AS DOUBLE)",
    "ndcg_at_1": "((d + s) % 2) / CAST(1 AS DOUBLE)",
    "ndcg_at_3": "((d * 2 + s) % 7) / CAST(6 AS DOUBLE)",
    "ndcg_at_5": "((d * 3 + s) % 9) / CAST(8 AS DOUBLE)",
    "ndcg_at_10": "((d * 4 + s) % 11) / CAST(10 AS DOUBLE)",
    "strategy_match": "(d + s) % 3 = d % 3",
    "intent_match": "(d + s) % 5 <> 0",
    "complexity_match": "(d * s) % 4 <> 1",
    "latency_ms": "((d * 13 + s * 7) % 1000) + CAST(0.5 AS DOUBLE)",
    "retrieval_calls": "CAST(s % 3 + 1 AS BIGINT)",
    "chunks_processed": "CAST(5 * (s + 1) AS BIGINT)",
    "escalation_count": "CAST(CASE WHEN (d + s) % 41 = 0 THEN 1 ELSE 0 END AS BIGINT)",
    "prompt_tokens": "CAST(CASE WHEN s = 0 THEN NULL ELSE 100 + d % 50 END AS BIGINT)",
    "completion_tokens": "CAST(CASE WHEN s = 0 THEN NULL ELSE 10 + d % 7 END AS BIGINT)",
    "total_tokens": "CAST(CASE WHEN s = 0 THEN NULL ELSE 110 + d % 50 + d % 7 END AS BIGINT)",
    "judge_prompt_tokens": "CAST(CASE WHEN s < 2 THEN NULL ELSE 300 + d % 20 END AS BIGINT)",
    "judge_completion_tokens": "CAST(CASE WHEN s < 2 THEN NULL ELSE 30 END AS BIGINT)",
    "judge_total_tokens": "CAST(CASE WHEN s < 2 THEN NULL ELSE 330 + d % 20 END AS BIGINT)",
    "correctness": "CAST(quality * 2 AS DOUBLE) + ((d + s) % 5) / CAST(2 AS DOUBLE)",
    "faithfulness": "((d * 3 + s) % 9) / CAST(2 AS DOUBLE)",
    "relevance": "((d * 2 + s * 5) % 9) / CAST(2 AS DOUBLE)",
    "overall": "((d + s * 2) % 17) / CAST(4 AS DOUBLE)",
    "reason": "CASE WHEN (d + s) % 17 = 0 THEN 'Failed to parse judge output: no object' WHEN (d + s) % 19 = 0 THEN 'Evaluation execution failure: stopped' ELSE 'fine' END",
    "error": "CASE WHEN (d + s) % 23 = 0 THEN 'timeout' END",
    "generated_answer": "CASE WHEN (d + s) % 29 = 0 THEN '  ' WHEN (d + s) % 31 = 0 THEN '[EVALUATION_ERROR] none' ELSE 'answer' END",
    "batch": "CAST(d % 5 AS BIGINT)",
    "position": "CAST(d AS BIGINT)",
}
_PICK = lambda names, key: "CASE " + " ".join(f"WHEN {key} = {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
_COLUMNS |= {
    "system": _PICK(SYSTEMS, "s"),
    "expected_intent": _PICK(INTENTS, "d % 6"),
    "expected_complexity": _PICK(LEVELS, "d % 3"),
    "expected_strategy": _PICK(PLANS, "d % 3"),
    "predicted_strategy": f"CASE WHEN s = 3 AND d % 10 = 0 THEN NULL ELSE {_PICK(PLANS, '(d + s) % 3')} END",
    "question_id": "concat('q', CAST(d AS VARCHAR(20)))",
}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("d"), F.col("quality").cast("long").alias("quality"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("s"))
    return rows.selectExpr(*(f"{e.replace('VARCHAR(20)', 'STRING')} AS {n}" for n, e in _COLUMNS.items()))


def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which three documents at a time share a question: later batches bring it again."""
    return records(spark, sf_dir).withColumn("question_id", F.concat(F.lit("q"), (F.col("position") % 40).cast("string")))


def system_summary(spark, sf_dir):
    return longs(E.system_summary(records(spark, sf_dir)))


def grouped_metrics(spark, sf_dir):
    return longs(E.grouped_metrics(records(spark, sf_dir)))


def routing_distribution(spark, sf_dir):
    return E.routing_distribution(records(spark, sf_dir))


def routing_accuracy(spark, sf_dir):
    return E.routing_accuracy(records(spark, sf_dir))


_PAIRS = (("full_rag", "hybrid_rag"), ("full_rag", "basic_rag"))


def head_to_head(spark, sf_dir):
    return E.head_to_head(E.system_summary(records(spark, sf_dir)), _PAIRS)


_METRICS = ("mean_overall", "mean_correctness", "recall_at_5", "mrr")


def best_system(spark, sf_dir):
    return E.best_system(E.system_summary(records(spark, sf_dir)), _METRICS, SYSTEMS)


def latest_valid(spark, sf_dir):
    return longs(E.latest_valid(repeated(spark, sf_dir)).select("question_id", "system", "batch", "position", "overall"))


def batch_counts(spark, sf_dir):
    return E.batch_counts(records(spark, sf_dir))


def per_question(spark, sf_dir):
    return E.per_question(records(spark, sf_dir), SYSTEMS)


def question_lines(spark, sf_dir):
    """The report's table of questions, line by line."""
    from sparkloom import reports as R

    return R.question_lines(E.per_question(records(spark, sf_dir), SYSTEMS), SYSTEMS)


def resume_pending(spark, sf_dir):
    r = records(spark, sf_dir)
    return E.pending(r.select("question_id").distinct(), SYSTEMS, r.where("position % 2 = 0"))


def resume_conflicts(spark, sf_dir):
    """A checkpoint of the even questions with half of their fingerprints changed, and of one question unknown."""
    d = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"))
    now = d.select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"), "quality")
    then = now.withColumn("fingerprint", E.fingerprint("question_id", "quality")).where(F.substring("question_id", -1, 1).isin(*"02468"))
    then = then.withColumn("fingerprint", F.when(F.col("quality") == 1, F.lit("changed")).otherwise(F.col("fingerprint")))
    then = then.unionByName(spark.createDataFrame([("x1", 0, "f")], "question_id string, quality long, fingerprint string"))
    return E.conflicts(then, now, ("question_id", "quality"))


def fingerprints(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("question_id"), F.sha2("text", 256).alias("digest"))
    return b.select("question_id", E.fingerprint("question_id", "digest").alias("fingerprint"))


def set_fingerprint(spark, sf_dir):
    """One fingerprint of all documents, and one of those of each third."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    out = E.set_fingerprint(d, ("doc_id", "digest")).withColumn("part", F.lit("all"))
    for i in range(3):
        out = out.unionByName(E.set_fingerprint(d.where(F.col("doc_id") % 3 == i), ("doc_id", "digest")).withColumn("part", F.lit(str(i))))
    return out


def efficiency_summary(spark, sf_dir):
    return longs(E.efficiency_summary(records(spark, sf_dir), "system"))


def efficiency_tracker(spark, sf_dir):
    """Events as a run's log: clicks retrieve, purchases escalate, the rest spend tokens; values shifted so that some are negative. A run is timed from
    its first signup, if it has one."""
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "retrieval").when(F.col("event_type") == "purchase", "escalation").when(F.col("event_type") == "signup", "start").otherwise("tokens")
    return longs(E.tracked(e.select("user_id", kind.alias("kind"), (F.floor("value").cast("long") - 20).alias("amount"), F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts"))


def usage_totals(spark, sf_dir):
    """Words of users as prompt tokens, of others as completion tokens."""
    from sparkloom.functions.text import word_count

    c = read(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "user").alias("asked"), word_count("text").alias("n"))
    return c.groupBy("conv_id").agg(F.sum(F.when(F.col("asked"), F.col("n"))).alias("prompt_tokens"), F.sum(F.when(~F.col("asked"), F.col("n"))).alias("completion_tokens"), F.sum("n").alias("total_tokens"))


def filter_benchmark(spark, sf_dir):
    from sparkloom.sources.tables import filter_benchmark as keep

    q = read(spark, sf_dir, "benchmark").select(F.format_string("b%04d", "item_id").alias("question_id"), F.length("text").cast("long").alias("n_chars"))
    return keep(q, [f"b{i:04d}" for i in range(0, 40, 3)], 10)


def score_bands(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.groupBy(scoring.score_band(scoring.clamp(F.col("overall"), 0.0, 4.0)).alias("band")).agg(F.count("*").alias("records"))


def overall_autofill(spark, sf_dir):
    r = records(spark, sf_dir)
    given = F.when(F.col("position") % 2 == 0, F.col("overall"))
    return r.select("question_id", "system", scoring.overall(given, *(F.col(c) for c in ("correctness", "faithfulness", "relevance"))).alias("overall"))


def violations(spark, sf_dir):
    """Records some of whose scores lie beyond the scale."""
    r = records(spark, sf_dir)
    high = F.col("position") % 7 == 0
    return E.violations(r.withColumns({"relevance": F.when(high, F.col("relevance") + 1).otherwise(F.col("relevance"))})).select("question_id", "system")


_REPLIES = [
    'Sure: ```json\n{"correctness": 3.5, "faithfulness": 4, "relevance": 2, "reason": "good"}\n```',
    '{"correctness": 9, "faithfulness": -1, "relevance": 2.5}',
    'before {"correctness": 1, "relevance": 2, "reason": " partly "} after',
    "no object at all",
    '{"correctness": "high"}',
    "",
]


def judge_parse(spark, sf_dir):
    """Replies of every form, each behind the start of a conversation's turn."""
    c = read(spark, sf_dir, "conversations")
    n = (F.col("conv_id") * 3 + F.col("turn")) % len(_REPLIES)
    replies = c.select("conv_id", "turn", F.concat(F.substring("text", 1, 40), F.lit(" "), F.array(*map(F.lit, _REPLIES))[n.cast("int")]).alias("reply"))
    return replies.select("conv_id", "turn", scoring.judged(F.col("reply")).alias("s")).select("conv_id", "turn", *(F.col(f"s.{c}").alias(c) for c in ("correctness", "faithfulness", "relevance", "overall", "reason")))


_NAMES = ["Basic", "hybrid-rag", " Adaptive RAG ", "FULL", "baseline", "other"]


def system_names(spark, sf_dir):
    """A spelling of a system's name for each event."""
    e = read(spark, sf_dir, "events").select("event_id", F.array(*map(F.lit, _NAMES))[(F.col("event_id") % len(_NAMES)).cast("int")].alias("name"))
    return e.select("event_id", "name", scoring.system_name(F.col("name"), strict=False).alias("system"))


def durations(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", scoring.duration((F.col("event_id") * 37 % 9000).cast("double") + 0.25).alias("duration"))


def retry_delays(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 90).cast("string")).alias("header"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("Please try again in "), (F.col("event_id") % 70).cast("string"), F.lit(".5s. Tokens per day"))).otherwise("busy").alias("body"))
    return e.select("event_id", scoring.retry_delay(F.col("header"), F.col("body"), F.col("event_id") % 7).alias("delay"), scoring.quota_spent(F.col("body")).alias("quota_spent"))


def response_efficiency(spark, sf_dir):
    """Efficiency out of responses' JSON, some of it missing."""
    e = read(spark, sf_dir, "events")
    known = F.to_json(F.struct((F.col("event_id") % 50).cast("double").alias("latency_ms"), (F.col("event_id") % 4).cast("int").alias("retrieval_calls"), F.struct((F.col("event_id") * 3).alias("total_tokens")).alias("token_usage")))
    rows = e.select("event_id", F.when(F.col("event_id") % 3 > 0, known).when(F.col("event_id") % 2 == 0, "{}").alias("metadata"))
    return longs(E.efficiency_of(rows).drop("metadata"))


def sigmoids(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.round(scoring.sigmoid(F.col("value") - 10), 6).alias("s"), scoring.percent_difference(F.col("value"), F.col("event_id") % 3).alias("pct"))


def reports(spark, sf_dir):
    """Both reports, as one row of Markdown text each."""
    from sparkloom import reports as R
    from sparkloom.operators import chunking
    from sparkloom.plans.section_queries import talks
    from sparkloom.plans.text_queries import probes

    r = records(spark, sf_dir)
    summary = E.system_summary(r)
    chunks = chunking.chunk_all(talks(spark, sf_dir))
    kept = chunking.preservation_rates(chunking.preservation(chunks, probes(spark, sf_dir)))
    made = [("chunking", R.chunking_report(chunking.chunk_stats(chunks), kept)), ("evaluation", R.evaluation_report(summary, E.head_to_head(summary, _PAIRS), E.best_system(summary, _METRICS, SYSTEMS), E.grouped_metrics(r)))]
    return spark.createDataFrame(made, "report string, text string")


QUERIES = {f.__name__: f for f in (reports, response_efficiency, sigmoids, system_summary, grouped_metrics, routing_distribution, routing_accuracy, head_to_head, best_system, latest_valid, batch_counts, per_question, question_lines, resume_pending, resume_conflicts, fingerprints, set_fingerprint, efficiency_summary, efficiency_tracker, usage_totals, filter_benchmark, score_bands, overall_autofill, violations, judge_parse, system_names, durations, retry_delays)}

def set_sql(digest: str) -> str:
    """The fingerprint of a group of digests as a set."""
    lane = lambda i: f"lpad(to_hex((sum(('0x' || substr({digest}, {16 * i + 1}, 16))::UBIGINT::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT), 16, '0')"
    return f"sha256(count(*) || ':' || lower({' || '.join(lane(i) for i in range(4))}))"


_RECORDS = "records AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _COLUMNS.items()) + " FROM (SELECT doc_id AS d, quality::BIGINT AS quality, unnest([0, 1, 2, 3])::BIGINT AS s FROM labels))"
_OK = "(trim(coalesce(generated_answer, '')) <> '' AND coalesce(error, '') = '')"
_VALID = f"({_OK} AND NOT starts_with(generated_answer, '[EVALUATION_ERROR]') AND overall IS NOT NULL AND NOT starts_with(coalesce(reason, ''), 'Evaluation execution failure:'))"
_GRADED = f"({_OK} AND NOT starts_with(reason, 'Failed to parse judge output:'))"
_MEAN = lambda c, of=_OK, p=4, name=None: f"round(coalesce(avg({c}::DOUBLE) FILTER ({of}), 0), {p}) AS {name or c}"
_SUMMARY = f"""summary AS (SELECT system, count(*) AS question_count, count(*) FILTER ({_OK}) AS successful_count, count(*) - count(*) FILTER ({_OK}) AS failure_count,
  round((count(*) - count(*) FILTER ({_OK})) / count(*), 4) AS error_rate, count(*) FILTER ({_GRADED}) AS judge_successful_count, count(*) FILTER ({_OK}) - count(*) FILTER ({_GRADED}) AS judge_failure_count,
  round((count(*) FILTER ({_OK}) - count(*) FILTER ({_GRADED})) / nullif(count(*) FILTER ({_OK}), 0), 4) AS judge_error_rate,
  {', '.join(_MEAN(c) for c in E.RETRIEVAL)}, {', '.join(_MEAN(c + '::INT', name=c.replace('match', 'accuracy')) for c in E.ROUTING)},
  {_MEAN('latency_ms', p=2, name='mean_latency_ms')}, (sum(retrieval_calls) FILTER ({_OK}))::BIGINT AS total_retrieval_calls, {_MEAN('retrieval_calls', p=2, name='mean_retrieval_calls')},
  (sum(chunks_processed) FILTER ({_OK}))::BIGINT AS total_chunks_processed, {_MEAN('chunks_processed', p=2, name='mean_chunks_processed')}, (sum(escalation_count) FILTER ({_OK}))::BIGINT AS total_escalations,
  {', '.join(f'(sum({c}) FILTER ({_OK}))::BIGINT AS {c}' for c in E.USAGE)}, {', '.join(_MEAN(c, _GRADED, name=f'mean_{c}') for c in E.QUALITY)}
  FROM records GROUP BY 1)"""
_DELTAS = ", ".join(f"round(a.{c} - b.{c}, {2 if c.endswith('_ms') else 4}) AS {c}_delta" for c in ("mean_overall", "mean_correctness", "mean_faithfulness", "mean_relevance", "recall_at_5", "mrr", "mean_latency_ms"))
_PERCENTS = ", ".join(f"coalesce(round((a.{c} - b.{c}) / nullif(b.{c}, 0) * 100, 2), 0) AS {c}_pct" for c in ("mean_overall", "mean_latency_ms"))
_ORDER = "CASE system " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SYSTEMS)) + " END"
_N = "event_id * 37 % 9000"
SQL = {
    "response_efficiency": """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN (event_id % 50)::DOUBLE ELSE 0.0::DOUBLE END AS latency_ms, CASE WHEN event_id % 3 > 0 THEN event_id % 4 ELSE 1 END AS retrieval_calls,
      0::BIGINT AS chunks_processed, 0::BIGINT AS escalation_count, CASE WHEN event_id % 3 > 0 THEN event_id * 3 END AS total_tokens FROM events""",
    "sigmoids": "SELECT event_id, round(1 / (1 + exp(-greatest(-5.0::DOUBLE, least(5.0::DOUBLE, value - 10)))), 6) AS s, coalesce(round((value - event_id % 3) / nullif((event_id % 3)::DOUBLE, 0) * 100, 2), 0) AS pct FROM events",
    "system_summary": f"WITH {_RECORDS}, {_SUMMARY} SELECT * FROM summary",
    "grouped_metrics": f"""WITH {_RECORDS} SELECT expected_intent AS intent, expected_complexity AS complexity, system, count(*) AS records, {', '.join(f'round(avg({c}), 4) AS mean_{c}' for c in (*E.QUALITY, 'recall_at_5', 'mrr'))},
      round(avg(latency_ms), 2) AS mean_latency_ms, round(avg(retrieval_calls), 2) AS mean_retrieval_calls FROM records WHERE {_VALID} GROUP BY GROUPING SETS ((expected_intent, system), (expected_complexity, system))""",
    "routing_distribution": f"WITH {_RECORDS} SELECT system, predicted_strategy AS strategy, count(*) AS records FROM records WHERE {_VALID} AND predicted_strategy IS NOT NULL GROUP BY 1, 2",
    "routing_accuracy": f"WITH {_RECORDS} SELECT system, round(avg(CASE WHEN predicted_strategy = expected_strategy THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM records GROUP BY 1",
    "head_to_head": f"WITH {_RECORDS}, {_SUMMARY} SELECT a.system AS first, b.system AS second, {_DELTAS}, {_PERCENTS} FROM summary a, summary b WHERE (a.system, b.system) IN ({', '.join(str(p) for p in _PAIRS)})",
    "best_system": f"WITH {_RECORDS}, {_SUMMARY} " + " UNION ALL ".join(f"(SELECT '{m}' AS metric, system FROM summary ORDER BY {m} DESC, {_ORDER} LIMIT 1)" for m in _METRICS),
    "latest_valid": f"""WITH {_RECORDS}, r AS (SELECT 'q' || (position % 40) AS question_id, * EXCLUDE (question_id) FROM records),
      v AS (SELECT *, {_VALID} AS ok FROM r)
      SELECT question_id, system, batch, position, overall FROM v QUALIFY row_number() OVER (PARTITION BY question_id, system ORDER BY ok DESC, CASE WHEN ok THEN batch END DESC NULLS LAST, CASE WHEN ok THEN position END DESC NULLS LAST, batch, position) = 1""",
    "batch_counts": f"WITH {_RECORDS} SELECT batch, count(*) AS total_records, count(*) FILTER ({_VALID}) AS valid_records FROM records GROUP BY 1",
    "per_question": f"WITH {_RECORDS} SELECT question_id, {', '.join(f'''max(overall) FILTER (system = '{s}') AS {s}''' for s in SYSTEMS)} FROM records GROUP BY 1",
    "question_lines": f"""WITH {_RECORDS}, p AS (SELECT question_id, {', '.join(f"max(overall) FILTER (system = '{s}') AS {s}" for s in SYSTEMS)} FROM records GROUP BY 1)
      SELECT question_id, '| ' || question_id || ' | ' || {" || ' | ' || ".join(f"coalesce(format('{{:.2f}}', {s}), '-')" for s in SYSTEMS)} || ' | ' || coalesce({', '.join(f"CASE WHEN {s} = greatest({', '.join(SYSTEMS)}) THEN '{s}' END" for s in SYSTEMS)}, '-') || ' |' AS line FROM p""",
    "resume_pending": f"WITH {_RECORDS} SELECT question_id, system FROM records WHERE NOT (position % 2 = 0 AND {_OK})",
    "resume_conflicts": "SELECT 'q' || doc_id AS question_id, 'changed question' AS problem FROM labels WHERE doc_id % 2 = 0 AND quality = 1 UNION ALL SELECT 'x1', 'unknown question'",
    "fingerprints": """SELECT 'b' || item_id AS question_id, sha256('{"digest":"' || sha256(text) || '","question_id":"b' || item_id || '"}') AS fingerprint FROM benchmark""",
    "set_fingerprint": f"""WITH rows AS (SELECT doc_id, sha256('{{"digest":"' || sha256(text) || '","doc_id":' || doc_id || '}}') AS f FROM documents),
      every AS (SELECT 'all' AS part, f FROM rows UNION ALL SELECT (doc_id % 3)::VARCHAR, f FROM rows) SELECT part, {set_sql('f')} AS fingerprint FROM every GROUP BY 1""",
    "efficiency_summary": f"""WITH {_RECORDS} SELECT system, count(*) AS records, round(avg(latency_ms), 4) AS mean_latency_ms, sum(retrieval_calls)::BIGINT AS total_retrieval_calls, round(avg(retrieval_calls), 4) AS mean_retrieval_calls,
      sum(chunks_processed)::BIGINT AS total_chunks_processed, round(avg(chunks_processed), 4) AS mean_chunks_processed, sum(escalation_count)::BIGINT AS total_escalations,
      sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM records GROUP BY 1""",
    "efficiency_tracker": """SELECT user_id, count(*) FILTER (k = 'r') AS retrieval_calls, coalesce(sum(a) FILTER (k = 'r'), 0)::BIGINT AS chunks_processed, coalesce(sum(a) FILTER (k = 'e'), 0)::BIGINT AS escalation_count, (sum(a) FILTER (k = 't'))::BIGINT AS total_tokens,
        greatest((epoch_us(max(ts)) - epoch_us(coalesce(min(ts) FILTER (k = 's'), min(ts)))) / 1000::DOUBLE, 0.0::DOUBLE) AS latency_ms
      FROM (SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'r' WHEN 'purchase' THEN 'e' WHEN 'signup' THEN 's' ELSE 't' END AS k, greatest(floor(value)::BIGINT - 20, 0) AS a FROM events) GROUP BY 1""",
    "usage_totals": r"""SELECT conv_id, (sum(n) FILTER (role = 'user'))::BIGINT AS prompt_tokens, (sum(n) FILTER (role <> 'user'))::BIGINT AS completion_tokens, sum(n)::BIGINT AS total_tokens
      FROM (SELECT conv_id, role, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS n FROM conversations) GROUP BY 1""",
    "filter_benchmark": "SELECT 'b' || lpad(item_id::VARCHAR, 4, '0') AS question_id, length(text) AS n_chars FROM benchmark WHERE item_id < 40 AND item_id % 3 = 0 ORDER BY 1 LIMIT 10",
    "score_bands": f"WITH {_RECORDS} SELECT CASE WHEN overall = 0 THEN 'does not satisfy' WHEN overall < 1 THEN 'very poor' WHEN overall < 2 THEN 'partially satisfies' WHEN overall < 3 THEN 'mostly satisfactory' ELSE 'strongly satisfies' END AS band, count(*) AS records FROM records GROUP BY 1",
    "overall_autofill": f"WITH {_RECORDS}, m AS (SELECT *, CASE WHEN position % 2 = 0 THEN overall END AS given, round((correctness + faithfulness + relevance) / 3, 4) AS mean FROM records) SELECT question_id, system, CASE WHEN given IS NULL OR (given = 0 AND mean > 0) THEN mean ELSE given END AS overall FROM m",
    "violations": f"WITH {_RECORDS} SELECT question_id, system FROM records WHERE correctness > 4 OR faithfulness > 4 OR relevance + CASE WHEN position % 7 = 0 THEN 1 ELSE 0 END > 4 OR overall > 4",
    "judge_parse": """SELECT conv_id, turn, correctness, faithfulness, relevance, overall, reason FROM conversations JOIN (VALUES (0::BIGINT, 3.5::DOUBLE, 4.0::DOUBLE, 2.0::DOUBLE, 3.1667::DOUBLE, 'good'), (1, 4.0, 0.0, 2.5, 2.1667, 'Evaluated by judge.'), (2, 1.0, 0.0, 2.0, 1.0, 'partly'),
      (3, 0.0, 0.0, 0.0, 0.0, 'Failed to parse judge output: no JSON object of scores'), (4, 0.0, 0.0, 0.0, 0.0, 'Failed to parse judge output: no JSON object of scores'), (5, 0.0, 0.0, 0.0, 0.0, 'Failed to parse judge output: no JSON object of scores')) t(n, correctness, faithfulness, relevance, overall, reason) ON n = (conv_id * 3 + turn) % 6""",
    "system_names": "SELECT event_id, name, system FROM events JOIN (VALUES (0, 'Basic', 'basic_rag'), (1, 'hybrid-rag', 'hybrid_rag'), (2, ' Adaptive RAG ', 'adaptive_rag'), (3, 'FULL', 'full_rag'), (4, 'baseline', 'basic_rag'), (5, 'other', NULL)) t(n, name, system) ON n = event_id % 6",
    "durations": f"SELECT event_id, CASE WHEN {_N} < 60 THEN ({_N}) || 's' WHEN {_N} < 3600 THEN ({_N} // 60) || 'm ' || lpad(({_N} % 60)::VARCHAR, 2, '0') || 's' ELSE ({_N} // 3600) || 'h ' || lpad(({_N} % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad(({_N} % 60)::VARCHAR, 2, '0') || 's' END AS duration FROM events",
    "retry_delays": """SELECT event_id, least(60.0::DOUBLE, CASE WHEN event_id % 3 = 0 AND event_id % 90 > 0 THEN (event_id % 90)::DOUBLE WHEN event_id % 3 = 1 THEN (event_id % 70)::DOUBLE + 1.0::DOUBLE ELSE 2.0::DOUBLE * pow(2.0::DOUBLE, event_id % 7) END) AS delay, event_id % 3 = 1 AS quota_spent FROM events""",
}
