"""The engine: one object over an index, from pages to graded answers."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scoring import ADAPTIVE, BASIC, FULL, HYBRID, SYSTEM_NAMES, SYSTEMS, quota_spent
from sparkloom.operators import answers, chunking, dense, evaluation, evidence, fusion, lexical, metrics, questions
from sparkloom.operators.ranking import within
from sparkloom.sources import html, tables
from sparkloom.session import materialise

MOST_K = 20


@dataclass(frozen=True)
class Settings:
    dimension: int = 64
    dense_k: int = 5
    candidates: int = 20
    final: int = 5
    rrf_k: int = 60
    sub_queries: int = 4


@dataclass(frozen=True)
class Retrieved:
    """hits: system, query_id, rank, chunk_id, score; work: what each question took, counted from the rows that were there."""

    hits: DataFrame
    work: DataFrame


@dataclass
class Engine:
    """Indexed chunks with their lexical index and vectors; every method is a plan over a table of questions (query_id, query)."""

    spark: SparkSession
    chunks: DataFrame
    index: lexical.LexicalIndex
    vectors: DataFrame
    encoder: object
    settings: Settings = field(default_factory=Settings)
    scorer: fusion.Scorer = fusion.overlap_scorer

    @staticmethod
    def ingest(pages: DataFrame) -> DataFrame:
        return html.clean_pages(pages)

    @staticmethod
    def chunk(documents: DataFrame, strategy: str = "structure_aware") -> DataFrame:
        return chunking.chunk(documents, strategy)

    @staticmethod
    def build(chunks: DataFrame, encoder=None, settings: Settings | None = None, path: str | None = None) -> Engine:
        """Index chunks; with a path the tables are written there and read back, with a manifest of their counts."""
        settings = settings or Settings()
        encoder = encoder or dense.hashing_encoder(settings.dimension)
        spark = chunks.sparkSession
        chunks = chunks if path is None else _kept(chunks, f"{path}/chunks")
        vectors = dense.encode(chunks.select("chunk_id", "content"), encoder, dimension=settings.dimension).select("chunk_id", "embedding")
        index = lexical.build(chunks, path=path and f"{path}/lexical", by_id=False)
        if path is not None:
            dense.build(materialise(vectors, "vectors"), f"{path}/vectors")  # read twice there
            built = Engine.load(spark, path, encoder, settings)
            built._manifest(path)
            return built
        return Engine(spark, chunks, index, vectors, encoder, settings)

    @staticmethod
    def load(spark: SparkSession, path: str, encoder=None, settings: Settings | None = None) -> Engine:
        settings = settings or Settings()
        return Engine(spark, spark.read.parquet(f"{path}/chunks"), lexical.LexicalIndex.read(spark, f"{path}/lexical"), dense.load(spark, f"{path}/vectors"), encoder or dense.hashing_encoder(settings.dimension), settings)

    def _manifest(self, path: str) -> None:
        """Written last, with the counts of each table and how many hits a smoke question, the first chunk's own text, has by either index."""
        smoke = self.chunks.where(F.trim("content") != "").orderBy("chunk_id").limit(1).select(F.lit(1).alias("query_id"), F.substring("content", 1, 200).alias("query"))
        counts = [F.lit(self.settings.dimension).alias("dimension")]
        counts += [F.lit(table.count()).alias(name) for name, table in (("chunks", self.chunks), ("vectors", self.vectors), ("terms", self.index.terms))]
        counts.append(F.lit(self.index.n_postings).cast("long").alias("postings"))
        counts += [F.lit(self.search(smoke, method, 1).count()).alias(f"{method}_smoke_hits") for method in ("dense", "bm25")]
        self.spark.range(1).select(*counts).write.mode("errorifexists").json(f"{path}/manifest")

    @staticmethod
    def manifest(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.json(f"{path}/manifest")

    # search

    def retrieved(self, asked: DataFrame, method: str = "hybrid", k: int | None = None) -> DataFrame:
        """search with retrieval_method and the metadata of each chunk."""
        return answers.citations(self.search(asked, method, k).select("query_id", "rank", "chunk_id", "score"), self.chunks).withColumn("retrieval_method", F.lit(method))

    def search(self, asked: DataFrame, method: str = "hybrid", k: int | None = None) -> DataFrame:
        """query_id, rank, chunk_id, score by method dense, bm25 or hybrid; blank questions have no row."""
        asked = asked.where(F.trim("query") != "")
        if method == "dense":
            encoded = dense.encode(asked.select("query_id", "query"), self.encoder, "query", self.settings.dimension)
            return dense.search(self.vectors, encoded, k or self.settings.dense_k)
        if method == "bm25":
            return lexical.search(self.index, asked, k or self.settings.final)
        if method == "hybrid":
            return self.hybrid(asked, self.settings.candidates, k or self.settings.final)
        raise ValueError(f"unknown method: {method}")

    def hybrid(self, asked: DataFrame, candidates: int, final: int, reranking: bool = True) -> DataFrame:
        both = [self.search(asked, m, candidates) for m in ("dense", "bm25")]
        return fusion.hybrid(*both, asked, self.chunks, candidates, final, self.scorer if reranking else None)

    def analyze(self, asked: DataFrame) -> DataFrame:
        return questions.analyze(asked)

    def route(self, asked: DataFrame) -> DataFrame:
        return questions.route(questions.analyze(asked))

    def _jobs(self, asked: DataFrame, names: list[str], k: int | None) -> DataFrame:
        """A row a system and question: the strategy, its depths, and what the analysis says."""
        planned = [n for n in names if n in (ADAPTIVE, FULL)]
        routed = ["intent", "complexity", "terms"]
        some = self.settings
        fixed = {BASIC: ("DENSE", some.dense_k, k or some.dense_k), HYBRID: ("HYBRID", some.candidates, k or some.final)}
        out = [asked.select("query_id", "query", F.lit(n).alias("system"), *(F.lit(v).alias(c) for v, c in zip(fixed[n], ("strategy", "candidates", "final"))), *(F.lit(None).cast("array<string>" if c == "terms" else "string").alias(c) for c in routed)) for n in names if n in fixed]
        if planned:
            plans = self.route(asked).withColumn("system", F.explode(F.array(*map(F.lit, planned))))
            strategy = F.when((F.col("strategy") == "MULTI_STEP") & (F.col("system") == ADAPTIVE), "HYBRID").otherwise(F.col("strategy"))
            out.append(plans.select("query_id", "query", "system", strategy.alias("strategy"), F.col("candidate_top_k").alias("candidates"), (F.lit(k) if k else F.col("final_top_k")).alias("final"), *routed))
        return reduce(DataFrame.unionByName, out)

    def systems(self, asked: DataFrame, names: tuple[str, ...] = SYSTEMS, k: int | None = None) -> Retrieved:
        """The hits of several systems, and what each question took, from one ranking an index.

        Each index is searched once, to the greatest depth that a question has; jobs (question, strategy, depths) are
        cut from those rankings by their own depths, and what two systems do alike is done once. The parts of
        complex questions are one more search of each index, and one more for those whose evidence falls short.
        """
        if k is not None and not 1 <= k <= MOST_K:
            raise ValueError(f"k lies between 1 and {MOST_K}")
        asked = asked.where(F.trim("query") != "").select("query_id", "query")
        jobs = materialise(self._jobs(asked, [_system(n) for n in names], k), "jobs")
        key = F.struct("query_id", "strategy", "candidates", "final")
        once = materialise(jobs.withColumn("job", key).dropDuplicates(["job"]).drop("system"), "distinct-jobs")
        done = self._done(once.withColumnRenamed("query_id", "asked_id").withColumnRenamed("job", "query_id"), asked)
        owned = jobs.select("system", key.alias("job"))
        for_systems = lambda rows: owned.join(rows.withColumnRenamed("query_id", "job"), "job").withColumn("query_id", F.col("job.query_id"))
        return Retrieved(for_systems(done.hits).select("system", "query_id", "rank", "chunk_id", "score"), for_systems(done.work).select("system", "query_id", "retrieval_calls", "chunks_processed", "escalation_count"))

    def planned(self, plans: DataFrame) -> DataFrame:
        """query_id, rank, chunk_id, score for plans of dense and hybrid retrieval; any other strategy raises when rows are read."""
        able = F.when(F.col("strategy").isin("DENSE", "HYBRID"), True).otherwise(F.raise_error(F.concat(F.lit("no plan-driven retrieval for "), F.coalesce("strategy", F.lit("null")))).cast("boolean"))
        jobs = plans.where(able).select("query_id", F.col("query_id").alias("asked_id"), "query", "strategy", F.col("candidate_top_k").alias("candidates"), F.col("final_top_k").alias("final"), "intent", "complexity", "terms")
        return self._done(materialise(jobs, "jobs"), plans.select("query_id", "query")).hits

    def _done(self, jobs: DataFrame, asked: DataFrame) -> Retrieved:
        """jobs: query_id (of the job), asked_id, query, strategy, candidates, final, intent, complexity, terms."""
        one = lambda s: jobs.where(F.col("strategy") == s)
        deepest = {r["strategy"]: r for r in jobs.groupBy("strategy").agg(F.max("candidates").alias("candidates"), F.max("final").alias("final")).collect()}  # three rows
        columns = ("query_id", "rank", "chunk_id", "score")
        hits, work = ([], []) if deepest else ([jobs.crossJoin(self.chunks).select("query_id", F.lit(1).alias("rank"), "chunk_id", F.lit(0.0).alias("score")).limit(0)], [_work(jobs, F.lit(0), jobs)])
        for_both = deepest["HYBRID"]["candidates"] if "HYBRID" in deepest else 0
        depth = max(for_both, deepest["DENSE"]["final"] if "DENSE" in deepest else 0)
        of_job = lambda rows, some: rows.withColumnRenamed("query_id", "asked_id").join(some.select("asked_id", "query_id"), "asked_id").drop("asked_id")
        if depth:
            dense_hits = materialise(self.search(asked, "dense", depth).select(*columns), "dense-hits")
        if "DENSE" in deepest:
            found = within(of_job(dense_hits, one("DENSE")), one("DENSE"), "final")
            hits.append(found.select(*columns))
            work.append(_work(one("DENSE"), F.lit(1), found))
        if for_both:
            some = one("HYBRID")
            lexical_hits = materialise(self.search(asked, "bm25", for_both).select(*columns), "lexical-hits")
            both = [within(of_job(rows, some), some, "candidates") for rows in (dense_hits, lexical_hits)]
            hits.append(fusion.hybrid(*both, some, self.chunks, "candidates", "final", self.scorer).select(*columns))
            work.append(_work(some, F.lit(2), both[0].unionByName(both[1])))
        if "MULTI_STEP" in deepest:
            found, verdicts, parts = self.multi_step(one("MULTI_STEP"))
            hits.append(found.select(*columns))
            counted = parts.groupBy("query_id").agg(F.count("*").alias("parts")).join(verdicts, "query_id")
            work.append(counted.select("query_id", (F.col("parts") * 2 * F.col("attempts")).alias("retrieval_calls"), F.col("examined").alias("chunks_processed"), (F.col("attempts") > 1).cast("long").alias("escalation_count")))
        return Retrieved(reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, work))

    def multi_step(self, jobs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Evidence for complex questions, its verdicts and the questions' parts: parts are searched, pooled, searched deeper where the
        evidence falls short, and reranked against the question. jobs: query_id, query, candidates, final and the analysis."""
        parts = questions.decompose(jobs, self.settings.sub_queries).join(jobs.select("query_id", "candidates"), "query_id")
        parts = materialise(parts, "parts")

        def retrieve(some: DataFrame, depth: str) -> DataFrame:
            flat = materialise(some.select(F.struct("query_id", "sub_query_id").alias("query_id"), F.col("query_text").alias("query"), depth), "flat")
            deepest = flat.agg(F.max(depth)).first()[0]
            both = [self.search(flat, m, deepest).select("query_id", "rank", "chunk_id", "score") for m in ("dense", "bm25")]
            return fusion.hybrid(*both, flat, self.chunks, depth, depth, self.scorer).select("query_id.query_id", "query_id.sub_query_id", "chunk_id", "score")

        found, verdicts = evidence.retrieve_complex(parts, retrieve, "candidates", "candidates")
        return fusion.rerank(found.drop("rank"), jobs, self.chunks, self.scorer, "final"), verdicts, parts

    def retrieve(self, asked: DataFrame, system: str = "full", k: int | None = None) -> DataFrame:
        """query_id, rank, chunk_id, score by one of the four systems."""
        return self.systems(asked, (system,), k).hits.drop("system")

    # answers

    def prompts(self, asked: DataFrame, hits: DataFrame) -> DataFrame:
        made = answers.contexts(asked, answers.citations(hits, self.chunks)).join(asked, "query_id")
        return made.select("query_id", answers.prompt(F.col("context"), F.col("query")).alias("prompt"))

    def answer(self, asked: DataFrame, system: str = "full", provider: answers.Provider | None = None, k: int | None = None) -> DataFrame:
        return answers.generate(self.prompts(asked, self.retrieve(asked, system, k)), provider or answers.FixedAnswer())

    def compare(self, asked: DataFrame, systems: tuple[str, ...] = SYSTEMS, provider: answers.Provider | None = None) -> DataFrame:
        """Answers of several systems: system, status and the columns of answer; one that fails has a row with its error."""
        out = None
        for s in systems:
            try:
                got = materialise(self.answer(asked, s, provider), "answers").withColumns({"system": F.lit(s), "status": F.when(F.col("error").isNull(), "ok").otherwise("failed")})
            except Exception as e:  # one system's failure is its result
                got = asked.select("query_id", F.lit(None).cast("string").alias("answer"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"), *(F.lit(None).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")), F.lit(s).alias("system"), F.lit("failed").alias("status"))
            out = got if out is None else out.unionByName(got)
        return out

    # evaluation

    def evaluate(self, benchmark: DataFrame, systems: tuple[str, ...] = SYSTEMS) -> DataFrame:
        """Retrieval measures of each question and system; benchmark: query_id, query, truth (array of chunk ids)."""
        truth = benchmark.select("query_id", F.explode("truth").alias("chunk_id"))
        found = materialise(self.systems(benchmark.select("query_id", "query"), systems).hits, "hits")
        out = None
        for s in systems:
            lists = metrics.ranked_lists(found.where(F.col("system") == _system(s)).drop("system"), truth, benchmark)
            got = metrics.bundle(lists).withColumn("system", F.lit(s))
            out = got if out is None else out.unionByName(got)
        return out

    def run(self, benchmark: DataFrame, systems: tuple[str, ...] = SYSTEMS, provider: answers.Provider | None = None, judge: answers.Provider | None = None, done: DataFrame | None = None, retry_failed: bool = True, most: int | None = None) -> DataFrame:
        """Records of the systems over the benchmark's questions: retrieved, answered, measured against the truth and judged.

        benchmark: question_id, query, reference_answer, truth (array of chunk ids), expected_intent, expected_complexity,
        expected_strategy; the first `most` questions, if given. done: earlier records, whose pairs are run again only where they
        failed and retry_failed is set; they come back with the new ones, whose previous_errors tell of earlier tries. Once a daily
        quota is spent the systems that follow are not begun, so that a later run resumes with them.
        """
        asked = tables.filter_benchmark(benchmark, limit=most)
        new = self.fresh(asked, systems, provider, judge, done, retry_failed)
        if new is None:
            return done if done is not None else self._records(asked.withColumn("query_id", F.col("question_id")).where(F.lit(False)), systems[0], provider, judge).withColumn("position", F.lit(0).cast("long"))
        return new if done is None else evaluation.merged(done, new)

    def fresh(self, benchmark: DataFrame, systems: tuple[str, ...], provider: answers.Provider | None, judge: answers.Provider | None, done: DataFrame | None, retry_failed: bool = True) -> DataFrame | None:
        """The records that `run` makes beside those done, None if there is nothing to do; after a spent quota no further system is begun."""
        asked = materialise(benchmark.withColumn("query_id", F.col("question_id")), "asked")
        new = None
        for position, system in enumerate(systems):
            todo = asked
            if done is not None:
                todo = asked.join(evaluation.pending(asked, (_system(system),), done, retry_failed), "question_id", "left_semi")
            if todo.isEmpty():
                continue
            got = materialise(self._records(todo, system, provider, judge).withColumn("position", F.lit(position).cast("long")), "records")
            new = got if new is None else new.unionByName(got)
            if not got.where(quota_spent(F.coalesce("error", F.lit("")))).isEmpty():
                break
        return new

    def _records(self, asked: DataFrame, system: str, provider: answers.Provider | None, judge: answers.Provider | None) -> DataFrame:
        began = time.monotonic()
        questions_ = asked.select("query_id", "query")
        retrieved = self.systems(questions_, (system,))
        hits = materialise(retrieved.hits.drop("system"), "hits")
        work = materialise(retrieved.work.drop("system"), "work")
        replies = materialise(answers.generate(self.prompts(questions_, hits), provider or answers.FixedAnswer()), "answers")
        seconds = time.monotonic() - began
        truth = asked.select("query_id", F.explode("truth").alias("chunk_id"))
        measures = metrics.bundle(metrics.ranked_lists(hits, truth, asked))
        shown = "content_snippet" if _system(system) == BASIC else "content"  # the plain system is judged on its snippets
        snippets = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(shown).alias("shown")))), lambda x: x["shown"])
        evidence_ = answers.citations(hits, self.chunks).groupBy("query_id").agg(snippets.alias("snippets"))
        rows = asked.join(replies, "query_id").join(evidence_, "query_id", "left")
        evidence_text = answers.evidence_text(F.coalesce("snippets", F.array().cast("array<string>")))
        graded = rows.select("query_id", F.col("query").alias("question"), F.coalesce("reference_answer", F.lit("")).alias("reference"), evidence_text.alias("evidence"), "answer")
        scores = answers.judge(graded, judge or answers.FixedAnswer('{"correctness": 0, "faithfulness": 0, "relevance": 0, "reason": "no judge"}')).select("query_id", "scores.*", *(f"judge_{c}" for c in answers.TOKENS))
        name = _system(system)
        plans = self.route(questions_).select("query_id", "intent", "complexity", "strategy")
        fixed = {BASIC: "DENSE", HYBRID: "HYBRID"}.get(name)
        predicted = F.lit(fixed) if fixed else F.col("strategy")
        routed = lambda c: F.lit(None).cast("boolean") if fixed else F.col(c) == F.col(f"expected_{c}")
        out = rows.join(scores, "query_id").join(measures, "query_id").join(plans, "query_id", "left").join(work, "query_id", "left")
        return out.select(
            "question_id",
            F.lit(name).alias("system"),
            F.col("answer").alias("generated_answer"),
            "error",
            "reason",
            *(c for c in measures.columns if c.startswith(("recall", "ndcg")) or c == "mrr"),
            "correctness",
            "faithfulness",
            "relevance",
            "overall",
            (F.lit(seconds * 1000) / F.lit(max(1, asked.count()))).alias("latency_ms"),
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("retrieval_calls", "chunks_processed", "escalation_count")),
            "prompt_tokens",
            "completion_tokens",
            "total_tokens",
            *(f"judge_{c}" for c in answers.TOKENS),
            (predicted == F.col("expected_strategy")).alias("strategy_match"),
            routed("intent").alias("intent_match"),
            routed("complexity").alias("complexity_match"),
            "expected_intent",
            "expected_complexity",
            "expected_strategy",
            predicted.alias("predicted_strategy"),
            F.array().cast("array<string>").alias("previous_errors"),
        )

    @staticmethod
    def summarize(records: DataFrame) -> DataFrame:
        return evaluation.system_summary(records)


def _system(name: str) -> str:
    """The system of a name in any spelling."""
    found = SYSTEM_NAMES.get(name.strip().lower().replace("-", "_").replace(" ", "_"))
    if found is None:
        raise ValueError(f"unknown system: {name}")
    return found


def _work(jobs: DataFrame, calls: Column, seen: DataFrame) -> DataFrame:
    """retrieval_calls, chunks_processed and escalation_count of jobs that search `calls` times and have gone through the rows of `seen`."""
    counted = seen.groupBy("query_id").agg(F.count("*").alias("n"))
    none = F.lit(0).cast("long")
    return jobs.select("query_id").join(counted, "query_id", "left").select("query_id", calls.cast("long").alias("retrieval_calls"), F.coalesce("n", none).alias("chunks_processed"), none.alias("escalation_count"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
