"""Evidence for questions in parts: pooled, judged for sufficiency, and looked for again where it falls short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.scoring import sigmoid
from sparkloom.session import materialise

MIN_TOP, MIN_COVERAGE, MIN_CHUNKS = 0.0, 0.5, 2
ATTEMPTS, GROWTH = 2, 1.75


def pool(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, retrieved_by, sub_query_scores, initial_score, overlap_count: one row a chunk of a question.

    hits: query_id, sub_query_id, chunk_id, score; of repeated hits of one part the best counts.
    """
    one = hits.groupBy("query_id", "chunk_id", "sub_query_id").agg(F.max("score").alias("score"))
    return one.groupBy("query_id", "chunk_id").agg(
        F.sort_array(F.collect_list("sub_query_id")).alias("retrieved_by"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sub_query_id", "score")))).alias("sub_query_scores"),
        F.max("score").alias("initial_score"),
        F.count("*").alias("overlap_count"),
    )


def pool_counts(hits: DataFrame, pooled: DataFrame) -> DataFrame:
    """query_id, examined and unique: hits before and chunks after pooling."""
    seen = hits.groupBy("query_id").agg(F.count("*").alias("examined"))
    return seen.join(pooled.groupBy("query_id").agg(F.count("*").alias("unique")), "query_id")


def reranked(pooled: DataFrame, scores: DataFrame) -> DataFrame:
    """pooled with final_score from scores (query_id, chunk_id, rerank_score); a chunk without one keeps its first score."""
    return pooled.join(scores, ["query_id", "chunk_id"], "left").withColumn("final_score", F.coalesce("rerank_score", "initial_score"))


def coverage(sub_queries: DataFrame, pooled: DataFrame) -> DataFrame:
    """query_id, sub_query_id, chunks: how many pooled chunks each part found, 0 for none."""
    found = pooled.select("query_id", F.explode("retrieved_by").alias("sub_query_id")).groupBy("query_id", "sub_query_id").agg(F.count("*").alias("n"))
    return sub_queries.select("query_id", "sub_query_id").join(found, ["query_id", "sub_query_id"], "left").select("query_id", "sub_query_id", F.coalesce("n", F.lit(0)).cast("long").alias("chunks"))


def sufficiency(sub_queries: DataFrame, pooled: DataFrame, attempt: int = 1, attempts: int = ATTEMPTS, score: str = "initial_score", min_top: float = MIN_TOP, min_coverage: float = MIN_COVERAGE, min_chunks: int = MIN_CHUNKS) -> DataFrame:
    """One row a question: whether its evidence suffices, how well, and what to do next. min_top is in the scorer's own scale."""
    parts = coverage(sub_queries, pooled).groupBy("query_id").agg(F.count("*").alias("parts"), F.sum((F.col("chunks") > 0).cast("int")).alias("covered"))
    best = pooled.groupBy("query_id").agg(F.count("*").alias("evidence_count"), F.max(score).alias("top_score"))
    rows = parts.join(best, "query_id", "left").withColumns({"evidence_count": F.coalesce("evidence_count", F.lit(0)).cast("long"), "top_score": F.coalesce("top_score", F.lit(-999.0))})
    empty = F.col("evidence_count") == 0
    share = F.when(empty, 0.0).otherwise(F.col("covered") / F.col("parts"))
    enough = (F.col("evidence_count") >= min_chunks) & (F.col("top_score") >= min_top) & (share >= min_coverage) & ~empty
    graded = F.round(0.4 * share + 0.3 * F.least(F.lit(1.0), F.col("evidence_count") / max(1, 2 * min_chunks)) + 0.3 * sigmoid(F.col("top_score")), 3)
    next_step = F.when(enough, "PROCEED_TO_GENERATION").otherwise("ESCALATE_RETRIEVAL" if attempt < attempts else "INSUFFICIENT_EVIDENCE")
    return rows.select("query_id", "evidence_count", "top_score", share.alias("concept_coverage"), enough.alias("is_sufficient"), F.when(empty, 0.0).otherwise(graded).alias("sufficiency_score"), next_step.alias("recommendation"))


def retrieve_complex(sub_queries: DataFrame, retrieve: Callable[[DataFrame, int | str], DataFrame], candidates: int | str, final: int | str, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """The ranked evidence of each question, and its sufficiency with the attempts made and the hits examined in the last.

    retrieve(sub_queries, k) gives hits. Questions whose evidence falls short are retrieved anew with k grown; each attempt
    is one plan over only those questions, and there are `attempts` plans at most. candidates and final are numbers, or columns of
    sub_queries with each question's own; retrieve then gets the column's name as k.
    """
    from sparkloom.operators.ranking import top_k, within

    left, k, done, verdicts = sub_queries, candidates, None, None
    for attempt in range(1, attempts + 1):
        pooled = materialise(pool(retrieve(left, k)), "pool")
        seen = pooled.groupBy("query_id").agg(F.sum("overlap_count").alias("examined"))
        judged = sufficiency(left, pooled, attempt, attempts).withColumn("attempts", F.lit(attempt)).join(seen, "query_id", "left")
        judged = materialise(judged.withColumn("examined", F.coalesce("examined", F.lit(0)).cast("long")), "sufficiency")
        short = judged.where(~F.col("is_sufficient")).select("query_id")
        settled = judged if attempt == attempts else judged.where("is_sufficient")
        kept = pooled.join(settled.select("query_id"), "query_id", "left_semi")
        done = kept if done is None else done.unionByName(kept)
        verdicts = settled if verdicts is None else verdicts.unionByName(settled)
        if attempt == attempts or short.isEmpty():
            break
        left = left.join(short, "query_id", "left_semi")
        if isinstance(k, str):
            left = left.withColumn(k, F.floor(F.col(k) * GROWTH).cast("int"))
        else:
            k = int(k * GROWTH)
    ranked = done.withColumn("score", F.col("initial_score"))
    if isinstance(final, str):
        return within(top_k(ranked), sub_queries.select("query_id", final).distinct(), final), verdicts
    return top_k(ranked, final), verdicts


def as_hits(pooled: DataFrame) -> DataFrame:
    """Pooled evidence as hits: score is the final one, or the first."""
    final = F.col("final_score") if "final_score" in pooled.columns else F.col("initial_score")
    return pooled.select("query_id", "chunk_id", F.coalesce(final, F.col("initial_score")).alias("score"), F.lit("multi_step").alias("retrieval_method"), "overlap_count", "retrieved_by")
