"""Rank fusion, reranking and the hybrid of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import lexical_tokens
from sparkloom.operators.ranking import of_hits, top_k, within
from sparkloom.session import materialise

RRF_K = 60
#: What a scorer gives from question and content; larger is better.
Scorer = Callable[[Column, Column], Column]


def reciprocal_rank_fusion(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, dense_rank, lexical_rank, dense_score, bm25_score.

    A chunk's score is the sum of 1 / (k + rank) over the two rankings (query_id, rank, chunk_id, score), ranks from 1.
    """
    if k < 1 or limit is not None and limit < 1:
        raise ValueError("k and limit must be positive")
    a = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"))
    b = lexical.select("query_id", "chunk_id", F.col("rank").alias("lexical_rank"), F.col("score").alias("bm25_score"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    part = [F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank")]
    return top_k(both.withColumn("score", F.round(part[0] + part[1], 9)), limit)


def overlap_scorer(question: Column, content: Column) -> Column:
    """Share of the question's distinct words that the content has: a deterministic stand-in for a cross-encoder, not equivalent to one."""
    words = F.array_distinct(lexical_tokens(question))
    return F.coalesce(F.round(F.try_divide(F.size(F.array_intersect(words, lexical_tokens(content))), F.size(words)), 6), F.lit(0.0))


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame, scorer: Scorer = overlap_scorer, limit: int | str | None = None) -> DataFrame:
    """hits with rerank_score, scored and ranked anew by it, ties by chunk_id; other scores stay.

    Cut hits to their candidates first: the scorer sees each of their rows. questions: query_id, query; chunks: chunk_id, content.
    limit may name a column of questions.
    """
    _positive(limit)
    hits = materialise(hits, "candidates")
    pairs = hits.join(questions.select("query_id", "query"), "query_id").join(of_hits(hits, chunks.select("chunk_id", "content")), "chunk_id")
    scored = pairs.withColumn("rerank_score", scorer(F.col("query"), F.col("content"))).drop("rank", "score", "query", "content")
    scored = scored.withColumn("score", F.col("rerank_score"))
    return within(top_k(scored), questions, limit) if isinstance(limit, str) else top_k(scored, limit)


def hybrid(dense: DataFrame, lexical: DataFrame, questions: DataFrame, chunks: DataFrame, candidates: int | str = 20, final: int | str = 5, scorer: Scorer | None = overlap_scorer) -> DataFrame:
    """Both rankings cut to `candidates`, fused, cut again, then reranked to `final`, or cut to it without a scorer.

    The depths are numbers, or columns of questions with a depth for each, so that questions of all depths are one plan.
    """
    for depth in (candidates, final):
        _positive(depth)
    both = [within(hits, questions, candidates) for hits in (dense, lexical)]
    fused = reciprocal_rank_fusion(*both, limit=candidates if isinstance(candidates, int) else None)
    if isinstance(candidates, str):
        fused = within(fused, questions, candidates)
    fused = fused.withColumn("rrf_score", F.col("score"))
    return rerank(fused, questions, chunks, scorer, final) if scorer else within(fused, questions, final)


def _positive(depth: int | str | None) -> None:
    if isinstance(depth, int) and depth < 1:
        raise ValueError("depths must be positive")
