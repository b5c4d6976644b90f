"""Ranking within a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Chunk ids that are broadcast; the chunks of more are shuffled.
BROADCAST = 1_000_000


def top_k(hits: DataFrame, k: int | None = None, score: str = "score", query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """hits with rank, from 1, by falling score and then item; the first k of each question.

    The limit is on the rank, so Spark cuts each task's rows to k a question before the shuffle.
    """
    order = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def within(hits: DataFrame, questions: DataFrame, depth: int | str) -> DataFrame:
    """hits of a rank up to depth: a number, or the column of questions (one row a query_id) that has each question's own."""
    if isinstance(depth, int):
        return hits.where(F.col("rank") <= depth)
    own = questions.select("query_id", F.col(depth).alias("_depth"))
    return hits.join(own, "query_id").where(F.col("rank") <= F.col("_depth")).drop("_depth")


def of_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks that hits name. Hits are a stated number a question: their ids are sent to the chunks, whose texts don't move."""
    ids = hits.select("chunk_id").distinct()
    return chunks.join(F.broadcast(ids) if hits.count() <= BROADCAST else ids, "chunk_id", "left_semi")
