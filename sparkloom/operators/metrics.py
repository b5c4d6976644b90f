"""Measures of a ranked list against its ground truth: column expressions on arrays, and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def recall(retrieved: Column, truth: Column, k: int) -> Column:
    """Distinct hits among the first k over distinct true items; 0 for k below 1 or an empty side."""
    if k < 1:
        return F.lit(0.0)
    hits = F.size(F.array_intersect(F.slice(retrieved, 1, k), truth))
    return F.coalesce(F.try_divide(hits, F.size(F.array_distinct(truth))), F.lit(0.0))


def hit(retrieved: Column, truth: Column, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, max(k, 0)), truth), F.lit(False)) if k > 0 else F.lit(False)


def _positions(retrieved: Column, truth: Column) -> Column:
    """Ranks, from 1, of the true items where each comes first."""
    return F.filter(
        F.transform(F.array_distinct(F.array_intersect(retrieved, truth)), lambda x: F.array_position(retrieved, x)),
        lambda p: p > 0,
    )


def reciprocal_rank(retrieved: Column, truth: Column, k: int | None = None) -> Column:
    """1 / rank of the first hit, within the first k if given; else 0."""
    if k is not None and k < 1:
        return F.lit(0.0)
    first = F.array_min(_positions(F.slice(retrieved, 1, k) if k else retrieved, truth))
    return F.coalesce(F.lit(1.0) / first, F.lit(0.0))


def ndcg(retrieved: Column, truth: Column, k: int) -> Column:
    """Binary nDCG of the first k; an item that comes twice counts where it comes first."""
    if k < 1:
        return F.lit(0.0)
    gain = F.aggregate(F.array_sort(_positions(F.slice(retrieved, 1, k), truth)), F.lit(0.0), lambda s, p: s + 1.0 / F.log2(p.cast("double") + 1))
    n = F.least(F.lit(k), F.size(F.array_distinct(truth)))
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, p: s + 1.0 / F.log2(p.cast("double") + 1))
    return F.coalesce(F.try_divide(gain, ideal), F.lit(0.0))


def bundle(lists: DataFrame, cuts: tuple[int, ...] = CUTS, keep: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Per row with arrays retrieved and truth: recall, nDCG and hit at each cut, and mrr, rounded to 4 places."""
    r, t = F.col("retrieved"), F.col("truth")
    columns = [f(r, t, k).alias(f"{name}_at_{k}") if name == "hit" else F.round(f(r, t, k), 4).alias(f"{name}_at_{k}") for name, f in (("recall", recall), ("ndcg", ndcg), ("hit", hit)) for k in cuts]
    return lists.select(*keep, *columns, F.round(reciprocal_rank(r, t), 4).alias("mrr"))


def ranked_lists(hits: DataFrame, truth: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, retrieved, truth: one row for every question, with empty arrays where it has none."""
    got = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("retrieved"))
    true = truth.groupBy("query_id").agg(F.sort_array(F.collect_set("chunk_id")).alias("truth"))
    lists = questions.select("query_id").join(got, "query_id", "left").join(true, "query_id", "left")
    empty = F.expr("filter(array(null), x -> x is not null)")
    kind = hits.schema["chunk_id"].dataType.simpleString()
    return lists.select("query_id", *(F.coalesce(c, empty.cast(f"array<{kind}>")).alias(c) for c in ("retrieved", "truth")))


def mean_reciprocal_rank(lists: DataFrame, k: int | None = None) -> DataFrame:
    """One row, mrr over all rows of lists; 0 if there is none."""
    return lists.agg(F.coalesce(F.avg(reciprocal_rank(F.col("retrieved"), F.col("truth"), k)), F.lit(0.0)).alias("mrr"))


def accuracy(predicted: Column, expected: Column) -> Column:
    """Aggregate: share of rows where both agree, without regard to case and outer spaces; null never agrees."""
    return F.coalesce(F.avg(F.when(F.upper(F.trim(predicted)) == F.upper(F.trim(expected)), 1.0).otherwise(0.0)), F.lit(0.0))
