"""Exact search by inner product over a table of vectors: block by block, or by clusters with bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.operators.ranking import top_k
from sparkloom.session import materialise

#: Vectors in a block: two blocks and their product are what a task holds.
BLOCK = 1024


def build(chunk_vectors: DataFrame, path: str) -> None:
    """Write (chunk_id, embedding); a null or empty vector, or one of another length, raises when the rows are written."""
    size = F.size("embedding")
    first = chunk_vectors.select(size.alias("n")).agg(F.min("n"), F.max("n")).first()
    if first[0] is None or first[0] != first[1] or first[0] < 1:
        raise ValueError(f"vectors must be of one positive length, got {first[0]} to {first[1]}")
    chunk_vectors.write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Blocks of at most BLOCK vectors: an array of ids and one of all their values."""
    kind = to_arrow_type(rows.schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(kind)), pa.array([flat], pa.list_(pa.float32()))], names=[f"{name}_ids", f"{name}_flat"])

    return rows.mapInArrow(run, f"{name}_ids array<{rows.schema[0].dataType.simpleString()}>, {name}_flat array<float>")


def _products(k: int, query_type: pa.DataType, chunk_type: pa.DataType):
    """For rows of a block of questions and one of vectors, the k best of each question: q_ids, q_flat, v_ids, v_flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, v_ids = batch.column("q_ids")[i].as_py(), batch.column("v_ids")[i].as_py()
                q, v = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) for c, n in (("q_flat", len(q_ids)), ("v_flat", len(v_ids))))
                order = np.argsort(np.argsort(np.array(v_ids, object), kind="stable"), kind="stable")
                score = np.round(v @ q.T, 6)
                best = [np.lexsort((order, -score[:, j]))[:k] for j in range(len(q_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, b in zip(q_ids, best) for _ in b], query_type), pa.array([v_ids[r] for b in best for r in b], chunk_type), pa.array([float(score[r, j]) for j, b in enumerate(best) for r in b], pa.float64())],
                    names=["query_id", "chunk_id", "score"],
                )

    return run


def _best(met: DataFrame, k: int, vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, chunk_id, score: k a question and block, of rows that hold a block of each."""
    query, chunk = questions.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType
    return met.mapInArrow(_products(k, to_arrow_type(query), to_arrow_type(chunk)), f"query_id {query.simpleString()}, chunk_id {chunk.simpleString()}, score double")


def search(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score: the k vectors with the largest inner product, ties by chunk_id.

    A block of the questions, a stated set, meets every block of vectors in one matrix product, which
    keeps k a question: what is shuffled is k rows a question and block, not all pairs. Nothing passes through the driver.
    Scores are rounded to 6 places. A vector without values scores nothing.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = _packed(questions.select("query_id", "embedding").where(F.size("embedding") > 0), "q")
    rows = _packed(vectors.select("chunk_id", "embedding").where(F.size("embedding") > 0), "v")
    return top_k(_best(asked.crossJoin(rows), k, vectors, questions), k)


#: Vectors that centres are fitted on, rounds of fitting, clusters of a question that are looked at first, and what rounding may hide.
SAMPLE, ROUNDS, FIRST, SLACK = 20_000, 8, 4, 1e-6
#: Bytes of questions with their clusters that are broadcast.
BROADCAST = 64 << 20


@dataclass(frozen=True)
class ClusteredVectors:
    """vectors (chunk_id, embedding, cluster), each cluster's in files of their own size; centres, one row a cluster; radius, the largest
    distance of a cluster's vectors from its centre, -1 where it has none."""

    vectors: DataFrame
    centres: np.ndarray
    radius: np.ndarray


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1)
    own = square.argmin(axis=1)
    return own, np.linalg.norm(rows - centres[own], axis=1)


def cluster(vectors: DataFrame, clusters: int = 64, sample: int = SAMPLE) -> ClusteredVectors:
    """Vectors by the nearest of `clusters` centres. The centres are fitted to at most `sample` vectors, those of the least hashed ids; every
    vector is assigned, and the radii cover all of them. Vectors without values are left out."""
    rows = vectors.select("chunk_id", "embedding").where(F.size("embedding") > 0)
    some = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").collect()  # so many at most
    points = np.array([r[0] for r in some], np.float64) if some else np.zeros((0, 0))
    centres = points[:: max(1, len(points) // clusters)][:clusters].copy()
    for _ in range(ROUNDS):
        if not len(points):
            break
        own, _ = _nearest(points, centres)
        for c in np.unique(own):
            centres[c] = points[own == c].mean(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = np.zeros(0, np.int64), np.zeros(0)
            if batch.num_rows:
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                own, far = _nearest(flat.reshape(batch.num_rows, -1), centres)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(far)], names=["chunk_id", "embedding", "cluster", "far"])

    kind = vectors.schema["chunk_id"].dataType.simpleString()
    placed = materialise(rows.mapInArrow(run, f"chunk_id {kind}, embedding {vectors.schema['embedding'].dataType.simpleString()}, cluster int, far double").hint("rebalance", "cluster").sortWithinPartitions("cluster", "chunk_id"), "clustered")
    radius = np.full(len(centres), -1.0)
    for c, far in placed.groupBy("cluster").agg(F.max("far")).collect():  # one row a cluster
        radius[c] = far
    return ClusteredVectors(placed.drop("far"), centres, radius)


def _grouped(rows: DataFrame, name: str) -> DataFrame:
    """As _packed, of rows sorted by cluster: blocks of at most BLOCK vectors of one cluster, with it."""
    kind = to_arrow_type(rows.schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            edges = np.flatnonzero(np.diff(own, prepend=-1, append=-1))
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for at in range(begin, end, BLOCK):
                    part = batch.slice(at, min(BLOCK, end - at))
                    flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array([own[begin]], pa.int32()), pa.array([part.column(0).to_pylist()], pa.list_(kind)), pa.array([flat], pa.list_(pa.float32()))], names=["cluster", f"{name}_ids", f"{name}_flat"])

    return rows.mapInArrow(run, f"cluster int, {name}_ids array<{rows.schema[0].dataType.simpleString()}>, {name}_flat array<float>")


def bounds(index: ClusteredVectors, questions: DataFrame) -> DataFrame:
    """query_id, cluster, bound: no vector of the cluster has a larger inner product with the question."""
    filled = np.flatnonzero(index.radius >= 0)
    centres, radius = index.centres[filled], index.radius[filled]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                q = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                bound = q @ centres.T + np.linalg.norm(q, axis=1)[:, None] * radius
                at = pa.array(np.repeat(np.arange(part.num_rows), len(filled)))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array(np.tile(filled, part.num_rows).astype(np.int32)), pa.array(bound.ravel())], names=["query_id", "cluster", "bound"])

    asked = questions.select("query_id", "embedding").where(F.size("embedding") > 0)
    return asked.mapInArrow(run, f"query_id {questions.schema['query_id'].dataType.simpleString()}, cluster int, bound double")


def search_clustered(index: ClusteredVectors, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What `search` gives, and the pairs of question and cluster that were looked at (query_id, cluster).

    A question first meets the FIRST clusters of the largest bounds. Its k-th best score there is what others must reach: of the
    rest it meets only the clusters whose bound does, so no vector among the k best is missed.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if not len(index.centres):
        nothing = search(index.vectors, questions, k)
        return nothing, nothing.select("query_id", F.lit(0).alias("cluster"))
    known = materialise(bounds(index, questions), "cluster-bounds")
    rows = _grouped(index.vectors.select("chunk_id", "embedding", "cluster"), "v")
    asked = questions.select("query_id", "embedding")

    def met(pairs: DataFrame) -> DataFrame:
        wanted = asked.join(pairs, "query_id").select("query_id", "embedding", "cluster").repartition("cluster").sortWithinPartitions("cluster")
        groups = _grouped(wanted, "q")
        small = pairs.count() * index.centres.shape[1] * 4 <= BROADCAST
        return _best(rows.join(F.broadcast(groups) if small else groups, "cluster"), k, index.vectors, questions)

    first = materialise(top_k(known, FIRST, "bound", item="cluster").select("query_id", "cluster"), "first-clusters")
    found = materialise(top_k(met(first), k).drop("rank"), "first-best")
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    open_ = known.join(first, ["query_id", "cluster"], "left_anti").join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
    second = materialise(open_.select("query_id", "cluster"), "second-clusters")
    return top_k(found.unionByName(met(second)), k), first.unionByName(second)


def encode(texts: DataFrame, encoder, text: str = "content", dimension: int = 64) -> DataFrame:
    """texts with embedding, from encoder(list of texts) -> array of shape (n, dimension), scaled to unit length.

    The encoder is pluggable, as no model is at hand: it is called with one Arrow batch at a time.
    """
    names, at = texts.columns, texts.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.asarray(encoder([t or "" for t in batch.column(at).to_pylist()]), np.float64).reshape(-1, dimension)
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, norm, out=out.copy(), where=norm > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float32()))], names=[*names, "embedding"])

    return texts.mapInArrow(run, schema)


def hashing_encoder(dimension: int = 64):
    """A deterministic stand-in for a sentence model: signed counts of hashed words. Not equivalent to one."""
    import re
    import zlib

    def encode_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"[a-z0-9_]+", text.lower()):
                h = zlib.crc32(word.encode())
                out[i, h % dimension] += 1 if h >> 31 else -1
        return out

    return encode_texts
