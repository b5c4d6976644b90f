"""A sentence encoder trained on the corpus: the leading directions of its weighted term matrix.

Words are hashed to FEATURES columns; a text's row has ln(1 + count) times the column's inverse document frequency, at unit
length. The rows' leading right singular vectors come from a randomised range finder (Halko, Martinsson and Tropp, 2011): passes
multiply the matrix and its transpose into a random block, a last one gives the small matrix of the products in that range, whose
eigenvectors the driver finds. All texts are learnt from: they are cut into words once, and the passes read their counts, packed as
bytes. A task holds the rows of BLOCK texts at a time and sends sums of fixed size, no texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise

FEATURES = 1 << 14
#: Columns of the random block beyond the dimension.
MORE = 8
#: Times that the matrix and its transpose are multiplied into the block.
PASSES = 2
#: Texts whose rows are multiplied at a time.
BLOCK = 128

_WORD = re.compile(r"[a-z0-9_]+")


@lru_cache(1 << 16)
def _feature(word: str) -> int:
    return zlib.crc32(word.encode()) % FEATURES


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's features in order, and how many of its words each has."""
    words = Counter(_WORD.findall(text.lower()))
    found = np.bincount(np.fromiter(map(_feature, words), np.int64, len(words)), np.fromiter(words.values(), np.float64, len(words)), FEATURES)
    feature = np.flatnonzero(found)
    return feature, found[feature]


def _weighted(counts: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse rows at unit length of texts with these features and counts: row, feature and value of each entry."""
    row = np.repeat(np.arange(len(counts)), [len(f) for f, _ in counts])
    feature, count = (np.concatenate([c[i] for c in counts] or [np.zeros(0)]) for i in (0, 1))
    feature = feature.astype(np.int64)
    value = np.log1p(count) * idf[feature]
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(counts)))
    return row, feature, np.divide(value, norm[row], out=np.zeros_like(value), where=norm[row] > 0)


def _rows(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' sparse rows at unit length: row, feature and value of each entry."""
    return _weighted([_counts(t) for t in texts], idf)


def _matrix(entries: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The n rows with all their columns: of BLOCK texts 16 MB, whatever their length."""
    row, feature, value = entries
    out = np.zeros((n, FEATURES))
    out[row, feature] = value
    return out


@dataclass(frozen=True)
class TrainedEncoder:
    """encoder(texts) -> an array of a row a text; a text without a known word is all zero."""

    idf: np.ndarray
    directions: np.ndarray  # (FEATURES, dimension)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.directions.shape[1]))
        for at in range(0, len(texts), BLOCK):
            some = texts[at : at + BLOCK]
            out[at : at + BLOCK] = _matrix(_rows(some, self.idf), len(some)) @ self.directions
        return out


def _packed(texts: DataFrame) -> DataFrame:
    """features, counts: a row a text, as bytes of its features in order and of their counts. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = [_counts(t or "") for t in batch.column(0).slice(at, BLOCK).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([c[i].astype(t).tobytes() for c in some], pa.binary()) for i, t in ((0, np.uint16), (1, np.uint32))], names=["features", "counts"])

    return texts.mapInArrow(run, "features binary, counts binary")


def _sums(packed: DataFrame, make, width: int) -> np.ndarray:
    """make(counts of BLOCK texts at most) gives an array of shape (FEATURES at most, width); the sum over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, width))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = [(np.frombuffer(f, np.uint16), np.frombuffer(c, np.uint32)) for f, c in zip(*(batch.column(i).slice(at, BLOCK).to_pylist() for i in (0, 1)))]
                part = make(some)
                total[: len(part)] += part
        keep = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(keep), *(pa.array(total[keep, k]) for k in range(width))], names=["number", *(f"c{k}" for k in range(width))])

    columns = [f"c{k}" for k in range(width)]
    met = packed.mapInArrow(run, "number long, " + ", ".join(f"{c} double" for c in columns)).groupBy("number").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    out = np.zeros((FEATURES, width))
    if met.num_rows:
        out[met.column("number").to_numpy()] = np.stack([met.column(c).to_numpy() for c in columns], axis=1)
    return out


def _sample(chunks: DataFrame, text: str, id_column: str, sample: int) -> DataFrame:
    """The texts of the least hashed ids, `sample` and those that share the last one's hash. Only hashes are sorted, and the texts are
    picked where they are."""
    h = F.xxhash64(id_column)
    last = chunks.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return chunks.where(h <= F.lit(last)).select(F.col(text).alias("text"))


def train(chunks: DataFrame, dimension: int = 64, text: str = "content", id_column: str = "chunk_id", sample: int | None = None, seed: int = 7) -> TrainedEncoder:
    """The encoder of a corpus, learnt from all its chunks, or with a sample from those of the least hashed ids. Null texts count as empty;
    of no texts all directions are zero."""
    some = chunks.select(F.col(text).alias("text")) if sample is None else _sample(chunks, text, id_column, sample)
    packed = materialise(_packed(some), "encoder-counts")

    def frequency(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.bincount(np.concatenate([f for f, _ in counts]), minlength=FEATURES)[:, None]

    df = _sums(packed, frequency, 1)[:, 0]
    n = packed.count()
    idf = np.log((n + 1) / (df + 1)) + 1
    width = dimension + MORE
    basis = np.random.default_rng(seed).normal(size=(FEATURES, width))
    for _ in range(PASSES):

        def power(counts: list[tuple[np.ndarray, np.ndarray]], block: np.ndarray = basis) -> np.ndarray:
            rows = _matrix(_weighted(counts, idf), len(counts))
            return rows.T @ (rows @ block)

        basis, _ = np.linalg.qr(_sums(packed, power, width))

    def gram(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        inside = _matrix(_weighted(counts, idf), len(counts)) @ basis
        return inside.T @ inside

    values, vectors = np.linalg.eigh(_sums(packed, gram, width)[:width])
    top = np.argsort(-values, kind="stable")[:dimension]
    directions = basis @ vectors[:, top]
    directions *= np.where(values[top] > 1e-12, 1.0, 0.0)
    return TrainedEncoder(idf, directions)
