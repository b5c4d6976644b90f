"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, lower-cased, each weighted by its bytes times its count. For
each of SAMPLES samples every term draws r and c from Gamma(2, 1) and b from [0, 1), from its own hash, and
with its weight w gives

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1);

the term with the least a is sampled. Two texts sample the same (term, t) with a
probability equal to their generalised Jaccard similarity, sum of min weights over
sum of max weights. As a depends on the weight through t alone, equal samples have
equal a and others almost never do: the 32 bits of the least ln a stand for the sample.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, hashed_words, keyed_text, mix64, read

SAMPLES = 64
_LOW = -(1 << 63)


def _keys(samples: int, lane: int) -> np.ndarray:
    return mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(lane) + np.uint64(0xC0FFEE00))


def _log_a(terms: np.ndarray, log_weight: np.ndarray, samples: int) -> np.ndarray:
    """ln a of each term (rows) in each sample (columns)."""
    x = mix64(terms[:, None] ^ _keys(samples, 0))
    half = np.float32(0.5)
    u = ((x >> np.uint64(43)).astype(np.float32) + half) * (((x >> np.uint64(22)) & np.uint64(0x1FFFFF)).astype(np.float32) + half)
    r = -np.log(u * np.float32(2.0**-42))
    b = (x & np.uint64(0x3FFFFF)).astype(np.float32) * np.float32(2.0**-22)
    x = mix64(terms[:, None] ^ _keys(samples, 1))
    u = ((x >> np.uint64(41)).astype(np.float32) + half) * (((x >> np.uint64(18)) & np.uint64(0x7FFFFF)).astype(np.float32) + half)
    log_c = np.log(-np.log(u * np.float32(2.0**-46)))
    t = np.floor(log_weight[:, None] / r + b)
    return log_c - r * (t - b + np.float32(1))


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """One row of 32-bit samples a text; all zero for a text without words.

    The samples of a term with one weight are drawn once for all texts given, then each text takes minima.
    """
    out = np.zeros((len(texts), samples), np.uint32)
    words, lengths, counts = hashed_words([t.lower() for t in texts])
    if not len(words):
        return out
    owner = np.repeat(np.arange(len(texts)), counts)
    terms, first, code = np.unique(words, return_index=True, return_inverse=True)
    held, n = np.unique(owner * len(terms) + code, return_counts=True)
    owner, code = held // len(terms), held % len(terms)
    top = int(n.max()) + 1
    pairs, at = np.unique(code * top + n, return_inverse=True)
    weight = (pairs % top) * lengths[first][pairs // top]
    log_weight = np.log(weight).astype(np.float32)
    table = np.empty((len(pairs), samples), np.float32)
    for i in range(0, len(pairs), 256):
        table[i : i + 256] = _log_a(terms[pairs[i : i + 256] // top], log_weight[i : i + 256], samples)
    full = np.flatnonzero(counts)
    starts = np.searchsorted(owner, full)
    ends = np.append(starts[1:], len(owner))
    i = 0
    while i < len(full):  # as many texts as have 8192 terms, or one
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 8192, side="right")))
        best = np.minimum.reduceat(table[at[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0)
        out[full[i:j]] = best.view(np.uint32)
        i = j
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, by row: an unbiased estimate of the generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Per row of docs: doc_id and fingerprint, 8 hexadecimal digits a sample. Null texts count as empty; a text
    without words has zeros. Repeated rows give a row each."""

    def make(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "fingerprint": [as_text(x) for x in signatures(cols["text"], samples)]}

    return by_batch(keyed_text(docs), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string", rows=500)


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(kind: pa.DataType, samples: int):
    """Rows come by part, each part's own documents first, in descending order, then the one after its last."""

    def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
        """For all but the last of the texts, which only follows."""
        edited = [_edited(a, b) for a, b in zip(texts, texts[1:])]
        found = signatures(texts + edited, samples)
        own, other = found[: len(texts)], found[len(texts) :]
        columns = [
            pa.array(ids, kind),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            [as_text(x) for x in own[:-1]],
            [as_text(x) for x in other],
            likeness(own[:-1], other),
            likeness(own[:-1], own[1:]),
        ]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, over = None, [], [], True
        size = 0
        for batch in batches:
            for p, edge, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "edge", "doc_id", "text"))):
                if p != part:
                    part, ids, texts, over, size = p, [], [], False, 0
                if over:  # a further row of the edge's doc_id
                    continue
                texts.append(text)
                size += len(text)
                if edge:
                    over = True
                else:
                    ids.append(doc)
                if over or len(texts) > 400 or (size > 4_000_000 and len(texts) > 1):
                    n = len(texts) - 1
                    if n:
                        yield rows(ids[:n], texts)
                    ids, texts, size = ids[n:], texts[n:], len(text)

    return run


_WHOLE = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}


def _cut(place: np.ndarray, draw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each (place, draw): ranges end at the bounds, and a place that is several bounds is cut by its draws."""
    low, high = np.searchsorted(bounds, place, side="left"), np.searchsorted(bounds, place, side="right")
    share = np.maximum(high - low, 1)
    unit = (draw.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) * 2.0**-64
    return (low + np.minimum((unit * share).astype(np.int64), share - 1)).astype(np.int32)


def compare_with_next(docs: DataFrame, samples: int = SAMPLES, rows_a_range: int = 400) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document, as columns _NAMES.

    Next is by descending doc_id (null last; rows of one doc_id by descending hash of their texts), after the last the first;
    a single row follows itself. Whole numbers are ordered as such, ids of other types by the bytes of their text form, which
    is also how they come back if they aren't strings. The edited text has its last third replaced by the start of the next. Null
    texts count as empty. Very long texts are taken whole. An empty table gives no row; other columns are not read.

    Texts move once: they are dealt to ranges of doc_id found from the ids alone, and the first document
    of a range goes to its predecessor's range too. An id that many rows share is cut into several ranges.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = kind in _WHOLE
    kind, arrow_kind = (kind, _WHOLE[kind]) if whole else ("string", pa.string())
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    texts = keyed_text(docs).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("place", place).withColumn("draw", F.xxhash64("text"))
    ids = docs.select(place.alias("place"))
    n = ids.count()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not n:
        return spark.createDataFrame([], schema)
    parts = max(1, min(n // rows_a_range, 20_000))
    found = _bounds(ids, parts, whole)
    bounds = np.array(found, np.int64) if whole else np.array([x.encode() for x in found], object)
    shared = len(set(found)) < len(found)

    def numbers(place: pd.Series) -> np.ndarray:
        return place.to_numpy(np.int64) if whole else np.array([x.encode() for x in place], object)

    @F.pandas_udf("int")
    def range_of(place: pd.Series, draw: pd.Series) -> pd.Series:
        return pd.Series(_cut(numbers(place), draw.to_numpy(np.int64), bounds))

    # the draws, which need the texts, are read only where an id is cut
    marks = texts.select("place", "draw" if shared else F.lit(0).cast("long").alias("draw"))
    # one row a range, 20,000 at most
    top = marks.withColumn("part", range_of("place", "draw")).groupBy("part").agg(F.max(F.struct("place", *(["draw"] if shared else []))).alias("top"))
    highest = dict(sorted((r["part"], tuple(r["top"])) for r in top.collect()))
    filled = list(highest)
    above = {highest[p]: filled[(i + 1) % len(filled)] for i, p in enumerate(filled)}

    @F.pandas_udf("array<int>")
    def also_in(place: pd.Series, draw: pd.Series) -> pd.Series:
        keys = zip(place.tolist(), draw.tolist()) if shared else ((x,) for x in place.tolist())
        return pd.Series([[above[x]] if x in above else [] for x in keys])

    dealt = texts.withColumn("own", range_of("place", "draw")).withColumn("more", also_in("place", "draw"))
    targets = F.concat(F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("edge"))), F.transform("more", lambda p: F.struct(p.alias("part"), F.lit(True).alias("edge"))))
    dealt = dealt.select("doc_id", "place", "draw", "text", F.explode(targets).alias("to")).select("to.part", "to.edge", "doc_id", "place", "draw", "text")
    shuffled = dealt.repartition("part").sortWithinPartitions("part", "edge", F.desc("place"), F.desc_nulls_last("doc_id"), F.desc("draw"), "text")
    return shuffled.select("part", "edge", "doc_id", "text").mapInArrow(_compared(arrow_kind, samples), schema)


def _bounds(ids: DataFrame, parts: int, whole: bool) -> list:
    """parts - 1 places that cut the ids into ranges of about equal size, ascending; a frequent one comes several times."""
    if parts == 1:
        return []
    if whole:
        shares = [i / parts for i in range(1, parts)]
        return list(ids.agg(F.percentile_approx("place", shares, 10 * parts)).first()[0])
    # strings have no percentiles: places with their rows, in ranges, of each range its bounds
    counted = ids.groupBy("place").count()
    ranged = counted.repartitionByRange(parts, "place").withColumn("part", F.spark_partition_id())
    found = sorted(tuple(r) for r in ranged.groupBy("part").agg(F.max("place").alias("place"), F.sum("count").alias("n"), F.max(F.struct("count", "place")).alias("hot")).collect())
    total, out = sum(n for _, _, n, _ in found), []
    for _, last, _, (count, hot) in found[:-1] or found:
        out += [hot] * (count * parts // total)
        out.append(last)
    if found[1:]:
        count, hot = found[-1][3]
        out += [hot] * (count * parts // total)
    return sorted(out, key=str.encode)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
