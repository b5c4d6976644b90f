"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has a bit for each of 64, set where more than half of the text's shingles have it set in their hash.
Two fingerprints at `radius` differing bits or fewer have a common one half way: each sends all variants within half the
radius, itself and those with one bit turned for a radius of 2, and those that send the same variant meet there. Different
fingerprints around a variant are 65 at most, and any two of them are within the radius, so a variant's fingerprints are
linked to the least of them, which keeps every component. Copies of a fingerprint are one all along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, keyed_text, lookup, read
from sparkloom.llm.graph import components
from sparkloom.session import materialise

BITS = 64
WORDS = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer; an even number, as the ball of a variant has half of it.
RADIUS = 2
#: Shingles whose bits are counted at a time.
PIECE = 1 << 14

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str, width: int = WORDS) -> int:
    """The fingerprint of a text's shingles of `width` words, repeats included.

    A-Z are lower-cased and the words of a shingle joined by one space. A text of fewer words has one shingle, of all its
    words; without a word it has fingerprint 0.
    """
    words = text.encode().lower().split()  # white space and capitals of bytes are those of ASCII
    if not words:
        return 0
    runs = zip(*(islice(words, i, None) for i in range(min(width, len(words)))))
    hashes = map(_hash, map(b" ".join, runs))
    left = max(1, len(words) - width + 1)
    half, counts = left / 2, np.zeros(BITS, np.int64)
    while left:
        piece = np.fromiter(islice(hashes, PIECE), ">u8", min(PIECE, left))
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= len(piece)
    return int.from_bytes(np.packbits(counts > half).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id and fingerprint, as a signed 64-bit number. Null texts count as empty."""

    def make(cols: dict) -> dict:
        return {"doc_id": cols["doc_id"], "fingerprint": pa.array([_signed(fingerprint(t, width)) for t in cols["text"]], pa.int64())}

    return by_batch(keyed_text(docs), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long", rows=1000)


def masks(turned: int) -> list[int]:
    """What turns up to `turned` of the bits, as signed numbers: 65 for one bit."""
    return [_signed(sum(1 << b for b in bits)) for n in range(turned + 1) for bits in combinations(range(BITS), n)]


def _linked(within: int):
    """Rows come sorted by variant and fingerprint; of each variant's fingerprints all but the least are linked to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant, head = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v, f = (batch.column(c).to_numpy() for c in ("variant", "fingerprint"))
            new = np.concatenate([[variant is None or int(v[0]) != variant], v[1:] != v[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            heads = np.where(start < 0, head, f[start])
            variant, head = int(v[-1]), int(heads[-1])
            apart = np.bitwise_count((heads ^ f).view(np.uint64))
            met = (apart > 0) & (apart <= within)
            yield pa.RecordBatch.from_arrays([pa.array(heads[met]), pa.array(f[met])], names=["a", "b"])

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a < b: links between the distinct fingerprints of `prints`, enough that those within `radius` bits are connected."""
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = prints.withColumn("mask", F.explode(F.array(*map(F.lit, masks(radius // 2))))).select(F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("variant"), "fingerprint")
    met = variants.repartition("variant").sortWithinPartitions("variant", "fingerprint")
    return met.mapInArrow(_linked(radius), "a long, b long").distinct()


def near(docs: DataFrame, radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits) and component_id.

    component_id is the least doc_id that is reached over links of `radius` or fewer differing bits, the own included; null ones
    are reached last, so it is null where nothing else is. Null and empty texts, and those without a word, have
    fingerprint zero, which links like any other. Very long texts are taken whole, their shingles a piece at a time. Repeated rows give
    a row each; rows of one doc_id with different texts have their own fingerprints. doc_id may have any type that has an order.
    An empty table gives an empty one; other columns are not read.
    """
    rows = materialise(fingerprints(docs, width), "prints")
    # a task sends each fingerprint once
    known = materialise(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows")), "known")
    found = materialise(links(known.select("fingerprint"), radius), "links")
    labels = components(found).toDF("fingerprint", "label")
    linked = materialise(known.join(labels, "fingerprint"), "linked")
    least = linked.groupBy("label").agg(F.min("own").alias("least"))
    placed = linked.join(least, "label").select("fingerprint", "least")
    table = materialise(known.join(placed, "fingerprint", "left").select("fingerprint", "rows", F.coalesce("least", "own").alias("component_id")), "placed")
    total = table.agg(F.sum("rows")).first()[0] or 0
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return lookup(rows, table, ["fingerprint"], "rows", total).select("doc_id", shown, "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(read(spark, sf_dir, "documents"))
