"""Filter interaction audit: what each filter removes, in every order of the filters, by first-failure lookup.

A document's failures are the bits of a number below 32. A table of 32 by 120, made before, says at which step of each order a
document with these failures is removed, so orders are looked up and never run. Each task adds up its removals by part, label,
order and step with np.bincount, and its arrays are summed.

The filters are: A, under 100 words; B, under 80 distinct words in 100; C, over 10 capitals A-Z in 100 code points; D, holds one of
`#$%&*|`; E, identical to the text of a document with a smaller doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import lookup, read, slices
from sparkloom.session import materialise

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: By failures (bit 0 is A) and order the step at which a document is removed; STEPS if never.
FIRST = np.array([[next((s for s, f in enumerate(o) if mask >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for mask in range(1 << STEPS)], np.uint8)
#: Bit 0 of a label class is a good document, bit 1 a toxic one.
CLASSES = 4
WIDTH = CLASSES * len(ORDERS) * (STEPS + 1)
#: Parts whose arrays (of WIDTH numbers) a task holds at a time.
HELD = 256
CAPITALS, SIGNS = bytes(range(65, 91)), b"#$%&*|"


def failures(raw: bytes, n_chars: int) -> int:
    """The bits of A to D for a text in UTF-8 of so many code points."""
    words = raw.split()  # the white space of bytes is 0x20 and 0x09 to 0x0D
    few = len(words) < 100
    dull = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > 10 * n_chars
    marked = len(raw.translate(None, SIGNS)) < len(raw)
    return few | dull << 1 | loud << 2 | marked << 3


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch):
            text = rows.column("text")
            raw = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
            bits = [failures(r.as_py(), n) for r, n in zip(raw, pc.utf8_length(text).to_pylist())]
            names = [n for n in rows.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(bits, pa.int32())], names=[*names, "bits"])


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, two hashes of the text, and bits, its failures of A to D."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    return rows.mapInArrow(_measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, h1 long, h2 long, bits int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of this task by part: removals by label class, order and step, and those never removed as a last step."""
    held: dict[str, np.ndarray] = {}
    lanes = np.arange(len(ORDERS)) * (STEPS + 1)
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        code, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        mask, label = batch.column("mask").to_numpy(), batch.column("label").to_numpy()
        for i in range(0, len(code), 4096):
            cut = slice(i, i + 4096)
            used, own = np.unique(code[cut], return_inverse=True)
            at = (own * CLASSES + label[cut])[:, None] * (len(ORDERS) * (STEPS + 1)) + lanes + FIRST[mask[cut]]
            sums = np.bincount(at.ravel(), minlength=len(used) * WIDTH).reshape(len(used), WIDTH)
            for k, x in zip(used.tolist(), sums):
                if names[k] not in held and len(held) >= HELD:
                    yield _sums(held)
                    held = {}
                held[names[k]] = held.get(names[k], 0) + x
    yield _sums(held)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column("part").to_pylist(), batch.column("sums")):
            if part not in held and len(held) >= HELD:
                yield _sums(held)
                held = {}
            held[part] = held.get(part, 0) + x.values.to_numpy()
    yield _sums(held)


def _sums(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["part", "sums"])


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: part, mask (the failures of all filters as bits) and label (bit 0 good, bit 1 toxic).

    A null doc_id is neither smaller than another nor has a smaller one, and has no label. A document is good, or toxic, if any of its
    rows in labels says 1.
    """
    rows = materialise(measured(docs), "measured")
    texts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    texts = materialise(texts, "repeated")
    total = rows.count()
    placed = lookup(rows, texts, ["h1", "h2"], "rows", total)
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int")
    placed = placed.select("doc_id", "part", F.col("bits").bitwiseOR(F.shiftleft(copied, 4)).alias("mask"))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic"))
    marks = marks.select("doc_id", F.col("good").bitwiseOR(F.col("toxic")).alias("label")).where("label > 0")
    # how many rows a doc_id has matters only where ids repeat
    uses = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("doc_id is not null")
    known = materialise(marks.join(uses, "doc_id"), "marks")
    return lookup(placed, known, ["doc_id"], "rows", total).select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part (a lang value, null as the empty string), filter_order (all 120) and step (1 to 5), zeros included: kept (after the step),
    removed (here), redundant (failing the step's filter, removed earlier), unique_fails (failing its filter only), good_lost and
    toxic_lost (removed here, with that label) and shapley (its filter's removals, summed over all orders at any step).

    Null texts count as empty: they fail A, and of several all but those of the least doc_id fail E. Rows of one doc_id and text aren't
    copies of each other. Null doc_ids: see `failing`. Very long texts are taken whole. An empty table gives no row; columns other
    than doc_id, text, lang, quality and toxic are not read.
    """
    partial = failing(docs, labels).mapInArrow(_counted, "part string, sums array<long>").withColumn("piece", F.spark_partition_id())
    # 64 tasks' arrays are added in one, before numbers are summed one by one
    fewer = partial.repartition("part", F.floor(F.col("piece") / 64)).select("part", "sums").mapInArrow(_summed, "part string, sums array<long>")
    cells = fewer.select("part", F.posexplode("sums").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n"))
    step, order, label = F.col("at") % (STEPS + 1), F.floor(F.col("at") / (STEPS + 1)) % len(ORDERS), F.floor(F.col("at") / (len(ORDERS) * (STEPS + 1)))
    cells = cells.select("part", F.array(*map(F.lit, ORDERS))[order.cast("int")].alias("filter_order"), (step + 1).cast("int").alias("step"), "n", label.alias("label"))
    by_step = cells.groupBy("part", "filter_order", "step").agg(
        F.sum("n").alias("removed"),
        F.sum(F.when(F.col("label") % 2 == 1, F.col("n")).otherwise(0)).alias("good_lost"),
        F.sum(F.when(F.col("label") >= 2, F.col("n")).otherwise(0)).alias("toxic_lost"),
    )
    walk = Window.partitionBy("part", "filter_order").orderBy(F.desc("step"))
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = by_step.withColumn("kept", F.sum("removed").over(walk) - F.col("removed")).where(F.col("step") <= STEPS)
    return rows.select(
        "part",
        "filter_order",
        "step",
        "kept",
        "removed",
        # what a filter fails is what it removes as the first; what it alone fails, as the last
        (F.max(F.when(F.col("step") == 1, F.col("removed"))).over(own) - F.col("removed")).alias("redundant"),
        F.max(F.when(F.col("step") == STEPS, F.col("removed"))).over(own).alias("unique_fails"),
        "good_lost",
        "toxic_lost",
        F.sum("removed").over(own).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
