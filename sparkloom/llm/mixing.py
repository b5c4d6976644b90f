"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a random but fixed order, are cut into blocks of equal bytes. With a weight of
w slots in every period of D, its block k (from 0) is released at slot floor(k D / w) and due by ceil((k + 1) D / w).
Earliest-deadline-first over the released blocks meets every deadline, as the weights fill the
period, so at any slot each source has had its share of the slots to within less than one block.

The schedule repeats with the period, so one period is laid out, in one SQL expression over D slots, and
joined to the blocks. When a source runs out its slots stay empty and the others keep their proportions: no
document is dropped or repeated. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import read

BLOCK = 64 * 1024
#: Slots of a period at least; a target is met to within half a slot of it.
PERIOD = 1000
#: Weights go with the power ALPHA of a source's bytes where no target is given.
ALPHA = 0.5
#: A mix names its sources; more than this is refused, not cut.
SOURCES = 2000
#: Rows of a source that are numbered in one part, or so; a source has a power of two of parts.
ROWS_A_PART = 2_000


def apportioned(weights: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots by source, one at least, that sum to the period; largest remainders first, ties by name."""
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in sorted(weights.items())}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def period_schedule(spark: SparkSession, slots: Mapping[str, int]) -> DataFrame:
    """source, turn (its block within the period) and slot: earliest-deadline-first over one period."""
    names, period = list(slots), sum(slots.values())
    w = F.array(*(F.lit(slots[s]) for s in names))
    d = F.lit(period)

    def step(state, t):
        def window(weight, i):
            k = state["done"][i]
            return F.struct(
                F.floor(((k + 1) * d + weight - 1) / weight).alias("deadline"),
                i.alias("i"),
                F.floor(k * d / weight).alias("release"),
                k.alias("k"),
            )

        ready = F.filter(F.transform(w, window), lambda x: x["release"] <= t)
        picked = F.array(F.array_min(ready))
        return F.transform(
            picked,
            lambda p: F.struct(
                F.transform(state["done"], lambda k, i: k + F.when(i == p["i"], 1).otherwise(0)).alias("done"),
                F.concat(state["out"], F.array(F.struct(p["i"].alias("i"), p["k"].alias("turn"), t.alias("slot")))).alias("out"),
            ),
        )[0]

    start = F.struct(F.array_repeat(F.lit(0), len(names)).alias("done"), F.lit(None).cast("array<struct<i:int,turn:int,slot:int>>").alias("none"))
    start = F.struct(start["done"].alias("done"), F.coalesce(start["none"], F.array().cast("array<struct<i:int,turn:int,slot:int>>")).alias("out"))
    laid = spark.range(1).select(F.explode(F.aggregate(F.sequence(F.lit(0), d - 1), start, step, lambda s: s["out"])).alias("x"))
    return laid.select(F.array(*map(F.lit, names))[F.col("x.i")].alias("mix_source"), F.col("x.turn").alias("turn"), F.col("x.slot").alias("slot_in_period"))


def target_slots(sizes: Mapping[str, int], targets: Mapping[str, float] | None = None, alpha: float = ALPHA) -> dict[str, int]:
    """Slots of a period by source. Sources that the targets don't name share the least weight named."""
    if len(sizes) > SOURCES:
        raise ValueError(f"{len(sizes)} sources; a mix has {SOURCES} at most")
    least = min((w for w in (targets or {}).values() if w > 0), default=1.0)
    return apportioned({s: (targets.get(s) or least) if targets else max(1, n) ** alpha for s, n in sizes.items()})


#: Bits of a draw.
DRAW_BITS = 60


def drawn(doc_id: Column, size: Column, seed: int) -> Column:
    """A number from the MD5 of the id, the seed and the bytes, so that any engine can repeat the order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(str(seed)), size.cast("string"))), 1, DRAW_BITS // 4), 16, 10).cast("long")


_NEW = ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place"]


def schedule(docs: DataFrame, targets: Mapping[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """docs with mix_source, mix_block, mix_release, mix_deadline, mix_slot and mix_place, every row once.

    In the order of mix_slot, then mix_place (the bytes of its source before it), sources follow their target
    weights. A document lies in the block in which it begins. A null source is the source ''; a null text has no bytes.
    Repeated rows are rows like others; ties in the order go by doc_id, then bytes. Columns of docs named like
    the new ones are replaced, all others keep their values whatever their names. An empty table gives an empty one.
    """
    docs = docs.drop(*_NEW)
    placed, own = _placed(docs, targets, alpha, block, seed)
    return placed.select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own)), *_NEW)


def _placed(docs: DataFrame, targets: Mapping[str, float] | None, alpha: float, block: int, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed to those given back, and the new ones."""
    spark = docs.sparkSession
    # docs' columns go by number meanwhile, so that no name of theirs can meet one of ours
    own = [f"own{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    id_column, text, source = (F.col(at[c]) for c in ("doc_id", "text", "source"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.toDF(*own).withColumns({"mix_source": F.coalesce(source, F.lit("")), "bytes": size, "draw": drawn(id_column, size, seed)})
    sizes = {s: (n, c) for s, n, c in rows.groupBy("mix_source").agg(F.sum("bytes"), F.count("*")).limit(SOURCES + 1).collect()}
    if not sizes:
        return docs.toDF(*own).withColumns({n: F.lit("") if n == "mix_source" else F.lit(0).cast("long") for n in _NEW}), own
    slots = target_slots({s: n for s, (n, _) in sizes.items()}, targets, alpha)
    period = sum(slots.values())

    def of_source(values: Mapping[str, int]) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("mix_source"))

    rows = rows.withColumn("shift", of_source({s: DRAW_BITS - max(1, (c // ROWS_A_PART).bit_length()) for s, (_, c) in sizes.items()}))
    rows = rows.withColumn("part", F.expr("shiftright(draw, shift)")).drop("shift")
    parts = rows.groupBy("mix_source", "part").agg(F.sum("bytes").alias("sum"))
    before = Window.partitionBy("mix_source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for ROWS_A_PART rows of docs
    starts = parts.select("mix_source", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("mix_source", "part").orderBy("draw", at["doc_id"], "bytes").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("before", F.coalesce(F.sum("bytes").over(inside), F.lit(0)))
    # both sides are dealt by source and part already
    numbered = numbered.join(starts, ["mix_source", "part"]).withColumn("mix_place", F.col("start") + F.col("before"))
    numbered = numbered.withColumn("mix_block", F.floor(F.col("mix_place") / block)).withColumn("weight", of_source(slots))
    numbered = numbered.withColumn("turn", F.pmod("mix_block", "weight").cast("int"))
    # a period has max(PERIOD, 4 * SOURCES) slots at most
    placed = numbered.join(F.broadcast(period_schedule(spark, slots)), ["mix_source", "turn"])
    k, w, d = F.col("mix_block"), F.col("weight"), F.lit(period)
    placed = placed.withColumns({
        "mix_slot": (F.floor(k / w) * d + F.col("slot_in_period")).cast("long"),
        "mix_release": F.floor(k * d / w),
        "mix_deadline": F.ceil((k + 1) * d / w),
    })
    return placed.select(*own, *_NEW), own


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, alpha: float = ALPHA, block: int = BLOCK) -> DataFrame:
    """The rows of docs in the scheduled order, all kept, with docs' own columns.

    Partitions are consecutive stretches of the schedule and sorted within, so files written from this
    hold the mix in order.
    """
    placed, own = _placed(docs, targets, alpha, block)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place", *own[:1])
    return ordered.select(*(F.col(o).alias(c) for c, o in zip(docs.columns, own)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read(spark, sf_dir, "documents")).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
