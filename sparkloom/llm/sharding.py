"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots, thousands of them. Bytes are summed by slot,
and a small versioned map says which shard each slot lives in. To rebalance, the map is edited, slot by slot;
records never hash anew. The law held is `bytes`: shard sizes are near equal.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import read
from sparkloom.session import materialise, table_path

SLOTS = 4096
#: Bytes that a record takes beside its text.
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot lives in."""

    version: int
    shards: int
    slots: tuple[int, ...]

    @staticmethod
    def balanced(sizes: list[int], shards: int, version: int = 1) -> SlotMap:
        """Slots dealt from the largest on, each to the shard that has least so far."""
        heap = [(0, s) for s in range(shards)]
        out = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            held, shard = heapq.heappop(heap)
            out[slot] = shard
            heapq.heappush(heap, (held + sizes[slot], shard))
        return SlotMap(version, shards, tuple(out))

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.slots):
            out[shard] += sizes[slot]
        return out

    def edited(self, sizes: list[int], shards: int | None = None, slack: float = 0.01) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest, the largest that narrows their
        gap first, until all lie within `slack` of the mean or no move helps. Slots of shards beyond `shards` move out first."""
        shards = shards or self.shards
        slots = list(self.slots)
        load = [0] * max(shards, self.shards)
        held: list[set[int]] = [set() for _ in load]
        for slot, shard in enumerate(slots):
            load[shard] += sizes[slot]
            held[shard].add(slot)

        def move(slot: int, to: int) -> None:
            at = slots[slot]
            held[at].remove(slot)
            held[to].add(slot)
            load[at] -= sizes[slot]
            load[to] += sizes[slot]
            slots[slot] = to

        for shard in range(shards, len(load)):
            for slot in sorted(held[shard], key=lambda i: (-sizes[i], i)):
                move(slot, min(range(shards), key=lambda s: (load[s], s)))
        mean = sum(sizes) / shards
        while True:
            full, bare = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
            if load[full] <= mean * (1 + slack) and load[bare] >= mean * (1 - slack):
                break
            fit = [i for i in held[full] if 0 < sizes[i] < load[full] - load[bare]]
            wanted = min(load[full] - mean, mean - load[bare])
            if not fit:
                break
            move(min(fit, key=lambda i: (sizes[i] > wanted, abs(sizes[i] - wanted), i)), bare)
        return SlotMap(self.version + 1, shards, tuple(slots))


def with_slots(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row; a null text has no bytes and the CRC of none.

    The slot hashes doc_id and the text's CRC, so that many rows with a null doc_id don't share one. It is taken from their
    MD5, which any engine can repeat.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    hashed = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")))
    return rows.withColumn("virtual_slot", F.pmod(F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int"))


def spread(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """rows of with_slots, those of a doc_id and text that alone are more than a slot's share dealt to all slots, row by row.

    There are `slots` such groups at most, so they are broadcast; their rows are all alike, so which goes where makes no difference.
    """
    same = ["doc_id", "text_crc32", "size"]
    share = (rows.agg(F.sum("size")).first()[0] or 0) / slots
    groups = rows.groupBy(*same).agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") * F.col("size") > share)).drop("n")
    hot = materialise(groups.toDF(*(f"hot_{c}" for c in same)), "hot-groups")
    if hot.isEmpty():
        return rows
    met = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"hot_{c}")) for c in same))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    placed = rows.join(F.broadcast(hot), met, "left").withColumn("virtual_slot", F.when(F.col("hot_size").isNotNull(), dealt).otherwise(F.col("virtual_slot")))
    return materialise(placed.select(*rows.columns), "slotted")  # each row's slot is drawn once


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: one pair of numbers a slot comes to the driver, whatever the input."""
    sizes, counts = [0] * slots, [0] * slots
    for slot, size, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        sizes[slot], counts[slot] = size, n
    return sizes, counts


def store_map(spark: SparkSession, path: str, slot_map: SlotMap, counts: list[int]) -> None:
    """Add a version to the map kept at path. first is where the slot's records begin in its shard."""
    begin, rows = [0] * slot_map.shards, []
    for slot, shard in enumerate(slot_map.slots):
        rows.append((slot_map.version, slot, shard, begin[shard], slot_map.shards))
        begin[shard] += counts[slot]
    table = spark.createDataFrame(rows, "version int, virtual_slot int, shard int, first long, shards int").coalesce(1)
    table.write.mode("errorifexists").parquet(_version_path(path, slot_map.version))


def _version_path(path: str, version: int) -> str:
    return f"{path}/version={version}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the map kept at path, ascending; none where there is no map."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The map of a version, the latest if none is given: a row a virtual slot."""
    version = version or versions(spark, path)[-1]
    return spark.read.parquet(_version_path(path, version)).withColumn("version", F.lit(version))


def load_map(spark: SparkSession, path: str) -> SlotMap | None:
    """The latest map kept at path, None where there is none."""
    kept = versions(spark, path)
    if not kept:
        return None
    rows = sorted(read_map(spark, path, kept[-1]).select("virtual_slot", "shard", "shards").collect())  # a row a virtual slot
    return SlotMap(kept[-1], rows[0]["shards"], tuple(r["shard"] for r in rows))


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None, slack: float = 0.01) -> DataFrame:
    """Each row of docs with its shard and its gapless place there (slot), by the law `bytes`.

    Where path holds a map, that is edited, so that only the slots move that bring the shards within `slack` of the mean (or
    off shards beyond `shards`), and stored as its next version; else version 1 is dealt anew and stored. The rows are
    joined to that one version.

    grown_shard is null, as this law has none. Rows of one doc_id and text share a virtual slot, unless they are more than its share;
    equal texts of different doc_ids are rows like others; ties of doc_id go by CRC, then size. doc_id may have any type. Null and empty texts have
    no bytes. An empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    rows = spread(with_slots(docs, slots), slots)
    sizes, counts = slot_sizes(rows, slots)
    path = path or table_path(spark, "slot-map")
    before = load_map(spark, path)
    if before is not None and len(before.slots) != slots:
        raise ValueError(f"the map at {path} has {len(before.slots)} virtual slots, not {slots}")
    now = before.edited(sizes, shards, slack) if before else SlotMap.balanced(sizes, shards)
    store_map(spark, path, now, counts)
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("n", F.row_number().over(inside) - 1)
    known = F.broadcast(read_map(spark, path, now.version))  # one row a virtual slot
    return placed.join(known, "virtual_slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"))
