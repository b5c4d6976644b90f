"""Conversation prefix trie by mergeable partial tries.

A node stands for a sequence of turns and is known by its depth and a hash of the sequence, so that a task can make the nodes of
its own rows without any other's. Each task's node table is combined locally; then tables are merged by key in a tree of groups, member
counts summed and the least member kept. End lists are merged apart, as blocks of sorted ids, so that no row grows with a node's members.
Last, leaves and saved tokens are rolled up over the nodes that several conversations share, by doubling distances: a round adds
up what lies as far below a node as all rounds before it reach, so there are as many rounds as the depth has bits.

A sequence's hash is a polynomial in its turns' hashes, of odd base modulo 2^64, twice. It can be taken apart and put together: a long
conversation is cut into pieces in sorted order, and the turns that others begin with are exchanged without going through the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import lookup, read
from sparkloom.session import materialise

#: A conversation begins with up to SHARED - 1 turns of the first of its GROUP.
SHARED, GROUP = 9, 5
#: Tables that are merged into one at a time.
FAN_IN = 64
#: Ids in a block of an end list.
BLOCK = 4096
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
KEY = ["depth", "k1", "k2"]
_FULL = 1 << 64


def _u(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1)."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn get their place in this partition's piece of the conversation (from 1) and, for both
    bases b, the sum of h_i * b^i over the piece so far."""
    part = TaskContext.get().partitionId()
    last, place = None, 0
    sums, scale = [0, 0], [1, 1]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy()
        new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        own = np.where(start < 0, at + 1 + place, at - start + 1)
        columns = []
        for lane, base in enumerate(BASES):
            power = _powers(base, n + 2)
            local = np.where(start < 0, power[at + 1] * np.uint64(scale[lane]), power[np.minimum(own, n + 1)])
            total = np.cumsum(_u(batch.column(f"h{lane + 1}")) * local)
            before = np.where(start <= 0, np.uint64(0), total[np.maximum(start, 1) - 1])
            total = total - before + np.where(start < 0, np.uint64(sums[lane]), np.uint64(0))
            columns.append(total.view(np.int64))
            sums[lane] = int(total[-1])
            scale[lane] = pow(base, int(own[-1]), _FULL)
        last, place = conv[-1], int(own[-1])
        out = [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(own), pa.array(columns[0]), pa.array(columns[1]), batch.column("bytes")]
        yield pa.RecordBatch.from_arrays([*out, batch.column("h1"), batch.column("h2")], names=["conv_id", "part", "place", "p1", "p2", "bytes", "h1", "h2"])


def _hashed(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes")
    )


def ordered(turns: DataFrame, parts: int) -> DataFrame:
    """Every turn with its piece of its conversation, its place there and the piece's hash up to it.

    Texts stay behind unless different turns of a conversation have one number, and then only theirs are sorted. Rows are dealt to
    ranges by a salt too, so that neither a conversation nor equal rows end in one task for their number.
    """
    rows = _hashed(turns)
    ties = materialise(rows.groupBy("conv_id", "turn").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("conv_id", F.col("turn").alias("tied")), "ties")
    narrow = rows.select("conv_id", "turn", "h1", "h2", "bytes", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    if not ties.isEmpty():
        met = (rows.conv_id == ties.conv_id) & rows.turn.eqNullSafe(ties.tied)
        narrow = narrow.join(ties, (narrow.conv_id == ties.conv_id) & narrow.turn.eqNullSafe(ties.tied), "left_anti")
        narrow = narrow.unionByName(rows.join(ties, met, "left_semi").select(*narrow.columns))
    sort = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "h1", "h2"]
    dealt = narrow.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *sort, "salt").sortWithinPartitions(*sort)
    made = dealt.select("conv_id", "h1", "h2", "bytes").mapInArrow(_numbered, "conv_id long, part int, place long, p1 long, p2 long, bytes long, h1 long, h2 long")
    return materialise(made, "turns")


def _rebased(before: dict[int, tuple[int, int, int, int]]):
    """Places and sums of the pieces that go on with a conversation, by part: its conversation, turns and sums before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, place = (batch.column(c).to_numpy().copy() for c in ("conv_id", "part", "place"))
            sums = [_u(batch.column(f"p{lane}")).copy() for lane in (1, 2)]
            for p in np.unique(part).tolist():
                if p in before:
                    owner, turns, *carried = before[p]
                    at = np.flatnonzero((part == p) & (conv == owner))
                    place[at] += turns
                    for lane, base in enumerate(BASES):
                        sums[lane][at] = sums[lane][at] * np.uint64(pow(base, turns, _FULL)) + np.uint64(carried[lane])
            columns = {"place": pa.array(place), "p1": pa.array(sums[0].view(np.int64)), "p2": pa.array(sums[1].view(np.int64))}
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return run


def placed(turns: DataFrame, parts: int) -> DataFrame:
    """`ordered`, with places and hashes in the whole conversation. A partition goes on with one conversation at most, so what is
    carried from piece to piece is a few numbers a partition."""
    rows = ordered(turns, parts)
    ends = rows.groupBy("conv_id", "part").agg(F.max(F.struct("place", "p1", "p2")).alias("end"))
    cut = ends.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    before, seen = {}, {}
    for conv, part, (n, *sums) in sorted(ends.join(cut, "conv_id", "left_semi").select("conv_id", "part", "end").collect(), key=lambda r: (r[0], r[1])):  # two rows a partition at most
        held = seen.get(conv, (0, 0, 0))
        if held[0]:
            before[part] = (conv, *held)
        seen = {conv: (held[0] + n, *((h + pow(b, held[0], _FULL) * (s % _FULL)) % _FULL for h, b, s in zip(held[1:], BASES, sums)))}
    return rows.mapInArrow(_rebased(before), rows.schema) if before else rows


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns after the first `own` are moved behind the `shared` turns of the group's first conversation."""
    for batch in batches:
        read = {n: batch.column(n).to_numpy() for n in ("own", "shared", "place")}
        depth = read["shared"] + read["place"] - read["own"]
        out = [batch.column("conv_id"), batch.column("bytes"), pa.array(depth)]
        for lane, base in enumerate(BASES):
            shift = np.array([pow(base, k, _FULL) for k in range(1 - SHARED, 1)], np.uint64)[read["shared"] - read["own"] + SHARED - 1]
            key, first, behind, h = (_u(batch.column(f"{c}{lane + 1}")) for c in ("p", "o", "s", "h"))
            here = behind + shift * (key - first)
            above = here - h * shift * _power_at(base, read["place"])  # without the last turn
            out += [pa.array(here.view(np.int64)), pa.array(above.view(np.int64))]
        out.append(pa.array(read["place"] == batch.column("n").to_numpy()))
        yield pa.RecordBatch.from_arrays(out, names=["conv_id", "bytes", "depth", "k1", "above1", "k2", "above2", "ends"])


def _power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base^at, by squares."""
    out, square, left = np.ones(len(at), np.uint64), base, at.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        square, left = square * square % _FULL, left >> np.uint64(1)
    return out


def paths(turns: DataFrame, parts: int) -> DataFrame:
    """A row for each turn of each rebuilt conversation, and one for its start: conv_id, depth, k1 and k2 (the hash of the turns so far),
    above1 and above2 (without the last), bytes, and whether the conversation ends there."""
    rows = materialise(placed(turns, parts), "placed")
    # the first turns of each conversation, 8 at most, and its number of turns
    heads = rows.where(F.col("place") < SHARED).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "p1", "p2", "bytes"))).alias("head"))
    pieces = materialise(rows.groupBy("conv_id", "part").agg(F.max("place").alias("n")), "pieces")
    convs = pieces.groupBy("conv_id").agg(F.max("n").alias("n")).join(heads, "conv_id")
    convs = convs.withColumn("own", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = materialise(convs, "conversations")
    bases = convs.select(F.col("conv_id").alias("first"), F.col("head").alias("base"))
    known = convs.join(bases, "first", "left").withColumn("base", F.slice(F.coalesce("base", F.array().cast(bases.schema["base"].dataType)), F.lit(1), F.col("own").cast("int")))
    known = known.withColumn("shared", F.size("base").cast("long"))
    at_own, at_base = F.get("head", (F.least("own", "n") - 1).cast("int")), F.get("base", F.size("base") - 1)
    known = known.select("conv_id", "n", "own", "shared", "base", *(F.coalesce(x[p], F.lit(0).cast("long")).alias(f"{c}{p[1]}") for c, x in (("o", at_own), ("s", at_base)) for p in ("p1", "p2")))
    known = materialise(known, "rebuilt")
    # conversations in pieces: a key has one piece's rows
    info = pieces.select("conv_id", "part").join(known.where("n > own").drop("base"), "conv_id")
    later = rows.where("place > 0").join(info, ["conv_id", "part"]).where("place > own")
    moved = later.mapInArrow(_keyed, "conv_id long, bytes long, depth long, k1 long, above1 long, k2 long, above2 long, ends boolean")
    none = F.lit(0).cast("long")
    steps = F.transform("base", lambda x, i: F.struct(x["place"].alias("depth"), x["p1"].alias("k1"), x["p2"].alias("k2"), F.coalesce(F.get("base", i - 1)["p1"], none).alias("above1"), F.coalesce(F.get("base", i - 1)["p2"], none).alias("above2"), x["bytes"].alias("bytes")))
    begun = known.select("conv_id", (F.col("n") <= F.col("own")).alias("short"), "shared", F.explode(steps).alias("x")).select("conv_id", "x.*", (F.col("short") & (F.col("x.depth") == F.col("shared"))).alias("ends"))
    roots = known.select("conv_id", *(none.alias(c) for c in ("depth", "k1", "k2", "above1", "above2", "bytes")), ((F.col("n") <= F.col("own")) & (F.col("shared") == 0)).alias("ends"))
    return materialise(moved.unionByName(begun).unionByName(roots), "paths")


def merged(steps: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The nodes of `paths`: key, the parent's hash, bytes, n_convs and the least conv_id.

    Each task's rows are combined before they move. Then up to `fan_in` tasks' tables are merged at a time, until there is one.
    """
    same = [*KEY, "above1", "above2", "bytes"]
    tables = steps.select(*same, "conv_id", F.lit(1).cast("long").alias("n_convs"), F.spark_partition_id().alias("piece"))
    left = steps.rdd.getNumPartitions()
    while True:
        left = -(-left // fan_in)
        tables = tables.withColumn("piece", F.floor(F.col("piece") / fan_in)).groupBy(*same, "piece").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
        if left <= 1:
            return materialise(tables.drop("piece"), "nodes")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and id become blocks of at most BLOCK ids of one node."""
    for batch in batches:
        keys = [batch.column(c).to_numpy() for c in KEY]
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
        begin = np.flatnonzero(new)
        cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(begin, np.append(begin[1:], len(ids)))])
        blocks = [ids[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(ids)))]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts]) for k in keys), pa.array(ids[cuts]), pa.array(blocks, pa.binary())], names=[*KEY, "least", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by node and least id go through a node's hash one by one."""
    node, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            listed = ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode()
            if key == node:
                state.update(b",")
            else:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            state.update(listed)
        if out:
            yield _ended(out)
    if node is not None:
        yield _ended([(*node, state.hexdigest())])


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])


def end_lists(steps: DataFrame, parts: int) -> DataFrame:
    """ends_sha256 of every node at which a conversation ends.

    Ids are sorted in ranges of node and id and packed in blocks, a hot node's in many tasks. One task hashes a node's blocks
    in order, holding one of them at a time, as SHA-256 can't be put together from parts.
    """
    ids = steps.where("ends").select(*KEY, "conv_id").repartitionByRange(parts, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = ids.mapInArrow(_packed, "depth long, k1 long, k2 long, least long, ids binary")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_digested, "depth long, k1 long, k2 long, ends_sha256 string")


def rolled_up(shared: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens over the subtree of each row of `shared`: key, the parent's hash, and the node's own leaves and saved.

    A round knows a node's sums over all nodes less than 2^r below it and its ancestor 2^r above; it adds the sums of the nodes for which
    it is that ancestor. Nodes that share a hot ancestor are summed before they move, and find its own ancestor by `lookup`.
    """
    up = ["up_depth", "up1", "up2"]
    level = materialise(shared.select(*KEY, (F.col("depth") - 1).alias("up_depth"), F.col("above1").alias("up1"), F.col("above2").alias("up2"), "leaves", "saved"), "rollup")
    reach, total = 1, level.count()
    deepest = level.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        below = level.where("up_depth >= 0").groupBy(*up).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("saves"), F.count("*").alias("uses")).toDF(*KEY, "more", "saves", "uses")
        below = materialise(level.select(*KEY, *(F.col(c).alias(f"next_{c}") for c in up)).join(below, KEY), "below")
        further = below.select(*(F.col(c).alias(u) for c, u in zip(KEY, up)), *(f"next_{c}" for c in up), "uses")
        summed = level.join(below.select(*KEY, "more", "saves"), KEY, "left").select(*KEY, *up, (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("saves", F.lit(0))).alias("saved"))
        found = lookup(summed, further, up, "uses", total)
        level = materialise(found.select(*KEY, *(F.coalesce(f"next_{c}", F.lit(-1 if c == "up_depth" else 0).cast("long")).alias(c) for c in up), "leaves", "saved"), "rollup")
        reach *= 2
    return level.select(*KEY, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


EMPTY = hashlib.sha256(b"").hexdigest()


def trie(turns: DataFrame, parts: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (its least member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Conversation c is rebuilt from the first h turns of conversation c - c % 5 and its own turns after its first h, h = crc32(c) % 9. Turns go by
    number, null first; those of one number by role, then text, and equal rows are turns of their own. Null roles and texts count as empty. Rows
    without a conv_id belong to no conversation. The remainder of a negative conv_id has its sign, as in SQL. Very long texts are hashed whole and
    stay where they are; a conversation may have any number of turns. An empty table gives no row; other columns are not read.
    """
    spark = turns.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.rdd.getNumPartitions())
    steps = paths(turns, parts)
    nodes = merged(steps, fan_in)
    total = nodes.count()
    parent = [(F.col("depth") - 1).alias("depth"), F.col("above1").alias("k1"), F.col("above2").alias("k2")]
    kids = materialise(nodes.where("depth > 0").select(*parent, "n_convs").groupBy(*KEY).agg(F.count("*").alias("n_children"), F.sum((F.col("n_convs") == 1).cast("long")).alias("single")), "children")
    # below a node of one conversation there is one leaf, and nothing is saved
    many = nodes.where("n_convs > 1").join(kids, KEY, "left")
    leaf = F.col("n_children").isNull().cast("long")
    many = many.select(*KEY, "above1", "above2", (F.coalesce("single", F.lit(0)) + leaf).alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    sums = rolled_up(many)
    full = nodes.join(kids.drop("single"), KEY, "left").join(sums, KEY, "left").join(end_lists(steps, parts), KEY, "left")
    up = ["up_depth", "above1", "above2"]
    parents = nodes.select(*KEY, F.col("conv_id").alias("parent_conv_id")).join(kids, KEY).select(F.col("depth").alias("up_depth"), F.col("k1").alias("above1"), F.col("k2").alias("above2"), "parent_conv_id", F.col("n_children").alias("uses"))
    rows = lookup(full.withColumn("up_depth", F.col("depth") - 1), parents, up, "uses", total)
    zero = lambda c, other=0: F.coalesce(c, F.lit(other).cast("long")).alias(c)
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), zero("n_leaves", 1), zero("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))
