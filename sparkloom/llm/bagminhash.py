"""Near-duplicate detection by BagMinHash on multisets of word shingles.

A text is the multiset of its five-word shingles. Weights are discretised at the whole
numbers, which is exact for counts, and the levels form a hierarchy of dyadic
blocks [0,1), [1,2), [2,4), [4,8), ... Each shingle's block carries a Poisson process whose rate is the
block's length; a point has a time, a register and a height in the block. A text takes from
each of its shingles the points below the shingle's count, and keeps by register the least time:
two texts agree in a register with a probability equal to their weighted Jaccard similarity. Points
come in the order of time, and only up to the time at which all registers are full, so a
signature costs about REGISTERS * ln REGISTERS points, however long the text.

Signatures are cut into bands; texts with an equal band meet in a bucket. Each member is compared
with its bucket's head, exactly, on the two multisets. Then buckets whose members
still lie in different classes are gone through again: pairs across classes not yet compared are, until
one links the member to the other class. So every pair with a common band is either compared or already
in one class: no link between classes is lost, and members of one class are not compared all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import by_batch, hashed_words, keyed_text, mix64, read, shingles
from sparkloom.llm.graph import components
from sparkloom.session import materialise

WORDS = 5
SIMILARITY = 0.8
#: 25 bands of 5 registers miss a pair at 0.8 with a probability of 5e-5, at 0.85 of 1e-6.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Registers estimate a similarity of 0.8 with a deviation of 0.036; in buckets of several classes, what they put five of those
#: below is not compared exactly, unless `slack` is None.
SLACK = 0.18
#: Members of a bucket that are at home in one task, and those that visit it; a larger bucket goes block by block.
BLOCK = 512
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_U53 = np.float64(2.0**-53)


def bag_signatures(items: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """One row of 32-bit values a bag; items are 64-bit hashes, counts the bags' sizes. Empty bags give zeros."""
    bags = len(counts)
    out = np.zeros((bags, registers), np.uint32)
    if not len(items):
        return out
    owner = np.repeat(np.arange(bags), counts)
    order = np.lexsort((items, owner))
    owner, items = owner[order], items[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (items[1:] != items[:-1])]))
    weight = np.diff(np.append(new, len(items)))
    owner, items = owner[new], items[new]
    # one stream of points for each block that a count reaches into
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))).astype(np.int64) + 1, 1)
    at = np.repeat(np.arange(len(items)), blocks)
    level = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.maximum(low, 1).astype(np.float64)
    height = np.minimum((weight[at] - low) / rate, 1.0)
    owner = owner[at]
    seed = mix64(items[at] + mix64(level.astype(np.uint64) + np.uint64(77)))

    def gap(seed: np.ndarray, step: np.ndarray, rate: np.ndarray) -> np.ndarray:
        u = ((mix64(seed + step * _GOLD) >> np.uint64(11)).astype(np.float64) + 0.5) * _U53
        return -np.log(u) / rate

    least = np.full(bags * registers, np.inf)
    total = counts.astype(np.float64)
    until = np.full(bags, np.inf)
    until[total > 0] = registers * (np.log(registers) + 3) / total[total > 0]
    step = np.ones(len(seed), np.uint64)
    time = gap(seed, step, rate)
    while len(time):
        live = np.flatnonzero(time <= until[owner])
        while len(live):
            spot = mix64(mix64(seed[live] ^ np.uint64(0x5851F42D4C957F2D)) + step[live] * _GOLD)
            register = ((spot >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
            inside = (spot & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < height[live]
            hit = live[inside]
            np.minimum.at(least, owner[hit] * registers + register[inside].astype(np.int64), time[hit])
            step[live] += np.uint64(1)
            time[live] += gap(seed[live], step[live], rate[live])
            live = live[time[live] <= until[owner[live]]]
        short = np.isinf(least.reshape(bags, registers)).any(axis=1)
        until *= 2
        rest = short[owner]
        owner, seed, step, time, rate, height = (x[rest] for x in (owner, seed, step, time, rate, height))
    full = counts > 0
    out[full] = (mix64(least.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(bags, registers)[full]
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    cut = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    out = np.tile(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), 1))
    for k in range(rows):
        out = mix64(out * _GOLD + cut[:, :, k])
    return out.view(np.int64)


def _prepared(cols: dict) -> dict:
    words, _, counts = hashed_words([t.lower() for t in cols["text"]])
    n = len(counts)
    items, sizes = shingles(words, counts, WORDS)
    found = bag_signatures(items, sizes)
    # two more hashes, of the words in order: copies are the rows that agree in both
    owner = np.repeat(np.arange(n), counts)
    place = (np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
    exact = []
    for lane in (1, 2):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, mix64(mix64(words + np.uint64(lane)) ^ mix64(place + np.uint64(lane << 32))))
        exact.append(mix64(total + counts.astype(np.uint64)).view(np.int64))
    keys = band_keys(found)
    filled = sizes > 0
    width = np.where(filled, BANDS, 0)
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(keys[filled].ravel()))
    return {"doc_id": cols["doc_id"], "raw": cols["raw"], "h1": exact[0], "h2": exact[1], "signature": [x.tobytes() for x in found], "bands": bands}


def bag(text_words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Each text's multiset as a sorted array of distinct numbers: shingles with their occurrence."""
    items, sizes = shingles(text_words, counts, WORDS)
    owner = np.repeat(np.arange(len(counts)), sizes)
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    first = np.concatenate([[True], (owner[1:] != owner[:-1]) | (items[1:] != items[:-1])]) if len(items) else np.zeros(0, bool)
    begin = np.flatnonzero(first)
    nth = np.arange(len(items)) - np.repeat(begin, np.diff(np.append(begin, len(items))))
    items = np.where(nth > 0, mix64(items + nth.astype(np.uint64) * _GOLD), items)
    return [np.sort(x) for x in np.split(items, np.cumsum(sizes)[:-1])]


def _bags(cols: dict) -> dict:
    words, _, counts = hashed_words([t.lower() for t in cols["text"]])
    return {"node": cols["node"], "bag": [x.tobytes() for x in bag(words, counts)]}


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                keep.append(overlap(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(similarity: float, slack: float | None):
    """Links of the visitors of a bucket's block with the rows at home there that bear another label, one a visitor and label."""

    def links(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        node, label, main, home, visits = (table.column(c).to_numpy() for c in ("node", "label", "main", "home", "visits"))
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, REGISTERS)
        bags = [np.frombuffer(x, np.uint64) for x in table.column("bag").to_pylist()]
        bands = band_keys(signature)
        found: list[tuple[int, int]] = []
        for i in np.flatnonzero(visits).tolist():
            # each pair once: with all of the main label, and with lesser nodes of other labels
            j = np.flatnonzero(home & (label != label[i]) & ((label == main) | (node < node[i])))
            if slack is not None:
                j = j[(signature[j] == signature[i]).mean(axis=1) >= similarity - slack]
            same = bands[j] == bands[i]
            j = j[bands[i][same.argmax(axis=1)] == key]  # the first bucket that both are in compares them
            met: set[int] = set()
            for k in j.tolist():
                if int(label[k]) not in met and overlap(bags[i], bags[k]) >= similarity:
                    met.add(int(label[k]))
                    found.append((int(node[i]), int(node[k])))
        a, b = ([min(p) for p in found], [max(p) for p in found])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _dealt(placed: DataFrame) -> DataFrame:
    """The members of buckets of several labels (key, node, label), dealt to tasks (key, lo, hi).

    Each pair of labels has a member that isn't of the bucket's main label. Those few visit all blocks of the bucket, at most BLOCK of them
    at a time; the others stay in their block. So a bucket's rows grow with its size times its blocks of visitors.
    """
    counted = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    of = counted.groupBy("key").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("most")).where("size > most.n")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = materialise(of.select("key", F.col("most.label").alias("main"), blocks(F.col("size")).alias("homes"), blocks(F.col("size") - F.col("most.n")).alias("rounds")), "mixed")
    h = F.xxhash64("node")
    left = placed.join(mixed, "key").withColumns({"own": F.pmod(h, F.col("homes")).cast("int"), "turn": F.pmod(F.xxhash64(h), F.col("rounds")).cast("int"), "other": F.col("label") != F.col("main")})
    place = lambda lo, hi, home, visits: F.struct(lo.alias("lo"), hi.alias("hi"), home.alias("home"), visits.alias("visits"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_home = F.transform(upto("rounds"), lambda v: place(F.col("own"), v, F.lit(True), F.col("other") & (v == F.col("turn"))))
    away = F.transform(F.filter(upto("homes"), lambda b: F.col("other") & (b != F.col("own"))), lambda b: place(b, F.col("turn"), F.lit(False), F.lit(True)))
    return left.select("key", "node", "label", "main", F.explode(F.concat(at_home, away)).alias("at")).select("key", "at.*", "node", "label", "main")


def classes(docs: DataFrame, similarity: float = SIMILARITY, slack: float | None = SLACK) -> DataFrame:
    """Per row of docs: doc_id, class_id, copy_of and n_links.

    class_id is the least doc_id of the class: documents linked, directly or in a chain, by a weighted
    Jaccard similarity of their lower-cased five-word shingles of at least `similarity`. copy_of is the least doc_id
    with the same words in the same order, n_links how many compared texts, other than those copies, that text is linked to.

    A text of one to four words has one shingle; null and empty texts, and those without a word, are copies of each
    other and have no further link. doc_id may have any type that has an order; a null one comes before all others, and a class
    with it has class_id null. Rows of one doc_id with different texts are documents of their own. Very long texts are taken
    whole. An empty table gives an empty one; other columns are not read.
    """
    facts, texts = _placed(docs, similarity, slack)
    return facts.select("doc_id", "h1", "h2").join(texts, ["h1", "h2"]).select("doc_id", F.col("first.doc_id").alias("class_id"), F.col("own.doc_id").alias("copy_of"), "n_links")


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, the text and a hash of it: a document is known by doc_id and raw."""
    return keyed_text(docs).withColumn("raw", F.xxhash64("text"))


def _placed(docs: DataFrame, similarity: float, slack: float | None) -> tuple[DataFrame, DataFrame]:
    """The hashes of each row, and of each distinct text (h1, h2) its own least document and that of its class, with n_links."""
    facts, nodes = _nodes(docs)
    edges, labels = _links(docs, nodes, similarity, slack)
    links = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = nodes.select("h1", "h2", "node", "own")
    linked = materialise(labels.join(known.select("node", "own"), "node"), "linked")
    firsts = linked.groupBy("label").agg(F.min("own").alias("first"))
    classed = linked.join(firsts, "label").select("node", "first").join(links, "node", "left")
    texts = known.join(classed, "node", "left").select("h1", "h2", "own", F.coalesce("first", "own").alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return facts, materialise(texts, "texts")


def _nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row of hashes for each row of docs, and one for each distinct text with a number, its signature and its least document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = by_batch(_texts(docs), _prepared, f"doc_id {kind}, raw long, h1 long, h2 long, signature binary, bands array<long>", rows=1000)
    facts = materialise(made, "signatures")
    own = F.struct("doc_id", "raw")
    # the largest rows are shed before the shuffle: each task sends a text once
    nodes = facts.groupBy("h1", "h2").agg(F.min(own).alias("own"), F.min_by(F.struct("signature", "bands"), own).alias("of"))
    return facts, materialise(nodes.select("h1", "h2", F.monotonically_increasing_id().alias("node"), "own", "of.signature", "of.bands"), "nodes")


def _links(docs: DataFrame, nodes: DataFrame, similarity: float, slack: float | None) -> tuple[DataFrame, DataFrame]:
    """The verified links between texts, and the label of every linked text."""
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    head = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"]
    shared = materialise(buckets.groupBy("key").agg(F.count("*").alias("size"), head.alias("head")).where("size > 1"), "buckets")
    members = materialise(buckets.join(shared, "key"), "members")
    tested = materialise(members.where("node <> head").select("node", "head").distinct(), "pairs")
    wanted = tested.select(F.explode(F.array("node", "head")).alias("node")).distinct().join(nodes.select("node", "own"), "node")
    wanted = wanted.select("node", F.col("own.doc_id").alias("wanted_id"), F.col("own.raw").alias("wanted_raw"))
    texts = _texts(docs)
    met = F.col("raw").eqNullSafe(F.col("wanted_raw")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    texts = texts.join(wanted.hint("shuffle_hash"), met).select("node", "text")
    bags = materialise(by_batch(texts, _bags, "node long, bag binary", rows=1000).dropDuplicates(["node"]), "bags")
    # a member's bag goes to its head's, which moves once, or once for each split of a hot head
    sent = tested.join(bags, "node").select(F.col("node").alias("a"), F.col("head").alias("b"), F.col("bag").alias("left"))
    both = sent.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("right")), "b").select("a", "b", "left", "right")
    edges = both.mapInArrow(_verified(similarity), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links")
    labels = components(edges)
    # buckets that still hold several classes
    placed = members.where("size > 2").select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    left = materialise(_dealt(materialise(placed, "placed")), "left")
    if left.isEmpty():
        return edges, labels
    carried = nodes.select("node", "signature").join(bags, "node")
    full = left.join(carried, "node")
    more = materialise(full.groupBy("key", "lo", "hi").applyInArrow(_across(similarity, slack), "a long, b long"), "links")
    edges = materialise(edges.union(more).distinct(), "links")
    return edges, components(edges)


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY, slack: float | None = SLACK) -> DataFrame:
    """One row of each class, with all of docs' columns: the document with the class's least doc_id.

    Of rows with that doc_id and the same text one stays; of different texts under that doc_id in one class, that with the least hash.
    Rows go only for a text like theirs: different texts under one doc_id, null ones included, all stay.
    """
    facts, texts = _placed(docs, similarity, slack)
    gone = facts.join(texts, ["h1", "h2"]).where("not (struct(doc_id, raw) <=> first)").select(F.col("doc_id").alias("gone_id"), F.col("raw").alias("gone_raw")).distinct()
    own = [f"own{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    rows = docs.toDF(*own).withColumn("raw", F.xxhash64(F.coalesce(F.col(at["text"]), F.lit(""))))
    met = F.col("raw").eqNullSafe(F.col("gone_raw")) & F.col(at["doc_id"]).eqNullSafe(F.col("gone_id"))
    kept = rows.join(gone.hint("shuffle_hash"), met, "left_anti")
    if _repeats(facts):
        kept = kept.dropDuplicates([at["doc_id"], "raw"])
    return kept.select(*(F.col(o).alias(c) for c, o in at.items()))


def _repeats(facts: DataFrame) -> bool:
    """Whether a document has several rows."""
    return not facts.groupBy("doc_id", "raw").count().where("count > 1").isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "copy_of")
