"""The prefix trie, the filter audit and SimHash against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import common, filter_audit, prefix_trie, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# the trie


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(first, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        last = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[k] for k in children[node])
        ends = ",".join(map(str, sorted(c for c in members[node] if len(rebuilt[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations():
    draw = random.Random(5)
    rows = []
    for c in range(-7, 60):
        for t in range(draw.choice([0, 1, 2, 9, 10, 14])):
            rows.append((c, t, "user" if t % 2 == 0 else None, draw.choice(["yes", "no", "é ü", None, ""])))
    rows += [(100 + k, t, "user", f"same {t}") for k in (0, 5, 10, 15, 20) for t in range(40)]  # equal ones, shared deep down
    rows += [(205, t, "user", f"long {t % 7}") for t in range(900)]  # one with a third of the rows
    rows += [(300, None, r, x) for r, x in [("b", "x"), ("a", "z"), ("a", "y"), (None, "y"), ("a", "y")]] + [(300, 1, "a", "w"), (300, 1, "a", "v")]  # ties
    rows += [(401, 3, None, None)] * 4 + [(None, 1, "user", "no conversation")] * 3 + [(1 << 40, 0, "user", "far")]
    return rows


def test_trie(spark):
    rows = conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumns({n: F.lit("x") for n in ("depth", "part", "k1", "n", "piece", "place", "uses", "bytes")}).repartition(5)
    want = brute_trie(rows)
    got = prefix_trie.trie(table, parts=6, fan_in=2)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want
    assert sorted(map(tuple, prefix_trie.trie(table, parts=1).collect()), key=lambda r: r[:2]) == want


def test_a_long_conversation_is_cut(spark):
    turns = spark.createDataFrame([(7, i, "user", str(i)) for i in range(3000)] + [(8, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    cut = prefix_trie.ordered(turns, 6)
    assert cut.groupBy("part").count().count() > 3
    places = prefix_trie.placed(turns, 6).where("conv_id = 7").select("place").collect()
    assert sorted(r["place"] for r in places) == list(range(1, 3001))


def test_equal_rows_are_cut(spark):
    turns = spark.range(4000).select(F.lit(7).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    parts = [r["count"] for r in prefix_trie.ordered(turns, 5).groupBy("part").count().collect()]
    assert len(parts) == 5 and max(parts) < 2000


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(empty).collect() == []
    none = spark.createDataFrame([(None, 1, "user", "x")], empty.schema)
    assert prefix_trie.trie(none).collect() == []


def test_end_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    steps = spark.range(100).select(*(F.lit(0).cast("long").alias(c) for c in prefix_trie.KEY), F.col("id").alias("conv_id"), F.lit(True).alias("ends"))
    (row,) = prefix_trie.end_lists(steps, 4).collect()
    assert row["ends_sha256"] == hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest()


# the audit


def brute_audit(docs, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    facts = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > least[t] else set()
        facts[lang or ""].append((fails, i is not None and i in good, i is not None and i in toxic))
    out = []
    for part, rows in facts.items():
        shapley, found = defaultdict(int), []
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                here = [r for r in rows if f in r[0] and not r[0] & set(order[:s])]
                shapley[f] += len(here)
                found.append((part, order, s + 1, sum(not r[0] & set(order[: s + 1]) for r in rows), len(here), sum(f in r[0] for r in rows) - len(here), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here), f))
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def test_audit(spark, odd, rows):
    docs = [(i, t, lang) for i, t, lang, _ in rows]
    clean = " ".join(f"word{i}" for i in range(120))
    more = [(20 + k, clean, "en") for k in range(3)] + [(30, clean + " A$", "fr"), (31, "A B C", None), (32, clean.upper(), "de"), (None, clean, "en"), (None, clean, "en"), (33, clean + " \x1c\x85\xa0x", "en")]
    marks = [(1, 1, 0), (2, 0, 1), (2, 1, None), (20, 1, 0), (21, 1, 1), (31, None, 1), (None, 1, 1), (32, 1, 0)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string")
    table = odd.select("doc_id", "text", "lang", "part", "label", "slot").unionByName(extra.withColumns({c: F.lit("x") for c in ("part", "label", "slot")})).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("rows", F.lit("x"))
    got = filter_audit.audit(table, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs + more, marks)


def test_audit_of_nothing(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(empty, labels).collect() == []


def test_audit_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 3)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), (F.col("id") % 11).cast("string").alias("lang"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    first = filter_audit.audit(docs, labels).where("filter_order = 'ABCDE' and step = 1").collect()
    assert len(first) == 11 and sum(r["removed"] for r in first) == 400 and all(r["kept"] == 0 for r in first)


def test_first_failures():
    for mask in range(32):
        for order, step in zip(filter_audit.ORDERS, filter_audit.FIRST[mask]):
            fails = [f for f in order if mask >> "ABCDE".index(f) & 1]
            assert step == (order.index(fails[0]) if fails else 5)


def test_lookup_takes_hot_keys_by_broadcast(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1100, None).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    table = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("uses")).withColumn("w", F.col("k") * 2).where("k < 2000")
    got = common.lookup(rows, table, ["k"], "uses", 3000, share=100).select("v", "k", "w").collect()
    assert len(got) == 3000 and all(r["w"] == (r["k"] * 2 if r["k"] is not None and r["k"] < 2000 else None) for r in got)


# SimHash


def brute_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(prints, radius=2):
    """Components by comparing every two rows."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((doc, f"{f:016x}", least.get(root(i))) for i, (doc, f) in enumerate(prints)), key=str)


def test_simhash(odd, rows):
    want = brute_near([(i, brute_print(t)) for i, t, *_ in rows])
    assert sorted(map(tuple, simhash.near(odd).collect()), key=str) == want


def test_simhash_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = simhash.near(docs).collect()
    for r in random.Random(3).sample(got, 60):
        assert int(r["fingerprint"], 16) == brute_print(held[r["doc_id"]])
    prints = [(r["doc_id"], int(r["fingerprint"], 16)) for r in got]
    assert sorted(map(tuple, got), key=str) == brute_near(prints)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_all_links_at_the_radius_connect(spark, radius):
    """Chains, balls and pairs at the radius and one bit beyond it."""
    draw = random.Random(radius)
    found = [0, (1 << 64) - 1]
    for _ in range(12):
        x = draw.getrandbits(64)
        found.append(x)
        for n in (1, 2, 3, 4, 5):
            y = x
            for b in draw.sample(range(64), n):
                y ^= 1 << b
            found.append(y)
            x = y if n % 2 else x
    found = sorted(set(found))
    prints = spark.createDataFrame([(simhash._signed(x),) for x in found], "fingerprint long").repartition(4)
    edges = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(prints, radius).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in edges)
    name = {x: i for i, x in enumerate(found)}
    want = brute_near([(name[x], x) for x in found], radius)
    parent = {x: x for x in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    least = defaultdict(lambda: 1 << 30)
    for x in found:
        least[root(x)] = min(least[root(x)], name[x])
    assert sorted(((name[x], f"{x:016x}", least[root(x)]) for x in found), key=str) == want


def test_simhash_of_nothing(empty):
    assert simhash.near(empty).collect() == []
    with pytest.raises(ValueError):
        simhash.links(empty, 3)


# sharding


def test_rows_of_one_id_and_text_fill_all_shards(spark):
    """A null id and empty text, 100,000 times, among others."""
    docs = spark.range(105_000).selectExpr("if(id < 100000, null, id) AS doc_id", "if(id < 100000, null, repeat('x', int(id % 50))) AS text")
    got = sharding.shard(docs, shards=24)
    loads = [r["bytes"] for r in got.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(loads) == 24 and max(loads) < 1.02 * min(loads)
    slots = got.groupBy("virtual_slot").count().agg(F.max("count"), F.percentile_approx("count", 0.5)).first()
    assert slots[0] < 3 * slots[1]
    ends = got.groupBy("shard").agg((F.max("slot") - F.count("*")).alias("gap"), F.countDistinct("slot").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["gap"] == -1 and r["n"] == r["rows"] for r in ends) and got.count() == 105_000
