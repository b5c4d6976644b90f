import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import dense, evidence, fusion, lexical, metrics

CHUNKS = [("chunk_001", "Ridge alpha penalty shrinks coefficients toward zero"), ("chunk_002", "Lasso does feature selection"), ("chunk_003", "Support vectors define the margin"), ("chunk_004", "Étion only")]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.build(spark.createDataFrame(CHUNKS, "chunk_id string, content string"))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def hits(spark, rows):
    return spark.createDataFrame([(0, i, c, s) for i, (c, s) in enumerate(rows, start=1)], "query_id int, rank int, chunk_id string, score double")


def brute_bm25(query):
    import re

    docs = {c: [t.lower() for t in re.findall(r"\w+", x) if t.isascii()] for c, x in CHUNKS}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for d in docs.values() for t in d}
    idf = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return {c: sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query.split()) for c, d in docs.items()}


def test_bm25_matches_brute_force(spark, index):
    query = "alpha penalty coefficients alpha feature"
    got = {r["chunk_id"]: r["score"] for r in lexical.search(index, ask(spark, query), 4).collect()}
    assert got == pytest.approx({c: round(s, 6) for c, s in brute_bm25(query).items()}, abs=1e-6)


def test_bm25_ranks_pads_and_guards(spark, index):
    rows = lexical.search(index, ask(spark, "alpha penalty", "", "unknown"), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in rows] == [(0, "chunk_001"), (0, "chunk_002"), (2, "chunk_001"), (2, "chunk_002")]
    assert [r["score"] for r in rows][1:] == [0, 0, 0]
    with pytest.raises(ValueError, match="positive"):
        lexical.search(index, ask(spark, "x"), 0)


def test_index_round_trip(spark, index, tmp_path):
    index.write(f"file://{tmp_path}/i")
    back = lexical.LexicalIndex.read(spark, f"file://{tmp_path}/i")
    assert back.terms.count() == index.terms.count()
    with pytest.raises(Exception, match="(?i)exist"):
        index.write(f"file://{tmp_path}/i")


def test_dense_matches_brute_force_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8)).astype(np.float32)
    v[7] = v[3]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id int, embedding array<float>")
    got = dense.search(table, table.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id"), 5)
    for q in range(7):
        score = np.round(v.astype(np.float64) @ v[q].astype(np.float64), 6)
        best = np.lexsort((np.arange(40), -score))[:5]
        assert [r["chunk_id"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == best.tolist()
    assert dense.search(table, table.where("false").withColumnRenamed("chunk_id", "query_id"), 5).count() == 0


def test_encoder_gives_unit_vectors(spark):
    out = dense.encode(spark.createDataFrame([("a", "some words"), ("b", "")], "chunk_id string, content string"), dense.hashing_encoder(16), dimension=16).collect()
    assert np.linalg.norm(out[0]["embedding"]) == pytest.approx(1, abs=1e-6) and set(out[1]["embedding"]) == {0.0}


def test_rrf(spark):
    a = hits(spark, [("ridge", 0.85), ("lasso", 0.75), ("elastic", 0.65)])
    b = hits(spark, [("lasso", 14.2), ("sgd", 11.5), ("ridge", 9.8)])
    rows = fusion.reciprocal_rank_fusion(a, b).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["lasso", "ridge", "sgd", "elastic"]
    assert rows[0]["score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and rows[1]["score"] == pytest.approx(1 / 61 + 1 / 63, abs=1e-9)
    assert (rows[0]["dense_score"], rows[0]["bm25_score"]) == (0.75, 14.2)
    with pytest.raises(ValueError, match="positive"):
        fusion.reciprocal_rank_fusion(a, b, limit=0)


def test_rerank_keeps_stage_scores(spark):
    c = spark.createDataFrame([("a", "one two"), ("b", "two three four")], "chunk_id string, content string")
    rows = fusion.rerank(hits(spark, [("a", 9.0), ("b", 8.0)]).withColumn("bm25_score", F.col("score")), ask(spark, "three four"), c).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"], r["bm25_score"]) for r in rows] == [("b", 1.0, 8.0), ("a", 0.0, 9.0)]


@pytest.mark.parametrize(
    ("r", "t", "k", "recall", "rr", "ndcg"),
    [
        (["a", "c", "b"], ["a", "b"], 1, 0.5, 1, 1),
        (["a", "c", "b"], ["a", "b"], 2, 0.5, 1, 1 / (1 + 1 / math.log2(3))),
        (["a", "c", "b"], ["a", "b"], 3, 1, 1, (1 + 0.5) / (1 + 1 / math.log2(3))),
        (["a", "a", "c"], ["a", "b"], 2, 0.5, 1, 1 / (1 + 1 / math.log2(3))),
        (["x", "t"], ["t"], 2, 1, 0.5, 1 / math.log2(3)),
        (["c1", "c1", "c2"], ["c1"], 3, 1, 1, 1),
        ([], ["a"], 3, 0, 0, 0),
        (["a"], [], 3, 0, 0, 0),
        (["a"], ["a"], 0, 0, 0, 0),
        (["x", "y", "a"], ["a"], 2, 0, 0, 0),
    ],
)
def test_measures(spark, r, t, k, recall, rr, ndcg):
    row = spark.createDataFrame([(r, t)], "r array<string>, t array<string>").select(*(f(F.col("r"), F.col("t"), k).alias(n) for n, f in (("recall", metrics.recall), ("rr", metrics.reciprocal_rank), ("ndcg", metrics.ndcg)))).first()
    assert (row["recall"], row["rr"], row["ndcg"]) == pytest.approx((recall, rr, ndcg))


def test_mrr_and_accuracy(spark):
    lists = spark.createDataFrame([(["a"], ["a"]), (["x", "a"], ["a"]), (["x"], ["a"])], "retrieved array<string>, truth array<string>")
    assert metrics.mean_reciprocal_rank(lists).first()["mrr"] == pytest.approx(0.5)
    rows = spark.createDataFrame([("D", "D"), ("h ", "H"), ("D", "M"), ("M", "M"), (None, "D")], "p string, e string")
    assert rows.agg(metrics.accuracy(F.col("p"), F.col("e")).alias("a")).first()["a"] == pytest.approx(0.6)


def test_evidence_pool_and_sufficiency(spark):
    found = spark.createDataFrame([(1, "sub_01", "pipe", 0.85), (1, "sub_01", "prep", 0.7), (1, "sub_02", "pipe", 0.85), (1, "sub_02", "model", 0.9)], "query_id int, sub_query_id string, chunk_id string, score double")
    parts = spark.createDataFrame([(1, "sub_01"), (1, "sub_02"), (2, "sub_01")], "query_id int, sub_query_id string")
    pooled = evidence.pool(found)
    rows = {r["chunk_id"]: r for r in pooled.collect()}
    assert rows["pipe"]["overlap_count"] == 2 and rows["prep"]["retrieved_by"] == ["sub_01"]
    counts = evidence.pool_counts(found, pooled).first()
    assert (counts["examined"], counts["unique"]) == (4, 3)
    got = {r["query_id"]: r for r in evidence.sufficiency(parts, pooled).collect()}
    assert got[1]["is_sufficient"] and got[1]["concept_coverage"] == 1 and got[1]["recommendation"] == "PROCEED_TO_GENERATION"
    assert got[2]["recommendation"] == "ESCALATE_RETRIEVAL" and got[2]["top_score"] == -999
    assert {r["recommendation"] for r in evidence.sufficiency(parts, pooled, attempt=2).where("query_id = 2").collect()} == {"INSUFFICIENT_EVIDENCE"}


def test_escalation_is_bounded(spark):
    parts = spark.createDataFrame([(1, "sub_01", "q")], "query_id int, sub_query_id string, query_text string")
    asked = []

    def nothing(some, k):
        asked.append(k)
        return spark.createDataFrame([], "query_id int, sub_query_id string, chunk_id string, score double")

    found, verdicts = evidence.retrieve_complex(parts, nothing, 20, 5)
    assert asked == [20, 35] and found.count() == 0
    assert verdicts.first()["attempts"] == 2 and verdicts.first()["recommendation"] == "INSUFFICIENT_EVIDENCE"


def test_holding_equals_contains(spark, monkeypatch):
    from sparkloom.operators import containing

    monkeypatch.setattr(containing, "BLOCK", 2)
    bodies = ["one two three four", "xone two threex", "two", "one  two three", "", None, "one two three one two three", "four\none two three four"]
    asked = ["one two three", "two", "e two t", "", None, "one two three four", "absent here now", "  two  "]
    texts = spark.createDataFrame(list(enumerate(bodies)), "text_id long, body string")
    passages = spark.createDataFrame(list(enumerate(asked)), "passage_id long, passage string")
    want = {(i, j) for i, b in enumerate(bodies) for j, p in enumerate(asked) if b is not None and p is not None and p in b}
    assert sorted(map(tuple, containing.holding(texts, passages).collect())) == sorted(want)
    assert containing.holding(texts.where("false"), passages).count() == 0 and containing.holding(texts, passages.where("false")).count() == 0


def test_padding_takes_the_least_ids_not_found(spark):
    """A question with few scored chunks, and one whose scores are below zero, against a ranking of all chunks."""
    from sparkloom.operators import lexical

    texts = ["a b c", "a b", "a", "a d", "b a", "e", ""]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    index = lexical.build(chunks)
    asked = spark.createDataFrame([(1, "a"), (2, "e"), (3, "zz"), (4, "d a b"), (5, "  ")], "query_id long, query string")
    for k in (1, 3, 7, 9):
        scored = {(r["query_id"], r["chunk_id"]): r["score"] for r in lexical.scores(index, asked).collect()}
        want = []
        for q in (1, 2, 3, 4):
            rows = sorted(((-scored.get((q, f"c{i}"), 0.0), f"c{i}") for i in range(7)))[:k]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(rows, 1)]
        got = [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in lexical.search(index, asked, k).collect()]
        assert sorted(got) == sorted((q, n, c, s + 0.0) for q, n, c, s in want)


def test_blocks_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    """Small blocks, few of them first: the k best equal those of scoring all chunks, and most blocks stay unread."""
    monkeypatch.setattr(lexical, "FIRST", 1)
    words = [f"w{i}" for i in range(60)]
    texts = [(f"c{i:03d}", " ".join(words[(i // 10 * 5 + (i * k) % 7 + k * k) % 60] for k in range(1 + i % 9)) + (" everywhere" if i % 2 else "")) for i in range(300)]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string")
    index = lexical.build(chunks, block=10)
    asked = spark.createDataFrame([(1, "w1 w2 w9"), (2, "everywhere w30"), (3, "everywhere"), (4, "w59 w59 unknown"), (5, "")], "query_id long, query string")
    wanted = lexical.weighted(index, asked)
    for k in (1, 4):
        got = lexical.search(index, asked, k, pad=False)
        want = lexical.top_k(lexical.scores(index, asked), k)
        assert sorted(map(tuple, got.select("query_id", "rank", "chunk_id", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "chunk_id", "score").collect()))
        _, read = lexical.candidates(index, wanted, k)
        assert read.count() < 0.7 * lexical.bounds(index, wanted).count()
    over = lexical.scores(index, asked).join(index.chunks, "chunk_id").join(lexical.bounds(index, wanted), ["query_id", "block"])
    assert over.where(F.col("score") > F.col("bound") + lexical.SLACK).count() == 0


def test_index_leaves_no_table(spark, tmp_path):
    lexical.build(spark.createDataFrame(CHUNKS, "chunk_id string, content string")).write(f"file://{tmp_path}/index")
    back = lexical.LexicalIndex.read(spark, f"file://{tmp_path}/index")
    assert lexical.search(back, ask(spark, "alpha"), 1).first()["chunk_id"] == "chunk_001"
    assert not [t.name for t in spark.catalog.listTables() if "posting" in t.name]


def test_clusters_are_skipped_and_nothing_is_lost(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 4
    rows = [(i, (centres[i % 30] + rng.normal(size=12) * 0.2).tolist()) for i in range(1500)] + [(2000 + i, centres[0].tolist()) for i in range(40)] + [(3000, None), (3001, [])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    asked = vectors.where("chunk_id % 50 = 0 and chunk_id < 2010").withColumnRenamed("chunk_id", "query_id")
    index = dense.cluster(vectors, clusters=25, sample=500)
    assert index.vectors.count() == 1540
    for k in (1, 7, 60):
        got, read = dense.search_clustered(index, asked, k)
        want = dense.search(vectors, asked, k)
        assert sorted(map(tuple, got.select("query_id", "rank", "chunk_id", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "chunk_id", "score").collect()))
        assert k > 7 or read.count() < 0.5 * dense.bounds(index, asked).count()


def test_clusters_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert dense.search_clustered(dense.cluster(none), one, 3)[0].count() == 0
    few = dense.cluster(spark.createDataFrame([(5, [0.5, 1.0])], "chunk_id long, embedding array<double>"))
    assert [tuple(r) for r in dense.search_clustered(few, one, 3)[0].select("chunk_id", "score").collect()] == [(5, 0.5)]
    assert dense.search_clustered(few, one.where("false"), 3)[0].count() == 0


def test_chunks_of_hits_do_not_move(spark):
    """A join by hits sends their ids to the chunks: no exchange of texts."""
    from sparkloom.operators.ranking import of_hits

    chunks = spark.range(2000).selectExpr("id AS chunk_id", "concat('text ', id) AS content")
    hits = spark.createDataFrame([(1, 5), (2, 5), (2, 7), (3, 9999)], "query_id long, chunk_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = of_hits(hits, chunks)
        assert sorted(map(tuple, got.collect())) == [(5, "text 5"), (7, "text 7")]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_terms_are_counted_where_the_text_is(spark):
    """The index of the words that the column expression gives, with one exchange: that of the texts."""
    from sparkloom.functions.text import lexical_tokens

    texts = ["a b a", "Åb ab_1 Ab", "x²y x y", "Kelvin K k", "", None, "一 two two", "é e", "DE deßen Ⅷ 9", "٠١ 12"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string")
    want = {r["chunk_id"]: r["w"] or [] for r in rows.select("chunk_id", lexical_tokens("content").alias("w")).collect()}
    assert {i: lexical.words(t) for i, t in enumerate(texts)} == want
    counted = lexical.term_frequencies(rows.withColumn("block", F.lit(0).cast("long")))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    got = lexical.build(rows)
    assert {(r["chunk_id"], r["term"]): r["tf"] for r in got.postings.collect()} == {(i, t): w.count(t) for i, w in want.items() for t in w}
    assert {r["chunk_id"]: r["dl"] for r in got.chunks.collect()} == {i: len(w) for i, w in want.items()}


def test_a_question_without_words_has_no_share(spark):
    import math

    from sparkloom.plans.retrieval_queries import shared

    got = spark.createDataFrame([("é ñ", "x"), ("x y", "x")], "q string, c string").select(shared(F.col("q"), F.col("c")).alias("s")).collect()
    assert math.isnan(got[0]["s"]) and got[1]["s"] == 0.5


def test_a_block_has_one_row_a_term(spark, monkeypatch):
    """Postings are packed: as many rows as terms and blocks, whatever a term's postings; the texts aren't exchanged."""
    texts = [(f"c{i:03d}", "common words " + f"w{i % 3} " * (i % 4)) for i in range(200)]
    chunks = spark.createDataFrame(texts, "chunk_id string, content string").coalesce(1)
    index = lexical.build(chunks, block=100)
    assert index.blocks.where("term is not null").count() == 2 * 5 and index.n_postings == index.postings.count() == 550
    monkeypatch.setattr(lexical, "POSTINGS", 50)
    parted = lexical.build(chunks, block=100)
    assert parted.blocks.where("term is not null").count() > 10
    asked = ask(spark, "w0 common", "w1 w1 w2", "none")
    want = sorted(map(tuple, lexical.search(index, asked, 7).select("query_id", "rank", "chunk_id", "score").collect()))
    for some, skip in ((index, True), (parted, False), (parted, True), (lexical.build(chunks, block=100, by_id=False), False)):
        assert sorted(map(tuple, lexical.search(some, asked, 7, skip=skip).select("query_id", "rank", "chunk_id", "score").collect())) == want
    rows = spark.range(50).selectExpr("id AS chunk_id", "'a b' AS content", "id DIV 10 AS block").sortWithinPartitions("chunk_id")
    assert "Exchange" not in lexical.term_frequencies(rows)._jdf.queryExecution().executedPlan().toString()


def test_only_two_letters_lower_to_other_kinds():
    """Words are cut before they are lower-cased byte by byte: of what is outside ASCII nothing may become an ASCII word."""
    chars = [chr(c) for c in range(1, 0x3000)]
    assert lexical.words("".join(f"A{c}b " for c in chars)) == [w.lower() for c in chars for w in re.findall(r"\w+", f"A{c}b") if w.isascii()]


def test_texts_cut_at_once_have_the_words_of_each(spark):
    """Words don't run from one text into the next, parting characters part them inside a run, and postings are bytes, not arrays."""
    import random

    import pyarrow as pa

    draw = random.Random(1)
    some = ["".join(draw.choice("aAbB_09 .,-\n\x00\x1c\x7fé—ßKİ一\u3000\xa0\u0301Ⅷ²😀٠") for _ in range(draw.choice((0, 1, 3, 10, 40)))) for _ in range(400)]
    texts = pa.array(["cut", None, "ab", "cd", "", "a—b—a", "é", "x", *some, "", None], pa.string())
    for held in (texts, texts.slice(1), texts.slice(3, 1), texts.slice(0, 0), texts.slice(len(texts) - 2)):
        names, code, at, tf, sizes = lexical.counted(held)
        want = {(i, w): found.count(w) for i, found in enumerate(map(lexical.words, held.to_pylist())) for w in found}
        assert dict(zip(zip(at.tolist(), names.take(pa.array(code)).to_pylist()), tf.tolist())) == want and len(code) == len(want)
        assert sizes.tolist() == [len(lexical.words(t)) for t in held.to_pylist()] and set(names.to_pylist()) == {w for _, w in want}
    index = lexical.build(spark.createDataFrame(CHUNKS, "chunk_id string, content string"))
    kinds = dict(index.blocks.dtypes)
    assert {kinds[c] for c in ("places", "tf", "dl")} == {"binary"}
    row = index.blocks.where("term = 'alpha'").first()
    assert (lexical.numbers(pa.array([row["tf"]])).tolist(), lexical.numbers(pa.array([row["dl"]])).tolist()) == ([1], [7])
