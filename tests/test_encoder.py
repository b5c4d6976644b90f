import numpy as np

from sparkloom.operators import dense, encoder


def texts(n):
    rng = np.random.default_rng(4)
    topics = [[f"w{t}x{i}" for i in range(30)] for t in range(5)]
    return [(i, " ".join(rng.choice(topics[i % 5], 20)) + " common words") for i in range(n)]


def test_directions_are_the_leading_singular_vectors(spark):
    rows = texts(120)
    model = encoder.train(spark.createDataFrame(rows, "chunk_id long, content string").repartition(5), dimension=5)
    row, feature, value = encoder._rows([t for _, t in rows], model.idf)
    matrix = np.zeros((120, encoder.FEATURES))
    matrix[row, feature] = value
    _, singular, v = np.linalg.svd(matrix, full_matrices=False)
    kept = np.linalg.norm(matrix @ model.directions) ** 2
    assert kept >= 0.98 * (singular[:5] ** 2).sum() and np.allclose(model.directions.T @ model.directions, np.eye(5), atol=1e-8)


def test_the_encoder_is_the_same_whatever_the_layout_and_tells_topics_apart(spark):
    table = spark.createDataFrame(texts(100) + [(500, None), (501, "")], "chunk_id long, content string")
    one, other = (encoder.train(table.repartition(n), dimension=5) for n in (1, 7))
    x = one(["w1x1 w1x2", "w1x20 w1x9", "w3x4 w3x5", "", "unknown"])
    y = other(["w1x1 w1x2", "w1x20 w1x9", "w3x4 w3x5", "", "unknown"])
    assert np.allclose(x @ x.T, y @ y.T)
    near = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert near(x[0], x[1]) > 0.8 > 0.5 > near(x[0], x[2]) and not x[3].any()
    rows = dense.encode(table, one, dimension=5).collect()
    assert len(rows) == 102 and {len(r["embedding"]) for r in rows} == {5}


def test_an_encoder_of_nothing(spark):
    model = encoder.train(spark.createDataFrame([], "chunk_id long, content string"), dimension=3)
    assert not model(["a b"]).any()


def test_only_hashes_are_sorted_for_the_sample(spark):
    table = spark.createDataFrame(texts(200), "chunk_id long, content string").repartition(6)
    some = encoder._sample(table, "content", "chunk_id", 50)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    want = [r["content"] for r in table.selectExpr("content", "xxhash64(chunk_id) AS h").orderBy("h").limit(50).collect()]
    assert sorted(r["text"] for r in some.collect()) == sorted(want)


def test_all_chunks_are_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(encoder, "_sample", lambda *_: (_ for _ in ()).throw(AssertionError("a sample")))
    table = spark.createDataFrame(texts(90), "chunk_id long, content string").repartition(3)
    model = encoder.train(table, dimension=5)
    df = np.bincount([f for _, t in texts(90) for f in {encoder._feature(w) for w in t.split()}], minlength=encoder.FEATURES)
    assert np.allclose(model.idf, np.log(91 / (df + 1)) + 1)


def test_a_sample_is_only_taken_if_asked_for(spark):
    table = spark.createDataFrame(texts(90), "chunk_id long, content string").repartition(3)
    assert (encoder.train(table, dimension=5, sample=20).idf != encoder.train(table, dimension=5).idf).any()


def test_many_texts_are_encoded_block_by_block():
    model = encoder.TrainedEncoder(np.ones(encoder.FEATURES), np.random.default_rng(1).normal(size=(encoder.FEATURES, 3)))
    some = [f"word{i} word{i % 7} word" for i in range(2 * encoder.BLOCK + 5)]
    assert np.allclose(model(some), np.concatenate([model([t]) for t in some])) and model([]).shape == (0, 3)
