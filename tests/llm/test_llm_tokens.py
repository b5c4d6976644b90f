"""Token counts, the streaming transducer and the token store against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import bpe_stream, token_count, token_store
from sparkloom.llm.common import vocabulary

ALPHABET = st.text(alphabet="abthe in.,'!é　\r\n\t▁漢²ΣİßA0_-<|>", max_size=40)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counts():
    return token_count.PieceCounts(vocabulary(token_count.MODEL))


@settings(max_examples=400, deadline=None)
@given(text=ALPHABET)
def test_piece_counts_equal_the_library(counts, text):
    assert token_count.count(text, counts) == len(counts.processor.encode(text))


def test_whole_tokens_are_proved(counts):
    assert counts.proved["the"] == 1 and counts.proved["\n"] == 0
    assert all(len(counts.processor.encode(k)) == 1 for k in random.Random(1).sample([k for k in counts.proved if k and k[0] != "\n"], 500))


def test_table_of_counts_is_emptied(monkeypatch, counts):
    monkeypatch.setattr(token_count, "MOST", len(counts.proved) + 2)
    some = token_count.PieceCounts(vocabulary(token_count.MODEL))
    assert [some[f"zqx{i}"] for i in range(9)] == [len(some.processor.encode(f"zqx{i}")) for i in range(9)]
    assert len(some) <= len(some.proved) + 2


@pytest.mark.parametrize("model", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_transducer_equals_the_library(model):
    library = Tokenizer.from_file(vocabulary(model))
    chunks, decoder = bpe_stream.machines(vocabulary(model))
    rng = random.Random(3)
    texts = ["", " ", "a<|startoftext|>b", "É 漢 ½ 's it's", "\x1cx\x85", "x" * 9000]
    texts += ["".join(rng.choice("abcdeént -.'0\n") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    texts += ["".join(rng.choice(letters) for _ in range(7000)) for letters in ("aetoinh", "ab", "-=_", "éà")]
    for text in texts:
        ids = np.frombuffer(bpe_stream.encoded(text, chunks), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert "".join(bpe_stream.decoded(np.array(ids, "<u4").tobytes(), decoder, step=3)) == library.decode(ids, skip_special_tokens=False), text[:80]


def test_window_stays_bounded(monkeypatch):
    encoder = bpe_stream.Encoder(vocabulary("word_bpe_49k.json"))
    seen = []
    merged = encoder.merged
    monkeypatch.setattr(encoder, "merged", lambda parts: (seen.append(len(parts)), merged(parts))[1])
    assert len(list(encoder.feed(b"hatenion" * 5000))) > 0
    assert max(seen) <= 4 * encoder.lookahead + 1 and len(seen) > 5


def test_lookahead_of_small_lists():
    assert bpe_stream.sufficient_lookahead([("a", "b")]) == 3
    assert bpe_stream.sufficient_lookahead([("b", "c"), ("a", "b"), ("z", "ab")]) == 3 + 3


def test_decoder_holds_broken_bytes():
    decoder = bpe_stream.Decoder(vocabulary("byte_bpe_50k.json"))
    spec = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = spec.encode("漢", add_special_tokens=False).ids
    parts = [decoder.feed([i]) for i in ids]
    assert parts[-1] == "漢" or "".join(parts) + decoder.end() == "漢"
    decoder.start()
    assert decoder.feed(ids[:1]) + decoder.end() == spec.decode(ids[:1])


def test_store_words_equal_the_library(word):
    coder = token_store.LibraryWords(vocabulary("word_bpe_49k.json"))
    rng = random.Random(5)
    signs = [*"abtheing of .,'é漢²ΣİßAÉŁŉǅªº×0½́\x85\x1c_<>~\n\t", "<|startoftext|>", "'s", "--"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += ["a" + chr(c) + "b" for c in range(0x20, 0x300)]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == word.encode(text, add_special_tokens=False).ids, text


def test_cuts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 40_000, 60_000).astype(np.uint16)
    ends = token_store.cuts([ids[:0], ids, np.full(10_000, 7, np.uint16), ids[:1]])
    assert ends[0] == [] and ends[3] == [1]
    for stream, n in ((ends[1], 60_000), (ends[2], 10_000)):
        sizes = np.diff([0, *stream])
        assert stream[-1] == n and sizes.max() <= token_store.MOST and (sizes[:-1] >= token_store.LEAST).all()
    shifted = token_store.cuts([np.concatenate([rng.integers(0, 40_000, 777).astype(np.uint16), ids])])[0]
    assert len({e + 777 for e in ends[1]} & set(shifted)) > 0.8 * len(ends[1])  # cuts follow the content


def test_merkle_and_crc():
    leaves = [bytes([i]) for i in range(5)]
    assert len({token_store.merkle(leaves[:n]) for n in range(6)}) == 6
    assert token_store.merkle(leaves) != token_store.merkle(leaves[::-1])
    parts = [b"abc", b"", b"x" * 1000, b"end"]
    assert token_store.crc_joined((zlib.crc32(p), len(p)) for p in parts) == zlib.crc32(b"".join(parts))


def check_counts(got, rows, counts):
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == sorted(
        ((i or -1, len((t or "").encode()), n := len(counts.processor.encode(t or "")), n > 4096) for i, t, *_ in rows)
    )


def test_counts_of_odd_rows(odd, empty, rows, counts):
    check_counts(token_count.token_counts(odd), rows, counts)
    assert token_count.token_counts(empty).count() == 0


def test_round_trip_of_odd_rows(odd, empty, rows, word):
    def expected(i, text):
        ids = word.encode(text or "", add_special_tokens=False).ids
        back = word.decode(ids, skip_special_tokens=False)
        return (i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())

    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe_stream.round_trip(odd).collect())
    assert got == sorted(expected(i, t) for i, t, *_ in rows)
    assert bpe_stream.round_trip(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in bpe_stream.decode(bpe_stream.encode(odd)).collect()}
    assert texts[10] == "four</w> words</w> only</w> here</w>" and texts[4] == ""


def test_store_of_odd_rows(spark, odd, rows, word, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(odd, path)
    got = sorted((r["start"], r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in token_store.read_store(spark, path).collect())
    start = 0
    streams = {}
    for _, doc, n, crc in got:
        text = next(t for i, t, *_ in rows if (i if i is not None else -1) == doc)
        ids = [*word.encode(text or "", add_special_tokens=False).ids, 1]
        assert (n, crc) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        streams[doc] = ids
        start += n
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert [g[1] for g in got] == sorted(g[1] for g in got) and len(got) == len(rows)
    back = {r["doc_id"] if r["doc_id"] is not None else -1: r["ids"] for r in token_store.read_ids(spark, path).collect()}
    assert back == streams
    chunks = spark.read.parquet(f"{path}/encoded/part=chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert sum(m["n_tokens"] for m in manifest) == start and sum(m["n_docs"] for m in manifest) == len(rows)


def test_store_notices_damage(spark, odd, tmp_path):
    path = f"file://{tmp_path}/s"
    token_store.write_store(odd.where("doc_id = 10"), path)
    from pyspark.sql import functions as F

    bad = spark.read.parquet(f"{path}/encoded/part=chunks").withColumn("ids", F.concat("ids", F.lit(b"\x01\x00"))).collect()
    spark.createDataFrame(bad, spark.read.parquet(f"{path}/encoded/part=chunks").schema).write.mode("overwrite").parquet(f"{path}/encoded/part=chunks")
    with pytest.raises(Exception, match="differs from its digest"):
        token_store.read_store(spark, path).collect()


def test_empty_store(spark, empty, tmp_path):
    token_store.write_store(empty, f"file://{tmp_path}/s")
    assert token_store.read_store(spark, f"file://{tmp_path}/s").count() == 0


def _tampered(kind, recipes):
    rows = sorted(recipes.collect(), key=lambda r: r["place"])
    if kind == "deleted":
        rows = rows[:3] + rows[4:]
    elif kind == "last deleted":
        rows = rows[:-1]
    elif kind == "half deleted":
        rows = rows[::2]
    elif kind == "repeated":
        rows.append(rows[2])
    elif kind == "swapped":
        a, b = rows[1].asDict(), rows[2].asDict()
        for c in ("digests", "root", "n_tokens"):
            a[c], b[c] = b[c], a[c]
        rows[1:3] = [type(rows[0])(**a), type(rows[0])(**b)]
    elif kind == "shifted":
        rows = [type(r)(**(r.asDict() | {"start": r["start"] + 1})) for r in rows]
    elif kind == "run moved":
        rows = [type(r)(**(r.asDict() | {"run": 7})) for r in rows]
    return recipes.sparkSession.createDataFrame(rows, recipes.schema)


@pytest.fixture(scope="module")
def small_store(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('store')}/s"
    token_store.write_store(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40"), f"file://{path}")
    return path


@pytest.mark.parametrize("kind", ["deleted", "last deleted", "half deleted", "repeated", "swapped", "shifted", "run moved"])
def test_recipes_are_held_against_the_manifest(spark, small_store, tmp_path, kind):
    import shutil

    shutil.copytree(small_store, tmp_path / "s")
    path = f"file://{tmp_path}/s"
    assert token_store.read_store(spark, path).count() == token_store.read_ids(spark, path).count() == 40
    changed = _tampered(kind, spark.read.parquet(f"{path}/recipes"))
    shutil.rmtree(tmp_path / "s" / "recipes")
    changed.write.parquet(f"{path}/recipes")
    for read in (token_store.read_store, token_store.read_ids):
        with pytest.raises(Exception, match="manifest|follow"):
            read(spark, path).collect()


def test_a_store_without_its_last_run_is_found_out(spark, tmp_path, monkeypatch):
    import shutil

    monkeypatch.setattr(token_store.run_starts, "__defaults__", (10,))
    path = f"file://{tmp_path}/s"
    token_store.write_store(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40"), path)
    last = spark.read.parquet(f"{path}/manifest").selectExpr("max(run)").first()[0]
    assert last > 1 and token_store.read_store(spark, path).count() == 40
    for name in ("recipes", "manifest"):
        kept = spark.read.parquet(f"{path}/{name}").where(f"run < {last}")
        kept.write.parquet(f"file://{tmp_path}/{name}")
        shutil.rmtree(tmp_path / "s" / name)
        shutil.move(tmp_path / name, tmp_path / "s" / name)
    with pytest.raises(ValueError, match="runs"):
        token_store.read_store(spark, path).collect()


def test_rows_of_one_id_fall_into_several_runs(spark):
    """A null id and one text, 100,000 times, among others."""
    rows = spark.range(130_000).selectExpr("if(id < 100000, null, id) AS doc_id", "cast(if(id < 100000, '', string(id)) AS binary) AS digests", "1L AS n_tokens")
    placed = token_store.run_starts(rows, "doc_id", "n_tokens", ["digests"], 5000)
    counts = sorted(r["count"] for r in placed.groupBy("run").count().collect())
    assert counts[-1] <= 2 * counts[len(counts) // 2] and sum(counts) == 130_000
    ends = placed.selectExpr("count(distinct place) AS n", "min(place) AS a", "max(place) AS b", "sum(int(place <> start)) AS odd", "max(if(doc_id is null, place, -1)) AS last_null").first()
    assert tuple(ends) == (130_000, 0, 129_999, 0, 99_999)


def test_runs_meet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store.run_starts, "__defaults__", (16,))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = f"file://{tmp_path}/s"
    token_store.write_store(docs, path)
    assert spark.read.parquet(f"{path}/manifest").count() > 5
    rows = sorted(map(tuple, token_store.read_store(spark, path).collect()))
    ids = {r["doc_id"]: r["ids"] for r in token_store.read_ids(spark, path).collect()}
    start = 0
    for doc_id, begin, n, crc in rows:
        assert begin == start and len(ids[doc_id]) == n and zlib.crc32(np.array(ids[doc_id], "<u4").tobytes()) == crc
        start += n
    gone = spark.read.parquet(f"{path}/manifest").where("run <> 2").collect()
    with pytest.raises(ValueError, match="manifest"):
        spark.createDataFrame(gone, spark.read.parquet(f"{path}/manifest").schema).write.mode("overwrite").parquet(f"{path}/cut")
        import shutil

        shutil.rmtree(tmp_path / "s" / "manifest")
        shutil.move(tmp_path / "s" / "cut", tmp_path / "s" / "manifest")
        token_store.read_store(spark, path).collect()


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="lower-cased"):
        token_store.LibraryWords(vocabulary("byte_bpe_50k.json"))


def test_worker_tables_are_bounded(word):
    """Tables of two generations give what the machines behind them give, whatever is thrown out on the way."""
    from sparkloom.llm.bpe_stream import Chunks, Encoder

    chunks = Chunks(Encoder(vocabulary("word_bpe_49k.json")))
    chunks.most = 5
    words = [f"w{i % 37},don't{i % 11}" for i in range(300)] + ["é漢字", "x" * 500]
    for w in words:
        assert np.frombuffer(chunks[w], "<u4").tolist() == word.encode(w, add_special_tokens=False).ids
        assert len(chunks) <= 5 and len(chunks.older) <= 5
    coder = token_store.LibraryWords(vocabulary("word_bpe_49k.json"))
    before, token_store.KNOWN = token_store.KNOWN, 20
    try:
        for i in range(0, 300, 10):
            texts = [" ".join(words[i : i + 10]), "", words[i]]
            assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode(texts)] == [word.encode(t, add_special_tokens=False).ids for t in texts]
    finally:
        token_store.KNOWN = before


def test_slices_are_cut_by_bytes():
    import pyarrow as pa

    from sparkloom.llm.common import hashed_words, slices

    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a" * 10, None, "b" * 100, "", "c" * 5, "d" * 5, "e" * 5, "f" * 300, "g"])], names=["i", "t"])
    parts = [p.column(0).to_pylist() for p in slices(batch, rows=4, size=20)]
    assert [x for p in parts for x in p] == list(range(9)) and parts == [[0, 1], [2], [3, 4, 5, 6], [7], [8]]
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 3, 400_000, 1)]
    whole = hashed_words(texts)
    one = [hashed_words([t]) for t in texts]
    assert whole[2].tolist() == [0, 3, 400_000, 1] and (whole[0] == np.concatenate([x[0] for x in one])).all() and (whole[1] == np.concatenate([x[1] for x in one])).all()
