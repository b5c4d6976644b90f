"""A content-addressed store of token ids.

`write_store` encodes documents, cuts each id stream where a rolling hash of the
last ids says so, and stores every distinct chunk once under its digest.
Documents are kept as recipes: the digests of their chunks in order, with the
Merkle root over them. A manifest row for each run of documents holds its Merkle
root over the documents' roots and the place of its ids in the whole stream,
which is in ascending doc_id order. `read_store` and `read_ids` read the files back and verify them: every chunk against its
digest, every recipe against its root, and every run's recipes against the manifest: their number, their order, where
each begins, their ids and the root over them. A chunk, recipe or run that is missing, repeated or altered raises.

Layout below one folder, all Parquet:

    encoded/part=chunks/  key binary(16), the digest, and ids binary: little-endian unsigned 16- or 32-bit integers
    recipes/   doc_id, run int, place long, start long, n_tokens long, digests binary (16 bytes each), root binary
    manifest/  run int, first_doc, last_doc, n_docs long, place long, start long, n_tokens long, root binary, width int
    store/     one row: n_runs long and root binary, over the roots of the runs
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkloom.llm.common import SPACE, keyed_text, mix64, powers, read, resident, slices, vocabulary
from sparkloom.session import materialise, table_path

MODEL = "word_bpe_49k.json"
END_ID = 1
#: Chunk lengths in ids: a cut is looked for from LEAST on, comes after MEAN more on average, and is forced at MOST.
LEAST, MEAN, MOST = 64, 512, 4096
#: Ids that the rolling hash sees.
SPAN = 12
DIGEST = 16
#: Pre-tokens in each of the two generations that a worker keeps, and the longest of them.
KNOWN, LONGEST = 250_000, 48


#: Kinds of the bytes of a lower-cased text in plain Latin script: white space, letters, digits, the rest.
GAP, LETTER, DIGIT, SIGN = range(4)
_KIND = np.full(256, SIGN, np.int8)
_KIND[SPACE] = GAP
_KIND[ord("a") : ord("z") + 1] = LETTER
_KIND[0x80:] = LETTER
_KIND[ord("0") : ord("9") + 1] = DIGIT
#: What the array path can't cut: other scripts, signs and modifiers beyond ASCII, control characters, and the
#: apostrophes of contractions and the brackets of special tokens, which have rules of their own.
_HARD = re.compile("[^\n\x0b\x0c\r\t\x20-\x26\x28-\x3b\x3d-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u01ba]")
#: A number for each byte, twice: pre-tokens are hashed as polynomials in the first and sums of the second.
BYTE_HASHES = [mix64(np.arange(256, dtype=np.uint64) + np.uint64(k << 20)) for k in (1, 2)]


class LibraryWords:
    """Ids of texts by the tokenizers library, which sees each distinct pre-token about once a worker.

    A text in plain Latin script is cut into pre-tokens by array operations over a batch's bytes, as the vocabulary's own
    splitting does: runs of letters, single digits, runs of other signs. New ones are encoded many in one call; each ends
    with the one token that bears the word-end mark, which tells them apart. The library cuts and encodes any other text itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        if spec["model"].get("end_of_word_suffix") != "</w>" or '"Lowercase"' not in json.dumps(spec["normalizer"]):
            raise ValueError(f"{path}: the store's cutting is made for lower-cased words that end in </w>")
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.ends = np.zeros(size, bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def width_of(path: str) -> int:
        """The bytes of an id."""
        return LibraryWords(path).width

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        """Add the packed ids of new pre-tokens, which are lower-cased."""
        for at in range(0, len(pieces), 256):
            part = pieces[at : at + 256]
            ids = np.array(self._ids([b" ".join(part).decode()])[0], f"<u{self.width}")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            raw = ids.tobytes()
            self.known |= zip(part, map(raw.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        hard = [i for i, t in enumerate(texts) if _HARD.search(t)]
        easy = texts
        if hard:
            easy = list(texts)
            for i in hard:
                easy[i] = ""
        parts = [t.lower().encode() for t in easy]
        joined = b"\n".join(parts)
        start, size, kind, first = distinct_pieces(joined)
        pieces = [joined[i : i + n] for i, n in zip(start[first].tolist(), size[first].tolist())]
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, pieces))
        if None in found:
            again = {w: self.older[w] for w, x in zip(pieces, found) if x is None and w in self.older}
            if again:
                self.known |= again
                found = list(map(self.known.get, pieces))
        if None in found:
            self.learn([w for w, x in zip(pieces, found) if x is None])
            found = list(map(self.known.__getitem__, pieces))
            for w in pieces:
                if len(w) > LONGEST:
                    self.known.pop(w)
        flat = np.frombuffer(b"".join(found), f"<u{self.width}")
        length = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        n = length[kind]
        end = np.cumsum(n)
        shift = (np.cumsum(length) - length)[kind] - (end - n)
        ids = flat[np.repeat(shift, n) + np.arange(int(n.sum()))].tobytes()
        limits = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        stops = (np.concatenate([[0], end])[np.searchsorted(start, limits)] * self.width).tolist()
        out = list(map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)))
        for i, found_ids in zip(hard, self._ids([texts[i] for i in hard])):
            out[i] = self.pack(found_ids)
        return out


def distinct_pieces(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size of every pre-token, the number of its distinct piece, and where each distinct piece comes first.

    Pieces are told apart by 64-bit hashes of their bytes; a second number and the size confirm that equal ones are equal.
    """
    raw = np.frombuffer(joined, np.uint8)
    byte_kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, bool)
    np.not_equal(byte_kind[1:], byte_kind[:-1], out=edge[1:-1])
    edge[:-1] |= byte_kind == DIGIT
    bound = np.flatnonzero(edge)
    start, end = bound[:-1], bound[1:]
    inside = byte_kind[start] != GAP
    start, end = start[inside], end[inside]
    power, inverse = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    weighted = BYTE_HASHES[0][raw]
    weighted *= power[: len(raw)]
    np.cumsum(weighted, out=total[1:])
    hashed = (total[end] - total[start]) * inverse[start]
    np.cumsum(BYTE_HASHES[1][raw], out=total[1:])
    check = total[end] - total[start]
    size = end - start
    order = np.argsort(hashed)
    ranked = hashed[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = order[new]
    if not ((check == check[first][kind]) & (size == size[first][kind])).all():
        raise ValueError("two pre-tokens have one hash")
    return start, size, kind, first


def cuts(streams: list[np.ndarray]) -> list[list[int]]:
    """The ends of the chunks of each id stream; the last is its length.

    A position is a candidate where the hash of the SPAN ids up to it is below a threshold, which is one in
    MEAN; that hash depends on those ids alone, so equal passages are cut alike, wherever they stand.
    """
    flat = np.concatenate([*streams, np.zeros(0, np.uint16)])
    power, inverse = powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mix64(flat) * power[: len(flat)], out=total[1:])
    rolled = (total[SPAN:] - total[:-SPAN]) * inverse[: max(0, len(flat) + 1 - SPAN)]
    spots = np.flatnonzero(mix64(rolled) < np.uint64((1 << 64) // MEAN)) + SPAN
    ends = np.cumsum([len(x) for x in streams]) if streams else np.zeros(0, np.int64)
    first = np.searchsorted(spots, ends - [len(x) for x in streams], side="right").tolist()
    last = np.searchsorted(spots, ends, side="right").tolist()
    spots = spots.tolist()
    return [_ends(len(x), [p - (int(end) - len(x)) for p in spots[i:j]]) for x, end, i, j in zip(streams, ends, first, last)]


def _ends(n: int, spots: list[int]) -> list[int]:
    """Of the candidates those that leave no chunk below LEAST or above MOST."""
    out, last = [], 0
    for spot in spots:
        if spot < SPAN:  # the hash would reach into the stream before
            continue
        while spot - last > MOST:
            last += MOST
            out.append(last)
        if spot - last >= LEAST:
            last = spot
            out.append(last)
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up as it is, and leaves and inner nodes are told apart."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + a + b) for a, b in zip(level[::2], level[1::2])] + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def split(data: bytes) -> list[bytes]:
    return [data[i : i + DIGEST] for i in range(0, len(data), DIGEST)]


_ROWS = "key binary, doc_id {}, n_tokens long, ids binary, digests binary"


def _encode_rows(place: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = resident(("library", place), lambda: LibraryWords(place)), set()
        end, kind = coder.pack([end_id]), f"<u{coder.width}"
        for batch in batches:
            for part in slices(batch):
                rows: tuple[list, ...] = ([], [], [], [], [])
                streams = [raw + end for raw in coder.encode(part.column(1).to_pylist())]
                stops = cuts([np.frombuffer(raw, kind) for raw in streams])
                for doc, raw, ends in zip(part.column(0).to_pylist(), streams, stops):
                    names, begin = [], 0
                    for stop in ends:
                        data = raw[begin * coder.width : stop * coder.width]
                        names.append(name := digest(data))
                        if name not in seen:  # a task sends a chunk once, or so: the rest is done after the shuffle
                            if len(seen) > 500_000:
                                seen.clear()
                            seen.add(name)
                            for out, x in zip(rows, (name, None, len(data) // coder.width, data, None)):
                                out.append(x)
                        begin = stop
                    recipe = b"".join(names)
                    for out, x in zip(rows, (digest(recipe + repr(doc).encode()), doc, len(raw) // coder.width, None, recipe)):
                        out.append(x)
                arrays = [pa.array(rows[0], pa.binary()), pa.array(rows[1], batch.schema.field(0).type), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "doc_id", "n_tokens", "ids", "digests"])

    return run


def write_store(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary_path: str | None = None) -> None:
    """Encode docs, append end_id to each and write the store's three tables below path.

    A null text is empty: its stream is end_id alone. Rows of one doc_id are all stored, in the
    order of a hash of their digests. An empty table gives empty tables. Other columns are not read.
    """
    spark = docs.sparkSession
    place = vocabulary(MODEL, vocabulary_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed_text(docs).mapInArrow(_encode_rows(place, end_id), _ROWS.format(kind))
    # the first row of each chunk, and all recipes; a task sends a chunk about once, so no key is hot
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("digests").isNotNull()))
    dealt = rows.repartition(parts, "key").withColumn("nth", nth).where("nth = 1 or digests is not null").drop("nth")
    dealt.withColumn("part", F.when(F.col("digests").isNull(), "chunks").otherwise("found")).write.partitionBy("part").parquet(f"{path}/encoded", compression="zstd")
    found = spark.read.schema(rows.schema).parquet(f"{path}/encoded/part=found").select("doc_id", "n_tokens", "digests") if _exists(spark, f"{path}/encoded/part=found") else spark.createDataFrame([], rows.select("doc_id", "n_tokens", "digests").schema)
    placed = run_starts(found, "doc_id", "n_tokens", ["digests"])
    rooted = placed.mapInArrow(_rooted, T.StructType([*placed.schema.fields, T.StructField("root", T.BinaryType())]))
    rooted.write.parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    width = F.lit(LibraryWords.width_of(place))
    ends = recipes.groupBy("run").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    rooted = _run_roots(recipes).join(ends, "run")
    rooted.select("run", "first_doc", "last_doc", "n_docs", "place", "start", "n_tokens", "root", width.alias("width")).write.parquet(f"{path}/manifest")
    _store_root(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/store")


_RUN_ROOTS = "run int, n_docs long, place long, start long, n_tokens long, root binary"


def _run_roots(recipes: DataFrame) -> DataFrame:
    """Per run its documents' number, first place and start, ids and the root over their roots; raises where places or starts don't follow.

    A run has about ROWS_A_RUN documents, of which only their roots, 16 bytes each, and three numbers come together.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, start, n = (table.column(c).to_numpy() for c in ("place", "start", "n_tokens"))
        if (np.diff(place) != 1).any() or (start[1:] != start[:-1] + n[:-1]).any():
            raise ValueError("the documents of a run don't follow each other")
        root = merkle(table.column("root").to_pylist())
        return pa.table({"run": table.column("run")[:1], "n_docs": [len(place)], "place": place[:1], "start": start[:1], "n_tokens": [int(n.sum())], "root": pa.array([root], pa.binary())})

    return recipes.select("run", "place", "start", "n_tokens", "root").groupBy("run").applyInArrow(one, _RUN_ROOTS)


def _store_root(manifest: DataFrame) -> DataFrame:
    """One row: how many runs there are, and the root over their roots. A run is a few bytes for every ROWS_A_RUN documents."""

    def one(table: pa.Table) -> pa.Table:
        return pa.table({"n_runs": pa.array([table.num_rows], pa.int64()), "root": pa.array([merkle(table.sort_by("run").column("root").to_pylist())], pa.binary())})

    found = manifest.select("run", "root").groupBy().applyInArrow(one, "n_runs long, root binary")
    none = manifest.sparkSession.createDataFrame([(0, None)], "n_runs long, root binary")
    return none.join(found.select(F.col("n_runs").alias("n"), F.col("root").alias("r")), F.lit(True), "left").select(F.coalesce("n", "n_runs").alias("n_runs"), F.coalesce("r", "root").alias("root"))


def verify_manifest(spark: SparkSession, path: str) -> int:
    """Hold the recipes against the manifest, and the manifest's runs against each other; gives the bytes of an id. Raises ValueError at a difference."""
    kept = spark.read.parquet(f"{path}/manifest")
    whole, now = (t.select("n_runs", "root").first() for t in (spark.read.parquet(f"{path}/store"), _store_root(kept)))
    if whole != now:
        raise ValueError(f"the manifest has {now['n_runs']} runs of another root than the store's {whole['n_runs']}")
    names = ["n_docs", "place", "start", "n_tokens", "root"]
    found = _run_roots(spark.read.parquet(f"{path}/recipes")).select("run", *(F.col(c).alias(f"found_{c}") for c in names))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"found_{c}")) for c in names))
    before = Window.orderBy("run")  # a row a run
    bad = kept.join(found, "run", "full_outer").where(~F.coalesce(same, F.lit(False)))
    problems = sorted(r["run"] for r in bad.select("run").limit(5).collect())
    if problems:
        raise ValueError(f"the recipes differ from the manifest in runs {problems}")
    place, start = F.lag(F.col("place") + F.col("n_docs"), 1, 0).over(before), F.lag(F.col("start") + F.col("n_tokens"), 1, 0).over(before)
    gaps = kept.withColumns({"next_place": place, "next_start": start}).where("place <> next_place or start <> next_start")
    if not gaps.isEmpty():
        raise ValueError("the manifest's runs don't follow each other")
    return kept.agg(F.max("width")).first()[0] or 4


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle(split(x)) for x in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, "root"])


#: Documents of a run, or somewhat more.
ROWS_A_RUN = 50_000


def run_starts(df: DataFrame, order: str, size: str, others: list[str], rows_a_run: int = ROWS_A_RUN) -> DataFrame:
    """df with run, place and start: a prefix sum of `size` over all rows in the order of `order`.

    The rows are cut into runs by range, each summed within itself; only one total a run,
    a few bytes for every `rows_a_run` rows, is summed across runs. No task sorts more than a run.
    Ties are in the order of a hash of the other columns, and many equal rows are cut, too.
    """
    n = df.count()
    runs = n // rows_a_run + 1
    tied = df.withColumns({"_tie": F.xxhash64(*others), "_salt": F.xxhash64(F.monotonically_increasing_id())})
    ranged = tied.repartitionByRange(runs, F.col(order).asc_nulls_first(), "_tie", "_salt").withColumn("run", F.spark_partition_id()).drop("_salt")
    kept = materialise(ranged, "runs")
    totals = kept.groupBy("run").agg(F.sum(size).alias("_total"), F.count("*").alias("_rows"))
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # over one row a run
    totals = totals.select("run", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_place"))
    inside = Window.partitionBy("run").orderBy(F.col(order).asc_nulls_first(), "_tie", *others)
    return (
        kept.withColumn("_n", F.row_number().over(inside) - 1)
        .withColumn("_sum", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(totals, "run")
        .select(order, "run", (F.col("_place") + F.col("_n")).cast("long").alias("place"), (F.col("_start") + F.col("_sum")).cast("long").alias("start"), size, *others)
    )


def crc_table(power: int) -> np.ndarray:
    """4 x 256 lookups that carry a CRC-32 over 2^power zero bytes."""
    columns = np.array([1 << i for i in range(32)], np.uint64)
    step = np.array([0xEDB88320, *(1 << i for i in range(31))], np.uint64)  # one zero bit

    def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.array([np.bitwise_xor.reduce(a[[i for i in range(32) if int(x) >> i & 1]]) if int(x) else 0 for x in b], np.uint64)

    for _ in range(power + 3):
        step = times(step, step)
    out = np.zeros((4, 256), np.uint64)
    for k in range(4):
        for v in range(256):
            bits = [8 * k + i for i in range(8) if v >> i & 1]
            out[k, v] = np.bitwise_xor.reduce(step[bits]) if bits else 0
    assert len(columns) == 32
    return out


_crc_tables: dict[int, list[list[int]]] = {}


def crc_over(crc: int, n_bytes: int) -> int:
    """The CRC register carried over n_bytes zero bytes (without the usual inversions)."""
    power = 0
    while n_bytes:
        if n_bytes & 1:
            if power not in _crc_tables:
                _crc_tables[power] = crc_table(power).astype(int).tolist()
            a, b, c, d = _crc_tables[power]
            crc = a[crc & 255] ^ b[crc >> 8 & 255] ^ c[crc >> 16 & 255] ^ d[crc >> 24]
        n_bytes >>= 1
        power += 1
    return crc


def crc_joined(parts: Iterable[tuple[int, int]]) -> int:
    """The CRC-32 of pieces joined, from each piece's CRC-32 and number of bytes."""
    out = 0
    for crc, n_bytes in parts:
        out = crc_over(out, n_bytes) ^ crc
    return out


def _verify_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, data = batch.column(0).to_pylist(), batch.column(1)
            ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            held = memoryview(data.buffers()[2])[int(ends[0]) : int(ends[-1])]
            wide = held if width == 4 else memoryview(np.frombuffer(held, "<u2").astype("<u4").view(np.uint8))
            scale = 4 // width
            ends = (ends - ends[0]).tolist()
            spans = list(zip(ends, ends[1:]))
            if any(digest(held[i:j]) != k for k, (i, j) in zip(keys, spans)):
                raise ValueError("a chunk differs from its digest")
            crcs = [zlib.crc32(wide[i * scale : j * scale]) for i, j in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array([(j - i) // width for i, j in spans], pa.int64())], names=["digest", "crc", "n"])

    return run


def _verify_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, pieces = [], batch.column("pieces")
        crcs, sizes = (pieces.flatten().field(k).to_pylist() for k in ("crc", "n"))
        first = 0
        for digests, root, n_tokens in zip(*(batch.column(c).to_pylist() for c in ("digests", "root", "n_tokens"))):
            if merkle(split(digests)) != root:
                raise ValueError("a recipe differs from its Merkle root")
            last = first + len(digests) // DIGEST
            if sum(sizes[first:last]) != n_tokens:
                raise ValueError("a document's chunks don't add up to its length")
            out.append(crc_joined(zip(crcs[first:last], (4 * n for n in sizes[first:last]))))
            first = last
        if first != len(sizes):
            raise ValueError("a document's chunks don't add up to its recipe")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32; raises where a digest, root or the manifest differs.

    Each chunk's ids are read once and turned into a CRC and a length; documents are put
    together from those, so the payload of a chunk that many documents share is never copied to them.
    """
    width = verify_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    if recipes.isEmpty():
        return recipes.select("doc_id", "start", "n_tokens", F.lit(0).cast("long").alias("ids_crc32"))
    chunks = spark.read.parquet(f"{path}/encoded/part=chunks").select(F.col("key").alias("digest"), "ids")
    facts = materialise(chunks.mapInArrow(_verify_chunks(width), "digest binary, crc long, n long"), "chunk-facts")
    n = (F.octet_length("digests") / DIGEST).cast("int")
    uses = recipes.select("place", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("digests", i * DIGEST + 1, DIGEST))).alias("seq", "digest"))
    pieces = uses.join(facts, "digest", "left").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("crc", F.lit(-1)).alias("crc"), F.coalesce("n", F.lit(-1)).alias("n")))).alias("pieces"))
    whole = recipes.join(pieces, "place")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    return whole.select("doc_id", "start", "n_tokens", "digests", "root", "pieces").mapInArrow(_verify_docs, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _rebuilt(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digests, n_tokens, root, pieces in zip(*(batch.column(c).to_pylist() for c in ("digests", "n_tokens", "root", "pieces"))):
                wanted, parts = split(digests), [p["ids"] for p in pieces]
                if merkle(wanted) != root or [digest(p or b"") for p in parts] != wanted:
                    raise ValueError("a chunk differs from its digest, or a recipe from its Merkle root")
                ids = np.frombuffer(b"".join(parts), f"<u{width}")
                if len(ids) != n_tokens:
                    raise ValueError("a document's chunks don't add up to its length")
                out.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return run


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids (array of int) of every document, rebuilt from its chunks and verified like read_store's."""
    width = verify_manifest(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    kind = recipes.schema["doc_id"].dataType.simpleString()
    if recipes.isEmpty():
        return recipes.select("doc_id", "start", F.array().cast("array<int>").alias("ids"))
    chunks = spark.read.parquet(f"{path}/encoded/part=chunks").select(F.col("key").alias("digest"), "ids")
    n = (F.octet_length("digests") / DIGEST).cast("int")
    uses = recipes.select("place", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("digests", i * DIGEST + 1, DIGEST))).alias("seq", "digest"))
    pieces = uses.join(chunks, "digest", "left").groupBy("place").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("pieces"))
    whole = recipes.join(pieces, "place").select("doc_id", "start", "n_tokens", "digests", "root", "pieces")
    return whole.mapInArrow(_rebuilt(width), f"doc_id {kind}, start long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-store")
    write_store(read(spark, sf_dir, "documents"), path)
    return read_store(spark, path)
