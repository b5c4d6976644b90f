"""What the corpus operators share: reading, vocabulary files, Arrow row plumbing, hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str, path: str | None = None) -> str:
    """The place of a public vocabulary file: path if given, else by its name."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def keyed_text(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, the text with null read as empty, and the further columns; nothing else."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *columns)


#: Bytes of strings and binaries in a slice of rows, unless one row alone has more.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, rows: int = 1000, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive slices of at most `rows` rows and `size` bytes of strings and binaries, one row at least."""
    n = batch.num_rows
    held = np.zeros(n, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            held += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(held)
    at = 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def by_batch(df: DataFrame, make: Callable[[dict[str, list]], dict], schema: str, rows: int = 2000) -> DataFrame:
    """df with each Arrow batch, cut into slices of at most `rows` rows and SLICE bytes, passed through make().

    make gets a dict of Python lists by column and returns a dict of lists, NumPy or
    Arrow arrays by output column. Slices bound the memory of one step.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                read = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                out = make(read)
                # a column handed on as it came keeps its type
                columns = [part.column(names.index(n)) if x is read.get(n) else x if isinstance(x, pa.Array) else pa.array(x) for n, x in out.items()]
                yield pa.RecordBatch.from_arrays(columns, names=list(out))

    return df.mapInArrow(run, schema)


_resident: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]) -> object:
    """What make() gives, kept in this process until another key is asked for.

    Python workers live from stage to stage; so one holds the tables of one operator at a time.
    """
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


class Recent(dict):
    """A table of what was met lately: of two generations of `most` entries the older goes when the younger is full.

    A subclass gives the value of a new key by make(); keys longer than LONGEST are not kept.
    """

    LONGEST = 48

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def make(self, key):
        raise NotImplementedError

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.LONGEST:
                return value
        self.keep(key, value)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection on 64-bit integers that scatters all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_POWER), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64 for i below n, of one fixed odd r; tables beyond two slices' length are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = 1 << int(n - 1).bit_length()
    made = []
    for base in (_POWER, _INVERSE):
        out = np.full(size, base, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out))
    if size <= 2 * SLICE:
        _powers[:] = made
    return made[0][:n], made[1][:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(joined: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end at white space."""
    at = 0
    while at < len(joined):
        found = _GAP.search(joined, at + SLICE) if at + SLICE < len(joined) else None
        stop = found.start() if found else len(joined)
        yield at, stop
        at = stop


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, the words' bytes, and the number of words of each text.

    Array operations over the UTF-8 bytes, block by block: a polynomial in the bytes of
    each word from prefix sums modulo 2^64, then scattered with the word's length.
    """
    parts = [t.encode() for t in texts]
    joined = b"\n".join(parts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at, stop in _blocks(joined):
        raw = np.frombuffer(joined, np.uint8, stop - at, at)
        edge = np.flatnonzero(np.diff(SPACE[raw], prepend=True, append=True))
        start, end = edge[0::2], edge[1::2]
        power, inverse = powers(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
        out = (total[end] - total[start]) * inverse[start]
        found.append((mix64(out ^ mix64((end - start).astype(np.uint64))), end - start, start + at))
    out, lengths, starts = map(np.concatenate, zip(*found))
    limits = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    return out, lengths, np.diff(np.searchsorted(starts, limits), prepend=0)


def shingles(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `width` words inside each text, and their number by text.

    A text of 1 to width-1 words has one shingle, of all its words; one without words has none.
    """
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    length = np.minimum(counts[owner], width)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        piece = mix64(padded[at + k] + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF))
        out += np.where(k < length, piece, np.uint64(0))
    return mix64(out + length.astype(np.uint64)), n


def lookup(rows: DataFrame, table: DataFrame, on: list[str], uses: str, total: int, share: int = 1000) -> DataFrame:
    """rows with the further columns of table, which has a row a key `on` at most; they are null where it has none, or a null key.

    `uses` is table's count of the rows with that key, `total` that of all rows. Keys of more than one in `share` of the rows,
    so `share` keys at most, are broadcast; the others are shuffled, and null keys stay where they are: no task gets a hot key's rows.
    """
    given = F.lit(True)
    for c in on:
        given &= F.col(c).isNotNull()
    hot = F.broadcast(table.where(F.col(uses) * share > total).drop(uses))
    rest = table.where(F.col(uses) * share <= total).drop(uses)
    found = rows.join(hot, on)
    others = rows.where(given).join(hot.select(*on), on, "left_anti").join(rest, on, "left")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in rest.schema if f.name not in on]
    return found.unionByName(others).unionByName(rows.where(~given).select(*found.columns[: len(rows.columns)], *blank))
