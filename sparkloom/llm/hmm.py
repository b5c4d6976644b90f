"""A hidden Markov language model with Baum-Welch counts summed across partitions.

A token is a word, ASCII letters lower-cased, or the end that follows a text's last word. The commonest words,
FREQUENT at most, emit as themselves; every other word emits as one of RARE classes, by its last
three bytes, and then as itself with its smoothed share of the class. So the emission table is bounded, while
the counts behind the shares cover every word of the corpus and stay distributed.

Baum-Welch: each partition runs scaled forward-backward over its whole training texts and adds up expected
transitions and emissions; Spark sums these by class, and the driver turns the sums, a table of fixed size, into the
next model. The first model is the classes' shares in the corpus, shaken by a hash; the counts of every round come from
every training text, part by part, with a new model after each, and the rounds end when the likelihood settles. Long texts are walked in blocks that
bound the memory, with the recursions carried from block to block.

Scoring is exact: the scaled forward recursion runs over each whole text.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import keyed_text, mix64, read, slices
from sparkloom.session import materialise, table_path

STATES = 8
FREQUENT, RARE = 32_768, 1024
#: Parts of the training texts, by a hash of the text, after each of which the model is renewed.
PARTS = 4
#: Rounds go on until one raises the log likelihood by less than this a token.
SETTLED = 1e-3
#: Tokens that forward-backward holds the states of at once, at most.
HELD = 200_000
#: Texts that go side by side in training.
LANES = 512
#: Steps from one scaling of the recursions to the next: probabilities above 1e-38 a step can't underflow between.
SCALED = 8
#: Tokens, or somewhat more, that a worker gathers before it puts texts of like length together.
POOL = 8_000_000

END = FREQUENT + RARE
CLASSES = END + 1


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes only A-Z change, and 0x20 and 0x09 to 0x0D are white space


def rare_class(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-3:]) % RARE


@dataclass
class Model:
    start: np.ndarray  # (K,)
    move: np.ndarray  # (K, K)
    emit: np.ndarray  # (CLASSES, K)

    @staticmethod
    def first(share: np.ndarray, states: int) -> Model:
        """Emissions near the classes' shares, shaken by a hash; states that tend to stay."""
        grid = np.arange(CLASSES, dtype=np.uint64)[:, None] * np.uint64(64) + np.arange(states, dtype=np.uint64)
        shaken = share[:, None] * (0.5 + (mix64(grid) >> np.uint64(11)) * 2.0**-53)
        move = np.full((states, states), 0.3 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.7 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, shaken / shaken.sum(axis=0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """Expected counts to probabilities, with one pseudo-count spread evenly or, for emissions, by the classes' shares."""
        k = len(start)
        start, move, emit = start + 1 / k, move + 1 / k, emit + share[:, None]
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


_space: dict[str, np.ndarray] = {}


def _buffer(name: str, *shape: int) -> np.ndarray:
    """An array to write over: memory that a worker goes on using from block to block."""
    n = shape[0] * shape[1]
    held = _space.get(name)
    if held is None or held.size < n:
        _space[name] = held = np.empty(max(n, (HELD + HELD // 4) * min(shape)))
    return held[:n].reshape(shape)


def _forward(model: Model, flat: np.ndarray, begin: np.ndarray, alive: np.ndarray, t0: int, before: np.ndarray | None, loglik: np.ndarray):
    """Ids, emissions and scaled forward states of a block's positions, by time, then text; before: the states ahead of it.

    A text's states are divided by their sum every SCALED steps; the logarithms of these sums, and of that at its end, go to its loglik.
    """
    at = np.cumsum(alive) - alive
    owner = np.arange(int(alive.sum()))
    owner -= np.repeat(at, alive)
    place = begin[owner]
    place += np.repeat(np.arange(t0, t0 + len(alive)), alive)
    ids = flat[place]
    states = len(model.start)
    emits = model.emit.take(ids, axis=0, mode="clip", out=_buffer("emits", len(ids), states))
    alpha = _buffer("alpha", len(ids), states)
    for t, (i, n) in enumerate(zip(at.tolist(), alive.tolist())):
        now = alpha[i : i + n]
        if before is None:
            now[:] = model.start
        else:
            np.dot(before[:n], model.move, out=now)
        now *= emits[i : i + n]
        if t % SCALED == 0 or t == len(alive) - 1:
            scale = now.sum(axis=1)
            now /= scale[:, None]
            loglik[:n] += np.log(scale)
        if t and len(before) > n and (t - 1) % SCALED:  # texts that ended at the step before
            loglik[n : len(before)] += np.log(before[n:].sum(axis=1))
        before = now
    return ids, emits, alpha


def _by_length(begin: np.ndarray, size: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """The order of the texts, longest first, their begins in it, how many live at each time, and times cut into blocks of about `held` tokens."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    steps = int(size[0]) if len(size) else 0
    alive = len(size) - np.searchsorted(size[::-1], np.arange(steps), side="right")
    block = (np.cumsum(alive) - alive) // held
    edges = np.flatnonzero(np.diff(block, prepend=-1)).tolist() + [steps]
    return order, begin, alive, list(zip(edges, edges[1:]))


class Counts:
    """Expected counts of one or more batches."""

    def __init__(self, states: int):
        self.start = np.zeros(states)
        self.move = np.zeros((states, states))
        self.emit = np.zeros((CLASSES, states))
        self.loglik = 0.0

    def add(self, model: Model, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, held: int = HELD, lanes: int = LANES) -> None:
        """Forward-backward over the texts flat[begin : begin + size], end to end in lanes, in blocks of about `held` tokens.

        With more than one block the first pass keeps the state at each block's start, and blocks are walked again from the last.
        """
        where, first, last, begin, size = _in_lanes(begin, size, lanes)
        lane = _Lanes(flat[where], first, last, model)
        _, begin, alive, blocks = _by_length(begin, size, held)
        states: list[np.ndarray | None] = [None]
        for t0, t1 in blocks[:-1]:
            alpha = lane.forward(begin, alive[t0:t1], t0, states[-1])[2]
            states.append(alpha[:, alpha.shape[1] - alive[t1 - 1] :].copy())
        ahead = np.zeros((len(model.start), 0))
        for (t0, t1), before in zip(blocks[::-1], states[::-1]):
            ahead = self._block(lane, begin, alive[t0:t1], t0, before, ahead)

    def _block(self, lane: _Lanes, begin: np.ndarray, alive: np.ndarray, t0: int, before: np.ndarray | None, ahead: np.ndarray) -> np.ndarray:
        """Adds a block's counts. ahead: emission times backward state, scaled, at the step after it, zero where a text begins there; returned
        for its first step."""
        ids, emits, alpha, begun, ended, scales = lane.forward(begin, alive, t0, before)
        move = lane.model.move
        self.loglik += scales + float(np.log(alpha[:, ended].sum(axis=0)).sum())
        beta = _buffer("beta", *alpha.shape)
        at = np.cumsum(alive) - alive
        cut = np.searchsorted(ended, np.append(at, len(ids))).tolist()
        last, later = int(at[-1]), ahead
        for t in range(len(alive) - 1, -1, -1):
            i, n, went = int(at[t]), int(alive[t]), ahead.shape[1]
            np.matmul(move, ahead, out=beta[:, i : i + went])
            if went < n:
                beta[:, i + went : i + n] = 1.0
            if cut[t] < cut[t + 1]:
                beta[:, ended[cut[t] : cut[t + 1]]] = 1.0
            ahead = emits[:, i : i + n]
            ahead *= beta[:, i : i + n]
            if t % SCALED == 0:
                ahead /= ahead.sum(axis=0)
        alpha /= np.einsum("kn,kn->n", alpha, beta)  # a position's states sum to one, however its text is scaled there
        emits[:, begun] = 0.0  # no step leads to a text's first token
        self.move += move * (alpha[:, last : last + later.shape[1]] @ later.T)
        width = int(alive[0])
        earlier = np.arange(width, len(ids)) - np.repeat(alive[:-1], alive[1:])  # the same lane's position a step before
        self.move += move * (alpha.take(earlier, axis=1, mode="clip", out=_buffer("earlier", len(alpha), len(earlier))) @ emits[:, width:].T)
        alpha *= beta
        self.start += alpha[:, begun].sum(axis=1)
        for k in range(len(alpha)):
            self.emit[:, k] += np.bincount(ids, alpha[k], minlength=CLASSES)
        return ahead.copy()


def _in_lanes(begin: np.ndarray, size: np.ndarray, lanes: int) -> tuple[np.ndarray, ...]:
    """Texts dealt to `lanes` lanes at most, the longest first, each to the shortest lane: the tokens' places lane by lane, which of them
    begin and end a text, and the lanes' begins and sizes. All steps so have about as many texts going, however long the longest."""
    order = np.argsort(-size, kind="stable")
    heap = [(0, k) for k in range(min(lanes, len(size)))]
    own = np.empty(len(size), np.int64)
    for i, n in zip(order.tolist(), size[order].tolist()):
        load, k = heap[0]
        own[i] = k
        heapq.heapreplace(heap, (load + n, k))
    order = order[np.argsort(own[order], kind="stable")]
    begin, size, own = begin[order], size[order], own[order]
    ends = np.cumsum(size)
    where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    first, last = np.zeros(len(where), bool), np.zeros(len(where), bool)
    first[ends - size] = True
    last[ends - 1] = True
    total = np.bincount(own, size, minlength=len(heap)).astype(np.int64)
    return where, first, last, np.cumsum(total) - total, total


class _Lanes:
    """The ids of lanes, one after the other, which of them begin and end a text, and the model that goes over them, its arrays a row a state."""

    def __init__(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray, model: Model):
        self.flat, self.first, self.last, self.model = flat.astype(np.int64), first, last, model
        self.emit, self.back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)

    def forward(self, begin: np.ndarray, alive: np.ndarray, t0: int, before: np.ndarray | None):
        """Ids, emissions and scaled forward states of a block's positions, by time, then lane, where texts begin and end, and
        the logarithms of the scales; before: the states ahead of it. A text begins with the model's start, whatever was before it in its lane."""
        at = np.cumsum(alive) - alive
        owner = np.arange(int(alive.sum()))
        owner -= np.repeat(at, alive)
        place = begin[owner]
        place += np.repeat(np.arange(t0, t0 + len(alive)), alive)
        ids = self.flat[place]
        begun, ended = np.flatnonzero(self.first[place]), np.flatnonzero(self.last[place])
        cut = np.searchsorted(begun, np.append(at, len(ids))).tolist()
        start, scales = self.model.start[:, None], 0.0
        emits = self.emit.take(ids, axis=1, mode="clip", out=_buffer("emits", len(start), len(ids)))
        alpha = _buffer("alpha", len(start), len(ids))
        for t, (i, n) in enumerate(zip(at.tolist(), alive.tolist())):
            now = alpha[:, i : i + n]
            if before is None:
                now[:] = start
            else:
                np.matmul(self.back, before[:, :n], out=now)
                if cut[t] < cut[t + 1]:
                    alpha[:, begun[cut[t] : cut[t + 1]]] = start
            now *= emits[:, i : i + n]
            if t % SCALED == 0 or t == len(alive) - 1:
                scale = now.sum(axis=0)
                now /= scale
                scales += float(np.log(scale).sum())
            before = now
        return ids, emits, alpha, begun, ended, scales


def log10_likelihoods(model: Model, texts: list[np.ndarray], held: int = HELD) -> np.ndarray:
    """log10 of each whole text's probability, by the scaled forward recursion over all texts at once, in double precision."""
    size = np.array([len(t) for t in texts], np.int64)
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    order, begin, alive, blocks = _by_length(np.cumsum(size) - size, size, held)
    total, before = np.zeros(len(texts)), None
    for t0, t1 in blocks:
        alpha = _forward(model, flat, begin, alive[t0:t1], t0, before, total)[2]
        before = alpha[len(alpha) - alive[t1 - 1] :].copy()
    out = np.empty(len(texts))
    out[order] = total / math.log(10)
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        held.clear()
        return out

    for batch in batches:
        for part in slices(batch):
            for text in part.column(0).to_pylist():
                held.update(tokens(text))
                if len(held) > 500_000:
                    yield flush()
    if held:
        yield flush()


def word_counts(texts: DataFrame) -> DataFrame:
    """word and c over the column text: each task sends a word's count about once."""
    return texts.select("text").mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _least_frequent(counts: DataFrame) -> int:
    """The least count such that at most FREQUENT words have it or more, from a histogram of a few thousand rows."""
    fine = F.col("c") < 4096
    rows = counts.groupBy(F.when(fine, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 4096).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("low")).collect()
    total, least = 0, 1 << 62
    for row in sorted(rows, key=lambda r: -r["low"]):
        total += row["n"]
        if total > FREQUENT:
            break
        least = row["low"]
    return least


def _encode(frequent: dict[bytes, int], log_counts: np.ndarray):
    """Per text its classes, what the frequent words add to the scores, and its rare words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sequences, sums, rare, counts, width = [], [], [], [], [0]
                for text in part.column("text").to_pylist():
                    words = tokens(text)
                    found = np.fromiter(map(frequent.get, words, repeat(FREQUENT)), np.uint16, len(words))
                    unknown = np.flatnonzero(found == FREQUENT).tolist()
                    odd = Counter(words[i] for i in unknown)
                    classes = {w: rare_class(w) for w in odd}
                    sums.append(float(log_counts[found[found < FREQUENT]].sum()))
                    found[unknown] = [classes[words[i]] for i in unknown]
                    sequences.append(np.append(found, np.uint16(END)).astype("<u2").tobytes())
                    rare += odd
                    counts += odd.values()
                    width.append(len(rare))
                words = pa.StructArray.from_arrays([pa.array(rare, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("train"), pa.array(sequences, pa.binary()), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(width, pa.int32()), words)], names=["doc_id", "train", "ids", "known_sum", "rare"])

    return run


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[np.ndarray, list[np.ndarray]]]]]:
    """The rows in pools of about POOL tokens; each with runs of texts of like length, about HELD tokens together: their rows and ids."""

    def pool(table: pa.Table) -> tuple[pa.Table, list[tuple[np.ndarray, list[np.ndarray]]]]:
        texts = [np.frombuffer(x, "<u2") for x in table.column("ids").to_pylist()]
        size = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-size, kind="stable")
        part = (np.cumsum(size[order]) - size[order]) // HELD
        runs = np.split(order, np.flatnonzero(np.diff(part)) + 1)
        return table, [(run, [texts[i] for i in run.tolist()]) for run in runs]

    held, tokens = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        tokens += batch.column("ids").nbytes // 2
        if tokens >= POOL:
            yield pool(pa.Table.from_batches(held))
            held, tokens = [], 0
    if held:
        yield pool(pa.Table.from_batches(held))


def _expected(sent: Broadcast, states: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        counts, some = Counts(states), False
        for _, runs in _pools(batches):
            texts = [x for _, some_ in runs for x in some_]
            size = np.array([len(x) for x in texts], np.int64)
            counts.add(model, np.concatenate(texts), np.cumsum(size) - size, size)
            some = True
        if some:
            hit = np.flatnonzero(counts.emit.any(axis=1))
            # below the classes: the start counts at -1, the transitions from state k at -2 - k, then the log likelihood
            key = np.concatenate([hit, [-1], -2 - np.arange(states + 1)])
            rows = np.concatenate([counts.emit[hit], counts.start[None], counts.move, np.full((1, states), counts.loglik)])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), *(pa.array(rows[:, k]) for k in range(states))], names=["class", *(f"e{k}" for k in range(states))])

    return run


def _sums(texts: DataFrame, model: Model) -> Counts:
    """The expected counts over the rows of texts, summed across partitions."""
    states = len(model.start)
    columns = [f"e{k}" for k in range(states)]
    sent = texts.sparkSession.sparkContext.broadcast(model)  # CLASSES rows of states
    partial = texts.select("ids").mapInArrow(_expected(sent, states), "class int, " + ", ".join(f"{c} double" for c in columns))
    counts = Counts(states)
    table = partial.groupBy("class").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # CLASSES + states + 2 rows at most
    sent.destroy()  # no file of a past model stays
    key, sums = table.column(0).to_numpy(), np.stack([table.column(c).to_numpy() for c in columns], axis=1)
    counts.emit[key[key >= 0]] = sums[key >= 0]
    for k, row in zip(key[key < 0].tolist(), sums[key < 0]):
        if k == -1:
            counts.start[:] = row
        elif k == -2 - states:
            counts.loglik = row[0]
        else:
            counts.move[-2 - k] = row
    return counts


def train(encoded: DataFrame, share: np.ndarray, states: int = STATES, rounds: int | None = None, logliks: list[float] | None = None, parts: int = 1) -> Model:
    """Baum-Welch over the rows of encoded whose train is true, `rounds` times or until the likelihood settles.

    With several parts (the column part, from 0) the model is renewed after each part, from the latest counts of every part: incremental
    expectation maximisation (Neal and Hinton, 1998), whose rounds still go over all texts once, but are fewer. The driver holds
    one table of counts a part. logliks gets the log likelihood of each round, every part's by the model that it met.
    """
    texts = encoded.where("train")
    model, last, n = Model.first(share, states), -np.inf, 0
    held: list[Counts | None] = [None] * parts
    while rounds is None or n < rounds:
        for part in range(parts):
            held[part] = _sums(texts.where(F.col("part") == part) if parts > 1 else texts, model)
            met = [c for c in held if c is not None]
            start, move, emit = (sum(getattr(c, name) for c in met) for name in ("start", "move", "emit"))
            model = Model.from_counts(start, move, emit, share)
        n, loglik = n + 1, sum(c.loglik for c in held)
        if logliks is not None:
            logliks.append(loglik)
        if loglik - last < SETTLED * max(1.0, emit.sum()):
            break
        last = loglik
    return model


def _scored(model: Model, log_class: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, runs in _pools(batches):
            score, n_tokens, n_rare = np.zeros(table.num_rows), np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
            for rows, texts in runs:
                n_tokens[rows] = [len(x) for x in texts]
                flat = np.concatenate(texts)
                odd = (flat >= FREQUENT) & (flat < END)
                owner = np.repeat(rows, n_tokens[rows])[odd]
                n_rare += np.bincount(owner, minlength=table.num_rows)
                score -= np.bincount(owner, log_class[flat[odd] - FREQUENT], minlength=table.num_rows)
                score[rows] += log10_likelihoods(model, texts)
            columns = {c: table.column(c) for c in ("row", "doc_id", "train", "known_sum")} | {"n_tokens": pa.array(n_tokens), "n_rare": pa.array(n_rare), "partial": pa.array(score)}
            yield from pa.table(columns).to_batches()

    return run


def score_documents(docs: DataFrame, states: int = STATES, rounds: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Training texts are those whose crc32 of the doc_id as text, modulo 7, is not 2. Null and empty texts
    are the end token alone; a null doc_id counts as the empty text. Repeated rows train and score as rows of their own. Without training
    texts every count is 0: base_score is 0 and the score that of the untrained model. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7
    texts = keyed_text(docs).withColumn("train", fold != 2)
    counts = materialise(word_counts(texts.where("train")), "word-counts")
    n_train = texts.where("train").select("doc_id").count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    train_tokens, types = n_words + n_train, n_types + (n_train > 0)

    least = _least_frequent(counts)
    top = sorted(counts.where(F.col("c") >= least).collect(), key=lambda r: (-r["c"], r["word"]))  # FREQUENT rows at most
    frequent = {r["word"].encode(): i for i, r in enumerate(top)}
    log_counts = np.log10(np.array([r["c"] for r in top] + [0] * (FREQUENT - len(top)), np.float64) + 1)
    at = F.lit(FREQUENT) + F.crc32(F.expr("right_bytes")) % RARE
    tail = F.col("word").cast("binary")
    size = F.octet_length("word")
    rest = counts.where(F.col("c") < least)
    rest = rest.withColumn("right_bytes", F.substring(tail, F.greatest(size - 2, F.lit(1)), F.lit(3)))
    share = np.zeros(CLASSES)
    share[: len(top)] = [r["c"] for r in top]
    held = np.zeros((RARE, 2))
    for cls, c, v in rest.groupBy(at.alias("class")).agg(F.sum("c"), F.count("*")).collect():  # RARE rows
        held[cls - FREQUENT] = c, v
    share[FREQUENT:END] = held[:, 0]
    share[END] = n_train
    share = (share + 1 / CLASSES) / (share.sum() + 1)
    log_class = np.log10(held.sum(axis=1) + 1)

    encoded = texts.mapInArrow(_encode(frequent, log_counts), f"doc_id {kind}, train boolean, ids binary, known_sum double, rare array<struct<word: string, n: long>>")
    path = table_path(docs.sparkSession, "encoded")
    encoded = encoded.withColumns({"row": F.monotonically_increasing_id(), "part": F.pmod(F.xxhash64("ids"), F.lit(PARTS)).cast("int")})
    encoded.write.partitionBy("part").parquet(path, compression="lz4_raw")
    encoded = docs.sparkSession.read.schema(encoded.schema).parquet(path)
    model = train(encoded, share, states, rounds, parts=PARTS)

    scored = encoded.select("row", "doc_id", "train", "ids", "known_sum").mapInArrow(_scored(model, log_class), f"row long, doc_id {kind}, train boolean, known_sum double, n_tokens long, n_rare long, partial double")
    rare = encoded.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.n")
    # no word here is among the FREQUENT commonest, so no key is hot
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("n").alias("n_met"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    n_met, rare_sum = F.coalesce("n_met", F.lit(0)), F.coalesce("rare_sum", F.lit(0.0))
    log_end, log_all = float(np.log10(n_train + 1)), float(np.log10(train_tokens + types + 1))
    return scored.join(met, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + n_met - F.lit(0 if n_train else 1)).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("known_sum") + rare_sum + F.lit(log_end) - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("partial") + rare_sum).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
