"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding. `sufficient_lookahead` reads the merge list once and bounds how far left
a change of the text right of a position can reach: a change moves left only
through merges (u, t) of ever later rank, each of whose right part t begins at
the boundary reached so far, so the longest such chain of left parts is enough.
`Encoder.feed` keeps a window of a few lookaheads, merges it, emits the tokens
that lie left of the lookahead and keeps the rest: memory stays constant however
long a word is. At a word's end everything left is stable.

Decoding. `Decoder` turns ids into text one at a time. A byte-level vocabulary
goes through an incremental UTF-8 state machine that holds at most three bytes;
a vocabulary whose file names no decoder yields its token strings with a space
between, as its library does.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from sparkloom.llm.common import WORD, Recent, by_batch, keyed_text, read, resident, vocabulary

MODEL = "word_bpe_49k.json"
#: Words in each of the two generations of a worker's table of known words.
MOST = 150_000
#: From this character on the library itself splits the text.
BEYOND = "\u0530"
_NONE = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for the characters from U+0100 in byte order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Symbols right of a position that settle all tokens left of it, for this merge list.

    Merges from the last rank to the first: reach(r) = |left part of r| + the largest reach
    of a later merge whose right part begins with that left part. The longest
    token is added, as a token may itself straddle the position.
    """
    best: dict[str, int] = {}
    most = longest = 0
    for left, right in reversed(merges):
        reach = len(left) + best.get(left, 0)
        most, longest = max(most, reach), max(longest, len(left) + len(right))
        for end in range(1, len(right) + 1):
            if best.get(part := right[:end], 0) < reach:
                best[part] = reach
    return most + longest


class Encoder:
    """The streaming transducer of one vocabulary file."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.lower = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.compose = '"NFC"' in json.dumps(spec["normalizer"])
        #: The library that owns the file; it normalises and splits what lies beyond the scripts below.
        self.library = Tokenizer.from_file(path)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if self.suffix else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        # a word's end counts as part of its last symbol, so lengths are those of the symbols
        self.lookahead = sufficient_lookahead([(a.removesuffix(self.suffix) if self.suffix else a, b.removesuffix(self.suffix) if self.suffix else b) for a, b in merges])
        ids = self.vocab
        self.pairs = {ids[a] << 20 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in reversed(list(enumerate(merges)))}
        signs = byte_alphabet()
        self.byte = {c: b for b, c in enumerate(signs)}
        self.inner = [ids[c] for c in signs]
        self.final = [ids[c + self.suffix] for c in signs]
        self.width = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in ids.items()}

    def merged(self, parts: list[int]) -> list[int]:
        """The symbols with all merges applied, lowest rank and then leftmost first."""
        pairs = self.pairs.get
        ranks = [pairs(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            parts[i : i + 2] = [least & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs(parts[i - 1] << 20 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = pairs(parts[i] << 20 | parts[i + 1], _NONE)
        return parts

    def feed(self, word: bytes) -> Iterator[int]:
        """The ids of one pre-token, from a window of at most four lookaheads of symbols."""
        inner, size = self.inner, 4 * self.lookahead
        last = len(word) - 1
        if last < size:
            yield from self.merged([inner[b] for b in word[:-1]] + [self.final[word[last]]])
            return
        window: list[int] = []
        at = 0
        while at < last:
            take = min(size - len(window), last - at)
            window += [inner[b] for b in word[at : at + take]]
            at += take
            if at == last:
                break
            settled, out = len(window) - self.lookahead, 0
            for token in self.merged(window[:]):
                if out + self.width[token] > settled:
                    break
                out += self.width[token]
                yield token
            window = window[out:]
        yield from self.merged([*window, self.final[word[last]]])

    def plain(self, text: str) -> Iterator[int]:
        """The ids of a text without special strings."""
        if text and max(text) >= BEYOND:  # releases of Unicode differ there in what a letter is
            if self.library.normalizer:
                text = self.library.normalizer.normalize_str(text)
            for signs, _ in self.library.pre_tokenizer.pre_tokenize_str(text):
                yield from self.feed(bytes(self.byte[c] for c in signs))
            return
        if self.compose and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        for found in self.words.finditer(text):
            yield from self.feed(found[0].encode())

    def encode(self, text: str) -> Iterator[int]:
        """The ids of the text; strings of special tokens give their ids, as the library's default is."""
        at = 0
        for found in self.cut.finditer(text):
            yield from self.plain(text[at : found.start()])
            yield self.special[found[0]]
            at = found.end()
        yield from self.plain(text[at:])


class Decoder:
    """An incremental machine from ids to text: feed() gives what has become certain, end() the rest."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if self.bytewise:
            byte = {c: b for b, c in enumerate(byte_alphabet())}
            self.pieces = {i: bytes(byte[c] for c in t) for i, t in tokens.items()} | {i: t.encode() for i, t in self.special.items()}
        else:
            self.pieces = tokens | self.special
        self.start()

    def start(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: Iterable[int]) -> str:
        if self.bytewise:
            return self.machine.decode(b"".join(map(self.pieces.__getitem__, ids)))
        out = " ".join(map(self.pieces.__getitem__, ids))
        if out and self.begun:
            out = " " + out
        self.begun = self.begun or bool(out)
        return out

    def end(self) -> str:
        return self.machine.decode(b"", True)


class Chunks(Recent):
    """The ids, as little-endian unsigned 32-bit integers, of the words met lately.

    No pre-token of a vocabulary with word ends crosses white space, so a text's ids
    are those of its words in turn.
    """

    def __init__(self, encoder: Encoder):
        super().__init__(MOST)
        self.encoder = encoder
        #: the same pattern for ASCII words, which need no Unicode classes
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 \t-\r]+").findall

    def make(self, word: str) -> bytes:
        encoder = self.encoder
        if word.isascii() and "<|" not in word and encoder.lower:
            pieces = self.ascii(word.lower())
            if len(pieces) > 1:  # a pre-token is a word of its own
                return b"".join(map(self.__getitem__, pieces))
            ids = encoder.feed(word.lower().encode())
        else:
            ids = encoder.encode(word)
        return array("I", ids).tobytes()


def machines(path: str) -> tuple[Chunks, Decoder]:
    """The worker's encoder and decoder of a vocabulary file."""
    return resident(("bpe", path), lambda: (Chunks(Encoder(path)), Decoder(path)))


def encoded(text: str, chunks: Chunks) -> bytes:
    if not chunks.encoder.suffix:  # white space counts in this vocabulary
        return np.fromiter(chunks.encoder.encode(text), "<u4").tobytes()
    return b"".join(map(chunks.__getitem__, WORD.findall(text)))


def decoded(ids: bytes, decoder: Decoder, step: int = 1 << 16) -> Iterator[str]:
    """The text of the ids, in pieces."""
    decoder.start()
    for at in range(0, len(ids), 4 * step):
        yield decoder.feed(np.frombuffer(ids[at : at + 4 * step], "<u4").tolist())
    yield decoder.end()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id and ids, an array of long. Null and empty texts have no ids."""
    place = vocabulary(MODEL, path)

    def make(cols: dict) -> dict:
        chunks, _ = machines(place)
        return {"doc_id": cols["doc_id"], "ids": [np.frombuffer(encoded(t, chunks), "<u4").astype(np.int64) for t in cols["text"]]}

    return by_batch(keyed_text(docs), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<long>", rows=500)


def decode(encoded_docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row with doc_id and ids: doc_id and text. Null ids give a null text, none an empty one."""
    place = vocabulary(MODEL, path)

    def make(cols: dict) -> dict:
        _, decoder = machines(place)
        return {"doc_id": cols["doc_id"], "text": [None if x is None else "".join(decoded(np.asarray(x, "<u4").tobytes(), decoder)) for x in cols["ids"]]}

    return by_batch(encoded_docs.select("doc_id", "ids"), make, f"doc_id {encoded_docs.schema['doc_id'].dataType.simpleString()}, text string", rows=500)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, both directions run in one pass.

    A null text counts as empty: no ids, and the digests of no bytes. Repeated rows give a row
    each. Other columns of docs are not read. The ids are decoded, not the text kept.
    """
    place = vocabulary(MODEL, path)

    def digests(text: str) -> tuple[int, str, str]:
        chunks, decoder = machines(place)
        ids = encoded(text, chunks)
        back = hashlib.sha256()
        for piece in decoded(ids, decoder):
            back.update(piece.encode())
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), back.hexdigest()

    def make(cols: dict) -> dict:
        n, ids, back = zip(*map(digests, cols["text"]))
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back}

    return by_batch(keyed_text(docs), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
