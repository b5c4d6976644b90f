"""Token counts by the whole-token shortcut.

The vocabulary is a SentencePiece BPE model with an identity normaliser. Its
pieces hold the space mark only at their start, so no merge crosses from another
character into a space mark, and none holds a line feed: a text falls apart,
exactly, into line feeds (one byte token each) and pre-tokens, each a run of
space marks with the characters up to the next. `whole_tokens` proves, before any
text is read, which vocabulary strings encode alone as one token. Counting is one
dictionary lookup a pre-token; only those not proved whole are merged, once each.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import Recent, by_batch, keyed_text, read, resident, vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Pre-tokens in each of the two generations of a worker's table, the proved ones included.
MOST = 130_000

_SPACED = re.compile(r" +[^ ]*|[^ ]+")


def _crosses(piece: str) -> bool:
    """Whether a space mark follows another character in the piece."""
    return MARK in piece.lstrip(MARK)


def whole_tokens(processor) -> dict[str, int]:
    """The keys of all pre-tokens that are a vocabulary string and encode alone as one token, each with 1.

    A key is the pre-token without its first space mark; of a pre-token right after a
    line feed, the line feed and the characters (see PieceCounts).
    """
    out = {}
    for i in range(processor.vocab_size()):
        piece = processor.id_to_piece(i)
        if processor.is_control(i) or processor.is_unknown(i) or processor.is_byte(i) or not piece:
            continue
        if _crosses(piece) or "\n" in piece:
            raise ValueError(f"the shortcut doesn't hold for this vocabulary: piece {piece!r} crosses a pre-token's edge")
        if piece.startswith(MARK):
            key = piece[1:].replace(MARK, " ")
            if (processor.encode(key) if key else [i]) == [i]:
                out[key] = 1
        elif processor.encode("\n" + piece)[2:] == [i]:
            out["\n" + piece] = 1
    out["\n"] = 0
    return out


def processor_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class PieceCounts(Recent):
    """Number of tokens by pre-token key: proved ones from the start, others merged when first met."""

    def __init__(self, path: str):
        self.processor = processor_of(path)
        self.proved = whole_tokens(self.processor)
        super().__init__(MOST)
        self.update(self.proved)

    def keep(self, key: str, n: int) -> None:
        if len(self) >= self.most:
            super().keep(key, n)
            self.update(self.proved)
        self[key] = n

    def make(self, key: str) -> int:
        # the library puts one space mark before any text: that is the key's first, or stands alone before a line feed
        return len(self.processor.encode(key)) - 2 * (key[:1] == "\n")


def keys(text: str) -> tuple[list[str], int]:
    """The keys of the text's pre-tokens, and the number of its line feeds."""
    lines = text.replace(MARK, " ").split("\n")
    out: list[str] = []
    for i, line in enumerate(lines):
        if "  " in line or line[:1] == " ":
            found = _SPACED.findall(line if i else " " + line)
            out += [x[1:] if x[0] == " " else "\n" + x for x in found]
            continue
        words = line.split(" ")
        if i:
            words[0] = "\n" + words[0]
        out += words
    return out, len(lines) - 1


def counter(path: str) -> PieceCounts:
    return resident(("counts", path), lambda: PieceCounts(path))


def count(text: str, counts: PieceCounts) -> int:
    if not text:
        return 0
    found, lines = keys(text)
    return sum(map(counts.__getitem__, found)) + lines


def token_counts(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows, and repeated
    doc_ids, give a row each. Other columns of docs are not read.
    """
    place = vocabulary(MODEL, path)

    def make(cols: dict) -> dict:
        counts = counter(place)
        return {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"], "n_tokens": [count(t, counts) for t in cols["text"]]}

    texts = keyed_text(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return by_batch(texts, make, types).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
