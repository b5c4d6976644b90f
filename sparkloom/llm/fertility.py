"""Quality rules from a public tokeniser: how well a vocabulary fits a text.

A text is encoded with a vocabulary with byte fallback. Measured are characters a
token, tokens a word (fertility), the share of byte-fallback tokens (line feeds, which
have no piece, aside), and the entropy of the text's tokens: Shannon's, and the
min-entropy -log2(share of the commonest unit). A unit is a token or, where a
character falls to bytes, that character, as a lead byte is common in any text of its
script; line feeds, lone space marks and the marks of list items are layout and don't
compete for the commonest. Each has a rejection band by language, or by the script of
most letters where the language is not listed.

The bands are fixed parameters, so a document's verdict depends on that document
alone: no corpus pass, no shuffle, the same at every size.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import asdict, dataclass
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD, Recent, by_batch, keyed_text, read, resident, slices, vocabulary
from sparkloom.llm.token_count import MODEL, keys, processor_of


@dataclass(frozen=True)
class Band:
    """What a document must meet to be kept."""

    least_chars_a_token: float = 1.4
    most_chars_a_token: float = 9.0
    most_tokens_a_word: float = 4.0
    most_byte_share: float = 0.15
    least_entropy: float = 3.5
    least_min_entropy: float = 3.15


#: By language code. Fertility limits lie between running prose and text strewn with symbols.
LANGUAGES: dict[str, Band] = {
    "en": Band(most_tokens_a_word=3.2),
    "de": Band(most_tokens_a_word=3.4),
    "es": Band(most_tokens_a_word=3.65),
    "fr": Band(most_tokens_a_word=3.75),
}
#: By script, for other languages. Scripts without spaces between words have no limit on tokens a word. Where the
#: vocabulary has a script's letters but not its words, the commonest letter is the commonest unit, so min-entropy is lower.
SCRIPTS: dict[str, Band] = {
    "LATIN": Band(most_tokens_a_word=4.5),
    "GREEK": Band(0.7, 9.0, 9.0, 0.3, least_min_entropy=2.6),
    "CYRILLIC": Band(0.9, 9.0, 7.0, 0.3, least_min_entropy=2.8),
    "ARABIC": Band(0.6, 9.0, 9.0, 0.3, least_min_entropy=2.5),
    "HEBREW": Band(0.6, 9.0, 9.0, 0.3, least_min_entropy=2.5),
    "CJK": Band(0.3, 9.0, float("inf"), 0.9, least_min_entropy=2.8),
    "HIRAGANA": Band(0.3, 9.0, float("inf"), 0.9, least_min_entropy=2.8),
    "KATAKANA": Band(0.3, 9.0, float("inf"), 0.9, least_min_entropy=2.8),
    "HANGUL": Band(0.3, 9.0, float("inf"), 0.9, least_min_entropy=2.8),
    "": Band(0.2, 9.0, float("inf"), 0.95, least_min_entropy=2.3),
}

_SYMBOLS = "#*$%&|<>"
_BYTES = slice(3, 259)  # ids of the byte-fallback tokens
_LINE_FEED = 13


class PieceIds(Recent):
    """The ids of the pre-tokens met lately, as unsigned 16-bit integers."""

    def __init__(self, path: str):
        super().__init__(100_000)
        self.processor = processor_of(path)
        self.mark = self.processor.piece_to_id("▁")

    def falls_to_bytes(self, character: str) -> bool:
        return self.processor.is_unknown(self.processor.piece_to_id(character))

    def make(self, key: str) -> bytes:
        # an empty key is a space mark alone
        ids = self.processor.encode(key)[2 * (key[:1] == "\n") :] if key else [self.mark]
        return np.array(ids, "<u2").tobytes()


def pieces_of(path: str) -> PieceIds:
    return resident(("pieces", path), lambda: PieceIds(path))


def token_histogram(text: str, pieces: PieceIds) -> np.ndarray:
    """How often each id occurs in the encoded text."""
    if not text:
        return np.zeros(_BYTES.stop, np.int64)
    found, lines = keys(text)
    out = np.bincount(np.frombuffer(b"".join(map(pieces.__getitem__, found)), "<u2"), minlength=_BYTES.stop)
    out[_LINE_FEED] += lines
    return out


_ITEM = re.compile(r"^[^\S\n]*(?:[-*+•·‣–—]|\d{1,3}[.)])(?=[^\S\n])", re.M)


def min_entropy_of(text: str, histogram: np.ndarray, pieces: PieceIds) -> float:
    """-log2 of the commonest unit's share of all units of an encoded text; 0 without a unit."""
    units, rare = int(histogram.sum()), 0
    if histogram[_BYTES].sum() > histogram[_LINE_FEED]:
        fallen = [n for c, n in Counter(text).items() if c not in " \n" and pieces.falls_to_bytes(c)]
        units += sum(fallen) - int(histogram[_BYTES].sum() - histogram[_LINE_FEED])
        rare = max(fallen, default=0)
    counts = token_histogram(_ITEM.sub("", text), pieces) if _ITEM.search(text) else histogram.copy()
    counts[_BYTES] = 0
    counts[pieces.mark : pieces.mark + 1] = 0  # a histogram ends at its greatest id
    most = max(rare, int(counts.max()))
    return float(-np.log2(most / units)) + 0.0 if most else 0.0


def repeated_words(words: list[str]) -> int:
    """Words inside a window of three that occurs twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    code = defaultdict(count().__next__)
    ids = np.fromiter((code[w] for w in words), np.int64, len(words))
    pair = ids[:-1] * len(code) + ids[1:]
    if len(code) >= 1 << 20:  # keep the product of three below 2^63
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(code) + ids[2:]
    order = np.sort(window)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(window, twice)
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


_LETTER = re.compile(r"[^\W\d_]")


def script(text: str) -> str:
    """The script of most letters, by the first word of their Unicode names; '' without letters or for one not listed."""
    found: Counter[str] = Counter()
    for letter, n in Counter(_LETTER.findall(text)).items():
        found[unicodedata.name(letter, "").split(" ")[0]] += n
    best = max(sorted(found), key=found.__getitem__, default="")
    return best if best in SCRIPTS else ""


def measure(text: str, lang: str | None, pieces: PieceIds, languages: dict[str, Band]) -> dict:
    words = WORD.findall(text)
    n_words = len(words)
    n_repeat = repeated_words(words)
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    histogram = token_histogram(text, pieces)
    n_tokens = int(histogram.sum())
    share = histogram[histogram > 0] / max(1, n_tokens)
    chars_a_token = len(text) / n_tokens if n_tokens else 0.0
    tokens_a_word = n_tokens / n_words if n_words else 0.0
    byte_share = int(histogram[_BYTES].sum() - histogram[_LINE_FEED]) / n_tokens if n_tokens else 0.0
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    min_entropy = min_entropy_of(text, histogram, pieces)
    name = lang if lang in languages else script(text)
    band = languages[name] if lang in languages else SCRIPTS[name]
    failed = [
        rule
        for rule, bad in (
            ("chars_a_token", not band.least_chars_a_token <= chars_a_token <= band.most_chars_a_token),
            ("tokens_a_word", tokens_a_word > band.most_tokens_a_word),
            ("byte_share", byte_share > band.most_byte_share),
            ("entropy", entropy < band.least_entropy),
            ("min_entropy", min_entropy < band.least_min_entropy),
        )
        if bad
    ]
    return {
        "n_words": n_words,
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, _SYMBOLS)),
        "n_dup_lines": repeated_lines(text),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": not base_failed and not failed,
        "n_tokens": n_tokens,
        "chars_a_token": chars_a_token,
        "tokens_a_word": tokens_a_word,
        "byte_share": byte_share,
        "token_entropy": entropy,
        "token_min_entropy": min_entropy,
        "band": name,
        "failed_rules": ",".join(failed),
    }


_COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "n_tokens long, chars_a_token double, tokens_a_word double, byte_share double, token_entropy double, token_min_entropy double, band string, failed_rules string"
)


def quality(docs: DataFrame, languages: dict[str, Band] | None = None, path: str | None = None) -> DataFrame:
    """A verdict per row of docs: doc_id and the columns of `measure`, no row dropped.

    Null and empty texts have zero everywhere and fail the base rule. A language that is null or
    not listed, or a table without that column, falls to the script's band. Repeated rows give a row each.
    """
    place, bands = vocabulary(MODEL, path), {k: asdict(v) for k, v in (languages or LANGUAGES).items()}
    texts = keyed_text(docs, *(["lang"] if "lang" in docs.columns else []))

    def make(cols: dict) -> dict:
        pieces, listed = pieces_of(place), {k: Band(**v) for k, v in bands.items()}
        rows = [measure(t, lang, pieces, listed) for t, lang in zip(cols["text"], cols.get("lang", [None] * len(cols["text"])))]
        return {"doc_id": cols["doc_id"]} | {k: [r[k] for r in rows] for k in rows[0]}

    return by_batch(texts, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")


def keep(docs: DataFrame, languages: dict[str, Band] | None = None, path: str | None = None) -> DataFrame:
    """The rows of docs whose text is kept, with all their columns: one pass, no shuffle."""
    place, bands = vocabulary(MODEL, path), {k: asdict(v) for k, v in (languages or LANGUAGES).items()}
    names = docs.columns
    text, lang = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches):
        import pyarrow as pa

        pieces, listed = pieces_of(place), {k: Band(**v) for k, v in bands.items()}
        for batch in batches:
            for part in slices(batch):
                codes = part.column(lang).to_pylist() if lang is not None else [None] * part.num_rows
                yield part.filter(pa.array([measure(t or "", code, pieces, listed)["kept"] for t, code in zip(part.column(text).to_pylist(), codes)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))


def rejected_by(verdicts: DataFrame) -> DataFrame:
    """How many documents each rule rejects, by band."""
    rules = F.explode(F.split(F.concat_ws(",", F.when(F.col("base_failed"), "base"), F.nullif("failed_rules", F.lit(""))), ","))
    return verdicts.where(~F.col("kept")).select("band", rules.alias("rule")).groupBy("band", "rule").agg(F.count("*").alias("n_docs"))
