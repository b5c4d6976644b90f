"""Documents to chunks, by three strategies.

Each is a fold over one document's units, and documents are independent: one pass over Arrow batches, no shuffle.
Documents: doc_id, title, content, sections (array of title, level, content) and source_url; absent ones count as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.containing import automaton, passes
from sparkloom.session import materialise

_TOKEN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]")
_SENTENCE = regex.compile(r"(?<=[.!?])\s+(?=[A-Z0-9`\"'])")
_HEADING = regex.compile(r"(#{1,6})\s+(.+)")

SCHEMA = (
    "chunk_id string, strategy string, doc_id string, source_url string, doc_title string, section_title string, section_level int, content string, "
    "token_count int, char_count int, target_tokens int, overlap_tokens int, is_split boolean, part int, total_parts int"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in SCHEMA.split(", ")]


def n_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


def split_paragraphs(text: str) -> list[str]:
    return [p for x in regex.split(r"\n\s*\n", text) if (p := x.strip())]


def split_sentences(text: str) -> list[str]:
    return [s for x in _SENTENCE.split(text) if (s := x.strip())]


@dataclass(frozen=True)
class Unit:
    text: str
    tokens: int
    section: str
    level: int


def units(title: str, content: str, most: int) -> Iterator[Unit]:
    """Paragraphs, or the sentences of those with more than `most` tokens, each with the heading it stands under."""
    section, level = title, 1
    for p in split_paragraphs(content):
        if found := _HEADING.fullmatch(p):
            level, section = len(found[1]), found[2].strip()
        size = n_tokens(p)
        for text in split_sentences(p) if size > most else [p]:
            yield Unit(text, n_tokens(text) if size > most else size, section, level)


@dataclass(frozen=True)
class Chunk:
    section: str
    level: int
    text: str
    tokens: int
    split: bool | None = None
    part: int | None = None
    parts: int | None = None


@dataclass(frozen=True)
class Fixed:
    """Units are packed up to `target` tokens; a chunk below `least` takes more, and such a rest joins the chunk before it.

    A chunk bears the section of the unit that closed it: a heading that starts the next chunk already counts.
    """

    target: int = 500
    least: int = 50
    name = "fixed"
    tag = "fixed"

    def chunks(self, title: str, content: str, sections: list) -> list[Chunk]:
        out: list[Chunk] = []
        held: list[Unit] = []
        size, section, level = 0, title, 1
        for unit in units(title, content, self.target):
            section, level = unit.section, unit.level
            if size + unit.tokens > self.target and size >= self.least:
                out.append(Chunk(section, level, "\n\n".join(u.text for u in held), size))
                held, size = [], 0
            held.append(unit)
            size += unit.tokens
        if held and size < self.least and out:
            last = out.pop()
            out.append(Chunk(last.section, last.level, "\n\n".join([last.text, *(u.text for u in held)]), last.tokens + size))
        elif size:
            out.append(Chunk(section, level, "\n\n".join(u.text for u in held), size))
        return out


@dataclass(frozen=True)
class Overlap:
    """As Fixed, but a chunk begins with the last units of the one before, `overlap` tokens of them or more."""

    target: int = 500
    overlap: int = 100
    least: int = 50
    name = "fixed_overlap"
    tag = "overlap"

    def chunks(self, title: str, content: str, sections: list) -> list[Chunk]:
        rows = [u for u in units(title, content, self.overlap) if u.tokens]
        out, begin = [], 0
        while begin < len(rows):
            end, size = begin, 0
            while end < len(rows) and (end == begin or size + rows[end].tokens <= self.target or size < self.least):
                size += rows[end].tokens
                end += 1
            out.append(Chunk(rows[begin].section, rows[begin].level, "\n\n".join(u.text for u in rows[begin:end]), size))
            if end == len(rows):
                break
            back = end
            shared = 0
            while back - 1 > begin and shared < self.overlap:
                back -= 1
                shared += rows[back].tokens
            begin = max(back, begin + 1)
        return out


@dataclass(frozen=True)
class Structure:
    """Sections are chunks; short ones join the next long one, and those above `most` tokens are split in parts."""

    most: int = 550
    least: int = 50
    name = "structure_aware"
    tag = "struct"

    def chunks(self, title: str, content: str, sections: list) -> list[Chunk]:
        groups: list[tuple[str, int, str]] = []
        waiting: list[tuple[str, int, str]] = []
        for s in sections:
            waiting.append(s)
            if n_tokens(s[2]) >= self.least:
                groups.append(self._joined(waiting))
                waiting = []
        if waiting:
            groups.append(self._joined(waiting, force=True))
        return [c for g in groups for c in self._cut(*g)]

    @staticmethod
    def _joined(parts: list[tuple[str, int, str]], force: bool = False) -> tuple[str, int, str]:
        title, level, content = parts[0]
        if len(parts) == 1 and not force:
            return title, level, content
        return title, level, "\n\n".join(f"### {t}\n{c}" for t, _, c in parts)

    def _cut(self, title: str, level: int, content: str) -> Iterator[Chunk]:
        head = f"{'#' * max(1, min(level, 4))} {title}"
        if n_tokens(content) <= self.most:
            text = f"{head}\n\n{content}".strip()
            yield Chunk(title, level, text, n_tokens(text), False, 1, 1)
            return
        room = max(self.least, self.most - n_tokens(f"{head} (Part 1/1)"))
        parts: list[list[str]] = [[]]
        size = 0
        for unit in units(title, content, room):
            if size + unit.tokens > room and size >= self.least:
                parts.append([])
                size = 0
            parts[-1].append(unit.text)
            size += unit.tokens
        bodies = ["\n\n".join(p) for p in parts if p]
        for i, body in enumerate(bodies, start=1):
            text = f"{head} (Part {i}/{len(bodies)})\n\n{body}".strip()
            yield Chunk(title, level, text, n_tokens(text), True, i, len(bodies))


Strategy = Fixed | Overlap | Structure
STRATEGIES: dict[str, Callable[[], Strategy]] = {"fixed": Fixed, "fixed_overlap": Overlap, "structure_aware": Structure}


def chunk(documents: DataFrame, strategy: Strategy | str) -> DataFrame:
    """Chunks of documents, with SCHEMA's columns; ids are the doc_id, the strategy's tag and a number from 1."""
    if isinstance(strategy, str):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {strategy}")
        strategy = STRATEGIES[strategy]()
    have = documents.columns
    text = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    sections = F.col("sections") if "sections" in have else F.lit(None).cast("array<struct<title:string,level:int,content:string>>")
    rows = documents.select(text("doc_id").alias("doc_id"), text("source_url").alias("source_url"), F.coalesce(text("title"), text("doc_id")).alias("title"), F.coalesce(text("content"), F.lit("")).alias("content"), sections.alias("sections"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for row in batch.slice(at, 500).to_pylist():
                    parts = [(s["title"] or "", s["level"] or 1, s["content"] or "") for s in row["sections"] or []]
                    for i, c in enumerate(strategy.chunks(row["title"] or "", row["content"], parts), start=1):
                        target = None if isinstance(strategy, Structure) else strategy.target
                        overlap = strategy.overlap if isinstance(strategy, Overlap) else None
                        out.append((f"{row['doc_id']}_{strategy.tag}_{i:04d}", strategy.name, row["doc_id"], row["source_url"], row["title"], c.section, c.level, c.text, c.tokens, len(c.text), target, overlap, c.split, c.part, c.parts))
                columns = list(zip(*out)) if out else [[] for _ in _NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    return rows.mapInArrow(run, SCHEMA)


def chunk_all(documents: DataFrame, strategies: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    out = chunk(documents, strategies[0])
    for name in strategies[1:]:
        out = out.unionByName(chunk(documents, name))
    return out


def complete() -> F.Column:
    """Whether a chunk has all its texts and a token."""
    columns = ("chunk_id", "doc_id", "source_url", "doc_title", "section_title", "content")
    whole = F.col("token_count") > 0
    for c in columns:
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    return whole


def chunk_stats(chunks: DataFrame, under: int = 50, over: int = 550, strategies: tuple[str, ...] = ()) -> DataFrame:
    """One row a strategy: counts, totals, means, ranges, and how many chunks are too small, too large or complete. Of the strategies named,
    those without a chunk have zeros."""
    n = F.count("*")
    share = lambda c: F.round(F.sum(c.cast("int")) * 100.0 / n, 2)
    small, large = F.col("token_count") < under, F.col("token_count") > over
    stats = chunks.groupBy("strategy").agg(
        n.alias("total_chunks"),
        F.sum("token_count").alias("total_tokens"),
        F.round(F.avg("token_count"), 2).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.round(F.avg("char_count"), 2).alias("avg_chars"),
        F.min("char_count").alias("min_chars"),
        F.max("char_count").alias("max_chars"),
        F.sum(small.cast("int")).alias("under_count"),
        share(small).alias("under_pct"),
        F.sum(large.cast("int")).alias("over_count"),
        share(large).alias("over_pct"),
        share(complete()).alias("complete_pct"),
    )
    if not strategies:
        return stats
    named = chunks.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")
    return named.join(stats, "strategy", "full_outer").fillna(0, [c for c in stats.columns if c != "strategy"]).select(*stats.columns)


def contains_all(content: F.Column, phrases: F.Column) -> F.Column:
    return F.forall(phrases, lambda p: F.contains(F.lower(content), F.lower(p)))


#: Probes of one pass over the chunks, and the characters of their phrases, unless one probe alone has more.
PROBES, PHRASE_CHARS = 10_000, 16 << 20


def _holding(probes: list[tuple]):
    """Of (number, document, lower-cased phrases): by strategy and probe, whether a chunk is of the probe's document, and whether one, of the
    document or not, has all phrases. A strategy with a chunk has a row without a probe."""
    words = sorted({p for _, _, phrases in probes for p in phrases or () if p})
    number = {p: i for i, p in enumerate(words)}
    needs = [(n, doc, None if phrases is None else {number[p] for p in phrases if p}) for n, doc, phrases in probes]
    wanted: dict[int, list[int]] = {}  # by one phrase of each probe, its longest
    always, of = [], {}
    for at, (n, doc, need) in enumerate(needs):
        if doc is not None:
            of.setdefault(doc, []).append(n)
        if need:
            wanted.setdefault(max(need, key=lambda i: len(words[i])), []).append(at)
        elif need is not None:
            always.append(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(words) if words else None
        seen: set[tuple[str, int | None, bool, bool]] = set()
        for batch in batches:
            for strategy, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen.add((strategy, None, False, False))
                seen.update((strategy, n, True, False) for n in of.get(doc, ()))
                if text is None:
                    continue
                has = {i for _, i in machine.iter(text)} if machine else set()
                for at in [*always, *(x for i in has for x in wanted.get(i, ()))]:
                    n, own, need = needs[at]
                    if need <= has:
                        seen.add((strategy, n, own is not None and own == doc, True))
        columns = list(zip(*seen)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names=["strategy", "n", "own", "holds"])

    return run


def preservation(chunks: DataFrame, probes: DataFrame) -> DataFrame:
    """question_id, category, strategy, preserved: whether some chunk of the probe's document holds all its phrases.

    A probe whose document has no chunk, or that has none, is held against all chunks. All phrases make one automaton, which goes over each
    chunk once, and a task sends a few flags a probe; probes, a stated set, are taken PROBES at a time, and only more of them than that read
    the chunks again. Case doesn't count, empty phrases are everywhere, and a probe with a null one is in no chunk.
    probes: question_id, category, target_doc_id, key_phrases.
    """
    probes = materialise(probes.select("question_id", "category", F.col("target_doc_id").cast("string").alias("target_doc_id"), F.transform("key_phrases", F.lower).alias("phrases")), "probes")
    numbered = materialise(probes.withColumn("n", F.monotonically_increasing_id()), "numbered")
    rows = chunks.select("strategy", "doc_id", F.lower("content").alias("content"))
    schema = "strategy string, n long, own boolean, holds boolean"
    whole = lambda p: p if p is not None and None not in p else None
    asked = ((r["n"], r["target_doc_id"], whole(r["phrases"])) for r in numbered.toLocalIterator())
    some = [rows.mapInArrow(_holding(x), schema) for x in passes(asked, lambda p: sum(map(len, p[2] or ())), PROBES, PHRASE_CHARS)]
    flags = materialise(reduce(DataFrame.unionByName, some or [rows.mapInArrow(_holding([]), schema)]).distinct(), "flags")
    strategies = flags.where("n is null").select("strategy").distinct()
    found = flags.where("n is not null").groupBy("strategy", "n").agg(F.max(F.col("own") & ~F.col("holds")).alias("known"), F.max(F.col("own") & F.col("holds")).alias("own"), F.max("holds").alias("anywhere"))
    met = numbered.crossJoin(strategies).join(found, ["strategy", "n"], "left")  # one row a strategy
    kept = F.when(F.col("known"), F.col("own")).otherwise(F.col("anywhere"))
    return met.select("question_id", "category", "strategy", F.coalesce(kept, F.lit(False)).alias("preserved"))


def preservation_rates(preserved: DataFrame) -> DataFrame:
    """By strategy, and by strategy and category: probes, those preserved and the percentage. Overall rows have category '(all)'."""
    return preserved.rollup("strategy", "category").agg(F.count("*").alias("probes"), F.sum(F.col("preserved").cast("int")).alias("kept"), F.grouping("category").alias("_all"), F.grouping("strategy").alias("_total")).where("_total = 0").select(
        "strategy", F.when(F.col("_all") == 1, "(all)").otherwise(F.col("category")).alias("category"), "probes", "kept", F.round(F.col("kept") * 100.0 / F.col("probes"), 2).alias("rate")
    )


def side_by_side(chunks: DataFrame, probes: DataFrame) -> DataFrame:
    """Per probe and strategy the first chunk of its document with all phrases, else the document's first chunk."""
    from pyspark.sql.window import Window

    probes = probes.select("question_id", F.col("target_doc_id").cast("string").alias("doc_id"), "key_phrases")
    met = probes.join(chunks, "doc_id").withColumn("matches", contains_all(F.col("content"), F.col("key_phrases")))
    order = Window.partitionBy("question_id", "strategy").orderBy(F.desc("matches"), "chunk_id")
    return met.withColumn("n", F.row_number().over(order)).where("n = 1").select("question_id", "strategy", "chunk_id", "section_title", "token_count", "matches", "content")
