"""Which texts hold a passage word for word, without holding every text against every passage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.session import materialise

#: Passages of one pass over the texts, and their characters, unless one passage alone has more.
BLOCK, CHARS = 10_000, 4 << 20


def automaton(phrases: list[str]):
    """A machine that finds all of them in one pass over a text, by their places."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        made.add_word(p, i)
    made.make_automaton()
    return made


def passes(rows: Iterator[tuple], size, most: int, chars: int) -> Iterator[list[tuple]]:
    """The rows in lists of at most `most`, and of at most `chars` by size(row), unless one row alone has more."""
    some, total = [], 0
    for row in rows:
        length = size(row)
        if some and (len(some) >= most or total + length > chars):
            yield some
            some, total = [], 0
        some.append(row)
        total += length
    if some:
        yield some


def holding(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """text_id and passage_id of each text that contains a passage.

    texts: text_id, body; passages: passage_id, passage, a stated set, taken BLOCK at a time. All of them make one automaton, which
    goes over each text once where it is. Nulls hold nothing and are held by none; an empty passage is in every text.
    """
    asked = materialise(passages.where(F.col("passage").isNotNull()).select("passage_id", "passage"), "passages")
    types = [f.dataType for f in (texts.schema["text_id"], asked.schema["passage_id"])]
    schema = f"text_id {types[0].simpleString()}, passage_id {types[1].simpleString()}"
    rows = texts.where(F.col("body").isNotNull()).select("text_id", "body")
    out = texts.sparkSession.createDataFrame([], schema)
    for some in passes(((r[0], r[1]) for r in asked.toLocalIterator()), lambda r: len(r[1]), BLOCK, CHARS):
        out = out.unionByName(rows.mapInArrow(_holding(some, to_arrow_type(types[1])), schema))
    return out


def _holding(some: list[tuple], kind: pa.DataType):
    distinct = list(dict.fromkeys(p for _, p in some if p))
    place = {p: i for i, p in enumerate(distinct)}
    always = [i for i, (_, p) in enumerate(some) if not p]
    rows: list[list[int]] = [[] for _ in distinct]
    for i, (_, p) in enumerate(some):
        if p:
            rows[place[p]].append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, ids = automaton(distinct) if distinct else None, pa.array([r[0] for r in some], kind)
        for batch in batches:
            at, found = [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                met = [*always, *(r for w in ({w for _, w in machine.iter(text)} if machine else ()) for r in rows[w])]
                at += [i] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(found, pa.int64()))], names=["text_id", "passage_id"])

    return run
