"""Reports as Markdown text, from summaries of a few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(rows: DataFrame, columns: tuple[str, ...] | None = None, order: str | None = None) -> str:
    """A summary (a row a strategy, system or category) as a Markdown table."""
    rows = rows.select(*columns) if columns else rows
    rows = rows.orderBy(order) if order else rows
    names = rows.columns
    lines = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    lines += ["| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in r) + " |" for r in rows.collect()]
    return "\n".join(lines)


def chunking_report(stats: DataFrame, rates: DataFrame) -> str:
    parts = ["# Chunking strategies", "## Chunks", table(stats, order="strategy"), "## Phrases kept whole", table(rates.orderBy("strategy", "category"))]
    return "\n\n".join(parts) + "\n"


def evaluation_report(summary: DataFrame, deltas: DataFrame, best: DataFrame, groups: DataFrame) -> str:
    parts = ["# Evaluation", "Grades run from 0 to 4.", "## Systems", table(summary, order="system"), "## Best system by measure", table(best, order="metric"), "## Differences", table(deltas, order="second"), "## By intent and complexity", table(groups.orderBy("intent", "complexity", "system"))]
    return "\n\n".join(parts) + "\n"


def question_lines(per_question: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """question_id and line: the rows of a Markdown table of each question's score by system, - where there is none, and the best system,
    the first of equals. A row a question, so that the table may have any number; its head is `question_head`."""
    cells = [F.when(F.col(s).isNull(), "-").otherwise(F.format_string("%.2f", F.col(s))) for s in systems]
    top = F.greatest(*(F.col(s) for s in systems))
    best = F.coalesce(*(F.when(F.col(s) == top, F.lit(s)) for s in systems), F.lit("-"))
    return per_question.select("question_id", F.concat(F.lit("| "), F.concat_ws(" | ", "question_id", *cells, best), F.lit(" |")).alias("line"))


def question_head(systems: tuple[str, ...]) -> str:
    names = ["question", *systems, "best"]
    return f"| {' | '.join(names)} |\n| {' | '.join(['---'] * len(names))} |"
