"""Text functions as column expressions, with the same meaning in Python, Java and RE2 regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters, digits and underscores, or one other character that is no white space.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"
RUN = r"[\p{L}\p{N}_]+"
SNIPPET_CHARS = 150


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_tokens(text: Column | str) -> Column:
    """Number of tokens; null for null."""
    return F.regexp_count(_col(text), F.lit(TOKEN))


def paragraphs(text: Column | str) -> Column:
    """Parts between blank lines, stripped, without empty ones."""
    parts = F.transform(F.split(_col(text), r"\n\s*\n"), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(text: Column | str) -> Column:
    """Parts after a full stop, exclamation or question mark, where a capital, digit, quote or backtick follows the white space."""
    parts = F.transform(F.split(_col(text), r"(?<=[.!?])\s+(?=[A-Z0-9`\"'])"), strip)
    return F.filter(parts, lambda p: p != "")


def lexical_tokens(text: Column | str) -> Column:
    """Lower-cased ASCII words; a run with any other letter or digit yields none."""
    runs = F.regexp_extract_all(_col(text), F.lit(RUN), F.lit(0))
    return F.transform(F.filter(runs, lambda t: F.rlike(t, F.lit("^[a-zA-Z0-9_]+$"))), F.lower)


def has_token(text: Column | str) -> Column:
    """Whether a text has a lexical token."""
    return F.rlike(_col(text), F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z0-9_]+(?![\p{L}\p{N}_])"))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def clean_text(text: Column | str) -> Column:
    """White space collapsed and stripped, after a trailing run of white space, # and pilcrows is cut."""
    return strip(F.regexp_replace(F.regexp_replace(_col(text), "[\\s#¶]+$", ""), r"\s+", " "))


def collapse_blank_lines(text: Column | str) -> Column:
    """Three or more line feeds become two; the ends are stripped."""
    return strip(F.regexp_replace(_col(text), r"\n{3,}", "\n\n"))


def heading(text: Column | str) -> Column:
    """Struct of level and title if the whole text is one Markdown heading line, else null."""
    level = F.length(F.regexp_extract(_col(text), r"^(#{1,6})\s+([^\n]+)$", 1))
    title = strip(F.regexp_extract(_col(text), r"^(#{1,6})\s+([^\n]+)$", 2))
    return F.when(level > 0, F.struct(level.alias("level"), title.alias("title")))


def snippet(text: Column | str, chars: int = SNIPPET_CHARS) -> Column:
    """The first characters on one line, with three dots if there are more."""
    head = strip(F.replace(F.substring(_col(text), 1, chars), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(_col(text)) > chars, F.concat(head, F.lit("..."))).otherwise(head)


def word_count(text: Column | str) -> Column:
    """Words between white space."""
    return F.regexp_count(_col(text), F.lit(r"\S+"))
