"""What the catalogue's queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import RUN, TOKEN


#: Tables of texts, on which work is by the row.
TEXTS = {"documents", "pages", "conversations"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of texts in fewer parts than there are cores, as a small file is, is dealt out to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if table in TEXTS and rows.rdd.getNumPartitions() < cores else rows


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as long, as in the SQL."""
    return df.select(*(F.col(f"`{n}`").cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(f"`{n}`") for n, t in df.dtypes))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tokens_sql(column: str) -> str:
    return f"regexp_extract_all({column}, {quoted(TOKEN)})"


def lexical_sql(column: str) -> str:
    return f"list_transform(list_filter(regexp_extract_all({column}, {quoted(RUN)}), lambda t: regexp_full_match(t, '[a-zA-Z0-9_]+')), lambda t: lower(t))"


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def sentences_sql(column: str) -> str:
    mark = "chr(1)"
    cut = f"regexp_replace({column}, '([.!?])\\s+([A-Z0-9`\"''])', '\\1' || {mark} || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({cut}, {mark}), lambda s: {strip_sql('s')}), lambda s: s <> '')"


def paragraphs_sql(column: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({column}, '\\n\\s*\\n'), lambda s: {strip_sql('s')}), lambda s: s <> '')"
