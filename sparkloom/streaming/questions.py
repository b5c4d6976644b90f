"""Questions as a stream: classified and routed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.questions import analyze, route

SCHEMA = "query_id long, query string, category string"


def read_questions(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the JSON question files that come into folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)


def routed(stream: DataFrame) -> DataFrame:
    """Each question with its plan. No state is kept, so any trigger and output mode append work."""
    return route(analyze(stream)).drop("terms", "signals")


def write_plans(plans: DataFrame, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start writing plans to Parquet, each question once, also after a restart from the checkpoint."""
    return plans.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
