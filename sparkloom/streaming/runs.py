"""A run of systems over a benchmark as a stream of small batches of questions, which can be stopped and resumed anywhere.

The records are a log, a folder a batch and try, that is only ever added to: it is both sink and state. A batch that meets a spent
quota fails after its records are kept, so no later question is sent, and the next run begins with that batch and sends only
what has not succeeded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.functions.scoring import SYSTEMS, quota_spent
from sparkloom.operators import answers, evaluation
from sparkloom.session import materialise

STOPPED = "a daily quota is spent"


def lay_out(benchmark: DataFrame, folder: str, questions_a_batch: int = 20) -> None:
    """The benchmark in files of about so many questions, in the order of question_id; a file is a batch."""
    files = max(1, -(-benchmark.count() // questions_a_batch))
    benchmark.repartitionByRange(files, "question_id").write.mode("errorifexists").parquet(folder)


def _tries(spark: SparkSession, log: str, batch: int | None = None) -> list[str]:
    """The complete tries of a batch, or of all."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log}/batch={'*' if batch is None else batch}/try=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(x.getPath().getParent().toString() for x in found or [])


def _read(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Their records, with the number of the try."""
    parts = [spark.read.parquet(p).withColumn("try", F.lit(int(p.rpartition("=")[2]))) for p in paths]
    return reduce(DataFrame.unionByName, parts) if parts else None


def records(spark: SparkSession, log: str) -> DataFrame | None:
    """The records of a log, one a question and system; None before the first."""
    found = _read(spark, _tries(spark, log))
    return None if found is None else evaluation.of_tries(found)


def run(engine: Engine, folder: str, log: str, checkpoint: str, systems: tuple[str, ...] = SYSTEMS, provider: answers.Provider | None = None, judge: answers.Provider | None = None) -> bool:
    """Run what the log lacks of the benchmark laid out in folder. True if all is done, False if a spent quota has stopped it."""
    spark = engine.spark
    schema = spark.read.parquet(folder).schema

    def batch(rows: DataFrame, number: int) -> None:
        before = _tries(spark, log, number)
        known = _read(spark, before)
        done = None if known is None else evaluation.of_tries(known)
        new = engine.fresh(materialise(rows, "batch"), systems, provider, judge, done)
        if new is None:
            return
        new.write.mode("overwrite").parquet(f"{log}/batch={number}/try={len(before):04d}")
        if not new.where(quota_spent(F.coalesce("error", F.lit("")))).isEmpty():
            raise RuntimeError(STOPPED)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if STOPPED not in str(e):
            raise
        return False
    return True
