"""Session helpers: local sessions, shared folders, worker imports and materialised tables."""

from __future__ import annotations

import atexit
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master that names no shared folder (tests, a single machine).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"

_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", memory: str = "8g", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sparkloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The folder of this application below the cluster's shared spark.checkpoint.dir.

    Every executor and the driver see that folder, so a table written there
    outlives any one executor. Without that setting a local master uses a local folder, and any other one raises.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
            base = LOCAL_CHECKPOINTS
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/sparkloom-{app}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may have ended already
        return


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here."""
    path = table_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers on this host import the package (on a cluster, pass it by --py-files)."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
