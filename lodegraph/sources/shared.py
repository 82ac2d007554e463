"""What jobs on a cluster need from it: the shared folder, and workers that find this package."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, may do without it."""
    set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_to.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext.setCheckpointDir(named)
        set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_to.get()


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's Python ends, with all tables settled in it."""
    path = f"{shared_folder(spark)}/lodegraph-{spark.sparkContext.applicationId}"
    if path not in _OWN:
        _OWN.add(path)
        atexit.register(_remove, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


_OWN: set[str] = set()


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts lineage and outlives lost executors."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
