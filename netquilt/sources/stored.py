"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may fall back to a temporary folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Paths that this process has given out and not discarded.
_given: list[str] = []


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``discard`` removes what is there."""
    path = f"{shared_dir(spark)}/netquilt/{name}-{uuid.uuid4().hex}"
    _given.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Remove what this process has put on ``fresh`` paths so far; the number of paths.

    For the end of a job: tables read from there can't be read afterwards.
    """
    removed = 0
    while _given:
        path = spark._jvm.org.apache.hadoop.fs.Path(_given.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, and the loss of an executor loses nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
