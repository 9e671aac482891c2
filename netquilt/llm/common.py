"""Helpers that all corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text handled at once inside a task; keeps a worker's memory flat whatever the batch.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The files survive the loss of any executor, so nothing upstream runs twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/netquilt/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def slices(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The rows of a batch as tuples, about ``SLICE_BYTES`` at once."""
    step = max(1, min(batch.num_rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield list(zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True))


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str | StructType,
    work: Callable[..., list[tuple]],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Run ``work(rows[, state])`` over slices of rows, batch by batch, inside tasks.

    ``rows`` is a list of tuples in the order of ``columns``; each call gets
    slices of at most about ``SLICE_BYTES`` of strings, so one batch of long
    texts never turns into one big Python list of results.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for rows in slices(batch):
                made = work(rows, *state)
                if made:
                    arrays = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=out)

    plain = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)]  # mapInArrow can't take every name
    return df.select(*plain).mapInArrow(run, schema)
