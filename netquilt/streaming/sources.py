"""Streams of flows and packets, and matrices kept up to date from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquilt.operators import filters, matrix
from netquilt.sources import captures, readers


def flows_from_files(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Flow records from files as they arrive; ``files_a_batch`` holds the pace down."""
    return readers.flow_columns(spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder))


def flows_from_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Flow records from a TCP socket, a line each. Such a source can't be replayed."""
    return readers.flow_columns(spark.readStream.format("socket").option("host", host).option("port", port).load())


def flows_from_kafka(spark: SparkSession, servers: str, topic: str, offsets_a_batch: int = 1_000_000) -> DataFrame:
    """Flow records from a topic; needs Spark's Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("maxOffsetsPerTrigger", offsets_a_batch).load()
    return readers.flow_columns(raw.select(F.col("value").cast("string").alias("value")))


def packets_from_captures(spark: SparkSession, folder: str, files_a_batch: int = 16, only: str = "") -> DataFrame:
    """Packets of capture files as they arrive; ``only`` is a capture filter."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pcap").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return filters.captured(captures.packets_of_files(files), only)


def valid_links(packets: DataFrame) -> DataFrame:
    """Links of weight 1 of the packets that a capture keeps."""
    return filters.no_broadcast(filters.ipv4_only(packets)).select("src", "dst", F.lit(1).cast("long").alias("packets"))


def accumulate(links: DataFrame, path: str, checkpoint: str):
    """Add each micro-batch to a table of links.

    A batch is combined and written to a folder of its own number, which a
    repeated batch overwrites, so each counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        matrix.build(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return links.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """The matrix of all batches so far."""
    return matrix.build(spark.read.parquet(path).select("src", "dst", "packets"))
