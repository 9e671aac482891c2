import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def twelve(spark):
    """A matrix of twelve links whose quantities are known."""
    rows = [(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 1), (2, 1, 4), (2, 2, 2), (2, 4, 1), (3, 2, 2), (3, 3, 4), (3, 4, 1), (4, 2, 1), (4, 4, 1)]
    return spark.createDataFrame(rows, "src long, dst long, packets long")
