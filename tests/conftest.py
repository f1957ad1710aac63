import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def build_session():
    from pyspark.sql import SparkSession
    shared = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark = (SparkSession.builder.master("local[8]").appName("mapweave-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", shared)
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    return build_session()
