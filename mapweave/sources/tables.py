"""Reading tables with enough partitions for the work that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by key when the scan has fewer partitions than the session has cores.

    A small table, often one Parquet row group, would otherwise be parsed and tokenised by a single task.
    Large tables already have more splits than cores and pass through without an exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return spread(df, key) if key else df
