"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _bytes(spark: SparkSession, name: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it lies; ``spread`` deals it out where its rows are costly to work on."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table's columns, dealt out to all cores if its files make fewer partitions than there are cores. That can
    only be so for tables of a few partitions, so it never shuffles a large one."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < cores * _bytes(spark, "spark.sql.files.maxPartitionBytes") and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
