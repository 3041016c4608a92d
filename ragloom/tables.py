"""Reading the Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One table. With ``spread``, one whose files give fewer partitions than there are cores is dealt over all of them.

    That is for dear work on each row over a small file with one row group; a table of many files is read as it is.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and rows.rdd.getNumPartitions() < cores else rows
