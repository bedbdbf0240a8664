"""Opening the star-schema and corpus tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its scan has fewer partitions than half of them, as one small file has.

    For work that costs more than moving its rows. A scan of many files has more partitions than cores and stays as
    it is; the rows are the same either way.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
