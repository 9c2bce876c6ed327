"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """`df`, dealt out over the cluster if its scan has fewer parts than there are cores.

    Only a table too small to be split is ever dealt out; one with a part for each core is read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < parts < cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of `folder`, a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` for work that is heavy for its size: its rows are on all cores, however few its files."""
    return spread(table(spark, folder, name))


def small_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """All rows of a lookup table; ValueError if there are more than `most`. One row beyond these is read at most."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows
