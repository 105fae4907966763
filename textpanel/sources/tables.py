"""Scans. Every table of a data set is one Parquet file or folder `<dir>/<name>.parquet`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The table, narrowed to `columns` if any are given; Parquet reads no others."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
