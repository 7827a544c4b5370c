"""Tables that cut lineage: written once under the shared folder, read as often as needed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from symgrove.session import scratch_path


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back. Its files outlive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
