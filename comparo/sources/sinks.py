"""Sinks (S4-S8, S10): predictions, metrics, search results, rankings.

All sinks write with ``mode('overwrite')`` to a directory, so a re-run after a
lost executor or a failed job simply replaces the output (idempotent).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prediction_columns(df: DataFrame, y: str, p: str) -> DataFrame:
    """Absolute and relative error next to each prediction."""
    return df.withColumn("abs_error", F.abs(F.col(y) - F.col(p))) \
             .withColumn("rel_error", F.abs(F.col(y) - F.col(p)) / F.col(y))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """Write a result; ``partition_by`` for large outputs (e.g. month)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_sorted(df: DataFrame, path: str, by: str, ascending: bool = True, fmt: str = "parquet") -> str:
    """Results sorted by a metric (range-partitioned sort, files in order)."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    df.orderBy(o).write.mode("overwrite").format(fmt).save(path)
    return path
