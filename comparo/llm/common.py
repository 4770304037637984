"""Helpers shared by the operators: shared scratch tables, package shipping,
ASCII-white-space words and rolling hashes."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from comparo.session import scratch_path, ship_package

#: Rows of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Ship this package to the workers once per context and keep Arrow batches small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Write a frame as Parquet in the shared checkpoint folder and read it
    back: lineage is cut and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    gc.collect()
    spark._jvm.System.gc()  # Spark's cleaner drops the shuffle files of plans nobody refers to any more
    out = spark.read.schema(df.schema).parquet(path)
    out._comparo_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table written by ``saved`` that no later frame reads."""
    path = getattr(df, "_comparo_path", None)
    if path is None:
        return
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; null has none."""
    return text.encode("utf-8").split() if text else []


_BASE = 0x9E3779B97F4A7C15 | 1
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        inv = pow(_BASE, -1, 1 << 64)
        for k, b in ((0, _BASE), (1, inv)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of k consecutive values (wrapping arithmetic)."""
    n = len(h)
    if n < k:
        return np.empty(0, np.uint64)
    p, inv = _powers(n)
    c = np.empty(n + 1, np.uint64)
    c[0] = 0
    np.cumsum(h * p, out=c[1:])
    return mix((c[k:] - c[:-k]) * inv[: n - k + 1])


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each run start..end - 1 of the values; equal runs get equal hashes."""
    p, inv = _powers(len(h))
    c = np.empty(len(h) + 1, np.uint64)
    c[0] = 0
    np.cumsum(h * p, out=c[1:])
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))


def ascii_word_count(col) -> "F.Column":
    """Number of ``[^\\x20\\x09-\\x0D]+`` words, in the JVM; null counts 0."""
    flat = F.trim(F.translate(F.coalesce(col, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    n = F.size(F.filter(F.split(flat, " "), lambda w: w != F.lit("")))
    return n.cast("long")
