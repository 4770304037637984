"""Cleaning and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions.numeric import safe_div


def valid_sales(df: DataFrame, price: str = "sold_price", area: str | None = "area",
                date: str | None = "list_date") -> DataFrame:
    """P5 (price > 0), P6 (+ area > 0, date present)."""
    cond = F.col(price).isNotNull() & (F.col(price) > 0)
    if area:
        cond = cond & F.col(area).isNotNull() & (F.col(area) > 0)
    if date:
        cond = cond & F.col(date).isNotNull()
    return df.where(cond)


def with_ppsf(df: DataFrame, price: str = "sold_price", area: str = "area",
              out: str = "ppsf") -> DataFrame:
    """Price per area, 0 area → NULL."""
    return df.withColumn(out, safe_div(F.col(price), F.col(area)))


def column_profile(df: DataFrame, cols=None) -> DataFrame:
    """One pass, one row per column: non-NULL count, NULL count, min, max.

    All columns are aggregated in a single ``agg`` and unpivoted afterwards,
    so the table is scanned once however many columns there are.
    """
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__nn"),
                 F.sum(F.col(c).isNull().cast("long")).alias(f"{c}__null"),
                 F.min(F.col(c).cast("string")).alias(f"{c}__min"),
                 F.max(F.col(c).cast("string")).alias(f"{c}__max")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__nn").alias("non_null"),
                     F.col(f"{c}__null").alias("nulls"), F.col(f"{c}__min").alias("min_text"),
                     F.col(f"{c}__max").alias("max_text")) for c in cols]
    return one.select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def coverage(df: DataFrame, col: str) -> DataFrame:
    """Share of rows where ``col`` is not NULL."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(col).alias("non_null"),
                  F.avg(F.col(col).isNotNull().cast("double")).alias("coverage"))
