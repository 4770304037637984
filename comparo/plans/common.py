"""Shared building blocks of the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.functions.keys import hash60
from comparo.operators.clean import valid_sales, with_ppsf
from comparo.sources.sales import SALES_ORDERS_SQL, SALES_SQL, sales

R = 6  # sums/averages/transcendentals are rounded to 6 decimals on both sides

# Fixed value: nudge added before rounding.  Averages of 2-decimal prices often
# sit exactly on a half at the 7th decimal, and the two engines' last-bit noise
# (~1e-11) would split such ties; the nudge moves every tie to the same side.
TIE_NUDGE = 1e-9


def rnd(c, scale: int = R):
    """Tie-stable rounding; the SQL twins write ``round(1e-9 + x, 6)``."""
    return F.round(F.lit(TIE_NUDGE) + (c if not isinstance(c, str) else F.col(c)), scale)


def priced(spark: SparkSession, sf_dir: str, with_orders: bool = False) -> DataFrame:
    """Valid sales (P5/P6) with ``ppsf``."""
    return with_ppsf(valid_sales(sales(spark, sf_dir, with_orders)))


PRICED_SQL = SALES_SQL + """,
priced AS (
  SELECT *, sold_price / NULLIF(area, 0) AS ppsf FROM sales
  WHERE sold_price IS NOT NULL AND sold_price > 0 AND area IS NOT NULL AND area > 0
    AND list_date IS NOT NULL
)"""

PRICED_ORDERS_SQL = SALES_ORDERS_SQL + """,
priced AS (
  SELECT *, sold_price / NULLIF(area, 0) AS ppsf FROM sales
  WHERE sold_price IS NOT NULL AND sold_price > 0 AND area IS NOT NULL AND area > 0
    AND list_date IS NOT NULL
)"""


def with_sql(*parts: str) -> str:
    """``WITH <cte>, <cte> ... <final SELECT>``; the last part may open with more CTEs."""
    *ctes, body = parts
    head = "WITH " + ",\n".join(ctes)
    if body.lstrip().upper().startswith("SELECT"):
        return head + "\n" + body
    return head + ",\n" + body.lstrip("\n")


def split_frame(spark: SparkSession, sf_dir: str, fractions=(0.7, 0.8), columns=None) -> DataFrame:
    """``priced`` (or the named ``columns`` of it, day and seq besides) + position (SP1) + 70/10/20 split +
    target y = ln(ppsf)."""
    from comparo.operators.ordering import with_position
    from comparo.operators.split import temporal_split
    from comparo.session import materialize
    p = priced(spark, sf_dir).withColumn("y", F.log("ppsf"))
    if columns is not None:
        p = p.select(*dict.fromkeys([*columns, "day", "seq", "y"]))
    n = p.select("day").count()
    p = with_position(p, rows=n)
    # the split needs a count and encoders take scalar statistics: positions are
    # materialized once instead of recomputing the join and the running totals
    return temporal_split(materialize(p), fractions, n=n)


def cut_frame(spark: SparkSession, sf_dir: str, columns, fractions=(0.7, 0.8)) -> DataFrame:
    """The named ``columns`` of ``priced`` (``y`` = ln(ppsf) among them), day and the 70/10/20 split, for queries that
    read no position: written once, then compared with the rows at the cuts.  ``sale_key`` has to be there; ``seq`` is
    its hash and made again from it instead of being written."""
    from comparo.operators.split import cut_split
    from comparo.session import materialize
    p = priced(spark, sf_dir).withColumn("y", F.log("ppsf")).select(*dict.fromkeys(["sale_key", *columns, "day"]))
    return cut_split(with_seq(materialize(p)), fractions)


def with_seq(df: DataFrame) -> DataFrame:
    """``seq`` of written rows from their ``sale_key``."""
    return df.withColumn("seq", hash60(F.col("sale_key")))


SPLIT_SQL = PRICED_SQL + """,
posd AS (SELECT *, row_number() OVER (ORDER BY day, seq) AS pos, count(*) OVER () AS n_all FROM priced),
spl AS (SELECT *, CASE WHEN pos <= floor(0.7 * n_all) THEN 'train'
                       WHEN pos <= floor(0.8 * n_all) THEN 'val' ELSE 'test' END AS split,
               ln(ppsf) AS y FROM posd)"""
