"""The ``sales`` view: the reference's column roles over the test tables.

The reference works on one table of dated property sales.  The driver data
is a TPC-H-like star schema, so every role is mapped to a column derived
from it (SURVEY §7.1):

=================  ==========================================================
role               expression
=================  ==========================================================
row key            ``sale_key`` = every lineitem column, prices in cents
                   (orderkey|linenumber|partkey|suppkey alone repeats)
tie-break order    ``seq`` = 60-bit number from md5(sale_key) (same in DuckDB)
event date         ``list_date`` = date(l_shipdate); ``day`` = days since 1970
sold price         ``sold_price`` = l_extendedprice
list price         ``list_price`` = l_quantity * p_retailprice
area               ``area`` = l_quantity
FSA / Region       supplier nation name / region name
TypeDwel           p_type; complex = p_brand; address = partkey
floors, bedrooms   p_size % 3 + 1, p_size; yr_blt = 1950 + p_size
baths              full = p_size % 4 + 1, half = linenumber % 2
MaintFee           extendedprice * discount, NULL where discount = 0
status / title     l_linestatus / l_returnflag
restricted         o_orderpriority (only with ``with_orders=True``)
=================  ==========================================================

Dimension joins: nation (25 rows) and region (5 rows) have a fixed size
and are broadcast explicitly; part, supplier and orders grow with the scale
factor, so the join strategy is left to Catalyst/AQE (broadcast only when
their runtime size is under ``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.functions.keys import hash60
from comparo.sources.tables import read_table



def sales(spark: SparkSession, sf_dir: str, with_orders: bool = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate")
    cents = [F.round(F.col(c) * 100).cast("bigint")
             for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    sale_key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *cents,
                           "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"))
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # supplier on its own: the estimated size of a join of it is a product, and lineitem would be shuffled for it
    df = (li.join(part, li.l_partkey == part.p_partkey)
            .join(supp, li.l_suppkey == supp.s_suppkey)
            .join(F.broadcast(nation), supp.s_nationkey == nation.n_nationkey)
            .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey))
    if with_orders:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey, "left")
    # after the joins: the numbers that the key is made of take less of a shuffle than its text and hash
    df = df.withColumn("sale_key", sale_key)
    list_date = F.col("l_shipdate").cast("date")
    cols = [
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("sale_key"),
        hash60(F.col("sale_key")).alias("seq"),
        list_date.alias("list_date"),
        F.datediff(list_date, F.lit("1970-01-01").cast("date")).alias("day"),
        F.col("l_extendedprice").alias("sold_price"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("list_price"),
        F.col("l_quantity").alias("area"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("n_name").alias("fsa"),
        F.col("r_name").alias("region"),
        F.col("p_type").alias("type_dwel"),
        F.col("p_brand").alias("complex"),
        (F.col("p_size") % 3 + 1).alias("floors"),
        F.col("p_size").alias("bedrooms"),
        (F.lit(1950) + F.col("p_size")).alias("yr_blt"),
        (F.col("p_size") % 4 + 1).alias("full_baths"),
        (F.col("l_linenumber") % 2).alias("half_baths"),
        F.when(F.col("l_discount") == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice") * F.col("l_discount")).alias("maint_fee"),
        F.col("l_linestatus").alias("status"),
        F.col("l_returnflag").alias("title"),
    ]
    if with_orders:
        cols.append(F.col("o_orderpriority").alias("restricted"))
    return df.select(*cols)


def _sales_sql(with_orders: bool) -> str:
    extra_col = ", o.o_orderpriority AS restricted" if with_orders else ""
    extra_join = ("\n  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey"
                  if with_orders else "")
    key = ("concat_ws('|', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, "
           "CAST(round(l.l_extendedprice * 100) AS BIGINT), CAST(round(l.l_quantity * 100) AS BIGINT), "
           "CAST(round(l.l_discount * 100) AS BIGINT), CAST(round(l.l_tax * 100) AS BIGINT), "
           "l.l_returnflag, l.l_linestatus, strftime(l.l_shipdate, '%Y%m%d'))")
    return f"""sales AS (
  SELECT l.l_orderkey AS orderkey, l.l_linenumber AS linenumber,
         l.l_partkey AS partkey, l.l_suppkey AS suppkey,
         {key} AS sale_key,
         ('0x' || substr(md5({key}), 1, 15))::BIGINT AS seq,
         CAST(l.l_shipdate AS DATE) AS list_date,
         CAST(CAST(l.l_shipdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day,
         l.l_extendedprice AS sold_price,
         l.l_quantity * p.p_retailprice AS list_price,
         l.l_quantity AS area, l.l_discount AS discount, l.l_tax AS tax,
         n.n_name AS fsa, r.r_name AS region, p.p_type AS type_dwel, p.p_brand AS complex,
         p.p_size % 3 + 1 AS floors, p.p_size AS bedrooms, 1950 + p.p_size AS yr_blt,
         p.p_size % 4 + 1 AS full_baths, l.l_linenumber % 2 AS half_baths,
         CASE WHEN l.l_discount = 0 THEN NULL ELSE l.l_extendedprice * l.l_discount END AS maint_fee,
         l.l_linestatus AS status, l.l_returnflag AS title{extra_col}
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey{extra_join}
)"""


# DuckDB twin of ``sales()``, used as the first CTE of every oracle query.
SALES_SQL = _sales_sql(False)
SALES_ORDERS_SQL = _sales_sql(True)
