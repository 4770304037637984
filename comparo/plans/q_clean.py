"""Queries: scans, parsing, predicates, profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.functions.numeric import safe_div
from comparo.functions.parse import NUMBER_PATTERN, money_text, parse_date, parse_money
from comparo.operators.clean import column_profile
from comparo.plans.common import PRICED_SQL, priced, rnd, with_sql
from comparo.plans.registry import query
from comparo.sources.sales import SALES_SQL, sales

_PAT = NUMBER_PATTERN.replace("\\", "\\\\")


@query("money_parse", sql=with_sql(SALES_SQL, f"""
t AS (SELECT sale_key, sold_price, '$' || format('{{:,.2f}}', sold_price) AS txt FROM sales),
u AS (SELECT sale_key, sold_price, regexp_replace(txt, '[$, ]', '', 'g') AS s FROM t)
SELECT sale_key, sold_price,
       CASE WHEN regexp_full_match(s, '{NUMBER_PATTERN}') THEN TRY_CAST(s AS DOUBLE) END AS parsed
FROM u"""))
def money_parse(spark, sf_dir):
    s = sales(spark, sf_dir)
    return s.select("sale_key", "sold_price", parse_money(money_text(F.col("sold_price"))).alias("parsed"))


@query("date_parse", sql=with_sql(SALES_SQL, """
t AS (SELECT sale_key, list_date,
             CASE WHEN seq % 2 = 0 THEN strftime(list_date, '%Y-%m-%d')
                  ELSE strftime(list_date, '%-m/%-d/%Y') END AS txt FROM sales)
SELECT sale_key, txt,
       coalesce(TRY_CAST(try_strptime(txt, '%Y-%m-%d') AS DATE),
                TRY_CAST(try_strptime(txt, '%m/%d/%Y') AS DATE)) AS parsed
FROM t"""))
def date_parse(spark, sf_dir):
    s = sales(spark, sf_dir)
    txt = F.when(F.col("seq") % 2 == 0, F.date_format("list_date", "yyyy-MM-dd")) \
           .otherwise(F.date_format("list_date", "M/d/yyyy"))
    return s.select("sale_key", txt.alias("txt")).select("sale_key", "txt", parse_date(F.col("txt")).alias("parsed"))


@query("valid_sales", sql=with_sql(PRICED_SQL, """
SELECT sale_key, list_date, fsa, ppsf FROM priced"""))
def valid_sales_q(spark, sf_dir):
    return priced(spark, sf_dir).select("sale_key", "list_date", "fsa", "ppsf")


_PROFILE_COLS = ("sold_price", "list_price", "area", "maint_fee", "bedrooms", "yr_blt", "discount")


@query("column_profile", sql=with_sql(SALES_SQL, "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, count({c}) AS non_null, count(*) - count({c}) AS nulls, "
    f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(1e-9 + avg({c}), 6) AS mean FROM sales"
    for c in _PROFILE_COLS)))
def column_profile_q(spark, sf_dir):
    s = sales(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in _PROFILE_COLS])
    prof = column_profile(s, _PROFILE_COLS)
    stats = s.agg(*[F.struct(F.lit(c).alias("column"), F.min(c).alias("min"), F.max(c).alias("max"),
                             rnd(F.avg(c)).alias("mean")).alias(f"p_{c}") for c in _PROFILE_COLS])
    stats = stats.select(F.explode(F.array(*[F.col(f"p_{c}") for c in _PROFILE_COLS])).alias("p")).select("p.*")
    # both sides are one row per column (tiny); the join is on the column name
    return prof.select("column", "non_null", "nulls").join(stats, "column")


@query("null_safe_ratio", sql=with_sql(SALES_SQL, """
SELECT sale_key, tax / NULLIF(discount, 0) AS tax_per_discount,
       maint_fee / NULLIF(area, 0) AS maint_per_area,
       CASE WHEN maint_fee IS NOT NULL THEN least(greatest(maint_fee, 100.0), 5000.0) END AS maint_clipped
FROM sales"""))
def null_safe_ratio(spark, sf_dir):
    from comparo.functions.numeric import clip
    s = sales(spark, sf_dir)
    return s.select("sale_key", safe_div(F.col("tax"), F.col("discount")).alias("tax_per_discount"),
                    safe_div(F.col("maint_fee"), F.col("area")).alias("maint_per_area"),
                    clip(F.col("maint_fee"), 100.0, 5000.0).alias("maint_clipped"))


@query("first_sale_per_group_day", sql=with_sql(PRICED_SQL, """
SELECT fsa, day, arg_min(sale_key, seq) AS first_sale_key, count(*) AS n_sales FROM priced GROUP BY fsa, day"""))
def first_sale_per_group_day(spark, sf_dir):
    """One row per (group, day), the first sale in the total order wins —
    ``min_by`` (partial aggregation) instead of ``dropDuplicates`` (no order) or a
    ``row_number`` window (one task per hot key)."""
    p = priced(spark, sf_dir)
    return p.groupBy("fsa", "day").agg(F.min_by("sale_key", "seq").alias("first_sale_key"),
                                       F.count(F.lit(1)).alias("n_sales"))


@query("text_shapes", sql=with_sql(SALES_SQL, f"""
t AS (SELECT *, CASE WHEN seq % 3 = 0 THEN '  $' || format('{{:,.2f}}', sold_price) || ' ' WHEN seq % 3 = 1 THEN '$ ' || format('{{:,.2f}}', sold_price) ELSE format('{{:,.2f}}', sold_price) END AS txt,
        CASE WHEN suppkey % 5 = 0 THEN 'X' || suppkey ELSE chr(CAST(65 + suppkey % 26 AS INTEGER)) || (suppkey % 10) || chr(CAST(97 + partkey % 26 AS INTEGER)) || ' 1A1' END AS postal FROM sales),
u AS (SELECT *, regexp_replace(txt, '[$,]', '', 'g') AS p2, regexp_replace(trim(txt, ' '), '[$, ]', '', 'g') AS p3 FROM t)
SELECT sale_key, CASE WHEN regexp_full_match(p2, '{NUMBER_PATTERN}') THEN TRY_CAST(p2 AS DOUBLE) END AS keep_space,
  CASE WHEN regexp_full_match(p3, '{NUMBER_PATTERN}') THEN TRY_CAST(p3 AS DOUBLE) END AS trimmed,
  nullif(regexp_extract(postal, '^([A-Za-z][0-9][A-Za-z])', 1), '') AS fsa_code, fsa || '|' || region || '|' || coalesce(CAST(partkey AS VARCHAR), '') AS place_key FROM u"""))
def text_shapes(spark, sf_dir):
    """P2/P3 (prices as text, inner blanks kept or trimmed), F1 (postal prefix by pattern), F5 (joined key)."""
    from comparo.functions.keys import composite_key, fsa_regex
    s = sales(spark, sf_dir)
    money = F.format_number("sold_price", 2)
    txt = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("  $"), money, F.lit(" "))).when(F.col("seq") % 3 == 1, F.concat(F.lit("$ "), money)).otherwise(money)
    postal = F.when(F.col("suppkey") % 5 == 0, F.concat(F.lit("X"), "suppkey")).otherwise(
        F.concat(F.char(65 + F.col("suppkey") % 26), F.col("suppkey") % 10, F.char(97 + F.col("partkey") % 26), F.lit(" 1A1")))
    return s.select("sale_key", parse_money(txt, strip_space=False).alias("keep_space"), parse_money(txt, trim=True).alias("trimmed"),
                    fsa_regex(postal).alias("fsa_code"), composite_key(F.col("fsa"), F.col("region"), F.col("partkey").cast("string")).alias("place_key"))
