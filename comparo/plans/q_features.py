"""Queries: derived features (F7-F17, D2-D20, P14-P16, AG17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.functions.calendar import calendar_columns
from comparo.operators import features as X
from comparo.operators.baseline import grouped_median
from comparo.operators.encode import label_codes
from comparo.plans.common import PRICED_SQL, SPLIT_SQL, cut_frame, priced, rnd, with_sql
from comparo.plans.registry import query


@query("calendar_features", sql=with_sql(PRICED_SQL, """
SELECT sale_key, year(list_date) AS year, month(list_date) AS month, quarter(list_date) AS quarter,
       dayofyear(list_date) AS day_of_year, weekofyear(list_date) AS iso_week,
       CAST(date_trunc('month', list_date) AS DATE) AS month_start,
       round(1e-9 + sin(2 * pi() * month(list_date) / 12.0), 6) AS month_sin,
       round(1e-9 + cos(2 * pi() * month(list_date) / 12.0), 6) AS month_cos,
       (list_date - DATE '2015-01-01') / 30.0 AS month_idx
FROM priced"""))
def calendar_features(spark, sf_dir):
    p = priced(spark, sf_dir).select("sale_key", *calendar_columns(F.col("list_date")))
    return p.select("sale_key", "year", "month", "quarter", "day_of_year", "iso_week", "month_start",
                    rnd("month_sin").alias("month_sin"), rnd("month_cos").alias("month_cos"), "month_idx")


@query("age_at_list", sql=with_sql(PRICED_SQL, """
SELECT sale_key, coalesce(greatest(year(list_date) - least(greatest(yr_blt, 1900), year(list_date)), 0), 20)::DOUBLE
       AS age_at_list, floor(yr_blt / 10) * 10 AS decade_built
FROM priced"""))
def age_at_list_q(spark, sf_dir):
    p = priced(spark, sf_dir)
    return p.select("sale_key", X.age_at_list(F.year("list_date"), F.col("yr_blt")).alias("age_at_list"),
                    (F.floor(F.col("yr_blt") / 10) * 10).alias("decade_built"))


@query("ratio_features", sql=with_sql(PRICED_SQL, """
SELECT sale_key, bedrooms / NULLIF(area, 0) AS rooms_per_sqft,
       full_baths + 0.5 * half_baths AS baths_equiv,
       (full_baths + 0.5 * half_baths) / greatest(bedrooms, 1) AS baths_per_br,
       maint_fee / NULLIF(area, 0) AS maint_per_sqft,
       area / greatest(bedrooms, 1) AS sqft_per_br
FROM priced"""))
def ratio_features(spark, sf_dir):
    r = X.ratio_columns(priced(spark, sf_dir))
    return r.select("sale_key", "rooms_per_sqft", "baths_equiv", "baths_per_br", "maint_per_sqft", "sqft_per_br")


@query("missing_flags", sql=with_sql(PRICED_SQL, """
SELECT sale_key, CAST(maint_fee IS NULL AS INTEGER) AS maint_fee_isna,
       CAST(maint_fee IS NOT NULL AS INTEGER) AS has_maint_fee
FROM priced"""))
def missing_flags_q(spark, sf_dir):
    return X.missing_flags(priced(spark, sf_dir), ["maint_fee"]).select(
        "sale_key", "maint_fee_isna", "has_maint_fee")


_WIN_COLS = ("list_price", "area", "maint_fee")


@query("winsorized", sql=with_sql(SPLIT_SQL, """
lim AS (SELECT quantile_cont(list_price, [0.005, 0.995]) AS lp, quantile_cont(area, [0.005, 0.995]) AS ar,
               quantile_cont(maint_fee, [0.005, 0.995]) AS mf FROM spl WHERE split = 'train')
SELECT sale_key,
       round(1e-9 + CASE WHEN list_price IS NOT NULL THEN least(greatest(list_price, lp[1]), lp[2]) END, 6) AS list_price_w,
       round(1e-9 + CASE WHEN area IS NOT NULL THEN least(greatest(area, ar[1]), ar[2]) END, 6) AS area_w,
       round(1e-9 + CASE WHEN maint_fee IS NOT NULL THEN least(greatest(maint_fee, mf[1]), mf[2]) END, 6) AS maint_fee_w
FROM spl, lim"""))
def winsorized(spark, sf_dir):
    """Limits fitted on the train split only (§8 Z8), applied to all rows."""
    s = cut_frame(spark, sf_dir, _WIN_COLS)
    lim = X.quantile_limits(s.where(F.col("split") == "train"), _WIN_COLS)
    # interpolated limits differ between engines in the last bits: tie-stable rounding
    return X.winsorize(s, lim).select("sale_key", *[rnd(f"{c}_w").alias(f"{c}_w") for c in _WIN_COLS])


@query("bin_median_impute", sql=with_sql(SPLIT_SQL, """
mm AS (SELECT min(area) AS lo, max(area) AS hi FROM spl WHERE split = 'train'),
b AS (SELECT spl.*, CAST(least(5, greatest(1, ceil((area - lo) / (hi - lo) * 5))) AS INTEGER) AS area_bin,
             maint_fee / NULLIF(area, 0) AS mps FROM spl, mm),
med AS (SELECT area_bin, median(mps) AS bin_med FROM b WHERE split = 'train' GROUP BY 1),
allmed AS (SELECT median(mps) AS all_med FROM b WHERE split = 'train')
SELECT sale_key, area_bin, coalesce(mps, bin_med, all_med) AS maint_per_sqft_filled
FROM b LEFT JOIN med USING (area_bin), allmed"""))
def bin_median_impute(spark, sf_dir):
    """P16/AG17: NULL maintenance per area ← median of its equal-width area bin (train-fitted)."""
    s = cut_frame(spark, sf_dir, ["area", "maint_fee"])
    train = s.where(F.col("split") == "train")
    lo, hi = train.agg(F.min("area"), F.max("area")).first()
    b = (s.withColumn("area_bin", X.equal_width_bin(F.col("area"), lo, hi, 5))
          .withColumn("mps", F.col("maint_fee") / F.nullif(F.col("area"), F.lit(0))))
    tr = b.where(F.col("split") == "train")
    med = grouped_median(tr, ["area_bin"], "mps", "bin_med")  # ≤ 5 rows, each bin may be huge
    all_med = grouped_median(tr, [], "mps").first()[0]
    return (b.join(F.broadcast(med), "area_bin", "left")
             .select("sale_key", "area_bin",
                     F.coalesce("mps", "bin_med", F.lit(all_med)).alias("maint_per_sqft_filled")))


@query("poly_interactions", sql=with_sql(PRICED_SQL, """
codes AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS loc_code
          FROM (SELECT DISTINCT coalesce(fsa, 'Unknown') AS v FROM priced)),
a AS (SELECT sale_key, area, coalesce(fsa, 'Unknown') AS v,
             coalesce(greatest(year(list_date) - least(greatest(yr_blt, 1900), year(list_date)), 0), 20)::DOUBLE AS age
      FROM priced)
SELECT sale_key, loc_code, age * age AS age_squared, round(1e-9 + ln(1 + age), 6) AS age_log,
       area * area AS sqft_squared, round(1e-9 + ln(1 + area), 6) AS sqft_log,
       loc_code * age AS location_age, loc_code * area AS location_size
FROM a JOIN codes USING (v)"""))
def poly_interactions(spark, sf_dir):
    """D11/D12 with E1 location codes."""
    p = priced(spark, sf_dir).withColumn("age_at_list", X.age_at_list(F.year("list_date"), F.col("yr_blt")))
    p = label_codes(p, "fsa", out="loc_code")
    r = X.poly_features(p, "age_at_list", "area", "loc_code")
    return r.select("sale_key", "loc_code", "age_squared", rnd("age_log").alias("age_log"), "sqft_squared",
                    rnd("sqft_log").alias("sqft_log"), "location_age", "location_size")


@query("log_targets", sql=with_sql(PRICED_SQL, """
SELECT sale_key, round(1e-9 + ln(sold_price), 6) AS log_price, round(1e-9 + ln(1 + sold_price), 6) AS log1p_price,
       round(1e-9 + ln(ppsf), 6) AS log_ppsf, round(1e-9 + abs(exp(ln(sold_price)) - sold_price), 6) AS back_transform_err
FROM priced"""))
def log_targets(spark, sf_dir):
    """Log, log1p targets and the back-transform."""
    p = priced(spark, sf_dir)
    return p.select("sale_key", rnd(F.log("sold_price")).alias("log_price"),
                    rnd(F.log1p("sold_price")).alias("log1p_price"), rnd(F.log("ppsf")).alias("log_ppsf"),
                    rnd(F.abs(F.exp(F.log("sold_price")) - F.col("sold_price"))).alias("back_transform_err"))


@query("median_fill", sql=with_sql(SPLIT_SQL, """
m AS (SELECT median(CAST(maint_fee AS DOUBLE)) AS mm, median(CAST(tax AS DOUBLE)) AS mt FROM spl WHERE split = 'train')
SELECT sale_key, round(1e-9 + coalesce(CAST(maint_fee AS DOUBLE), mm), 6) AS maint_fee_filled,
       round(1e-9 + coalesce(CAST(tax AS DOUBLE), mt), 6) AS tax_filled FROM spl, m"""))
def median_fill(spark, sf_dir):
    """Missing fees and taxes get the column's median over train."""
    s = X.median_fill(cut_frame(spark, sf_dir, ["maint_fee", "tax"]), ["maint_fee", "tax"], F.col("split") == "train")
    return s.select("sale_key", rnd("maint_fee_filled").alias("maint_fee_filled"), rnd("tax_filled").alias("tax_filled"))


@query("listing_defaults", sql=with_sql(PRICED_SQL, """
SELECT sale_key, (linenumber % 4) / greatest(CASE WHEN seq % 5 = 0 THEN 1 ELSE coalesce(bedrooms, 1) END, 1) AS parking_per_br,
  CAST(coalesce(month(d), 6) AS INTEGER) AS list_month, CAST(coalesce(quarter(d), 2) AS INTEGER) AS list_quarter, CAST(coalesce(year(d), 2020) AS INTEGER) AS list_year
FROM (SELECT *, CASE WHEN seq % 7 <> 0 THEN list_date END AS d FROM priced)"""))
def listing_defaults(spark, sf_dir):
    """D9 (parking per bedroom), D13/P14 (calendar columns of a missing date); every seventh date and fifth bedroom count is taken away."""
    p = priced(spark, sf_dir)
    rooms = F.when(F.col("seq") % 5 != 0, F.col("bedrooms"))
    d = F.when(F.col("seq") % 7 != 0, F.col("list_date"))
    return p.select("sale_key", X.per_bedroom((F.col("linenumber") % 4).cast("double"), rooms).alias("parking_per_br"), *X.list_date_columns(d))


@query("back_transforms", sql=with_sql(PRICED_SQL, """
SELECT sale_key, round(1e-9 + exp(ln(1 + list_price)) - 1, 4) AS from_log1p, round(1e-9 + exp(ln(ppsf) - 0.1) * area, 4) AS from_log_ppsf,
  round(1e-9 + list_price * exp(ln(sold_price) - ln(list_price)), 4) AS from_log_ratio FROM priced"""))
def back_transforms(spark, sf_dir):
    """expm1 of a log1p price, exp of a log price per area times area, baseline times exp of a log ratio."""
    from comparo.operators.model import back_transform, from_log1p, from_log_ratio
    p = priced(spark, sf_dir)
    return p.select("sale_key", rnd(from_log1p(F.log1p("list_price")), 4).alias("from_log1p"),
                    rnd(back_transform(F.log("ppsf") - 0.1, F.lit(1.0), F.col("area")), 4).alias("from_log_ppsf"),
                    rnd(from_log_ratio(F.log("sold_price") - F.log("list_price"), F.col("list_price")), 4).alias("from_log_ratio"))
