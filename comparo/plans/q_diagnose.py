"""Queries: exploratory diagnostics (X1-X15, AG5-AG8, AG12-AG16, M9/M10, P9/P10/P22).

Cohorts follow the reference's single- vs multi-storey study: ``single`` =
one floor level, ``multi`` = more.  Roles on the test tables: restricted =
order priority containing 'URGENT', leasehold = title containing 'R'.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.operators import audit as A
from comparo.operators.features import age_at_list
from comparo.operators.metrics import with_median
from comparo.plans.common import PRICED_ORDERS_SQL, PRICED_SQL, priced, rnd, with_sql
from comparo.plans.registry import query



def _cohort():
    """'multi' needs more than one floor; unknown floors belong to neither cohort."""
    return F.when(F.col("floors") == 1, F.lit("single")).when(F.col("floors") > 1, F.lit("multi"))


_COHORT_SQL = "CASE WHEN floors = 1 THEN 'single' WHEN floors > 1 THEN 'multi' END"
_AGE_SQL = "coalesce(greatest(year(list_date) - least(greatest(yr_blt, 1900), year(list_date)), 0), 20)::DOUBLE"

DIAG_SQL = PRICED_ORDERS_SQL + f""",
dg AS (SELECT *, {_COHORT_SQL} AS cohort, {_AGE_SQL} AS age,
              CAST(contains(restricted, 'URGENT') AS INTEGER) AS is_restricted,
              CAST(contains(title, 'R') AS INTEGER) AS is_leasehold
       FROM priced WHERE area > 0 AND area < 5000)"""


def diag(spark, sf_dir):
    """P9 range predicate (0 < area < 5000), cohort, age, flags."""
    p = priced(spark, sf_dir, with_orders=True).where((F.col("area") > 0) & (F.col("area") < 5000))
    return p.select("*", _cohort().alias("cohort"),
                    age_at_list(F.year("list_date"), F.col("yr_blt")).alias("age"),
                    F.col("restricted").contains("URGENT").cast("int").alias("is_restricted"),
                    F.col("title").contains("R").cast("int").alias("is_leasehold"))


@query("corr_matrix", sql=with_sql(PRICED_SQL, """
SELECT 'area' AS a, 'floors' AS b, round(1e-9 + corr(area, floors), 6) AS corr, corr(area, floors) > 0.7 AS strong FROM priced
UNION ALL SELECT 'area', 'sold_price', round(1e-9 + corr(area, sold_price), 6), corr(area, sold_price) > 0.7 FROM priced
UNION ALL SELECT 'floors', 'sold_price', round(1e-9 + corr(floors, sold_price), 6), corr(floors, sold_price) > 0.7 FROM priced"""))
def corr_matrix(spark, sf_dir):
    """X1/AG16: pairwise correlations in one aggregate; verdict at 0.7."""
    c = A.corr_pairs(priced(spark, sf_dir).select(F.col("area").cast("double"), F.col("floors").cast("double"),
                                                  "sold_price"), ["area", "floors", "sold_price"])
    return c.select("a", "b", rnd("corr").alias("corr"), (F.col("corr") > 0.7).alias("strong"))


@query("stats_by_floors", sql=with_sql(PRICED_SQL, """
SELECT floors, round(1e-9 + avg(area), 6) AS mean_area, median(area) AS median_area, count(*) AS n,
       round(1e-9 + stddev_samp(area), 6) AS std_area,
       round(1e-9 + avg(sold_price), 6) AS mean_price, round(1e-9 + avg(sold_price / area), 6) AS mean_ppsf
FROM priced GROUP BY floors"""))
def stats_by_floors(spark, sf_dir):
    """X2/X4/AG5/AG8: area and price statistics per number of floors."""
    p = priced(spark, sf_dir)
    agg = p.groupBy("floors").agg(
        rnd(F.avg("area")).alias("mean_area"),
        F.count(F.lit(1)).alias("n"), rnd(F.stddev_samp("area")).alias("std_area"),
        rnd(F.avg("sold_price")).alias("mean_price"), rnd(F.avg(F.col("sold_price") / F.col("area"))).alias("mean_ppsf"))
    return with_median(agg, p, ["floors"], "area", "median_area")


# Target sizes (±3 area units) and size bands on the test tables' area scale.
TARGET_SIZES = (15, 25, 35)
SIZE_BANDS = ((10, 20), (20, 30), (30, 50))


@query("price_near_size", sql=with_sql(PRICED_SQL, f"""
t AS (SELECT * FROM (VALUES {', '.join(f'({s})' for s in TARGET_SIZES)}) v(target))
SELECT target, floors, round(1e-9 + avg(sold_price), 6) AS mean_price, count(*) AS n
FROM priced JOIN t ON area BETWEEN target - 3 AND target + 3 GROUP BY target, floors"""))
def price_near_size(spark, sf_dir):
    """Price by floors among sales near three target sizes."""
    targets = F.array(*[F.lit(s) for s in TARGET_SIZES])
    p = priced(spark, sf_dir)
    near = F.filter(targets, lambda t: (F.col("area") >= t - 3) & (F.col("area") <= t + 3))
    j = p.select("floors", "sold_price", F.explode(near).alias("target"))  # no join: ≤ 3 copies per row
    return j.groupBy("target", "floors").agg(rnd(F.avg("sold_price")).alias("mean_price"),
                                             F.count(F.lit(1)).alias("n"))


def _band_sql():
    cases = " ".join(f"WHEN area >= {lo} AND area < {hi} THEN '{lo}-{hi}'" for lo, hi in SIZE_BANDS)
    return f"CASE {cases} END"


@query("size_band_premium", sql=with_sql(PRICED_SQL, f"""
b AS (SELECT *, {_band_sql()} AS band FROM priced),
g AS (SELECT band, avg(CASE WHEN floors = 1 THEN sold_price END) AS single_price,
             avg(CASE WHEN floors > 1 THEN sold_price END) AS multi_price, count(*) AS n
      FROM b WHERE band IS NOT NULL GROUP BY band)
SELECT band, round(1e-9 + single_price, 6) AS single_price, round(1e-9 + multi_price, 6) AS multi_price,
       round(1e-9 + multi_price - single_price, 6) AS premium,
       round(1e-9 + 100 * (multi_price - single_price) / single_price, 6) AS premium_pct, n
FROM g"""))
def size_band_premium(spark, sf_dir):
    """Multi-storey premium within half-open size bands."""
    band = None
    for lo, hi in SIZE_BANDS:
        c = (F.col("area") >= lo) & (F.col("area") < hi)
        band = F.when(c, F.lit(f"{lo}-{hi}")) if band is None else band.when(c, F.lit(f"{lo}-{hi}"))
    p = priced(spark, sf_dir).withColumn("band", band).where(F.col("band").isNotNull())
    g = p.groupBy("band").agg(F.avg(F.when(F.col("floors") == 1, F.col("sold_price"))).alias("s"),
                              F.avg(F.when(F.col("floors") > 1, F.col("sold_price"))).alias("m"),
                              F.count(F.lit(1)).alias("n"))
    return g.select("band", rnd("s").alias("single_price"), rnd("m").alias("multi_price"),
                    rnd(F.col("m") - F.col("s")).alias("premium"),
                    rnd(100 * (F.col("m") - F.col("s")) / F.col("s")).alias("premium_pct"), "n")


@query("cohort_compare", sql=with_sql(DIAG_SQL, """
c AS (SELECT cohort, count(*) AS n, avg(age) AS mean_age, avg(sold_price) AS mean_price,
             avg(is_restricted) AS restricted_share, avg(maint_fee) AS mean_maint_fee,
             avg(is_leasehold) AS leasehold_share
      FROM dg GROUP BY cohort),
gap AS (SELECT max(CASE WHEN cohort = 'multi' THEN mean_age END) - max(CASE WHEN cohort = 'single' THEN mean_age END) AS g FROM c)
SELECT cohort, n, round(1e-9 + mean_age, 6) AS mean_age, round(1e-9 + mean_price, 6) AS mean_price,
       round(1e-9 + restricted_share, 6) AS restricted_share, round(1e-9 + mean_maint_fee, 6) AS mean_maint_fee,
       round(1e-9 + leasehold_share, 6) AS leasehold_share,
       abs(gap.g) > 10 AS age_gap_verdict, restricted_share > 0.5 AS restricted_verdict,
       leasehold_share > 0.3 AS leasehold_verdict
FROM c, gap"""))
def cohort_compare(spark, sf_dir):
    """Cohort sizes, mean age, price, restricted/leasehold shares and verdicts."""
    d = diag(spark, sf_dir)
    c = d.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg("age").alias("mean_age"),
                                F.avg("sold_price").alias("mean_price"), F.avg("is_restricted").alias("rs"),
                                F.avg("maint_fee").alias("mf"), F.avg("is_leasehold").alias("ls"))
    ages = {r["cohort"]: r["mean_age"] for r in c.select("cohort", "mean_age").collect()}  # two rows
    gap = (ages.get("multi") or 0.0) - (ages.get("single") or 0.0)
    return c.select("cohort", "n", rnd("mean_age").alias("mean_age"), rnd("mean_price").alias("mean_price"),
                    rnd("rs").alias("restricted_share"), rnd("mf").alias("mean_maint_fee"),
                    rnd("ls").alias("leasehold_share"), F.lit(abs(gap) > 10).alias("age_gap_verdict"),
                    (F.col("rs") > 0.5).alias("restricted_verdict"), (F.col("ls") > 0.3).alias("leasehold_verdict"))


@query("decade_histogram", sql=with_sql(DIAG_SQL, """
SELECT cohort, CAST(floor(yr_blt / 10) * 10 AS INTEGER) AS decade, count(*) AS n
FROM dg WHERE yr_blt < 2030 GROUP BY 1, 2"""))
def decade_histogram(spark, sf_dir):
    """Count by decade built per cohort."""
    d = diag(spark, sf_dir).where(F.col("yr_blt") < 2030)
    return d.groupBy("cohort", (F.floor(F.col("yr_blt") / 10) * 10).cast("int").alias("decade")) \
            .agg(F.count(F.lit(1)).alias("n"))


@query("cohort_value_counts", sql=with_sql(DIAG_SQL, """
SELECT cohort, 'fsa' AS attribute, fsa AS value, count(*) AS n FROM dg GROUP BY 1, 3
UNION ALL SELECT cohort, 'type_dwel', type_dwel, count(*) FROM dg GROUP BY 1, 3
UNION ALL SELECT cohort, 'title', title, count(*) FROM dg GROUP BY 1, 3"""))
def cohort_value_counts(spark, sf_dir):
    """X9/AG12: value counts per cohort of location, type and title — one unpivot, one aggregate."""
    d = diag(spark, sf_dir).select("cohort", "fsa", "type_dwel", "title")
    long = A.unpivot(d, ["fsa", "type_dwel", "title"], ["cohort"], "attribute", "value")
    return long.groupBy("cohort", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


@query("newer_only_compare", sql=with_sql(DIAG_SQL, """
SELECT cohort, count(*) AS n, round(1e-9 + avg(sold_price), 6) AS mean_price,
       round(1e-9 + avg(sold_price / area), 6) AS mean_ppsf
FROM dg WHERE yr_blt >= 1990 GROUP BY cohort"""))
def newer_only_compare(spark, sf_dir):
    """X11/P10: the cohort comparison among newer buildings only."""
    d = diag(spark, sf_dir).where(F.col("yr_blt") >= 1990)
    return d.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("sold_price")).alias("mean_price"),
                                   rnd(F.avg(F.col("sold_price") / F.col("area"))).alias("mean_ppsf"))


_AGE_CLASS_SQL = "CASE WHEN age <= 10 THEN 'new' WHEN age <= 20 THEN 'mid' ELSE 'old' END"


@query("simpson_table", sql=with_sql(DIAG_SQL, f"""
SELECT {_AGE_CLASS_SQL} AS age_class, cohort, round(1e-9 + avg(ppsf), 6) AS mean_ppsf, count(*) AS n FROM dg GROUP BY 1, 2
UNION ALL
SELECT 'pooled', cohort, round(1e-9 + avg(ppsf), 6), count(*) FROM dg GROUP BY 2"""))
def simpson_table(spark, sf_dir):
    """Price per area by age class × cohort next to the pooled comparison (grouping sets)."""
    d = diag(spark, sf_dir).withColumn(
        "age_class", F.when(F.col("age") <= 10, "new").when(F.col("age") <= 20, "mid").otherwise("old"))
    r = d.rollup("cohort", "age_class").agg(rnd(F.avg("ppsf")).alias("mean_ppsf"), F.count(F.lit(1)).alias("n"),
                                            F.grouping("age_class").alias("g_age"), F.grouping("cohort").alias("g_c"))
    return r.where(F.col("g_c") == 0).select(
        F.when(F.col("g_age") == 1, F.lit("pooled")).otherwise(F.col("age_class")).alias("age_class"),
        "cohort", "mean_ppsf", "n")


@query("sample_listing", sql=with_sql(DIAG_SQL, """
SELECT sale_key, cohort, substr(complex, 1, 8) AS complex_short, sold_price FROM dg
ORDER BY ('0x' || substr(md5(sale_key || '|7'), 1, 15))::BIGINT, sale_key LIMIT 10"""))
def sample_listing(spark, sf_dir):
    """Ten sample rows with truncated text (a sampling report: the limit is the feature)."""
    from comparo.functions.keys import hash60
    d = diag(spark, sf_dir)
    return (d.orderBy(hash60(F.concat(F.col("sale_key"), F.lit("|7"))), "sale_key").limit(10)
             .select("sale_key", "cohort", F.substring("complex", 1, 8).alias("complex_short"), "sold_price"))


@query("ols_r2_compare", sql=with_sql(PRICED_SQL, """
r AS (SELECT corr(sold_price, area) AS r1, corr(sold_price, floors) AS r2, corr(area, floors) AS r12,
             regr_slope(sold_price, area) AS slope_1, regr_intercept(sold_price, area) AS intercept_1 FROM priced)
SELECT round(1e-9 + r1 * r1, 6) AS r2_x1,
       round(1e-9 + (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12), 6) AS r2_x1_x2,
       round(1e-9 + (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1, 6) AS r2_gain,
       (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / (1 - r12 * r12) - r1 * r1 > 0.01 AS adds_signal,
       r12 * r12 > 0.7 AS collinear, round(1e-9 + slope_1, 6) AS slope_1, round(1e-9 + intercept_1, 4) AS intercept_1
FROM r"""))
def ols_r2_compare(spark, sf_dir):
    """One- and two-predictor OLS R² (price on area, + floors), gain and collinearity."""
    p = priced(spark, sf_dir).select("sold_price", F.col("area").cast("double"), F.col("floors").cast("double"))
    r = A.two_predictor_r2(p, "sold_price", "area", "floors")
    return r.select(rnd("r2_x1").alias("r2_x1"), rnd("r2_x1_x2").alias("r2_x1_x2"), rnd("r2_gain").alias("r2_gain"),
                    "adds_signal", "collinear", rnd("slope_1").alias("slope_1"),
                    rnd("intercept_1", 4).alias("intercept_1"))
