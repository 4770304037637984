"""Queries: leakage audit and acceptance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.operators import audit as A
from comparo.operators import baseline as B
from comparo.operators.clean import coverage
from comparo.operators.metrics import with_median
from comparo.operators.split import snap_to_day, temporal_split
from comparo.plans.common import PRICED_SQL, priced, rnd, with_sql
from comparo.plans.registry import query
from comparo.sources.sales import SALES_SQL, sales

# Candidate numeric columns audited against the sold price (list_price is the
# planted copy of the target in the test tables: extendedprice = qty * retail).
AUDIT_COLS = ("list_price", "area", "maint_fee", "bedrooms", "yr_blt", "discount", "tax")

_AUDIT_SQL = PRICED_SQL + f""",
longf AS (UNPIVOT (SELECT sold_price AS t, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in AUDIT_COLS)} FROM priced)
          ON {', '.join(AUDIT_COLS)} INTO NAME "column" VALUE value),
agg AS (SELECT "column", count(*) AS n_joint, corr(value, t) AS corr, median(abs(value - t)) AS median_abs_diff,
               avg(CAST(abs(value - t) <= 5000 AS DOUBLE)) AS share_near
        FROM longf WHERE value IS NOT NULL AND t IS NOT NULL GROUP BY 1),
need AS (SELECT greatest(100, CAST(floor(0.05 * count(*)) AS BIGINT)) AS need FROM priced),
aud AS (SELECT agg.*, n_joint < need AS skipped,
               coalesce(n_joint >= need AND corr >= 0.995 AND (median_abs_diff <= 10000 OR share_near >= 0.5), FALSE) AS leak
        FROM agg, need)"""


def _audit(spark, sf_dir):
    return A.leakage_audit(priced(spark, sf_dir), "sold_price", AUDIT_COLS)


@query("leakage_audit", sql=with_sql(_AUDIT_SQL, """
SELECT "column", n_joint, round(1e-9 + corr, 6) AS corr, median_abs_diff, round(1e-9 + share_near, 6) AS share_near,
       skipped, leak FROM aud"""))
def leakage_audit(spark, sf_dir):
    """L1/L2: one unpivot + one aggregate over every audited column."""
    a = _audit(spark, sf_dir)
    return a.select("column", "n_joint", rnd("corr").alias("corr"), "median_abs_diff",
                    rnd("share_near").alias("share_near"), "skipped", "leak")


#: Known after listing: never a candidate, flagged or not.
HARD_EXCLUDES = ("list_price",)


@query("leakage_flags", sql=with_sql(_AUDIT_SQL, """
SELECT "column", leak, NOT leak AND "column" <> 'list_price' AS safe_candidate FROM aud"""))
def leakage_flags(spark, sf_dir):
    """L2/L4: the safe candidate list = audited - flagged - hard excludes; sparse columns stay."""
    a = _audit(spark, sf_dir)
    return a.select("column", "leak", (~F.col("leak") & ~F.col("column").isin(*HARD_EXCLUDES)).alias("safe_candidate"))


@query("ppsf_coverage", sql=with_sql(SALES_SQL, """
SELECT count(*) AS rows, count(sold_price / NULLIF(area, 0)) AS non_null,
       round(1e-9 + avg(CAST(sold_price / NULLIF(area, 0) IS NOT NULL AS DOUBLE)), 6) AS coverage,
       avg(CAST(sold_price / NULLIF(area, 0) IS NOT NULL AS DOUBLE)) >= 0.95 AS passed
FROM sales"""))
def ppsf_coverage(spark, sf_dir):
    """L6 (A2): price-per-area coverage on all sales, gate at 95%."""
    s = sales(spark, sf_dir).withColumn("ppsf", F.col("sold_price") / F.nullif(F.col("area"), F.lit(0)))
    c = coverage(s, "ppsf")
    return c.select("rows", "non_null", rnd("coverage").alias("coverage"), (F.col("coverage") >= 0.95).alias("passed"))


@query("time_order_check", sql=with_sql(PRICED_SQL, """
p AS (SELECT *, row_number() OVER (ORDER BY day, seq) AS pos, count(*) OVER () AS n_all FROM priced),
s AS (SELECT *, CASE WHEN pos <= floor(0.8 * n_all) THEN 'train' ELSE 'test' END AS split FROM p),
snap AS (SELECT day, min(CASE WHEN split = 'train' THEN 0 ELSE 1 END) AS r FROM s GROUP BY day),
s2 AS (SELECT s.*, CASE WHEN r = 0 THEN 'train' ELSE 'test' END AS split2 FROM s JOIN snap USING (day))
SELECT max(CASE WHEN split = 'train' THEN list_date END) AS max_train_date,
       min(CASE WHEN split = 'test' THEN list_date END) AS min_test_date,
       max(CASE WHEN split = 'train' THEN list_date END) < min(CASE WHEN split = 'test' THEN list_date END) AS passed,
       max(CASE WHEN split2 = 'train' THEN list_date END) < min(CASE WHEN split2 = 'test' THEN list_date END) AS passed_snapped,
       sum(CASE WHEN split2 = 'train' THEN 1 ELSE 0 END) AS n_train_snapped
FROM s2"""))
def time_order_check(spark, sf_dir):
    """L8 (A4): max train date < min test date, before and after snapping the cut to a day (§8 Z11)."""
    s = temporal_split(priced(spark, sf_dir), (0.8,), ("train", "test"))
    s2 = snap_to_day(s.withColumn("split2", F.col("split")), "split2", order=("train", "test"))
    tr, te = F.col("split") == "train", F.col("split") == "test"
    tr2, te2 = F.col("split2") == "train", F.col("split2") == "test"
    return s2.agg(F.max(F.when(tr, F.col("list_date"))).alias("max_train_date"),
                  F.min(F.when(te, F.col("list_date"))).alias("min_test_date"),
                  (F.max(F.when(tr, F.col("list_date"))) < F.min(F.when(te, F.col("list_date")))).alias("passed"),
                  (F.max(F.when(tr2, F.col("list_date"))) < F.min(F.when(te2, F.col("list_date")))).alias("passed_snapped"),
                  F.sum(F.when(tr2, 1).otherwise(0)).alias("n_train_snapped"))


@query("baseline_causality_check", sql=with_sql(PRICED_SQL, """
cut AS (SELECT CAST(quantile_disc(day, 0.5) AS INTEGER) AS c FROM priced),
pert AS (SELECT priced.*, CASE WHEN day >= c THEN ppsf * 2 ELSE ppsf END AS ppsf2 FROM priced, cut),
a AS (SELECT DISTINCT fsa, day, median(ppsf) OVER w AS m1, median(ppsf2) OVER w AS m2
      FROM pert WINDOW w AS (PARTITION BY fsa ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING))
SELECT count(*) AS n_checked,
       sum(CASE WHEN m1 IS DISTINCT FROM m2 THEN 1 ELSE 0 END) AS n_changed
FROM a, cut WHERE day <= c"""))
def baseline_causality_check(spark, sf_dir):
    """Property (c) of the test strategy: changing any price on day >= t leaves every baseline of day <= t alone."""
    p = priced(spark, sf_dir)
    # the cut day is an actual day: the lower middle value (DuckDB quantile_disc)
    cut = p.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY day)")).first()[0]
    p2 = p.withColumn("ppsf", F.when(F.col("day") >= cut, F.col("ppsf") * 2).otherwise(F.col("ppsf")))
    a = B.frame_median_by_day(p, ["fsa"], "ppsf", 90, 1).withColumnRenamed("med", "m1").drop("n")
    b = B.frame_median_by_day(p2, ["fsa"], "ppsf", 90, 1).withColumnRenamed("med", "m2").drop("n")
    j = a.join(b, ["fsa", "day"]).where(F.col("day") <= cut)
    return j.agg(F.count(F.lit(1)).alias("n_checked"),
                 F.sum(F.when(~F.col("m1").eqNullSafe(F.col("m2")), 1).otherwise(0)).alias("n_changed"))


_PER_AREA = ("list_ppsf", "maint_per_sqft", "rooms_per_sqft")


@query("leakage_audit_ppsf", sql=with_sql(PRICED_SQL, f"""
pa AS (SELECT ppsf, list_price / NULLIF(area, 0) AS list_ppsf, maint_fee / NULLIF(area, 0) AS maint_per_sqft,
              bedrooms / NULLIF(area, 0) AS rooms_per_sqft FROM priced),
longf AS (UNPIVOT pa ON {', '.join(_PER_AREA)} INTO NAME "column" VALUE value)
SELECT "column", count(*) AS n_joint, round(1e-9 + corr(value, ppsf), 6) AS corr,
       median(abs(value - ppsf)) AS median_abs_diff,
       count(*) >= greatest(100, CAST(floor(0.05 * (SELECT count(*) FROM priced)) AS BIGINT)) AND median(abs(value - ppsf)) <= 10 AS leak
FROM longf WHERE value IS NOT NULL AND ppsf IS NOT NULL GROUP BY 1"""))
def leakage_audit_ppsf(spark, sf_dir):
    """L3: per-area columns against the sold price per area; flag when the median gap is <= 10
    over at least max(100, 5%) joint rows, whatever the correlation."""
    p = priced(spark, sf_dir).select(
        "ppsf", (F.col("list_price") / F.nullif(F.col("area"), F.lit(0))).alias("list_ppsf"),
        (F.col("maint_fee") / F.nullif(F.col("area"), F.lit(0))).alias("maint_per_sqft"),
        (F.col("bedrooms") / F.nullif(F.col("area"), F.lit(0))).alias("rooms_per_sqft"))
    long = A.unpivot(p, _PER_AREA, ["ppsf"])
    d = F.abs(F.col("value") - F.col("ppsf"))
    both = long.where(F.col("value").isNotNull() & F.col("ppsf").isNotNull())
    r = both.groupBy("column").agg(F.count(F.lit(1)).alias("n_joint"), F.corr("value", "ppsf").alias("c"))
    r = with_median(r, both, ["column"], d, "median_abs_diff")
    return r.select("column", "n_joint", rnd("c").alias("corr"), "median_abs_diff",
                    ((F.col("n_joint") >= max(100, int(0.05 * p.count()))) & (F.col("median_abs_diff") <= 10)).alias("leak"))


@query("sold_only_profile", sql=with_sql(SALES_SQL, """
SELECT fsa, count(*) AS n_sold, round(1e-9 + avg(sold_price), 6) AS mean_price
FROM sales WHERE status = 'F' GROUP BY fsa"""))
def sold_only_profile(spark, sf_dir):
    """Restrict to sold rows (status 'F') before modelling."""
    s = sales(spark, sf_dir).where(F.col("status") == "F")
    return s.groupBy("fsa").agg(F.count(F.lit(1)).alias("n_sold"), rnd(F.avg("sold_price")).alias("mean_price"))


@query("ppsf_fallback", sql=with_sql(SALES_SQL, """
f AS (SELECT *, CASE WHEN discount <> 0 THEN area END AS fin_area FROM sales),
c AS (SELECT avg(CAST(sold_price / NULLIF(fin_area, 0) IS NOT NULL AS DOUBLE)) AS a, avg(CAST(sold_price / NULLIF(area, 0) IS NOT NULL AS DOUBLE)) AS b FROM f)
SELECT sale_key, CASE WHEN a >= 0.95 THEN 'fin_area' ELSE 'area' END AS used, round(1e-9 + CASE WHEN a >= 0.95 THEN a ELSE b END, 6) AS coverage,
  sold_price / NULLIF(CASE WHEN a >= 0.95 THEN fin_area ELSE area END, 0) AS ppsf FROM f, c WHERE greatest(a, b) >= 0.95"""))
def ppsf_fallback(spark, sf_dir):
    """An area column with too many gaps gives way to the fallback column."""
    s = sales(spark, sf_dir).withColumn("fin_area", F.when(F.col("discount") != 0, F.col("area")))
    t, used, got = A.ppsf_gate(s, "sold_price", "fin_area", "area")
    return t.select("sale_key", F.lit(used).alias("used"), rnd(F.lit(got)).alias("coverage"), "ppsf")
