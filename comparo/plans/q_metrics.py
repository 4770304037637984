"""Queries: metrics and comparisons (Q1-Q15), with the causal baseline price as the prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.operators import metrics as M
from comparo.operators.baseline import grouped_median, grouped_quantile
from comparo.operators.model import fit_linear
from comparo.operators.split import cut_split
from comparo.plans.common import rnd, with_sql
from comparo.plans.q_baseline import SHRUNK_SQL, shrunk
from comparo.plans.registry import query
from comparo.session import materialize

EVAL_SQL = SHRUNK_SQL + """,
ev0 AS (SELECT *, row_number() OVER (ORDER BY day, seq) AS pos, count(*) OVER () AS n_all,
               base_ppsf * area AS pred FROM shrunk),
ev AS (SELECT *, CASE WHEN pos <= floor(0.7 * n_all) THEN 'train'
                      WHEN pos <= floor(0.8 * n_all) THEN 'val' ELSE 'test' END AS split FROM ev0)"""


def evaluated(spark, sf_dir, columns=("sold_price",)):
    """``columns`` of the priced rows with the shrunk baseline as the prediction ``pred`` + 70/10/20 split,
    materialized once (the split needs a row count and the reports several passes)."""
    s = shrunk(spark, sf_dir, columns=[c for c in (*columns, "area", "seq") if c != "base_ppsf"])
    s = s.withColumn("pred", F.col("base_ppsf") * F.col("area"))
    return cut_split(materialize(s.select(*dict.fromkeys([*columns, "day", "seq", "pred"]))), (0.7, 0.8))


def _metric_sql(y, p):
    ok = f"{y} IS NOT NULL AND {p} IS NOT NULL"
    e = f"CASE WHEN {ok} THEN {y} - {p} END"
    return f"""count({e}) AS n, round(1e-9 + avg(abs({e})), 6) AS mae,
       round(1e-9 + sum(abs({e})) / sum(CASE WHEN {ok} THEN abs({y}) END), 6) AS wape,
       round(1e-9 + avg(CASE WHEN {ok} THEN abs({e}) / abs({y}) END), 6) AS mape,
       round(1e-9 + sqrt(avg(({e}) * ({e}))), 6) AS rmse,
       round(1e-9 + 1 - sum(({e}) * ({e})) / NULLIF(var_pop(CASE WHEN {ok} THEN {y} END) * count({e}), 0), 6) AS r2,
       median(abs({e})) AS median_ae,
       round(1e-9 + avg(CASE WHEN {ok} THEN CAST(abs({e}) / abs({y}) <= 0.10 + 1e-9 AS DOUBLE) END), 6) AS within_10pct"""


def _rounded(df):
    keep = {"n", "median_ae", "split"}
    return df.select(*[F.col(c) if c in keep else rnd(c).alias(c) for c in df.columns])


@query("metrics_by_split", sql=with_sql(EVAL_SQL, f"""
SELECT split, {_metric_sql('sold_price', 'pred')} FROM ev GROUP BY split"""))
def metrics_by_split(spark, sf_dir):
    """Q1-Q9: baseline price vs sold price per split."""
    return _rounded(M.metrics(evaluated(spark, sf_dir), "sold_price", "pred", ["split"]))


@query("within_10pct", sql=with_sql(EVAL_SQL, """
SELECT split, count(*) AS n_rows,
       sum(CASE WHEN abs(sold_price - pred) / sold_price <= 0.10 + 1e-9 THEN 1 ELSE 0 END) AS n_within_10pct,
       sum(CASE WHEN abs(sold_price - pred) <= 5000 THEN 1 ELSE 0 END) AS n_within_5000,
       round(1e-9 + avg(CASE WHEN pred IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM ev GROUP BY split"""))
def within_10pct(spark, sf_dir):
    """Q8/AG14: conditional counts and coverage per split."""
    e = evaluated(spark, sf_dir)
    ae = F.abs(F.col("sold_price") - F.col("pred"))
    return e.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(ae / F.col("sold_price") <= 0.10 + 1e-9, 1).otherwise(0)).alias("n_within_10pct"),
        F.sum(F.when(ae <= 5000, 1).otherwise(0)).alias("n_within_5000"),
        rnd(F.avg(F.when(F.col("pred").isNotNull(), 1.0).otherwise(0.0))).alias("coverage"))


@query("baseline_vs_naive", sql=with_sql(EVAL_SQL, """
med AS (SELECT median(sold_price) AS m FROM ev WHERE split = 'train'),
t AS (SELECT * FROM ev WHERE split = 'test')
SELECT round(1e-9 + avg(abs(sold_price - pred)), 6) AS mae_baseline,
       round(1e-9 + avg(abs(sold_price - m)), 6) AS mae_median_price,
       round(1e-9 + 100 * (1 - avg(abs(sold_price - pred)) / avg(abs(sold_price - m))), 6) AS improvement_pct,
       median(abs(list_price - sold_price)) AS naive_list_median,
       round(1e-9 + avg(abs(list_price - sold_price)), 6) AS naive_list_mean,
       round(1e-9 + quantile_cont(abs(list_price - sold_price), 0.75), 6) AS naive_list_p75
FROM t, med"""))
def baseline_vs_naive(spark, sf_dir):
    """Q10/Q11/Q14: baseline vs median-price baseline and the |list - sold| naive baseline on test."""
    e = evaluated(spark, sf_dir, ("sold_price", "list_price"))
    m = grouped_median(e.where(F.col("split") == "train"), [], "sold_price").first()[0]
    t = e.where(F.col("split") == "test")
    ae_b = F.abs(F.col("sold_price") - F.col("pred"))
    ae_m = F.abs(F.col("sold_price") - F.lit(m))
    nl = F.abs(F.col("list_price") - F.col("sold_price"))
    agg = t.agg(rnd(F.avg(ae_b)).alias("mae_baseline"), rnd(F.avg(ae_m)).alias("mae_median_price"),
                rnd(100 * (1 - F.avg(ae_b) / F.avg(ae_m))).alias("improvement_pct"),
                rnd(F.avg(nl)).alias("naive_list_mean"))
    p75 = grouped_quantile(t.select(nl.alias("nl")), [], "nl", 0.75).first()[0]
    # a non-median quantile's interpolation differs in the last bits between engines
    return M.with_median(agg, t, [], nl, "naive_list_median").withColumn("naive_list_p75", rnd(F.lit(p75)))


@query("error_by_group_top10", sql=with_sql(EVAL_SQL, """
SELECT fsa, round(1e-9 + avg(abs(sold_price - pred) / abs(sold_price)), 6) AS mape, count(*) AS n
FROM ev WHERE split = 'test' AND pred IS NOT NULL
GROUP BY fsa ORDER BY avg(abs(sold_price - pred) / abs(sold_price)) DESC, fsa LIMIT 10"""))
def error_by_group_top10(spark, sf_dir):
    """Q12: worst ten FSAs by mean absolute % error on test."""
    t = evaluated(spark, sf_dir, ("fsa", "sold_price")).where(F.col("split") == "test")
    r = M.error_by_group(t, "sold_price", "pred", "fsa", 10)
    return r.select("fsa", rnd("mape").alias("mape"), "n")


@query("error_by_month_last6", sql=with_sql(EVAL_SQL, """
SELECT CAST(date_trunc('month', list_date) AS DATE) AS month_start,
       round(1e-9 + avg(abs(sold_price - pred)), 6) AS mae, count(*) AS n
FROM ev WHERE split = 'test' GROUP BY 1 ORDER BY 1 DESC LIMIT 6"""))
def error_by_month_last6(spark, sf_dir):
    """MAE per month on test, the last six months."""
    t = evaluated(spark, sf_dir, ("list_date", "sold_price")).where(F.col("split") == "test")
    return (t.groupBy(F.trunc("list_date", "MM").alias("month_start"))
             .agg(rnd(F.avg(F.abs(F.col("sold_price") - F.col("pred")))).alias("mae"), F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("month_start")).limit(6))


@query("target_stats_by_split", sql=with_sql(EVAL_SQL, """
SELECT split, count(*) AS n, min(list_date) AS first_date, max(list_date) AS last_date,
       round(1e-9 + avg(ln(sold_price) - ln(pred)), 6) AS y_mean, round(1e-9 + stddev_samp(ln(sold_price) - ln(pred)), 6) AS y_std,
       round(1e-9 + min(ln(sold_price) - ln(pred)), 6) AS y_min, round(1e-9 + max(ln(sold_price) - ln(pred)), 6) AS y_max
FROM ev GROUP BY split"""))
def target_stats_by_split(spark, sf_dir):
    """Log price ratio statistics, size and date range per split."""
    e = evaluated(spark, sf_dir, ("list_date", "sold_price")).withColumn("yr", F.log("sold_price") - F.log("pred"))
    return e.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("list_date").alias("first_date"), F.max("list_date").alias("last_date"),
        rnd(F.avg("yr")).alias("y_mean"), rnd(F.stddev_samp("yr")).alias("y_std"),
        rnd(F.min("yr")).alias("y_min"), rnd(F.max("yr")).alias("y_max"))


# The features of the linear model that is set against the baseline.
MODEL_FEATURES = ("area", "full_baths", "tax")


def _linear_sql():
    from comparo.plans.q_search import _fits_sql
    fits = _fits_sql("lp", "z", 3, False, "rws")
    return f"""subs AS (SELECT '0,1,2' AS subset_id, 3 AS n_features, [0, 1, 2] AS idx, 'm' AS features_text),
rws AS (SELECT split, sold_price AS price, pred, ln(sold_price) - ln(pred) AS lp, [area::DOUBLE, full_baths::DOUBLE, tax::DOUBLE] AS xs FROM ev WHERE pred > 0),
{fits[:fits.index('err AS (')].rstrip().rstrip(',')},
e AS (SELECT r.split, price, pred, lp, b0 + b1 * xs[1] + b2 * xs[2] + b3 * xs[3] AS z FROM rws r, fit),
m AS (SELECT *, pred * exp(z) AS mp FROM e)"""


@query("model_vs_baseline", sql=with_sql(EVAL_SQL, _linear_sql(), """
SELECT split, count(*) AS n, round(1e-9 + avg(abs(price - pred)), 4) AS mae_baseline, round(1e-9 + avg(abs(price - mp)), 4) AS mae_model,
  round(1e-9 + sum(abs(price - pred)) / sum(abs(price)), 6) AS wape_baseline, round(1e-9 + sum(abs(price - mp)) / sum(abs(price)), 6) AS wape_model,
  round(1e-9 + 1 - sum((price - pred) ** 2) / (var_pop(price) * count(*)), 6) AS r2_baseline, round(1e-9 + 1 - sum((price - mp) ** 2) / (var_pop(price) * count(*)), 6) AS r2_model,
  round(1e-9 + 100.0 * avg(CAST(abs(price - mp) / price <= 0.10 + 1e-9 AS DOUBLE)), 6) AS within_10pct,
  round(1e-9 + 100.0 * (avg(abs(price - pred)) - avg(abs(price - mp))) / avg(abs(price - pred)), 6) AS improvement_pct,
  round(1e-9 + 1 - sum((lp - z) ** 2) / nullif(var_pop(lp) * count(*), 0), 6) AS r2_log_premium FROM m GROUP BY split"""))
def model_vs_baseline(spark, sf_dir):
    """Q4/Q9: a linear model of the log premium against the baseline per split, with the improvement in percent and
    R² on the log premium (NULL if that does not vary)."""
    e = evaluated(spark, sf_dir, ("sold_price", *MODEL_FEATURES)).where(F.col("pred") > 0).withColumn("lp", F.log("sold_price") - F.log("pred"))
    z = fit_linear(e, MODEL_FEATURES, "lp", "sold_price").predict()
    return M.against_baseline(e.withColumn("z", z).withColumn("model_price", F.col("pred") * F.exp("z")), "sold_price", "pred", "model_price", "lp", "z", "split")
