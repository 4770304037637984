"""Queries: splits, folds and sample weights (SP1-SP10, WT1-WT7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.operators import split as S
from comparo.operators import weights as W
from comparo.plans.common import PRICED_SQL, SPLIT_SQL, cut_frame, priced, rnd, split_frame, with_seq, with_sql
from comparo.plans.registry import query
from comparo.sources.sales import sales


@query("split_70_10_20", sql=with_sql(SPLIT_SQL, """
SELECT sale_key, pos, split FROM spl"""))
def split_70_10_20(spark, sf_dir):
    return split_frame(spark, sf_dir, columns=["sale_key"]).select("sale_key", "pos", "split")


_SPLIT80 = PRICED_SQL + """,
p80 AS (SELECT *, row_number() OVER (ORDER BY day, seq) AS pos, count(*) OVER () AS n_all FROM priced),
s80 AS (SELECT *, CASE WHEN pos <= floor(0.8 * n_all) THEN 'train' ELSE 'test' END AS split FROM p80)"""


def _split80(spark, sf_dir):
    return S.temporal_split(priced(spark, sf_dir), (0.8,), ("train", "test"))


@query("split_80_20", sql=with_sql(_SPLIT80, """
SELECT split, count(*) AS n_rows, min(list_date) AS first_date, max(list_date) AS last_date,
       min(pos) AS first_pos, max(pos) AS last_pos FROM s80 GROUP BY split"""))
def split_80_20(spark, sf_dir):
    """SP2 + Q15 (size and date range per split)."""
    return (_split80(spark, sf_dir).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("list_date").alias("first_date"),
                 F.max("list_date").alias("last_date"), F.min("pos").alias("first_pos"),
                 F.max("pos").alias("last_pos")))


@query("split_hash_80_20", sql=with_sql(PRICED_SQL, """
h AS (SELECT sale_key, ('0x' || substr(md5(sale_key || '|42'), 1, 8))::BIGINT % 100 AS bucket,
             ('0x' || substr(md5(sale_key || '|4242'), 1, 8))::BIGINT % 100 AS vbucket FROM priced)
SELECT sale_key, CAST(bucket AS INTEGER) AS bucket,
       CASE WHEN bucket < 80 AND vbucket < 15 THEN 'val' WHEN bucket < 80 THEN 'train' ELSE 'test' END AS split
FROM h"""))
def split_hash_80_20(spark, sf_dir):
    """SP4/SP5: repeatable random 80/20 with a 15% validation slice of train."""
    return S.hash_split(priced(spark, sf_dir)).select("sale_key", "bucket", "split")


@query("folds_hashed", sql=with_sql(PRICED_SQL, """
SELECT sale_key, CAST(('0x' || substr(md5(sale_key || '|42'), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM priced"""))
def folds_hashed(spark, sf_dir):
    """SP7: shuffled 5-fold, seed 42."""
    return S.kfold_hash(priced(spark, sf_dir)).select("sale_key", "fold")


@query("folds_contiguous", sql=with_sql(_SPLIT80, """
t AS (SELECT *, count(*) OVER () AS n_tr FROM s80 WHERE split = 'train'),
f AS (SELECT *, n_tr // 5 AS q, n_tr % 5 AS r FROM t)
SELECT sale_key, CAST(CASE WHEN pos - 1 < r * (q + 1) THEN (pos - 1) // (q + 1)
                           ELSE r + (pos - 1 - r * (q + 1)) // q END AS INTEGER) AS fold
FROM f"""))
def folds_contiguous(spark, sf_dir):
    """SP8: KFold(5, shuffle=False) over the 80% train rows in time order."""
    s = _split80(spark, sf_dir).where(F.col("split") == "train")
    n = s.count()
    return S.kfold_contiguous(s, n).select("sale_key", "fold")


@query("folds_time_series", sql=with_sql(SPLIT_SQL, """
t AS (SELECT *, count(*) OVER () AS n_tr FROM spl WHERE split = 'train'),
p AS (SELECT *, least(5, greatest(2, n_tr // 1000)) AS s FROM t),
q AS (SELECT *, n_tr // (s + 1) AS size, n_tr - s * (n_tr // (s + 1)) AS first FROM p)
SELECT sale_key, CAST(CASE WHEN pos <= first THEN 0 ELSE (pos - first - 1) // size + 1 END AS INTEGER) AS block
FROM q"""))
def folds_time_series(spark, sf_dir):
    """SP9: TimeSeriesSplit blocks of the 70% train rows."""
    from comparo.session import materialize
    p = with_seq(materialize(priced(spark, sf_dir).select("sale_key", "day")))
    n_all = p.count()
    ends = S.time_series_cuts(int(0.7 * n_all))
    b = S.cut_at(p, ends, range(len(ends) + 1), n_all, out="block")
    return b.where(F.col("block") < len(ends)).select("sale_key", F.col("block").cast("int").alias("block"))


@query("sample_rows", sql=with_sql(PRICED_SQL, """
SELECT sale_key, fsa, list_date, sold_price FROM priced
ORDER BY ('0x' || substr(md5(sale_key || '|42'), 1, 15))::BIGINT, sale_key LIMIT 5"""))
def sample_rows(spark, sf_dir):
    """SP10: five repeatable random rows (sampling is the feature: order by hash, limit 5)."""
    from comparo.functions.keys import hash60
    p = priced(spark, sf_dir)
    return (p.orderBy(hash60(F.concat(F.col("sale_key"), F.lit("|42"))), "sale_key").limit(5)
             .select("sale_key", "fsa", "list_date", "sold_price"))


# ---- weights ------------------------------------------------------------------------------

_WEIGHTS_SQL = SPLIT_SQL + """,
ref AS (SELECT max(list_date) AS ref_date FROM spl WHERE split = 'train'),
wt AS (SELECT spl.*, CASE WHEN split = 'train'
                          THEN greatest(pow(0.5, greatest(ref_date - list_date, 0) / 365.0), 0.05) END AS w_recency,
              CASE WHEN split = 'train'
                   THEN pow(0.5, greatest(ref_date - list_date, 0) / 365.0) / greatest(sold_price, 1000.0) END AS w_raw
       FROM spl, ref),
wn AS (SELECT wt.*, w_raw / (SELECT avg(w_raw) FROM wt WHERE split = 'train') AS w_norm FROM wt)"""


def _weights(spark, sf_dir):
    s = cut_frame(spark, sf_dir, ["list_date", "sold_price"])
    is_tr = F.col("split") == "train"
    ref = s.where(is_tr).agg(F.max("list_date")).first()[0]
    s = (s.withColumn("w_recency", F.when(is_tr, W.recency_weight(F.col("list_date"), ref, 365.0, 0.05)))
          .withColumn("w_raw", F.when(is_tr, W.recency_weight(F.col("list_date"), ref, 365.0)
                                      * W.inverse_price_weight(F.col("sold_price")))))
    return W.normalize_by_mean(s, "w_raw", is_tr, out="w_norm")


@query("weights_recency", sql=with_sql(_WEIGHTS_SQL, """
SELECT sale_key, split, round(1e-9 + coalesce(w_recency, 1.0), 6) AS w_recency FROM wn"""))
def weights_recency(spark, sf_dir):
    """WT1/WT2/WT6: half-life 365 days from the newest train date, floor 0.05; 1.0 outside train."""
    w = F.coalesce(F.col("w_recency"), F.lit(1.0))
    return _weights(spark, sf_dir).select("sale_key", "split", rnd(w).alias("w_recency"))


@query("weights_wape_normalized", sql=with_sql(_WEIGHTS_SQL, """
SELECT sale_key, round(1e-9 + w_norm * 1000, 6) AS w_norm_x1000 FROM wn WHERE split = 'train'"""))
def weights_wape_normalized(spark, sf_dir):
    """WT3/WT5: recency × 1/max(price,1000), divided by its train mean."""
    w = _weights(spark, sf_dir).where(F.col("split") == "train")
    return w.select("sale_key", rnd(F.col("w_norm") * 1000).alias("w_norm_x1000"))


@query("weight_quantiles", sql=with_sql(_WEIGHTS_SQL, """
SELECT round(1e-9 + min(w_recency), 6) AS w_min, round(1e-9 + quantile_cont(w_recency, 0.25), 6) AS w_p25,
       round(1e-9 + median(w_recency), 6) AS w_median, round(1e-9 + quantile_cont(w_recency, 0.75), 6) AS w_p75,
       round(1e-9 + max(w_recency), 6) AS w_max, round(1e-9 + avg(w_recency), 6) AS w_mean
FROM wn WHERE split = 'train'"""))
def weight_quantiles(spark, sf_dir):
    """WT7/L9 (A5): weight distribution of the train rows."""
    d = W.weight_distribution(_weights(spark, sf_dir).where(F.col("split") == "train"), "w_recency")
    return d.select(*[rnd(c).alias(c) for c in d.columns])


@query("split_auto", sql=with_sql(PRICED_SQL, """
c AS (SELECT avg(CAST(list_date IS NOT NULL AS DOUBLE)) AS cov FROM sales),
p AS (SELECT *, row_number() OVER (ORDER BY day, seq) AS pos, count(*) OVER () AS n_all FROM priced),
s AS (SELECT p.*, CASE WHEN cov > 0.8 THEN (CASE WHEN pos <= floor(0.8 * n_all) THEN 'train' ELSE 'test' END)
                       ELSE (CASE WHEN ('0x' || substr(md5(sale_key || '|42'), 1, 8))::BIGINT % 100 < 80
                                  THEN 'train' ELSE 'test' END) END AS split,
             CASE WHEN cov > 0.8 THEN 'time' ELSE 'random' END AS kind FROM p, c)
SELECT kind, split, count(*) AS n_rows FROM s GROUP BY 1, 2"""))
def split_auto(spark, sf_dir):
    """SP6: time split when the date is > 80% non-null, else the repeatable random split."""
    p = priced(spark, sf_dir)
    cov = sales(spark, sf_dir).agg(F.avg(F.col("list_date").isNotNull().cast("double"))).first()[0]
    if cov > 0.8:
        s, kind = S.temporal_split(p, (0.8,), ("train", "test")), "time"
    else:
        s, kind = S.hash_split(p, val_pct_of_train=None), "random"
    return s.groupBy(F.lit(kind).alias("kind"), "split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("weight_log_price", sql=with_sql(PRICED_SQL, """
w AS (SELECT sale_key, 1.0 / ln(sold_price + 1) AS w FROM priced)
SELECT sale_key, round(1e-9 + w / (SELECT avg(w) FROM w), 6) AS weight FROM w"""))
def weight_log_price(spark, sf_dir):
    """WT4/WT5: 1 / log(price + 1), scaled to mean 1."""
    p = priced(spark, sf_dir).select("sale_key", W.inverse_log_price_weight(F.col("sold_price")).alias("w"))
    return W.normalize_by_mean(p, "w").select("sale_key", rnd("w").alias("weight"))
