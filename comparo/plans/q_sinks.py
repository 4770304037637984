"""Queries: sources and sinks round trips (S1-S10) in a fresh folder under the shared checkpoint dir."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from comparo.functions.parse import money_text
from comparo.operators import metrics as M
from comparo.plans.common import rnd, with_sql
from comparo.plans.q_metrics import EVAL_SQL, _metric_sql, _rounded, evaluated
from comparo.plans.q_search import PRESENCE_SQL, SCORES_SQL, scored
from comparo.plans.registry import query
from comparo.session import scratch_path
from comparo.sources import sinks as K
from comparo.sources.listings import feature_candidates, read_listings, typed_listings
from comparo.sources.sales import SALES_SQL, sales


def _path(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


@query("predictions_sink", sql=with_sql(EVAL_SQL, """
SELECT sale_key, list_date, fsa, sold_price, round(1e-9 + pred, 4) AS predicted_price,
       round(1e-9 + abs(sold_price - pred), 4) AS abs_error, round(1e-9 + abs(sold_price - pred) / sold_price, 6) AS rel_error,
       base_ppsf AS base_ppsf_90d
FROM ev WHERE split = 'test'"""))
def predictions_sink(spark, sf_dir):
    """Test predictions with errors written as parquet (partitioned by month), read back."""
    t = evaluated(spark, sf_dir, ("sale_key", "list_date", "fsa", "sold_price", "base_ppsf")).where(F.col("split") == "test")
    t = K.prediction_columns(t, "sold_price", "pred").withColumn("month", F.trunc("list_date", "MM"))
    path = K.write_table(t.select("sale_key", "list_date", "fsa", "sold_price", "pred", "abs_error", "rel_error",
                                  "base_ppsf", "month"), _path(spark, "predictions"), partition_by=["month"])
    r = spark.read.parquet(path)
    return r.select("sale_key", "list_date", "fsa", "sold_price", rnd("pred", 4).alias("predicted_price"),
                    rnd("abs_error", 4).alias("abs_error"), rnd("rel_error").alias("rel_error"),
                    F.col("base_ppsf").alias("base_ppsf_90d"))


@query("metrics_sink", sql=with_sql(EVAL_SQL, f"""
SELECT split, {_metric_sql('sold_price', 'pred')} FROM ev GROUP BY split"""))
def metrics_sink(spark, sf_dir):
    """The metrics report, one row per split, written as JSON and read back."""
    m = _rounded(M.metrics(evaluated(spark, sf_dir), "sold_price", "pred", ["split"]))
    path = K.write_table(m.coalesce(1), _path(spark, "metrics"), fmt="json")
    return spark.read.schema(m.schema).json(path)


@query("listings_csv_roundtrip", sql=with_sql(SALES_SQL, """
SELECT sale_key, sold_price AS target, sold_price AS "Sold Price", list_date AS "List Date", area AS "TotFlArea",
       upper(substr(trim(fsa), 1, 3)) AS "FSA", regexp_extract(region, '^([A-Z]+)', 1) AS "Region"
FROM sales"""))
def listings_csv_roundtrip(spark, sf_dir):
    """Sales exported as raw listing text (money '$1,234.50',
    dates 'M/d/yyyy', area '1,234'), read back as all-text CSV and typed by the catalogue."""
    s = sales(spark, sf_dir)
    raw = s.select("sale_key", money_text(F.col("sold_price")).alias("Sold Price"),
                   F.date_format("list_date", "M/d/yyyy").alias("List Date"),
                   F.format_number("area", 0).alias("TotFlArea"),
                   F.col("fsa").alias("Postal Code"), F.col("region").alias("S/A"))
    path = _path(spark, "listings-csv")
    raw.write.mode("overwrite").option("header", True).csv(path)
    typed = typed_listings(read_listings(spark, path))
    assert "TotFlArea" in feature_candidates(typed)  # A1: leaky columns never candidates
    return typed.select("sale_key", "target", "Sold Price", "List Date", "TotFlArea", "FSA", "Region")


@query("search_results_sink", sql=with_sql(SCORES_SQL, PRESENCE_SQL))
def search_results_sink(spark, sf_dir):
    """Subset scores written sorted by test MAE, feature ranking written, both read back."""
    from comparo.operators.search import feature_presence
    scores = scored(spark, sf_dir)
    p1 = K.write_sorted(scores.select("subset_id", "n_features", "features", "mae_test", "r2_test", "status"), _path(spark, "search"), "mae_test")
    p2 = K.write_table(feature_presence(spark.read.parquet(p1), "mae_test", 100), _path(spark, "ranking"))
    return spark.read.parquet(p2).select("feature", "n_in_top", rnd("share").alias("share"))
