"""Streaming scoring (B16 on micro-batches), CSV listing source, sinks."""

import os
import tempfile

from pyspark.sql import functions as F

from comparo.plans.common import priced
from comparo.sources.listings import feature_candidates, read_listings, typed_listings
from comparo.streaming import score_stream
from comparo.streaming.scoring import score_batch
from tests.conftest import SF001


def test_stream_scoring_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="comparo-stream-")
    p = priced(spark, SF001)
    hist = p.where(F.col("day") < 10500)
    new = p.where(F.col("day") >= 10500)
    hist.write.parquet(os.path.join(root, "history"))
    new.repartition(3).write.parquet(os.path.join(root, "listings"))
    stream = spark.readStream.schema(new.schema).parquet(os.path.join(root, "listings"))
    q = score_stream(stream, os.path.join(root, "history"), os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(root, "out"))
    exp = score_batch(new, spark.read.parquet(os.path.join(root, "history")))
    assert got.count() == new.count()
    assert got.select("sale_key", "base_ppsf").exceptAll(exp.select("sale_key", "base_ppsf")).count() == 0


def test_listing_csv_typed(spark):
    root = tempfile.mkdtemp(prefix="comparo-csv-")
    path = os.path.join(root, "l.csv")
    with open(path, "w") as f:
        f.write('Sold Price,List Date,TotFlArea,Postal Code,S/A,DOM,Status\n'
                '"$500,000",5/1/2025,"1,450",v2p 1a1,ABC12,14,F\n'
                'nan,2025-05-02,0,,,3,F\n')
    t = typed_listings(read_listings(spark, path))
    r = t.orderBy("List Date").collect()
    assert r[0]["target"] == 500000.0 and r[0]["TotFlArea"] == 1450.0 and r[0]["FSA"] == "V2P"
    assert r[0]["Region"] == "ABC" and r[1]["target"] is None and r[1]["FSA"] is None
    assert feature_candidates(t) == ["TotFlArea"]  # DOM is after-listing, never a feature


def test_model_scoring_reads_the_days_before_a_batch_only(spark, tmp_path):
    """The plan prunes partitions, and the pruned result is that of the whole history."""
    from pyspark.sql import functions as F
    from comparo.operators.model import LinearModel
    from comparo.streaming import scoring as Sc
    rows = [(d, "ab"[d % 2], 100.0 + d % 17) for d in range(1000)]
    hist = spark.createDataFrame(rows, "day int, fsa string, ppsf double")
    path = str(tmp_path / "history")
    Sc.append_history(hist.where("day < 900"), path)
    Sc.append_history(hist.where("day >= 900"), path)
    lst = spark.createDataFrame([(f"k{i}", 950 + i % 5, "ab"[i % 2], 50.0 + i) for i in range(20)], "sale_key string, day int, fsa string, area double")
    model = LinearModel(("area",), (60.0,), (0.1, 0.001))
    window = Sc.history_window(spark, path, 860, 953)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day_block" in plan
    read = {f.split("day_block=")[1].split("/")[0] for f in window.inputFiles()}
    assert {int(b) for b in read} >= {26, 27, 28, 29} and window.agg(F.min("day"), F.max("day")).first()[:] == (860, 953)
    got = {r["sale_key"]: r for r in Sc.score_with_model(lst, path, model, min_n=3).collect()}
    want = {r["sale_key"]: r for r in Sc.score_batch(lst.withColumn("list_date", F.lit(None).cast("date")), hist, min_n=3).collect()}
    import math
    assert len(got) == 20
    for k, r in got.items():
        assert r["base_ppsf"] == want[k]["base_ppsf"]
        assert abs(r["predicted_price"] - want[k]["predicted_price"] * math.exp(0.1 + 0.001 * (r["area"] - 60))) < 1e-6
    assert Sc.score_with_model(lst.where("false"), path, model).count() == 0
