"""B16 on a stream: each micro-batch of new listings is priced from the history table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.operators.baseline import causal_baseline


def score_batch(listings: DataFrame, history: DataFrame, group: str = "fsa", value: str = "ppsf",
                length: int = 90, shrink_k: float = 10.0, min_n: int = 15) -> DataFrame:
    """Causal comparable price of each listing, from history rows only."""
    s = causal_baseline(listings, group, value, length, shrink_k, min_n, history=history)
    return s.select("sale_key", "list_date", group, "area", "n_grp", "base_ppsf",
                    (F.col("base_ppsf") * F.col("area")).alias("predicted_price"))


#: Days of one partition of the history table.
DAY_BLOCK = 32


def append_history(sales: DataFrame, path: str, day: str = "day") -> None:
    """Extend the history table: rows go to the partition of their block of days."""
    sales.withColumn("day_block", F.floor(F.col(day) / DAY_BLOCK).cast("int")).write.mode("append").partitionBy("day_block").parquet(path)


def history_window(spark, path: str, first: int, last: int, day: str = "day") -> DataFrame:
    """The rows of days first..last; only their partitions are read."""
    t = spark.read.parquet(path)
    return t.where(F.col("day_block").between(first // DAY_BLOCK, last // DAY_BLOCK) & F.col(day).between(first, last)).drop("day_block")


def score_with_model(listings: DataFrame, history_path: str, model, group: str = "fsa", value: str = "ppsf", length: int = 90,
                     shrink_k: float = 10.0, min_n: int = 15, day: str = "day") -> DataFrame:
    """Price of each listing = its causal baseline x area x exp(model of the log premium).

    A batch of days a..b reads the history of days a - ``length`` .. b - 1 only.  Adds n_grp,
    base_ppsf and predicted_price; an empty batch gives no rows."""
    spark = listings.sparkSession
    span = listings.agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    a, b = (span["a"], span["b"]) if span["a"] is not None else (0, 0)
    hist = history_window(spark, history_path, a - length, b - 1, day)
    s = causal_baseline(listings, group, value, length, shrink_k, min_n, day=day, history=hist)
    price = F.col("base_ppsf") * F.col("area")
    return s.withColumn("predicted_price", price * F.exp(model.predict()))


def score_stream(listings_stream: DataFrame, history_path: str, out_path: str, checkpoint: str,
                 available_now: bool = True, model=None, **kw):
    """Start a query: micro-batches of listings → ``score_batch`` → parquet, one folder per batch.

    ``foreachBatch`` reuses the batch operator unchanged; the history table is
    re-read per batch so that it can grow between batches.  The checkpoint
    folder (shared storage) keeps progress across restarts; a replayed batch
    overwrites its own ``epoch=N`` folder, so it adds no rows.  One ``out_path``
    belongs to one checkpoint.
    """
    spark = listings_stream.sparkSession

    def run(batch: DataFrame, epoch: int) -> None:
        if model is None:
            out = score_batch(batch, spark.read.parquet(history_path), **kw)
        else:  # a partitioned history (``append_history``): the batch's days only
            out = score_with_model(batch, history_path, model, **kw).select("sale_key", "list_date", "fsa", "area", "n_grp", "base_ppsf", "predicted_price")
        out.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = listings_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
