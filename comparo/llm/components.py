"""Connected components by alternating large and small stars (DataFrame joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from comparo.llm.common import dropped, saved


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v long) -> (v, u): every node but the smallest of its
    component, with that smallest node.  Self loops are ignored; an empty
    frame gives an empty frame.  Links stay distributed: each round is two
    grouped minima joined back to the edges and written to shared storage."""
    e = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = e.select(F.col("v").alias("a"), F.col("u").alias("b")).union(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("v"), F.least("a", "m").alias("u")).distinct())
        low2 = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(low2, "v").filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .union(low2.select("v", F.col("m").alias("u"))).distinct())
        new = saved(small, "edges")
        dropped(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))")).first())
        if now == last:
            return e
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
