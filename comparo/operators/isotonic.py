"""K3: isotonic calibration by pool-adjacent-violators in bounded tasks.

1. equal predictions are added up (weights and weighted targets), so a task never
   sees more than distinct values;
2. the points are cut into ranges of the prediction, and each range pools its own
   adjacent violators into blocks (ranges of few points share a task, which pools each and then their blocks);
3. neighbouring ranges meet in pairs, shifted by one in every other round, and pool again
   until no range border has a violator: pooling in any order gives the same fit;
4. a prediction is calibrated by linear interpolation between the ends of the blocks, clipped
   outside them; rows and block ends of one range meet in one task.

A task holds the points of about two ranges, or of several small ones; only numbers of points and ranges reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comparo.operators.baseline import numbered_ranges
from comparo.session import materialize

POINTS_PER_RANGE = 500_000
#: Where there are more ranges than ``_MANY`` they share tasks of about so many points.
_MANY, _SHARED = 1024, 50_000


def pool(x0: np.ndarray, x1: np.ndarray, w: np.ndarray, s: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (first x, last x, weight, weighted sum) with rising means, from blocks in order."""
    out: list[list[float]] = []
    for a, b, wi, si in zip(x0.tolist(), x1.tolist(), w.tolist(), s.tolist()):
        out.append([a, b, wi, si])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, b2, w2, s2 = out.pop()
            out[-1][1], out[-1][2], out[-1][3] = b2, out[-1][2] + w2, out[-1][3] + s2
    return [tuple(r) for r in out]


_BLOCK = "pid int, x0 double, x1 double, w double, s double"


def _tasks(n: int, per_range: int) -> int:
    """Tasks for ``n`` points: one for each range, or fewer if these are many and small."""
    return max(1, min(-(-n // per_range), max(_MANY, -(-n // _SHARED))))


def fit(rows: DataFrame, x: str, y: str, weight: str | None = None, points_per_range: int = POINTS_PER_RANGE) -> DataFrame:
    """Blocks (x0, x1, value) of the weighted isotonic fit of ``y`` on ``x``; rows without x, y or a
    positive weight take no part."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    pts = rows.select(F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y"), w.alias("w")).where("x0 IS NOT NULL AND y IS NOT NULL AND w > 0")
    pts = materialize(pts.groupBy("x0").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("s")))
    # bounds are joined, since as literals every look-up would hold all of them in the plan
    cut = numbered_ranges(pts, [], "x0", _tasks(pts.count(), points_per_range), "pid")[0]
    cut = cut.select("pid", "x0", F.col("x0").alias("x1"), "w", "s")
    meet, shift = F.col("pid"), 0
    while True:
        def pooled(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("x0", kind="stable")
            parts = [f[c].to_numpy(dtype="float64") for c in ("x0", "x1", "w", "s")]
            got = [b for i in range(0, len(f), points_per_range) for b in pool(*(p[i:i + points_per_range] for p in parts))]
            got = pool(*np.array(got).T) if len(f) > points_per_range else got
            first = f.drop_duplicates("x0").set_index("x0")["pid"]
            return pd.DataFrame([(int(first[g[0]]), *g) for g in got], columns=["pid", "x0", "x1", "w", "s"])

        blocks = materialize(cut.withColumn("g", meet).groupBy("g").applyInPandas(pooled, _BLOCK))
        # ends of each range, numbered anew: a range that was pooled away leaves no gap between its neighbours
        ends = blocks.groupBy("pid").agg(F.min_by(F.col("s") / F.col("w"), "x0").alias("lo"), F.max_by(F.col("s") / F.col("w"), "x0").alias("hi"))
        order = Window.partitionBy(F.lit(0)).orderBy("pid")  # one row per range
        ends = materialize(ends.select("pid", (F.row_number().over(order) - 1).alias("new"), (F.lag("hi").over(order) >= F.col("lo")).alias("bad")))
        if not ends.where("bad").count():
            return blocks.select("x0", "x1", (F.col("s") / F.col("w")).alias("value"))
        cut = blocks.join(ends.select("pid", "new"), "pid").select(F.col("new").alias("pid"), "x0", "x1", "w", "s")
        # pairs; the border that is inside a pair changes from round to round
        shift = 1 - shift
        meet = F.floor((F.col("pid") + F.lit(shift)) / 2).cast("int")


def calibrate(rows: DataFrame, blocks: DataFrame, x: str, out: str = "calibrated", points_per_range: int = POINTS_PER_RANGE) -> DataFrame:
    """Adds ``out``: the fit at ``x``, linear between blocks, clipped outside them; NULL for a NULL x or without blocks."""
    ends = blocks.select(F.explode(F.array(F.struct(F.col("x0").alias("x"), "value"), F.struct(F.col("x1").alias("x"), "value"))).alias("e")).select("e.x", "e.value").distinct()
    ends = materialize(ends)
    cols = rows.columns
    src = rows.select(F.struct(*cols).alias("row"), F.col(x).cast("double").alias("x"))
    tasks = _tasks(rows.where(F.col(x).isNotNull()).count(), points_per_range)
    # the rows' ranges, for rows and block ends alike: equal values get equal numbers
    both = src.select("row", "x", F.lit(None).cast("double").alias("value")).unionByName(ends.select(F.lit(None).cast(src.schema["row"].dataType).alias("row"), "x", "value"))
    both, ranges = numbered_ranges(both, [], "x", tasks, "r", source=src)
    src, own = both.where("row IS NOT NULL").select("row", "x", F.coalesce("r", F.lit(0)).alias("r")), both.where("row IS NULL").select("x", "value", "r")
    if ranges > 1:
        # the last end before and the first end after each range, found over one row per range
        per = own.groupBy("r").agg(F.max(F.struct("x", "value")).alias("last"), F.min(F.struct("x", "value")).alias("first"))
        every = rows.sparkSession.range(ranges).select(F.col("id").cast("int").alias("r")).join(per, "r", "left")
        w = Window.partitionBy(F.lit(0)).orderBy("r")
        near = every.select("r", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("a"),
                            F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("z"))
        extra = near.select("r", F.explode(F.filter(F.array("a", "z"), lambda e: e.isNotNull())).alias("e")).select("e.x", "e.value", "r")
        own = own.unionByName(extra)
    schema = src.select("row").schema
    from pyspark.sql import types as T
    res = T.StructType([schema["row"], T.StructField("val", T.DoubleType())])
    own = own.select(F.col("r").alias("__r"), F.col("x").alias("__x"), F.col("value").alias("__value"))

    def interpolate(f, e):
        import pyarrow as pa
        ex, ev = (e.column(c).to_numpy() for c in ("__x", "__value"))
        at = np.argsort(ex, kind="stable")
        xs = f.column("x").to_numpy(zero_copy_only=False).astype("float64") if f.num_rows else np.empty(0)
        val = np.interp(xs, ex[at], ev[at]) if len(ex) else np.full(len(xs), np.nan)
        val = np.where(np.isnan(xs), np.nan, val)
        return pa.table([f.column("row"), pa.array(val, from_pandas=True)], names=["row", "val"])

    got = src.groupBy("r").cogroup(own.groupBy("__r")).applyInArrow(interpolate, res)
    return got.select("row.*", F.col("val").alias(out))
