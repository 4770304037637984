"""Order-dependent operators without a global sort (SP1, W5, W6, O1).

The reference sorts the whole table by date and then works by position.  A
window ``ORDER BY day`` without ``PARTITION BY`` — or a running sum per
category when one category holds a third of the rows — runs in one task.
Here every running total is split in two levels on the total order
``(day, seq)``:

1. an aggregate per (key..., day, bucket), where ``bucket`` is the top bits (10, or
   fewer for a table known to be small) of the 60-bit hash ``seq`` (so ordering by (day, bucket, seq) equals
   ordering by (day, seq), and a hot day is spread over 1,024 buckets); running
   totals over this small table (earlier days by a RANGE frame, earlier buckets of
   the day by a ROWS frame, one sort for both) give each bucket's offset;
2. a running total inside (key..., day, bucket), ordered by ``seq``, plus the
   offset, which is joined once.

Both windows are partitioned by something that bounds their size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEQ_BITS, BUCKET_BITS = 60, 10  # 1,024 buckets per day
#: Rows of one day that may stay together: fewer buckets are made for a table of known size.
DAY_ROWS = 1_000_000


def bucket_bits(rows: int | None) -> int:
    """Bits of the day buckets: 10, or as many as a table of ``rows`` rows needs if all of them fell on one day."""
    if rows is None:
        return BUCKET_BITS
    return min(BUCKET_BITS, max(0, math.ceil(math.log2(max(rows, 1) / DAY_ROWS))))


def exclusive_running(df: DataFrame, keys, sums=(), *, day: str = "day", seq: str = "seq",
                      prefix: str = "run_", then: str | None = None, rows: int | None = None) -> DataFrame:
    """Adds ``{prefix}n`` (rows strictly before this row within ``keys`` in
    (day, seq) order) and ``{prefix}<c>`` (sum of ``c`` over those rows; NULLs
    count as rows in ``n`` but add nothing — use ``count`` columns for that).
    ``then`` orders rows of equal ``seq``; ``rows``, the size of the table if it is known, only
    sets the number of buckets."""
    keys = list(keys)
    sums = list(sums)
    b = "__bkt"
    x = df.withColumn(b, F.shiftright(F.col(seq), SEQ_BITS - bucket_bits(rows)))
    agg = (x.groupBy(*keys, day, b)
            .agg(F.count(F.lit(1)).alias("__cnt"), *[F.sum(c).alias(f"__s_{c}") for c in sums]))
    # both frames run over (key, day, bucket) totals: at most 1,024 rows a key and calendar day
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(day)
    earlier = earlier.rangeBetween(Window.unboundedPreceding, -1)
    same_day = Window.partitionBy(*keys, day).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    cols = {"__cnt": "__off_n"} | {f"__s_{c}": f"__off_{c}" for c in sums}
    before = lambda a: F.coalesce(F.sum(a).over(earlier), F.lit(0)) + F.coalesce(F.sum(a).over(same_day), F.lit(0))
    offs = agg.select(*keys, day, b, *[before(a).alias(o) for a, o in cols.items()])
    w2 = Window.partitionBy(*keys, day, b).orderBy(*([seq, then] if then else [seq])).rowsBetween(Window.unboundedPreceding, -1)
    y = x.join(offs, keys + [day, b], "left")
    y = y.withColumn(f"{prefix}n", F.col("__off_n") + F.coalesce(F.count(F.lit(1)).over(w2), F.lit(0)))
    for c in sums:
        y = y.withColumn(f"{prefix}{c}",
                         F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(w2), F.lit(0)))
    return y.drop(b, "__off_n", *[f"__off_{c}" for c in sums])


def with_position(df: DataFrame, *, day: str = "day", seq: str = "seq", out: str = "pos", rows: int | None = None) -> DataFrame:
    """W6/SP1: 1-based position in (day, seq) order, computed without a global sort."""
    return (exclusive_running(df, [], (), day=day, seq=seq, prefix="__p_", rows=rows)
            .withColumn(out, F.col("__p_n") + 1).drop("__p_n"))
