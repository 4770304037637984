"""Splits and folds (SP1-SP10).

Positional splits follow the reference: sort by date, cut at ``int(f * n)``.
The sort is the total order (day, seq) and the position comes from
``ordering.with_position`` (no global sort, no single-task window).
Where the position itself is not wanted, ``cut_split`` finds the rows at the cuts from
counts per day and compares every row with them: no row is shuffled or sorted.
Random splits use a repeatable md5 bucket of (key, seed), so they do not
depend on partitioning as ``randomSplit`` does, and DuckDB can reproduce them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comparo.functions.keys import hash_bucket
from comparo.operators.ordering import BUCKET_BITS, DAY_ROWS, SEQ_BITS, with_position


def _count(df: DataFrame) -> int:
    # one number; the position column carries everything else
    return df.count()


def temporal_split(df: DataFrame, fractions=(0.7, 0.8), names=("train", "val", "test"), *,
                   n: int | None = None, pos: str = "pos", out: str = "split") -> DataFrame:
    """SP1/SP2: rows 1..int(f1*n) → names[0], ..int(f2*n) → names[1], rest → last.

    Cut points are computed with Python's ``int`` on the driver from the row
    count, exactly as the reference does.
    """
    if pos not in df.columns:
        df = with_position(df, out=pos)
    n = _count(df) if n is None else n
    cuts = [int(f * n) for f in fractions]
    label = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names))):
        label = F.when(F.col(pos) <= cut, F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def _rows_at(df: DataFrame, places, day: str, seq: str) -> dict[int, tuple]:
    """For each 1-based place in (day, seq) order: (day, seq, rows before that key, rows of that key).

    Counts per day find the day, counts per bucket of ``seq`` (hot days only) the bucket, counts per key the key;
    a row per place reaches the driver each time.
    """
    found = {k: (None, 0) for k in places}  # place: (condition on the rows that are left, rows before them)
    x = df.select(F.col(day).alias("__d"), F.col(seq).alias("__s"))

    def narrow(src, key, keep):
        """(place, key..., rows before, rows) of the key that holds each place, over the groups ``keep``."""
        cnt = src.groupBy(*keep, *key).agg(F.count(F.lit(1)).alias("c"))
        order = (Window.partitionBy(*keep) if keep else Window.partitionBy(F.lit(0))).orderBy(*key)
        cnt = cnt.withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        hits = F.explode(F.array(*[F.when((F.col("upto") - F.col("c") < k - b) & (F.lit(k - b) <= F.col("upto")) & (F.lit(True) if at is None else at), F.lit(k))
                                   for k, (at, b) in found.items()]))
        return cnt.withColumn("k", hits).where("k IS NOT NULL").select("k", *keep, *key, (F.col("upto") - F.col("c")).alias("b"), "c").collect()

    rows = narrow(x, ["__d"], [])
    found = {r["k"]: (F.col("__d") == F.lit(r["__d"]), found[r["k"]][1] + r["b"]) for r in rows}
    days = sorted({r["__d"] for r in rows})
    x, keep = x.where(F.col("__d").isin(days)), ["__d"]
    if max((r["c"] for r in rows), default=0) > DAY_ROWS:
        x = x.withColumn("__k", F.shiftright("__s", SEQ_BITS - BUCKET_BITS))
        rows = narrow(x, ["__k"], ["__d"])
        held = {r["k"]: (F.col("__d") == F.lit(r["__d"])) & (F.col("__k") == F.lit(r["__k"])) for r in rows}
        found = {r["k"]: (held[r["k"]], found[r["k"]][1] + r["b"]) for r in rows}
        x, keep = x.where(reduce(or_, held.values())), ["__d", "__k"]
    return {r["k"]: (r["__d"], r["__s"], found[r["k"]][1] + r["b"], r["c"]) for r in narrow(x, ["__s"], keep)}


def cut_split(df: DataFrame, fractions=(0.7, 0.8), names=("train", "val", "test"), *, n: int | None = None,
              day: str = "day", seq: str = "seq", out: str = "split") -> DataFrame:
    """The split of ``temporal_split`` without positions: each row is compared with the rows at the cuts.

    ``df`` is read a few times (two columns of it for the cuts): materialize it first.  ``day`` and ``seq`` are not
    NULL.  Where a cut falls among rows of equal (day, seq), these alone are numbered.
    """
    n = _count(df) if n is None else n
    return cut_at(df, [int(f * n) for f in fractions], names, n, day=day, seq=seq, out=out)


def cut_at(df: DataFrame, cuts, names, n: int, *, day: str = "day", seq: str = "seq", out: str = "split") -> DataFrame:
    """Labels of runs of the (day, seq) order: ``names[i]`` up to the 1-based place ``cuts[i]`` (ascending), the last name
    behind them.  ``n``: rows of ``df``, which is read as by ``cut_split``."""
    at = _rows_at(df, sorted({k for k in cuts if 0 < k < n}), day, seq) if n else {}
    torn = {at[k][:2] for k in at if k < at[k][2] + at[k][3]}  # keys of which a part only lies before the cut
    key = lambda r: (F.col(day) == F.lit(r[0])) & (F.col(seq) == F.lit(r[1]))
    d, s = F.col(day), F.col(seq)

    def labelled(upto):
        label = F.lit(names[-1])
        for k, name in reversed(list(zip(cuts, names))):
            label = F.when(F.lit(True) if k >= n else upto(k) if k > 0 else F.lit(False), F.lit(name)).otherwise(label)
        return label

    whole = lambda k: (d < at[k][0]) | ((d == at[k][0]) & (s <= at[k][1]))
    if not torn:
        return df.withColumn(out, labelled(whole))
    of_torn = reduce(or_, [key(r) for r in torn])
    rank = F.row_number().over(Window.partitionBy(day, seq).orderBy(F.lit(0)))
    part = lambda k: F.when(key(at[k]), F.col("__rank") <= k - at[k][2]).otherwise(whole(k))
    own = df.where(of_torn).withColumn("__rank", rank).withColumn(out, labelled(part)).drop("__rank")
    return df.where(~of_torn).withColumn(out, labelled(whole)).unionByName(own)


def snap_to_day(df: DataFrame, split: str = "split", day: str = "day", order=("train", "val", "test")) -> DataFrame:
    """§8 Z11: move a cut that falls inside a day to the day boundary.

    Every row of a day gets the earliest split any row of that day has, so
    A4 (max train day < min test day) holds.  One aggregate per day.
    """
    r = F.lit(len(order) - 1)
    for i, name in reversed(list(enumerate(order[:-1]))):
        r = F.when(F.col(split) == name, F.lit(i)).otherwise(r)
    per_day = df.groupBy(day).agg(F.min(r).alias("__r"))
    back = F.lit(order[-1])
    for i, name in reversed(list(enumerate(order[:-1]))):
        back = F.when(F.col("__r") == i, F.lit(name)).otherwise(back)
    return df.join(per_day, day).withColumn(split, back).drop("__r")


def hash_split(df: DataFrame, key: str = "sale_key", train_pct: int = 80, seed: int = 42,
               val_pct_of_train: int | None = 15, val_seed: int = 4242, out: str = "split") -> DataFrame:
    """SP4/SP5: md5 bucket of (key, seed) < train_pct → train; optional validation within train."""
    b = hash_bucket(F.col(key), seed, 100)
    lab = F.when(b < train_pct, F.lit("train")).otherwise(F.lit("test"))
    if val_pct_of_train:
        vb = hash_bucket(F.col(key), val_seed, 100)
        lab = F.when((b < train_pct) & (vb < val_pct_of_train), F.lit("val")).otherwise(lab)
    return df.withColumn("bucket", b).withColumn(out, lab)


def kfold_hash(df: DataFrame, key: str = "sale_key", k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """SP7: shuffled K-fold as an md5 bucket."""
    return df.withColumn(out, hash_bucket(F.col(key), seed, k))


def kfold_contiguous(df: DataFrame, n: int, k: int = 5, pos: str = "pos", out: str = "fold") -> DataFrame:
    """SP8: scikit-learn ``KFold(k, shuffle=False)`` over positions 1..n.

    The first ``n % k`` folds have one extra row.
    """
    q, r = divmod(n, k)
    big = r * (q + 1)
    p0 = F.col(pos) - 1
    fold = F.when(p0 < big, F.floor(p0 / (q + 1))).otherwise(F.lit(r) + F.floor((p0 - big) / q))
    return df.withColumn(out, fold.cast("int"))


def _series(n: int, n_splits: int | None) -> tuple[int, int, int]:
    """Rows of the first block, of each later one, and the number of these."""
    s = n_splits or min(5, max(2, n // 1000))
    size = n // (s + 1)
    return n - s * size, size, s


def time_series_cuts(n: int, n_splits: int | None = None) -> list[int]:
    """Last positions of the blocks of ``time_series_blocks``, for ``cut_at``."""
    first, size, s = _series(n, n_splits)
    return [first + i * size for i in range(s + 1)]


def time_series_blocks(df: DataFrame, n: int, n_splits: int | None = None, pos: str = "pos",
                       out: str = "block") -> tuple[DataFrame, int]:
    """SP9: ``TimeSeriesSplit``: s = min(5, max(2, n // 1000)); test size n // (s+1);
    block 0 holds the first n - s*size rows, blocks 1..s the next ``size`` each."""
    first, size, s = _series(n, n_splits)
    blk = F.when(F.col(pos) <= first, F.lit(0)).otherwise(F.floor((F.col(pos) - first - 1) / size) + 1)
    return df.withColumn(out, blk.cast("int")), s
