"""Causal comparable baseline (B1-B18, W1-W4): time-window medians per group.

Frame semantics (SURVEY §8 Z5): the default frame of a sale on day ``t`` is
*strict*, ``[t - L, t - 1]`` in days: every sale of the same day is excluded,
so a baseline never depends on a price known on or after its own day.

Two physical methods compute the same numbers:

``sql``
    ``percentile(v, 0.5) OVER (PARTITION BY g ORDER BY day RANGE ...)``.
    Simple, exact, the oracle in the tests; but a window partition is one task
    and Spark rebuilds the percentile buffer per frame, so it does not scale.

``chunked`` (default)
    Exact and bounded per task, for groups of any size:

    1. time chunks of length ``C = lo - hi + 1``: a row on day ``d`` is needed
       by targets in ``[d + hi, d + lo]``, i.e. by at most two chunks, so it is
       copied to those two (``explode(sequence(..))``);
    2. value ranges: when one (group, chunk) would exceed ``max_task_rows``,
       each group's values are cut into ``V`` ranges at approximate quantiles;
       a (group, chunk, range) task then holds ~``2/V`` of a chunk;
    3. counts per (group, range, day) — a small table — give, through RANGE
       window sums over days, the frame size ``n`` and how many frame values
       fall below each range, hence which range holds the median ranks
       ``(n+1) div 2`` and ``n div 2 + 1`` and the rank inside that range;
    4. a cogrouped ``applyInPandas`` over (group, chunk, range) answers only
       those rank requests (numpy on value-sorted arrays);
    5. the two order statistics are averaged (linear interpolation, equal to
       ``percentile(v, 0.5)`` / DuckDB ``median``).
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_G0 = "__g"
#: Value ranges of a hot group beyond those that bound its tasks: the medians lie in a few of them, and only these are shuffled.
_SPARE_RANGES = 8
#: Bits of a level of the tree over value ranges (lag-row blocks): 16 children a node.
_NODE_BITS = 4
#: Rows of a run from which ranks are looked up in cells of values.
_CELL_RUN = 256
#: Rows of a level table (one per group and day) up to which it is joined by a broadcast.
_SMALL_LEVEL = 1_000_000
#: Window lengths that a chunk of a direct frame has at most.
_LONG_CHUNK = 8
#: Bounds that one sketch gives at most (its error is a ten thousandth of the rows).
_FAN = 1024
#: Rows of the small blocks of a day that share a task.
_RUN_ROWS = 100_000


# ---------------------------------------------------------------------------
# Frame median + count per (group, day)
# ---------------------------------------------------------------------------

def frame_median_by_day(df: DataFrame, groups, value: str, lo: int, hi: int = 1, *,
                        day: str = "day", method: str = "chunked",
                        value_splits: int | None = None,
                        max_task_rows: int = 2_000_000,
                        targets: DataFrame | None = None, q: float = 0.5,
                        picked: int | None = None) -> DataFrame:
    """Median and count of ``value`` over the days ``[t - lo, t - hi]`` of the group.

    Returns one row per distinct (group..., day) of ``df`` (or of ``targets``
    when given: e.g. new listings priced from a history table) whose group
    keys are not NULL, with columns ``group..., day, med, n`` (``n`` counts
    non-NULL values; ``med`` is NULL when ``n = 0``).  ``groups=[]`` is the
    global frame.
    """
    groups = list(groups)
    if hi < 0 or lo < hi:
        raise ValueError("need 0 <= hi <= lo")
    if method == "sql":
        if q != 0.5:
            raise ValueError("the sql method computes medians only")
        return _frame_sql(df, groups, value, lo, hi, day, targets)
    if method == "chunked":
        return _frame_chunked(df, groups, value, lo, hi, day, value_splits, max_task_rows, targets, q, picked)
    raise ValueError(f"unknown method {method!r}")


def _not_null_keys(df: DataFrame, groups):
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).isNotNull()
    return df.where(cond)


def _frame_sql(df, groups, value, lo, hi, day, targets=None):
    base = _not_null_keys(df, groups).select(*groups, day, F.col(value).cast("double").alias(value),
                                             F.lit(False).alias("__is_t"))
    if targets is not None:
        t = (_not_null_keys(targets, groups).select(*groups, day).distinct()
             .select(*groups, day, F.lit(None).cast("double").alias(value), F.lit(True).alias("__is_t")))
        base = base.unionByName(t)
    w = (Window.partitionBy(*groups) if groups else Window).orderBy(day).rangeBetween(-lo, -hi)
    res = base.select(*groups, day, "__is_t",
                      F.percentile(value, F.lit(0.5)).over(w).alias("med"),
                      F.count(value).over(w).alias("n"))
    if targets is not None:
        res = res.where("__is_t")
    return res.drop("__is_t").dropDuplicates(groups + [day])


def _pick_splits(src: DataFrame, gcols, chunk: int, max_task_rows: int) -> int:
    """Value ranges needed so that a (group, chunk, range) task stays bounded.

    One scalar aggregate over the (group, chunk) row counts; only the number
    reaches the driver.
    """
    biggest = (src.groupBy(*gcols, F.floor(F.col("d") / chunk).alias("c"))
                  .count().agg(F.max("count")).first()[0]) or 0
    return max(1, math.ceil(2 * biggest / max_task_rows))


def pick_splits_many(df: DataFrame, specs, value: str, *, day: str = "day",
                     max_task_rows: int = 2_000_000, lengths: bool = False) -> list:
    """The task-size statistic of ``_pick_splits`` for several (groups, chunk) frames
    over the same rows in ONE job (a union of small aggregates; one number each).
    ``lengths``: pairs of it and the number of chunk lengths that a task can hold besides the first,
    within ``max_task_rows`` and a 32nd of the rows."""
    parts = []
    for i, (groups, chunk) in enumerate(specs):
        gcols = list(groups)
        part = (_not_null_keys(df, gcols).where(F.col(value).isNotNull())
                .groupBy(*gcols, F.floor(F.col(day) / chunk).alias("__c")).count()
                .agg(F.max("count").alias("m"), F.sum("count").alias("all")).select(F.lit(i).alias("i"), "m", "all"))
        parts.append(part)
    u = parts[0]
    for part in parts[1:]:
        u = u.unionByName(part)
    got = {r["i"]: (r["m"] or 0, r["all"] or 0) for r in u.collect()}  # one row per spec
    splits = [max(1, math.ceil(2 * got[i][0] / max_task_rows)) for i in range(len(specs))]
    if not lengths:
        return splits
    spare = [min(max_task_rows, n // 32) // max(1, m) - 1 for m, n in (got[i] for i in range(len(specs)))]
    return [(v, min(_LONG_CHUNK, max(1, k))) for v, k in zip(splits, spare)]


def _frame_chunked(df, groups, value, lo, hi, day, value_splits, max_task_rows, targets=None, q=0.5,
                   picked=None):
    gcols = groups or [_G0]
    if not groups:
        df = df.withColumn(_G0, F.lit(0))
        if targets is not None:
            targets = targets.withColumn(_G0, F.lit(0))
    base = _not_null_keys(df, gcols)
    key_types = {f.name: f.dataType for f in base.schema.fields if f.name in gcols}
    tsrc = base if targets is None else _not_null_keys(targets, gcols)
    targets = tsrc.select(*gcols, F.col(day).cast("int").alias("t")).distinct()
    src = (base.where(F.col(value).isNotNull())
               .select(*gcols, F.col(day).cast("int").alias("d"),
                       F.col(value).cast("double").alias("v")))
    chunk = lo - hi + 1
    V = value_splits or picked or _pick_splits(src, gcols, chunk, max_task_rows)
    if V == 1:
        res = _frame_direct(src, targets, gcols, key_types, lo, hi, chunk, day, q)
        return (res.drop(_G0) if not groups else res).select(*groups, day, "med", "n")
    src, vg = _ranged(src, gcols, chunk, value_splits, V, max_task_rows)
    res = _frame_ranked(src, vg, targets, gcols, key_types, lo, hi, day, q)
    return (res if groups else res.drop(_G0)).select(*groups, day, "med", "n")


def _ranged(src: DataFrame, gcols, chunk: int, value_splits: int | None, V: int, max_task_rows: int) -> tuple[DataFrame, DataFrame]:
    """The values with their range ``r``, written once, and each group's number of ranges ``__V``."""
    from comparo.session import materialize
    # Per-group number of ranges: only hot groups are split.  Forced ``value_splits``
    # applies to every group; otherwise V_g is the power of two that brings the
    # group's largest chunk under the bound, and its range bounds are every
    # (V/V_g)-th bound of one V-quantile sketch per group.
    if value_splits:
        vg = src.select(*gcols).distinct().withColumn("__V", F.lit(int(V)))
    else:
        V = _SPARE_RANGES << (V - 1).bit_length()  # a power of two
        per = (src.groupBy(*gcols, F.floor(F.col("d") / chunk).alias("__c")).count()
                  .groupBy(*gcols).agg(F.max("count").alias("__m")))
        need = F.ceil(F.col("__m") * 2.0 / max_task_rows)
        pow2 = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(need, F.lit(1))))).cast("int")
        vg = per.select(*gcols, F.when(need > 1, F.least(F.lit(V), pow2 * _SPARE_RANGES)).otherwise(F.lit(1)).cast("int").alias("__V"))
    fracs = [i / V for i in range(1, V)]
    # written and counted: bounds of few groups spare the rows a shuffle that puts a hot group into one task
    bounds = materialize(src.groupBy(*gcols).agg(F.percentile_approx("v", fracs, 10000).alias("__b")).join(vg, gcols))
    if bounds.count() * V <= _SMALL_LEVEL:
        bounds = F.broadcast(bounds)
    # every (V / V_g)-th bound counts, so the number of those below v is a quotient
    step = F.lit(V) / F.col("__V")
    src = (src.join(bounds, gcols)
              .withColumn("r", F.floor(value_range(F.col("__b"), F.col("v"), V) / step).cast("int"))
              .drop("__b"))
    # approximate bounds are not bit-stable across re-evaluations, and the range
    # tag feeds two branches (frame counts, rank selection): write it once
    src = materialize(src)
    vg = src.select(*gcols, "__V").distinct()
    return src.drop("__V"), vg


def _frame_ranked(src: DataFrame, vg: DataFrame, targets: DataFrame, gcols, key_types, lo: int, hi: int, day: str, q: float) -> DataFrame:
    """Frame medians and counts from values with ranges: gcols..., ``day``, med, n."""
    from comparo.session import materialize
    chunk = lo - hi + 1
    # (3) frame sizes per (group, target day, range) from day-level counts.
    counts = src.groupBy(*gcols, "r", "d").agg(F.count(F.lit(1)).alias("cnt"))
    # a target group without any value has no range table entry: one empty range
    grid = (targets.join(vg, gcols, "left")  # vg: one row per group
                   .select(*gcols, F.col("t").alias("d"),
                           F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__V"), F.lit(1)) - 1)).alias("r")))
    unioned = (grid.select(*gcols, "r", "d", F.lit(0).cast("long").alias("cnt"),
                           F.lit(True).alias("is_t"))
                   .unionByName(counts.withColumn("is_t", F.lit(False))))
    w_days = Window.partitionBy(*gcols, "r").orderBy("d").rangeBetween(-lo, -hi)
    fc = (unioned.withColumn("fc", F.coalesce(F.sum("cnt").over(w_days), F.lit(0)))
                 .where("is_t")
                 .select(*gcols, F.col("d").alias("t"), "r", "fc"))
    w_t = Window.partitionBy(*gcols, "t")
    w_below = w_t.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    fc = (fc.withColumn("n", F.sum("fc").over(w_t))
            .withColumn("below", F.coalesce(F.sum("fc").over(w_below), F.lit(0))))
    # ranks around position (n-1)q (1-based); q = 0.5 gives (n+1) div 2 and n div 2 + 1
    pos = (F.col("n") - 1) * F.lit(float(q))
    k1 = F.floor(pos) + 1
    k2 = F.ceil(pos) + 1
    reqs = None
    for which, k in ((1, k1), (2, k2)):
        part = (fc.where((F.col("n") > 0) & (F.col("below") < k) & (k <= F.col("below") + F.col("fc")))
                  .select(*gcols, "t", "r", F.lit(which).alias("which"),
                          (k - F.col("below")).cast("long").alias("k")))
        reqs = part if reqs is None else reqs.unionByName(part)
    reqs = reqs.withColumn("c", F.floor(F.col("t") / chunk))

    # (1)+(4): copy the values of the ranges that a chunk asks for to it, answer rank requests.
    reqs = materialize(reqs)
    asked = reqs.select(*gcols, "c", "r").distinct()
    srcx = src.withColumn("c", F.explode(F.sequence(F.floor((F.col("d") + hi) / chunk),
                                                    F.floor((F.col("d") + lo) / chunk)))).join(asked, [*gcols, "c", "r"], "left_semi")
    out_schema = T.StructType(
        [T.StructField(g, key_types[g]) for g in gcols]
        + [T.StructField("t", T.IntegerType()), T.StructField("which", T.IntegerType()),
           T.StructField("x", T.DoubleType())])
    # The request side gets fresh key names: both sides derive from ``df`` and
    # the analyzer would otherwise see ambiguous self-join references.
    rk = [f"__rk{i}" for i in range(len(gcols))]
    reqs = reqs.select(*[F.col(g).alias(r) for g, r in zip(gcols, rk)],
                       F.col("c").alias("__rc"), F.col("r").alias("__rr"), "t", "which", "k")
    picker = _rank_picker(gcols, rk, lo, hi)
    picked = (srcx.select(*gcols, "c", "r", "d", "v").groupBy(*gcols, "c", "r")
                  .cogroup(reqs.groupBy(*rk, "__rc", "__rr"))
                  .applyInPandas(picker, out_schema))
    xs = picked.groupBy(*gcols, "t").agg(F.max(F.when(F.col("which") == 1, F.col("x"))).alias("x1"),
                                          F.max(F.when(F.col("which") == 2, F.col("x"))).alias("x2"))
    sizes = fc.where(F.col("r") == 0).select(*gcols, "t", "n")
    res = sizes.join(xs, gcols + ["t"], "left").withColumnRenamed("t", day)
    # Spark's percentile interpolation: (hi - pos) * x1 + (pos - lo) * x2
    p_ = (F.col("n") - 1) * F.lit(float(q))
    lo_, hi_ = F.floor(p_), F.ceil(p_)
    res = res.withColumn("med", F.when(lo_ == hi_, F.col("x1"))
                         .otherwise((hi_ - p_) * F.col("x1") + (p_ - lo_) * F.col("x2"))).drop("x1", "x2")
    return res.select(*gcols, day, "med", "n")


def _quantile(w: np.ndarray, q: float) -> float:
    """Exact quantile with Spark's ``percentile`` interpolation (bit-identical)."""
    if q == 0.5:
        return float(np.median(w))
    w = np.sort(w)
    p = (len(w) - 1) * q
    lo, hi = int(np.floor(p)), int(np.ceil(p))
    return float(w[lo]) if lo == hi else float((hi - p) * w[lo] + (p - lo) * w[hi])


def _run_quantiles(v: np.ndarray, a: np.ndarray, b: np.ndarray, q: float) -> list:
    """``_quantile`` of each run v[a:b] (None if empty); ``a`` and ``b`` never fall.

    The values are cut into cells of equal size by rank; counts per cell up to each border of a
    run say which cell holds a wanted rank, and only its values are looked at.
    """
    n = len(v)
    longest = int((b - a).max()) if len(a) else 0
    if longest < _CELL_RUN or np.isnan(v).any():
        return [_quantile(v[x:y], q) if y > x else None for x, y in zip(a, b)]
    order = np.argsort(v, kind="stable")  # values by rank; inside a cell their places
    size = max(64, int(math.sqrt(n)))
    cell = np.empty(n, np.int64)
    cell[order] = np.arange(n) // size
    cells = (n - 1) // size + 1
    held, at, res = np.zeros(cells, np.int64), (0, 0), []

    def pick(rank, up, x, y):
        c = int(np.searchsorted(up, rank, side="right"))
        some = order[c * size:(c + 1) * size]
        return v[some[np.flatnonzero((some >= x) & (some < y))[rank - (up[c - 1] if c else 0)]]]

    for x, y in zip(a.tolist(), b.tolist()):
        if y <= x:
            res.append(None)
            continue
        held += np.bincount(cell[at[1]:y], minlength=cells) - np.bincount(cell[at[0]:x], minlength=cells)
        at, up, p = (x, y), held.cumsum(), (y - x - 1) * q
        lo, hi = math.floor(p), math.ceil(p)
        low = pick(lo, up, x, y)
        high = low if hi == lo else pick(hi, up, x, y)
        res.append(float(low) if lo == hi else float((low + high) / 2) if q == 0.5 else float((hi - p) * low + (p - lo) * high))
    return res


def _frame_direct(src, targets, gcols, key_types, lo, hi, chunk, day, q=0.5, lengths=None):
    """No value split needed: one (group, chunk) task holds every value its
    target days need; medians and counts come straight out of the kernel
    (one shuffle).  Target days travel as value-less marker rows."""
    import pyarrow as pa
    marks = targets.select(*gcols, F.col("t").alias("d"), F.lit(None).cast("double").alias("v"),
                           F.floor(F.col("t") / chunk).cast("int").alias("c"))
    vals = src.select(*gcols, "d", "v", F.explode(F.sequence(F.floor((F.col("d") + hi) / chunk).cast("int"),
                                                             F.floor((F.col("d") + lo) / chunk).cast("int"))).alias("c"))
    outs = [("med", "n", lo)] if lengths is None else [(f"med_{x}", f"n_{x}", x) for x in lengths]
    schema = T.StructType([T.StructField(g, key_types[g]) for g in gcols] + [T.StructField(day, T.IntegerType())]
                          + [f for m, n, _ in outs for f in (T.StructField(m, T.DoubleType()), T.StructField(n, T.LongType()))])

    def kernel(t: pa.Table) -> pa.Table:
        is_t = t.column("v").is_null().to_numpy()  # NaN is a value
        d, v = t.column("d").to_numpy().astype("int64"), t.column("v").to_numpy().astype("float64")
        t_days = np.unique(d[is_t])
        at = np.flatnonzero(~is_t)
        at = at[np.argsort(d[at], kind="stable")]
        dv, vv = d[at], v[at]
        out = {g: t.column(g).take(pa.array(np.zeros(len(t_days), dtype="int64"))) for g in gcols} | {day: t_days.astype("int32")}
        b = np.searchsorted(dv, t_days - hi, side="right")
        for m, n, length in outs:
            a = np.searchsorted(dv, t_days - length, side="left")
            out[m] = pa.array(_run_quantiles(vv, a, b, q), pa.float64(), from_pandas=True)
            out[n] = (b - a).astype("int64")
        return pa.table(out)

    return marks.unionByName(vals).groupBy(*gcols, "c").applyInArrow(kernel, schema)


def frame_medians(df: DataFrame, groups, value: str, lengths, hi: int = 1, *, day: str = "day",
                  max_task_rows: int = 2_000_000, picked: int | None = None, stretch: int = 1) -> DataFrame:
    """``frame_median_by_day`` for several window lengths: groups..., day, med_<L>, n_<L> for each.

    One shuffle by (group, chunk of ``stretch`` times the longest window) answers all of them (a value is copied to
    1 + 1 / ``stretch`` chunks on average); if a chunk of one window length would exceed ``max_task_rows`` the
    windows take the value-range path, over one table of ranges.
    """
    groups, lengths = list(groups), list(lengths)
    gcols = groups or [_G0]
    src_df = df if groups else df.withColumn(_G0, F.lit(0))
    base = _not_null_keys(src_df, gcols)
    chunk = max(lengths) - hi + 1
    src = base.where(F.col(value).isNotNull()).select(*gcols, F.col(day).cast("int").alias("d"), F.col(value).cast("double").alias("v"))
    targets = base.select(*gcols, F.col(day).cast("int").alias("t")).distinct()
    key_types = {f.name: f.dataType for f in base.schema.fields if f.name in gcols}
    picked = picked or _pick_splits(src, gcols, chunk, max_task_rows)
    if picked > 1:
        # ranges that bound the tasks of the longest window bound those of the others
        src, vg = _ranged(src, gcols, chunk, None, picked, max_task_rows)
        out = None
        for length in lengths:
            t = _frame_ranked(src, vg, targets, gcols, key_types, length, hi, day, 0.5)
            t = t.withColumnRenamed("med", f"med_{length}").withColumnRenamed("n", f"n_{length}")
            out = t if out is None else out.join(t, [*gcols, day])
        return out if groups else out.drop(_G0)
    res = _frame_direct(src, targets, gcols, key_types, max(lengths), hi, chunk * stretch, day, lengths=lengths)
    return res if groups else res.drop(_G0)


def _rank_picker(gcols, rk, lo, hi):
    def pick(src: pd.DataFrame, req: pd.DataFrame) -> pd.DataFrame:
        if req.empty or src.empty:
            return pd.DataFrame({**{g: pd.Series(dtype="object") for g in gcols},
                                 "t": pd.Series(dtype="int32"), "which": pd.Series(dtype="int32"),
                                 "x": pd.Series(dtype="float64")})
        v = src["v"].to_numpy(dtype="float64")
        d = src["d"].to_numpy(dtype="int64")
        order = np.argsort(v, kind="stable")
        v, d = v[order], d[order]
        req = req.sort_values("t", kind="stable")
        t_arr = req["t"].to_numpy(dtype="int64")
        k_arr = req["k"].to_numpy(dtype="int64")
        x = np.empty(len(req), dtype="float64")
        starts = np.flatnonzero(np.r_[True, t_arr[1:] != t_arr[:-1]])
        ends = np.r_[starts[1:], len(t_arr)]
        for s, e in zip(starts, ends):
            t = t_arr[s]
            idx = np.flatnonzero((d >= t - lo) & (d <= t - hi))
            x[s:e] = v[idx[k_arr[s:e] - 1]]
        out = {g: req[r].to_numpy() for g, r in zip(gcols, rk)}
        out.update({"t": t_arr.astype("int32"),
                    "which": req["which"].to_numpy(dtype="int32"), "x": x})
        return pd.DataFrame(out)
    return pick


# ---------------------------------------------------------------------------
# Right-closed time window ending at the previous row (lag_row mode)
# ---------------------------------------------------------------------------

def lag_row_median(df: DataFrame, groups, value: str, length: int, min_periods: int, *,
                   day: str = "day", order: str = "seq", key: str = "sale_key",
                   out: str = "lag_med", max_task_rows: int = 2_000_000,
                   block_rows: int = 100_000, keep=None) -> DataFrame:
    """pandas ``rolling(f'{L}D', min_periods).median().shift(1)`` inside the group.

    Rows are ordered by (day, ``order``, ``key``).  The value of row i is M(i-1),
    where M(p) is the median over rows k <= p with ``day_k > day_p - L`` (NULL below
    ``min_periods`` values): the window ending at the previous row of the same
    group (§8 Z2: never the previous group's row).  ``groups=[]`` is the global
    frame (B7).  Adds column ``out``; rows with a NULL key get NULL; every input
    row, repeated ones too, gives one row.  ``keep`` names the columns of ``df`` that the
    result has (all without it): only these go through the kernels.  ``df`` is read a few times.

    A group whose two window lengths never hold more than ``max_task_rows`` rows
    is cut into time chunks of length L (``_lag_row_chunks``); a hotter group is
    cut into blocks of rows and value ranges (``_lag_row_blocks``).  Both give M
    for each row but the first of a chunk or block, and the M of its last row,
    which a lag over the table of chunks or blocks hands to the next one.
    """
    from comparo.session import materialize
    groups = list(groups)
    gcols = groups or [_G0]
    base = df if groups else df.withColumn(_G0, F.lit(0))
    keyed = _not_null_keys(base, gcols)
    keep = list(df.columns if keep is None else keep)
    L = int(length)
    sizes = keyed.groupBy(*gcols, F.floor(F.col(day) / L).alias("__c")).count()
    two = F.col("count") + F.coalesce(F.lag("count").over(Window.partitionBy(*gcols).orderBy("__c")), F.lit(0))
    hot = materialize(sizes.select(*gcols, two.alias("n")).groupBy(*gcols).agg(F.max("n").alias("__m"))
                      .where(F.col("__m") > max_task_rows))
    n_hot = hot.count()
    names = [f"__r{i}" for i in range(len(gcols))]
    right = hot.select(*[F.col(g).alias(r) for g, r in zip(gcols, names)], F.col("__m"))
    same = [F.col(g) == F.col(r) for g, r in zip(gcols, names)]
    cold = keyed.join(right, same, "left_anti") if n_hot else keyed
    every = n_hot and n_hot == sizes.select(*gcols).distinct().count()
    parts = [] if every else [_lag_row_chunks(cold, gcols, value, L, min_periods, day, order, key, out, keep)]
    if n_hot:
        parts.append(_lag_row_blocks(keyed.join(F.broadcast(right) if n_hot <= _SMALL_LEVEL else right, same).drop(*names), gcols, value, L, min_periods,
                                     day, order, key, out, max_task_rows, block_rows, keep))
    if groups:
        nulls = base.where(~F.coalesce(_all_set(gcols), F.lit(False))).select(*keep)
        parts.append(nulls.withColumn(out, F.lit(None).cast("double")))
    res = parts[0]
    for part in parts[1:]:
        res = res.unionByName(part)
    return res


def _all_set(gcols):
    cond = F.lit(True)
    for g in gcols:
        cond = cond & F.col(g).isNotNull()
    return cond


def _carried(gcols, order, key, keep) -> tuple[list, dict]:
    """The columns of ``keep`` that are no group, order or key, and under which name each of ``keep`` goes through the kernels."""
    extra = [c for c in keep if c not in (*gcols, order, key)]
    return extra, {c: c for c in gcols} | {order: "o", key: "k"} | {c: f"__x{i}" for i, c in enumerate(extra)}


def _handed_on(res: DataFrame, gcols, unit, out: str, keep, names) -> DataFrame:
    """Rows of the kernel (kind 0 row, 1 first of its chunk, 2 last M): the first
    row takes the last M of the chunk (ordered by ``unit``) before it."""
    own = [F.col(names[c]).alias(c) for c in keep]
    w = Window.partitionBy(*gcols).orderBy(*unit)
    tails = res.where(F.col("kind") == 2).select(*gcols, *unit, F.lag("val").over(w).alias("__t"))
    first = res.where(F.col("kind") == 1).drop("val").join(tails, [*gcols, *unit])
    return res.where(F.col("kind") == 0).select(*own, F.col("val").alias(out)).unionByName(first.select(*own, F.col("__t").alias(out)))


def _lag_row_chunks(keyed: DataFrame, gcols, value, L, min_periods, day, order, key, out, keep) -> DataFrame:
    """Time chunks of length L: the day and value of each row are also copied into
    the next chunk, so the task of a chunk holds everything M needs for its own rows."""
    import pyarrow as pa
    from comparo.session import materialize
    extra, names = _carried(gcols, order, key, keep)
    rows = keyed.select(*gcols, F.col(day).cast("int").alias("d"), F.col(value).cast("double").alias("v"), F.col(order).alias("o"), F.col(key).alias("k"),
                        *[F.col(c).alias(names[c]) for c in extra])
    own = F.floor(F.col("d") / L)
    # the next chunk's windows start after the first day of this one
    copied = F.col("v").isNotNull() & (F.col("d") > own * L)
    rows = rows.withColumn("c", F.explode(F.when(copied, F.array(own, own + 1)).otherwise(F.array(own))))
    rows = rows.select(*gcols, "d", "v", "c", *[F.when(F.col("c") == own, F.col(x)).alias(x) for x in ("o", "k", *[names[c] for c in extra])])
    through = [x for x in dict.fromkeys(names[c] for c in keep) if x not in gcols]
    schema = T.StructType([rows.schema[g] for g in gcols] + [T.StructField("kind", T.IntegerType()), T.StructField("c", T.LongType())]
                          + [T.StructField(x, rows.schema[x].dataType) for x in through] + [T.StructField("val", T.DoubleType())])

    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by([("d", "ascending"), ("o", "ascending"), ("k", "ascending")])
        c = t.column("c")[0].as_py()
        mine = np.flatnonzero(t.column("d").to_numpy() >= c * L)
        if not len(mine):
            none = t.slice(0, 0)
            return pa.table([*[none.column(g) for g in gcols], pa.array([], pa.int32()), none.column("c"), *[none.column(x) for x in through], pa.array([], pa.float64())],
                            names=schema.names)
        # pandas' time window on a sorted index is (d_i - L, d_i] up to row i
        # itself: exactly M(i); skiplist median, O(rows log window)
        ser = pd.Series(t.column("v").to_numpy().astype("float64"), index=pd.to_datetime(t.column("d").to_numpy().astype("int64"), unit="D"))
        m = ser.rolling(f"{L}D", min_periods=min_periods).median().to_numpy()[mine]
        n = len(mine)
        kind = np.zeros(n + 1, dtype="int32")
        kind[0], kind[n] = 1, 2
        sel = t.take(np.r_[mine, mine[-1]])
        cols = [sel.column(g) for g in gcols] + [pa.array(kind), sel.column("c"), *[sel.column(x) for x in through], pa.array(np.r_[np.nan, m[:-1], m[-1]], from_pandas=True)]
        return pa.table(cols, names=schema.names)

    # read three times (rows, firsts, tails): written once instead of three runs of the kernel
    res = materialize(rows.groupBy(*gcols, "c").applyInArrow(kernel, schema))
    return _handed_on(res, gcols, ["c"], out, keep, names)


def _lag_row_blocks(hot: DataFrame, gcols, value, L, min_periods, day, order, key, out,
                    max_task_rows: int, block_rows: int, keep) -> DataFrame:
    """Hot groups (``__m``: rows of their largest two window lengths): no task holds a window.

    A block is a run of at most ``block_rows`` rows of one (group, day), so its
    windows share their start and grow by one row each.  With n0 values before the block in that window
    and m in it, the medians lie among the block's own values and the ranks
    ``(n0+m+1) div 2 - m .. (n0+m) div 2 + 1`` of those before: m + 2 values at most.
    Counts per (value range, day) and (value range, block) say which ranges hold
    these ranks; tasks of one (chunk, range) answer them; the block's task runs an
    expanding median over what it got.  A task holds about 2/V of two window
    lengths, or twice ``block_rows``.
    """
    from comparo.operators.ordering import exclusive_running
    from comparo.session import materialize
    biggest = hot.agg(F.max("__m")).first()[0]
    V = 1 << max(0, math.ceil(math.log2(max(1.0, 2 * biggest / max_task_rows))))
    extra, names = _carried(gcols, order, key, keep)
    through = [x for x in dict.fromkeys(names[c] for c in keep) if x not in gcols]
    x = hot.select(*gcols, F.col(day).cast("int").alias("d"), F.col(order).alias("o"), F.col(key).alias("k"), F.col(value).cast("double").alias("v"),
                   *[F.col(c).alias(names[c]) for c in extra])
    # equal ``order`` values are told apart by the key, so positions are repeatable
    pos = exclusive_running(x, gcols, (), day="d", seq="o", prefix="p", then="k")
    # rows before each day: a row per group and day, broadcast once counted, so that the rows are not shuffled again for it
    earlier = Window.partitionBy(*gcols).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    start = materialize(x.groupBy(*gcols, "d").count().select(*gcols, "d", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__s")))
    start = F.broadcast(start) if start.count() <= _SMALL_LEVEL else start
    pos, _ = numbered_ranges(pos, gcols, "v", V, "r", source=x)
    # positions and sketch bounds are not bit-stable across re-evaluations: written once
    rows = materialize(pos.join(start, [*gcols, "d"])
                       .select(*gcols, "d", F.floor((F.col("pn") - F.col("__s")) / block_rows).cast("int").alias("b"), "pn", "v", "r", *through))
    vals = rows.where("v IS NOT NULL")
    unit = [*gcols, "d", "b"]
    blocks = rows.groupBy(*unit).agg(F.count("v").alias("m"))

    # values before each block in its window, per node of a tree over the ranges: whole days by a RANGE frame, earlier
    # blocks of the day by another; only the nodes that hold wanted ranks are opened, so a block costs log(V) rows
    bits, shifts = V.bit_length() - 1, []
    while not shifts or shifts[-1] > 0:
        shifts.append(max(0, (shifts[-1] if shifts else bits) - _NODE_BITS))

    def counted(nodes, shift):
        at = vals.select(*gcols, "d", "b", F.shiftright("r", shift).alias("r"))
        per_day = at.groupBy(*gcols, "r", "d").agg(F.count(F.lit(1)).alias("n"))
        per_block = at.groupBy(*gcols, "r", "d", "b").agg(F.count(F.lit(1)).alias("n"))
        days = nodes.select(*gcols, "r", "d").distinct().join(per_day, [*gcols, "r", "d"], "full").select(*gcols, "r", "d", F.coalesce("n", F.lit(0)).alias("n"))
        whole = days.select(*gcols, "r", "d", F.coalesce(F.sum("n").over(Window.partitionBy(*gcols, "r").orderBy("d").rangeBetween(-(L - 1), -1)), F.lit(0)).alias("w"))
        earlier = Window.partitionBy(*gcols, "r", "d").orderBy("b").rangeBetween(Window.unboundedPreceding, -1)
        both = nodes.withColumn("n", F.lit(0).cast("long")).unionByName(per_block, allowMissingColumns=True)
        both = both.withColumn("e", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").where("top IS NOT NULL")
        return both.join(whole, [*gcols, "r", "d"]).withColumn("n", F.col("w") + F.col("e")).drop("w", "e")

    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = (F.col("n") > 0) & (F.col("below") + 1 <= F.col("hi")) & (F.col("below") + F.col("n") >= F.col("lo"))
    grid = blocks.select(*unit, "m", F.lit(0).alias("top"), F.explode(F.sequence(F.lit(0), F.lit((1 << (bits - shifts[0])) - 1))).alias("r"))
    have = counted(grid, shifts[0]).withColumn("n0", F.sum("n").over(Window.partitionBy(*unit))).withColumn("below", before(*unit))
    lo = F.greatest(F.lit(1), F.floor((F.col("n0") + F.col("m") + 1) / 2) - F.col("m"))
    hi = F.least(F.col("n0"), F.floor((F.col("n0") + F.col("m")) / 2) + 1)
    have = have.withColumn("lo", lo).withColumn("hi", hi)
    first_level = have = materialize(have.where((F.col("r") == 0) | wanted))
    have = have.where(wanted).select(*unit, "r", "n", "below", "lo", "hi")
    for shift, above in zip(shifts[1:], shifts):
        fan = 1 << (above - shift)
        nodes = have.select(*unit, "lo", "hi", F.col("below").alias("base"), F.col("r").alias("top"), F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("i"))
        nodes = nodes.select(*unit, "lo", "hi", "base", "top", (F.col("top") * fan + F.col("i")).alias("r"))
        have = counted(nodes, shift).withColumn("below", F.col("base") + before(*unit, "top"))
        have = materialize(have.where(wanted).select(*unit, "r", "n", "below", "lo", "hi"))
    ask = have.select(*unit, "r", F.greatest(F.col("lo") - F.col("below"), F.lit(1)).alias("k1"), F.least(F.col("hi") - F.col("below"), F.col("n")).alias("k2"))

    # tasks of a chunk and one range, or several if they are small, answer the rank intervals
    few = max(1, _RUN_ROWS // max_task_rows)
    src = vals.select(*gcols, "d", "b", "v", "r", F.explode(F.sequence(F.floor(F.col("d") / L), F.floor((F.col("d") + L - 1) / L))).alias("c"))
    rk = [f"__rk{i}" for i in range(len(gcols))]
    ask = ask.select(*[F.col(g).alias(q) for g, q in zip(gcols, rk)], F.floor(F.col("d") / L).alias("__rc"), F.col("r").alias("__rr"), "d", "b", "k1", "k2")
    asked = ask.select(*rk, "__rc", "__rr").distinct()
    src = src.join(asked, [F.col(g).eqNullSafe(F.col(q)) for g, q in zip([*gcols, "c", "r"], [*rk, "__rc", "__rr"])], "left_semi")
    key_types = [rows.schema[g] for g in gcols]
    found_schema = T.StructType(key_types + [T.StructField("d", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("x", T.DoubleType())])

    def answer(s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if s.empty or q.empty:
            return pd.DataFrame({f.name: pd.Series(dtype="object") for f in found_schema.fields})
        at = np.lexsort((s["v"].to_numpy(dtype="float64"), s["r"].to_numpy(dtype="int64")))
        v, d, b, rs = s["v"].to_numpy(dtype="float64")[at], *(s[c].to_numpy(dtype="int64")[at] for c in ("d", "b", "r"))
        parts, size = [], []
        asks = q["__rr"].to_numpy(dtype="int64")
        for i, j, t, tb, k1, k2 in zip(np.searchsorted(rs, asks), np.searchsorted(rs, asks, side="right"), *(q[c].to_numpy(dtype="int64") for c in ("d", "b", "k1", "k2"))):
            di = d[i:j]
            held = np.flatnonzero((di > t - L) & ((di < t) | ((di == t) & (b[i:j] < tb))))
            parts.append(v[i + held[k1 - 1:k2]])
            size.append(len(parts[-1]))
        res = {g: np.repeat(q[r_].to_numpy(), size) for g, r_ in zip(gcols, rk)}
        return pd.DataFrame(res | {"d": np.repeat(q["d"].to_numpy(), size), "b": np.repeat(q["b"].to_numpy(), size), "x": np.concatenate(parts)})

    found = (src.groupBy(*gcols, "c", F.floor(F.col("r") / few).alias("__rg"))
             .cogroup(ask.groupBy(*rk, "__rc", F.floor(F.col("__rr") / few).alias("__ra"))).applyInPandas(answer, found_schema))

    # a task of blocks of one day (together at most about ``_RUN_ROWS`` rows, or one block): the values around the middle of what came before, then its own rows in order
    heads = first_level.where("r = 0").select(*unit, "n0", "lo", "hi")
    own = rows.select(*unit, "pn", "v", F.lit(None).cast("double").alias("x"), F.lit(None).cast("long").alias("n0"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    got = found.select(*unit, F.lit(None).cast("long").alias("pn"), F.lit(None).cast("double").alias("v"), "x", F.lit(None).cast("long").alias("n0"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    head = heads.select(*unit, F.lit(None).cast("long").alias("pn"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("double").alias("x"), "n0", "lo", "hi")
    med_schema = T.StructType(key_types + [T.StructField("d", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("pn", T.LongType()),
                                           T.StructField("kind", T.IntegerType()), T.StructField("val", T.DoubleType())])

    def running(line: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Medians of the sorted ``line`` and the values of ``v`` up to each of them; NaN adds nothing."""
        if len(v) > 2_000:
            return pd.Series(np.concatenate([line, v])).expanding(1).median().to_numpy()[len(line):]
        held, res = line.tolist(), np.full(len(v), np.nan)
        for i, x in enumerate(v.tolist()):
            if x == x:
                insort(held, x)
            if held:
                h = len(held) // 2
                res[i] = held[h] if len(held) % 2 else (held[h - 1] + held[h]) / 2
        return res

    def medians(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["b", "pn"], kind="stable")  # a block's rows, then what it got
        bs, pn, vs, xs = t["b"].to_numpy(dtype="int64"), t["pn"].to_numpy(dtype="float64"), t["v"].to_numpy(dtype="float64"), t["x"].to_numpy(dtype="float64")
        facts = [t[c].to_numpy(dtype="float64") for c in ("n0", "lo", "hi")]
        starts = np.flatnonzero(np.r_[True, bs[1:] != bs[:-1]])
        out = []
        for s, e in zip(starts, np.r_[starts[1:], len(bs)]):
            n0, lo_, hi_ = (int(np.nanmax(f[s:e])) for f in facts)
            n = int(np.count_nonzero(~np.isnan(pn[s:e])))
            x, v = xs[s:e], vs[s:s + n]
            # values left out on either side only count: equal numbers of them cancel
            under, over = (lo_ - 1, n0 - hi_) if n0 else (0, 0)
            pad = min(under, over)
            far = np.finfo(float).max
            med = running(np.concatenate([np.full(under - pad, -far), np.sort(x[~np.isnan(x)]), np.full(over - pad, far)]), v)
            med = np.where(n0 + np.cumsum(~np.isnan(v)) >= max(min_periods, 1), med, np.nan)
            kind = np.zeros(n + 1, dtype="int32")
            kind[0], kind[n] = 1, 2
            p_ = pn[s:s + n].astype("int64")
            out.append((np.repeat(bs[s], n + 1), np.r_[p_, p_[-1]], kind, np.r_[np.nan, med[:-1], med[-1]]))
        b_, p_, kind, val = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({g: np.repeat(t[g].to_numpy()[:1], len(b_)) for g in [*gcols, "d"]} | {"b": b_.astype("int32"), "pn": p_, "kind": kind, "val": val})

    run = F.floor(F.col("b") / max(1, _RUN_ROWS // block_rows)).alias("__run")
    med = materialize(own.unionByName(got).unionByName(head).groupBy(*gcols, "d", run).applyInPandas(medians, med_schema))
    w = Window.partitionBy(*gcols).orderBy("d", "b")
    tails = med.where("kind = 2").select(*unit, F.lag("val").over(w).alias("__t"))
    first = med.where("kind = 1").select(*unit, "pn").join(tails, unit).select(*gcols, "pn", F.col("__t").alias("val"))
    each = med.where("kind = 0").select(*gcols, "pn", "val").unionByName(first)
    return rows.select(*gcols, "pn", *through).join(each, [*gcols, "pn"]).select(*[F.col(names[c]).alias(c) for c in keep], F.col("val").alias(out))


def numbered_ranges(df: DataFrame, groups, v: str, ranges: int, out: str = "r", source: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Adds ``out``, the number of the value range of ``v`` in its group (0 first; NULL for a NULL value), and returns how
    many ranges there are: ``ranges`` or somewhat more.

    A sketch gives at most ``_FAN`` bounds a group; where more are wanted each range is cut again by its own sketch.  So no
    plan holds more than ``_FAN`` numbers and no row meets more than that many bounds.  Bounds are written, and broadcast
    unless they are many.  ``source``: rows of the same values that are cheaper to read (``groups`` and ``v``).
    """
    from comparo.session import materialize
    groups = list(groups)
    first = F.when(F.col(v).isNotNull(), F.lit(0))
    res, seen, done = df.withColumn(out, first), (df if source is None else source).select(*groups, v).withColumn(out, first), 1
    while done < ranges:
        fan = min(_FAN, -(-ranges // done))
        shares = F.percentile_approx(v, [i / fan for i in range(1, fan)], 10000)
        bounds = materialize(seen.where(F.col(v).isNotNull()).groupBy(*groups, out).agg(shares.alias("__b")))
        if bounds.count() * fan <= _SMALL_LEVEL:
            bounds = F.broadcast(bounds)
        cut = (F.col(out) * fan + value_range(F.col("__b"), F.col(v), fan)).cast("int")
        res, seen = (x.join(bounds, [*groups, out], "left").withColumn(out, cut).drop("__b") for x in (res, seen))
        done *= fan
    return res.select(*df.columns, out), done


def value_range(bounds, v, ranges: int):
    """Number of sorted ``bounds`` (an array of ``ranges`` - 1) that are <= ``v``, looked up in two
    steps of about sqrt(ranges) comparisons; NULL for a NULL value."""
    step = max(1, int(math.sqrt(ranges)))
    coarse = F.size(F.filter(F.array(*[bounds[i] for i in range(step - 1, ranges - 1, step)]) if ranges > step else F.array().cast("array<double>"), lambda b: b <= v))
    left = coarse * step
    fine = F.size(F.filter(F.slice(bounds, left + 1, F.lit(step)), lambda b: b <= v))
    return F.when(v.isNotNull(), (left + fine).cast("int"))


# ---------------------------------------------------------------------------
# Row-count frames
# ---------------------------------------------------------------------------

def rows_median(df: DataFrame, groups, value: str, n_rows: int, min_periods: int, *,
                day: str = "day", order: str = "seq", key: str = "sale_key", out: str = "rows_med",
                method: str = "chunked", chunk_rows: int = 100_000) -> DataFrame:
    """Median of the previous ``n_rows`` rows of the group (shift 1), NULL below
    ``min_periods`` non-NULL values.

    ``chunked``: the 0-based position inside the group comes from the two-level
    running count (``ordering.exclusive_running``, no group-sized window); rows
    are cut into position chunks of ``chunk_rows`` and each row is also copied
    to the chunk its successors need, so a task holds at most
    ``chunk_rows + n_rows`` rows however large the group.  ``sql``: the
    ``ROWS BETWEEN n PRECEDING AND 1 PRECEDING`` window (one task per group).
    """
    groups = list(groups)
    if method == "sql":
        w = ((Window.partitionBy(*groups) if groups else Window)
             .orderBy(day, order).rowsBetween(-n_rows, -1))
        cnt = F.count(value).over(w)
        return df.withColumn(out, F.when(cnt >= min_periods, F.percentile(value, F.lit(0.5)).over(w)))
    from comparo.operators.ordering import exclusive_running
    gcols = groups or [_G0]
    base = df if groups else df.withColumn(_G0, F.lit(0))
    keyed = _not_null_keys(base, gcols).select(*gcols, day, order, F.col(key).alias("__k"),
                                               F.col(value).cast("double").alias("__v"))
    pos = exclusive_running(keyed, gcols, (), day=day, seq=order, prefix="__p")  # __pn = 0-based position
    C = int(chunk_rows)
    own = F.floor(F.col("__pn") / C)
    rows = pos.select(*gcols, F.col("__pn").alias("p"), "__k", "__v", own.alias("own"),
                      F.explode(F.sequence(own, F.floor((F.col("__pn") + n_rows) / C))).alias("c"))
    schema = T.StructType([T.StructField("__k", rows.schema["__k"].dataType), T.StructField(out, T.DoubleType())])

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p", kind="stable")
        c = int(pdf["c"].iloc[0])
        m = (pd.Series(pdf["__v"].to_numpy(dtype="float64"))
               .rolling(n_rows, min_periods=min_periods).median().shift(1).to_numpy())
        mine = pdf["own"].to_numpy() == c
        return pd.DataFrame({"__k": pdf["__k"].to_numpy()[mine], out: m[mine]})

    vals = rows.groupBy(*gcols, "c").applyInPandas(kernel, schema).withColumnRenamed("__k", key)
    res = base.join(vals, key, "left")
    return res.drop(_G0) if not groups else res


# ---------------------------------------------------------------------------
# Group baseline with regional fallback and shrinkage
# ---------------------------------------------------------------------------

def causal_baseline(df: DataFrame, group: str = "fsa", value: str = "ppsf", length: int = 90,
                    shrink_k: float = 10.0, min_n: int = 15, *, day: str = "day",
                    method: str = "chunked", out: str = "base_ppsf",
                    history: DataFrame | None = None) -> DataFrame:
    """Adds ``base_grp, n_grp, base_reg, n_reg, alpha, <out>`` to every row.

    alpha = n/(n+k) (n = comparable count, 0 for an empty frame — §8 Z21);
    baseline = regional median when n < min_n, else alpha*group + (1-alpha)*regional.
    With ``history`` the comparables come from that table (B16: pricing new
    listings from past sales); otherwise from ``df`` itself.
    """
    from comparo.session import materialize
    src = df if history is None else history
    tg = None if history is None else df
    vg = vr = None
    if method == "chunked":
        vg, vr = pick_splits_many(src, [([group], length), ([], length)], value, day=day)
    grp = (frame_median_by_day(src, [group], value, length, 1, day=day, method=method, targets=tg, picked=vg)
           .withColumnRenamed("med", "base_grp").withColumnRenamed("n", "n_grp"))
    reg = (frame_median_by_day(src, [], value, length, 1, day=day, method=method, targets=tg, picked=vr)
           .withColumnRenamed("med", "base_reg").withColumnRenamed("n", "n_reg"))
    # a row per (group, day) and per day: written, so that their sizes are known before the joins are planned and
    # the rows are not shuffled for tables that fit a broadcast
    grp, reg = materialize(grp), materialize(reg)
    n = F.coalesce(F.col("n_grp"), F.lit(0))
    alpha = n / (n + F.lit(float(shrink_k)))
    res = (df.join(grp, [group, day], "left")
             .join(reg, [day], "left")
             .withColumn("n_grp", n)
             .withColumn("alpha", alpha))
    blended = (F.col("alpha") * F.coalesce(F.col("base_grp"), F.col("base_reg"))
               + (1 - F.col("alpha")) * F.col("base_reg"))
    return res.withColumn(out, F.when(F.col("n_grp") < min_n, F.col("base_reg")).otherwise(blended))


# ---------------------------------------------------------------------------
# Hierarchy of candidate levels
# ---------------------------------------------------------------------------

# Level lists and (window days, min_periods) pairs.
V5_LEVELS = (("type_dwel",), ("fsa",), ("region",), ())
V5_WINDOWS = ((90, 8), (365, 12))


def in_order(levels, windows=V5_WINDOWS) -> list:
    """Fallback order level by level: [(level, length, min_periods)]."""
    return [(tuple(lv), n, m) for lv in levels for n, m in windows]


def by_window(levels, windows=V5_WINDOWS) -> list:
    """The first window of all group levels, then the next; the global level last."""
    return [(tuple(lv), n, m) for n, m in windows for lv in levels if lv] + [((), n, m) for lv in levels if not lv for n, m in windows]


# The fallback orders (level x window) by version.
ORDERS = {
    "v1": by_window((("fsa", "type_dwel"), ("fsa",), ())),
    "v4": in_order((("fsa", "type_dwel"), ("fsa",), ())),
    "v4_regional": in_order((("region", "type_dwel"), ("type_dwel",), ("fsa",), ())),
    "v5": in_order(V5_LEVELS),
}


def level_name(level, length) -> str:
    return f"ppsf_{length}d_{'_'.join(level) if level else 'global'}"


def level_candidates(df: DataFrame, value: str = "ppsf", order=ORDERS["v5"], *, mode: str = "strict", day: str = "day",
                     min_group_rows: int = 0, max_task_rows: int = 2_000_000) -> tuple[DataFrame, list]:
    """One candidate column per entry (level, window, min_periods) of ``order``; NULL where support <
    min_periods, or (B9) where the whole group has no more than ``min_group_rows`` rows.

    ``mode='strict'`` uses the frame ``[t-L, t-1]`` per (level, day), one shuffle and one join per
    level for all its windows; ``mode='lag_row'`` the window ending at the previous row.
    Returns (frame, candidate column names in fallback order).
    """
    names = [level_name(lv, n) for lv, n, _ in order]
    levels = list(dict.fromkeys(lv for lv, _, _ in order))
    out = df
    if mode == "strict":
        windows = {lv: sorted({n for x, n, _ in order if x == lv}) for lv in levels}
        from comparo.session import materialize
        picks = pick_splits_many(df, [(list(lv), max(windows[lv])) for lv in levels], value, day=day, max_task_rows=max_task_rows, lengths=True)
        for lv, (picked, stretch) in zip(levels, picks):
            t = frame_medians(df, list(lv), value, windows[lv], day=day, picked=picked, max_task_rows=max_task_rows, stretch=stretch)
            t = t.select(*lv, day, *[F.when(F.col(f"n_{n}") >= m, F.col(f"med_{n}")).alias(level_name(lv, n)) for x, n, m in order if x == lv])
            # one row per group and day, written and counted: a small one spares the rows a shuffle
            t = materialize(t)
            out = out.join(F.broadcast(t) if t.count() <= _SMALL_LEVEL else t, [*lv, day], "left")
    elif mode == "lag_row":
        for lv, n, m in order:
            out = lag_row_median(out, list(lv), value, n, m, day=day, out=level_name(lv, n), max_task_rows=max_task_rows)
    else:
        raise ValueError(mode)
    if min_group_rows:
        for lv in levels:
            own = [level_name(lv, n) for x, n, _ in order if x == lv]
            big = df.groupBy(*lv).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > min_group_rows)
            if lv:
                keys = [f"__k{i}" for i in range(len(lv))]
                big = big.select(*[F.col(c).alias(k) for c, k in zip(lv, keys)], F.lit(True).alias("__big"))
                cond = F.lit(True)
                for c, k in zip(lv, keys):
                    cond = cond & (out[c] == big[k])
                out = out.join(big, cond, "left").drop(*keys)
            else:
                out = out.withColumn("__big", F.lit(big.first() is not None))
            out = out.select([F.when(F.col("__big"), F.col(c)).alias(c) if c in own else F.col(c) for c in out.columns if c != "__big"])
    return out, names


def pick_baseline(df: DataFrame, candidates, value: str = "ppsf", fallback=None,
                  area: str = "area", price: str = "sold_price") -> DataFrame:
    """First non-NULL candidate, else ``fallback``.

    ``fallback`` is the overall median of ``value`` over ``df`` when None (pass
    a train-only number to avoid §8 Z8).  Adds ``ppsf_baseline``,
    ``baseline_level`` (name of the filling candidate or 'overall_median'),
    ``price_baseline`` and ``log_price_ratio``.
    """
    if fallback is None:
        # One number, computed by a distributed aggregate; only it reaches the driver.
        fallback = grouped_median(df, [], value).first()[0]
    fb_col = F.lit(fallback).cast("double")
    level = F.lit("overall_median")
    for c in reversed(list(candidates)):
        level = F.when(F.col(c).isNotNull(), F.lit(c)).otherwise(level)
    return (df.withColumn("ppsf_baseline", F.coalesce(*[F.col(c) for c in candidates], fb_col))
              .withColumn("baseline_level", level)
              .withColumn("price_baseline", F.col("ppsf_baseline") * F.col(area))
              .withColumn("log_price_ratio",
                          F.when((F.col(price) > 0) & (F.col("price_baseline") > 0),
                                 F.log(F.col(price)) - F.log(F.col("price_baseline")))))


# ---------------------------------------------------------------------------
# Exact grouped median with bounded tasks
# ---------------------------------------------------------------------------

def grouped_median(df: DataFrame, groups, value: str, out: str = "median", *,
                   max_task_rows: int | None = None, value_splits: int | None = None,
                   q: float = 0.5) -> DataFrame:
    """Exact median (or quantile ``q``) of ``value`` per group, = ``percentile(v, q)``.

    Rank selection between sketch bounds (``grouped_quantiles``).  With ``value_splits``
    or ``max_task_rows`` the group is one frame of the chunked machinery instead (all
    rows on one pseudo-day).  Returns (groups..., out).
    """
    groups = list(groups)
    if value_splits is None and max_task_rows is None:
        return grouped_quantiles(df, groups, value, {out: q})
    one = df.select(*groups, F.col(value).alias(value), F.lit(0).alias("__day"))
    t = frame_median_by_day(one, groups, value, 0, 0, day="__day", method="chunked", value_splits=value_splits,
                            max_task_rows=max_task_rows or 2_000_000, q=q)
    return t.select(*groups, F.col("med").alias(out))


def grouped_quantile(df: DataFrame, groups, value: str, q: float, out: str = "quantile", **kw) -> DataFrame:
    """Exact quantile per group with bounded tasks (see ``grouped_median``)."""
    return grouped_median(df, groups, value, out, q=q, **kw)


#: Parts into which a refining round cuts a bracket.
_GRID = 64


def _narrowed(src: DataFrame, stats: DataFrame, keys, qs, max_cells: int, accuracy: int) -> tuple[DataFrame, int]:
    """Brackets of ``stats`` narrowed round by round until none holds more than ``max_cells`` different
    values of a group (or does not shrink any more); also the number of rounds.

    A round counts the values below and inside each bracket and sketches the inside at ``_GRID`` + 1
    even fractions; the wanted ranks lie between two of them, taken one step wider (16 times the
    sketch's error).
    """
    from comparo.session import materialize
    rounds = 0
    while True:
        right = stats.where("__n > 0").select(*[F.col(k).alias(f"r{k}") for k in keys], "__n", "__b")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"r{k}"))
        aggs = []
        for i in range(len(qs)):
            lo, hi = F.col("__b")[2 * i], F.col("__b")[2 * i + 1]
            inside = F.when(F.col("v").between(lo, hi), F.col("v"))
            aggs += [F.count(F.when(F.col("v") < lo, 1)).alias(f"below{i}"), F.count(inside).alias(f"in{i}"), F.approx_count_distinct(inside).alias(f"d{i}"),
                     F.percentile_approx(inside, [j / _GRID for j in range(_GRID + 1)], max(accuracy, 16 * _GRID)).alias(f"g{i}")]
        seen = materialize(src.where("v IS NOT NULL").join(right, same).groupBy(*keys, "__n", "__b").agg(*aggs))
        most = seen.agg(F.max(F.greatest(*[F.col(f"d{i}") for i in range(len(qs))], F.lit(0)))).first()[0] or 0
        if most <= max_cells:
            return stats, rounds
        new = []
        for i, q in enumerate(qs):
            pos = (F.col("__n") - 1) * F.lit(float(q))
            at = lambda k, i=i: (k - F.col(f"below{i}")) / F.col(f"in{i}") * _GRID
            j1 = F.greatest(F.floor(at(F.floor(pos) + 1)) - 1, F.lit(0))
            j2 = F.least(F.ceil(at(F.ceil(pos) + 1)) + 1, F.lit(_GRID))
            new += [F.element_at(f"g{i}", (j1 + 1).cast("int")), F.element_at(f"g{i}", (j2 + 1).cast("int"))]
        shrunk = seen.select(*keys, "__n", F.array(*new).alias("__c"), "__b")
        if not shrunk.where(F.col("__c") != F.col("__b")).limit(1).count():
            return stats, rounds
        stats = materialize(shrunk.select(*keys, "__n", F.col("__c").alias("__b")).unionByName(stats.where("__n = 0")))
        rounds += 1


def grouped_quantiles(df: DataFrame, groups, value: str, outs: dict[str, float], accuracy: int = 10_000,
                      max_cells: int = 2_000_000) -> DataFrame:
    """Exact quantiles ``{column: q}`` of ``value`` per group, one path at every size.

    One sketch per group brackets every wanted rank between two values (the sketch's
    rank error is below n / ``accuracy``; the brackets are four times as wide).  Rows
    outside the brackets are only counted, one number per stretch between brackets;
    inside, equal values are counted together.  A running count over those few rows
    finds the two ranks around each quantile, which are interpolated as ``percentile``
    does.  Map-side combining makes a hot group or a column of few values harmless.  Where
    8 / ``accuracy`` of the largest group's rows could be more than ``max_cells``, the brackets are
    narrowed in rounds first (``_narrowed``), so a task's different values per quantile stay below
    that number.  A NULL group is a group; a group without values gets NULL.
    """
    from comparo.session import materialize
    groups = list(groups)
    keys = [f"__q{i}" for i in range(len(groups))] or [_G0]
    src = df.select(*([F.col(g).alias(k) for g, k in zip(groups, keys)] or [F.lit(0).alias(_G0)]),
                    F.col(value).cast("double").alias("v"))
    eps = 4.0 / accuracy
    brackets = [(max(0.0, q - eps), min(1.0, q + eps)) for q in outs.values()]
    # sketches are not bit-stable across re-evaluations: one row per group, written once
    stats = materialize(src.groupBy(*keys).agg(
        F.count("v").alias("__n"), F.percentile_approx("v", [f for b in brackets for f in b], accuracy).alias("__b")))
    if 2 * eps * (stats.agg(F.max("__n")).first()[0] or 0) > max_cells:  # one number of a table with a row per group
        stats, _ = _narrowed(src, stats, keys, list(outs.values()), max_cells, accuracy)
    right = stats.where("__n > 0").select(*[F.col(k).alias(f"r{k}") for k in keys], "__n", "__b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"r{k}"))
    near = F.lit(False)
    for i in range(len(brackets)):
        near = near | F.col("v").between(F.col("__b")[2 * i], F.col("__b")[2 * i + 1])
    stretch = sum((F.when(F.col("v") > F.col("__b")[i], 1).otherwise(0) for i in range(2 * len(brackets))), F.lit(0))
    cells = (src.where("v IS NOT NULL").join(right, same)
             .select(*keys, "__n", "v", F.when(near, F.col("v")).alias("w"), F.when(~near, stretch).alias("s"))
             .groupBy(*keys, "__n", "w", "s").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("r")))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    ranked = cells.withColumn("upto", upto)
    aggs, res = [], []
    for i, (name, q) in enumerate(outs.items()):
        pos = (F.col("__n") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos), F.ceil(pos)
        for x, k in ((f"x{i}", lo + 1), (f"y{i}", hi + 1)):
            aggs.append(F.max(F.when((F.col("upto") - F.col("c") < k) & (k <= F.col("upto")), F.col("w"))).alias(x))
        x, y = F.col(f"x{i}"), F.col(f"y{i}")
        val = F.when(lo == hi, x).otherwise((hi - pos) * x + (pos - lo) * y)
        res.append(F.when(x.isNull() | y.isNull(), F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
                   .otherwise(val).alias(name))
    back = [F.col(k).alias(g) for k, g in zip(keys, groups)]
    found = ranked.groupBy(*keys, "__n").agg(*aggs).select(*back, *res)
    none = stats.where("__n = 0").select(*back, *[F.lit(None).cast("double").alias(n) for n in outs])
    return found.unionByName(none)
