"""Encoders (E1-E12).

All target encodings are leak-free by construction and written as
aggregates + joins over small (category, fold/block) tables; Spark ML's
``TargetEncoder`` is not used because it has no folds and no time order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comparo.operators.ordering import exclusive_running


# ---------------------------------------------------------------------------
# Label codes without collecting the labels
# ---------------------------------------------------------------------------

def label_codes(df: DataFrame, col: str, out: str | None = None, unknown: str = "Unknown",
                partitions: int | None = None) -> DataFrame:
    """Alphabetical 0-based code of ``col`` (NULL → ``unknown``).

    Distinct values are range-partitioned, numbered inside each partition and
    shifted by the sizes of the partitions before them (a table with one row
    per partition).  No label list reaches the driver.
    """
    out = out or f"{col}_code"
    v = F.coalesce(F.col(col).cast("string"), F.lit(unknown))
    vals = df.select(v.alias("__v")).distinct()
    n_parts = partitions or df.sparkSession.sparkContext.defaultParallelism
    ranged = (vals.repartitionByRange(n_parts, "__v")
                  .withColumn("__pid", F.spark_partition_id()))
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__sz"))
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select("__pid", F.coalesce(F.sum("__sz").over(w_off), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy("__pid").orderBy("__v")
    codes = (ranged.withColumn("__rn", F.row_number().over(w_in))
                   .join(F.broadcast(offs), "__pid")  # one row per partition
                   .select("__v", (F.col("__off") + F.col("__rn") - 1).cast("int").alias(out)))
    return df.withColumn("__v", v).join(codes, "__v", "left").drop("__v")


#: Values of a vocabulary up to which it is broadcast.
SMALL_VOCABULARY = 100_000


# ---------------------------------------------------------------------------
# One-hot vocabularies fitted on train
# ---------------------------------------------------------------------------

def top_values(train: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent train values (ties broken by value): at most k rows."""
    return (train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
                 .orderBy(F.desc("n"), F.asc(col)).limit(k).select(col))


def frequent_values(train: DataFrame, col: str, min_count: int = 30) -> DataFrame:
    """Train values with at least ``min_count`` rows (size grows with the data: joined, not broadcast)."""
    return (train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
                 .where(F.col("n") >= min_count).select(col))


def _counted(t: DataFrame) -> DataFrame:
    """``t`` written and counted, and broadcast if it is small: its estimated size is that of the rows it was made of, and an
    adaptive join has shuffled all rows when it learns the real one."""
    from comparo.session import materialize
    t = materialize(t)
    return F.broadcast(t) if t.count() <= SMALL_VOCABULARY else t


def map_to_vocab(df: DataFrame, col: str, vocab: DataFrame, out: str, other: str | None = None,
                 small: bool = False) -> DataFrame:
    """Keep the value if it is in ``vocab`` else ``other`` (NULL = all-zero one-hot).

    The vocabulary is written and counted unless it is ``small`` by its rule: one of few values is broadcast, as a
    shuffle would put all rows of a value into one task."""
    v = vocab.select(F.col(col).alias("__kv"), F.lit(True).alias("__in"))
    v = F.broadcast(v) if small else _counted(v)
    res = df.join(v, df[col] == v["__kv"], "left")
    keep = F.when(F.col("__in"), F.col(col))
    if other is not None:
        keep = F.coalesce(keep, F.lit(other))
    return res.withColumn(out, keep).drop("__kv", "__in")


def vocabulary(train: DataFrame, col: str, *, top: int | None = None, min_count: int | None = None,
               na: str | None = None, other: str | None = None) -> DataFrame:
    """(value, idx) fitted on train rows: every value (E2), the ``top`` most frequent (E3) or those
    with ``min_count`` rows (E4), numbered from 0 in the order of the values.  NULL counts as ``na``
    if that is given; ``other`` (E5) is one more value at the end.  The table is joined, never collected."""
    v = F.coalesce(F.col(col).cast("string"), F.lit(na)) if na is not None else F.col(col).cast("string")
    t = train.select(v.alias("value"))
    if top is not None:
        t = top_values(t, "value", top)
    elif min_count is not None:
        t = frequent_values(t, "value", min_count)
    else:
        t = t.where(F.col("value").isNotNull()).distinct()
    t = label_codes(t, "value", out="idx").select("value", "idx")
    return t if other is None else t.unionByName(t.agg(F.lit(other).alias("value"), F.count(F.lit(1)).cast("int").alias("idx")))


def one_hot(df: DataFrame, specs, out: str = "onehot") -> DataFrame:
    """One sparse row for several categorical columns.

    ``specs``: [(column, vocabulary, {"na": ..., "other": ...})].  Adds ``out``: struct(size, indices, values),
    a vector of fixed width (the vocabularies side by side, so every split is aligned to train).  A
    value that is not in its vocabulary is ``other`` if that is given, else leaves its block empty.
    Widths are one count per vocabulary; vocabularies are joined on the value.
    """
    from comparo.session import materialize
    offset, at, keep = 0, [], df.columns
    for i, (col, vocab, how) in enumerate(specs):
        vocab = materialize(vocab)
        width = vocab.count()
        v = F.col(col).cast("string")
        if how.get("na") is not None:
            v = F.coalesce(v, F.lit(how["na"]))
        df = df.withColumn(f"__v{i}", v).join(vocab.select(F.col("value").alias(f"__v{i}"), F.col("idx").alias(f"__i{i}")), f"__v{i}", "left").drop(f"__v{i}")
        idx = F.col(f"__i{i}")
        if how.get("other") is not None:
            idx = F.coalesce(idx, F.lit(width - 1))
        at.append(idx + F.lit(offset))
        offset += width
    hot = F.filter(F.array(*at), lambda x: x.isNotNull())
    return df.select(*keep, F.struct(F.lit(offset).alias("size"), hot.alias("indices"), F.transform(hot, lambda x: F.lit(1.0)).alias("values")).alias(out))


def to_vector(df: DataFrame, col: str = "onehot", out: str = "onehot_vector") -> DataFrame:
    """The struct of ``one_hot`` as a Spark ML sparse vector (a reinterpreted struct, no Python rows)."""
    from pyspark.ml.functions import array_to_vector
    c = F.col(col)
    dense = F.transform(F.sequence(F.lit(0), c["size"] - 1), lambda i: F.when(F.array_contains(c["indices"], i), 1.0).otherwise(0.0))
    return df.withColumn(out, array_to_vector(dense))


# ---------------------------------------------------------------------------
# Ordered (expanding) target encoding
# ---------------------------------------------------------------------------

def ordered_te(df: DataFrame, cat: str, y: str, is_train: Column, out: str | None = None,
               day: str = "day", seq: str = "seq") -> DataFrame:
    """Train rows get the mean of earlier train rows of the category (global
    train mean when none); other rows get the train's last value per category."""
    out = out or f"{cat}_te"
    is_train = F.coalesce(is_train, F.lit(False))
    train = df.where(is_train)
    gmean, n = train.agg(F.avg(y), F.count(F.lit(1))).first()
    t = exclusive_running(train, [cat], [y], day=day, seq=seq, prefix="__run_", rows=n)
    t = (t.withColumn(out, F.coalesce(F.col(f"__run_{y}") / F.nullif(F.col("__run_n"), F.lit(0)), F.lit(gmean)))
          .drop("__run_n", f"__run_{y}"))
    last = t.groupBy(cat).agg(F.max_by(out, F.struct(day, seq)).alias("__last"))
    # the other rows take the last train value of their category (one row per category)
    rest = (df.where(~is_train).join(last, cat, "left")
              .withColumn(out, F.coalesce("__last", F.lit(gmean))).drop("__last"))
    return t.unionByName(rest)


# ---------------------------------------------------------------------------
# K-fold encodings by subtraction
# ---------------------------------------------------------------------------

def kfold_te(df: DataFrame, cat: str, y: str, fold: str, is_train: Column, out: str | None = None,
             shrink_k: float | None = None) -> DataFrame:
    """E7 (``shrink_k=None``) and E8 (shrinkage n/(n+k) to the train mean).

    Out-of-fold statistics = category totals minus the fold's own: one
    aggregate per (category, fold), joins on small tables.
    E7: unseen category in the fold-train → mean of the fold-train rows.
    E8: unseen category stays NULL in train (reference behaviour), test rows
        use the full-train smoothing with the train mean as default.
    """
    out = out or f"{cat}_te"
    is_train = F.coalesce(is_train, F.lit(False))
    train = df.where(is_train)
    per = _counted(train.groupBy(cat, fold).agg(F.sum(y).alias("__s_cf"), F.count(y).alias("__n_cf")))
    tot_c = _counted(per.groupBy(cat).agg(F.sum("__s_cf").alias("__s_c"), F.sum("__n_cf").alias("__n_c")))
    per_f = per.groupBy(fold).agg(F.sum("__s_cf").alias("__s_f"), F.sum("__n_cf").alias("__n_f"))
    g = train.agg(F.sum(y).alias("s"), F.count(y).alias("n")).first()
    S, N = float(g["s"] or 0.0), int(g["n"])
    gmean = S / N if N else None
    oof = (train.join(tot_c, cat, "left").join(per, [cat, fold], "left")
                .join(F.broadcast(per_f), fold, "left"))  # one row per fold
    n_oof = F.col("__n_c") - F.coalesce(F.col("__n_cf"), F.lit(0))
    s_oof = F.col("__s_c") - F.coalesce(F.col("__s_cf"), F.lit(0.0))
    mean_oof = F.when(n_oof > 0, s_oof / n_oof)
    if shrink_k is None:
        fold_mean = (F.lit(S) - F.col("__s_f")) / (F.lit(N) - F.col("__n_f"))
        te_tr = F.coalesce(mean_oof, fold_mean)
    else:
        a = n_oof / (n_oof + F.lit(float(shrink_k)))
        te_tr = F.when(n_oof > 0, a * mean_oof + (1 - a) * F.lit(gmean))
    helpers = ["__s_cf", "__n_cf", "__s_c", "__n_c", "__s_f", "__n_f"]
    tr = oof.withColumn(out, te_tr).drop(*helpers)
    full_mean = F.col("__s_c") / F.col("__n_c")
    if shrink_k is None:
        te_full = F.coalesce(full_mean, F.lit(gmean))
    else:
        a = F.col("__n_c") / (F.col("__n_c") + F.lit(float(shrink_k)))
        te_full = F.coalesce(a * full_mean + (1 - a) * F.lit(gmean), F.lit(gmean))
    rest = df.where(~is_train).join(tot_c, cat, "left").withColumn(out, te_full).drop("__s_c", "__n_c")
    return tr.unionByName(rest)


# ---------------------------------------------------------------------------
# Time-series (expanding block) encoding with smoothing m
# ---------------------------------------------------------------------------

def time_series_te(df: DataFrame, cat: str, y: str, block: str, is_train: Column, m: float = 50.0,
                   out: str | None = None) -> DataFrame:
    """Block j >= 1 of train is encoded from blocks < j only:
    (cnt*mean + m*prior)/(cnt + m) with prior = mean of blocks < j (§8 Z7 fix);
    an unseen category gets the prior; block 0 stays NULL.  Val/test: the same
    formula over all train with prior = train mean."""
    out = out or f"{cat}_te"
    is_train = F.coalesce(is_train, F.lit(False))
    train = df.where(is_train)
    per = train.groupBy(cat, block).agg(F.sum(y).alias("__s_cb"), F.count(y).alias("__n_cb"))
    w_c = Window.partitionBy(cat).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    per_b = per.groupBy(block).agg(F.sum("__s_cb").alias("__s_b"), F.sum("__n_cb").alias("__n_b"))
    w_b = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    prior = per_b.select(block, (F.sum("__s_b").over(w_b) / F.sum("__n_b").over(w_b)).alias("__prior"))
    # every train row's (category, block) has an entry in ``per``: sums over earlier blocks
    cum = per.select(cat, block, F.sum("__s_cb").over(w_c).alias("__s_prev"),
                     F.sum("__n_cb").over(w_c).alias("__n_prev"))
    j = train.join(cum, [cat, block], "left").join(F.broadcast(prior), block, "left")
    te = F.when(F.col(block) == 0, F.lit(None).cast("double")).otherwise(
        F.coalesce((F.col("__s_prev") + F.lit(m) * F.col("__prior")) / (F.col("__n_prev") + F.lit(m)),
                   F.col("__prior")))
    tr = j.withColumn(out, te).drop("__s_prev", "__n_prev", "__prior")
    g = train.agg(F.avg(y)).first()[0]
    full = per.groupBy(cat).agg(F.sum("__s_cb").alias("__s_c"), F.sum("__n_cb").alias("__n_c"))
    rest = (df.where(~is_train).join(full, cat, "left")
              .withColumn(out, F.coalesce((F.col("__s_c") + F.lit(m * g)) / (F.col("__n_c") + F.lit(m)), F.lit(g)))
              .drop("__s_c", "__n_c"))
    return tr.unionByName(rest)


# ---------------------------------------------------------------------------
# Standardization fitted on train
# ---------------------------------------------------------------------------

def standardize(df: DataFrame, cols, is_train: Column, population: bool = True, suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd with train statistics (population sd as scikit-learn's scaler)."""
    sd = F.stddev_pop if population else F.stddev_samp
    st = df.where(is_train).agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                                *[sd(c).alias(f"s_{c}") for c in cols]).first()
    return df.select("*", *[((F.col(c) - F.lit(st[f"m_{c}"])) / F.lit(st[f"s_{c}"])).alias(f"{c}{suffix}")
                            for c in cols])
