"""Leakage audit and acceptance checks (L1-L9) and diagnostics helpers (X1-X15, AG15/AG16, M9/M10)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, cols, keep=(), name: str = "column", value: str = "value") -> DataFrame:
    """(column, value) long form in one projection (``stack``), no self-union."""
    return df.unpivot(list(keep), list(cols), name, value)


def leakage_audit(df: DataFrame, target: str, cols, near: float = 5000.0, min_share: float = 0.05,
                  min_rows: int = 100) -> DataFrame:
    """L1/L2: every column against the target in ONE pass.

    Unpivot to (column, value, target) and aggregate per column: joint count,
    correlation, median |value - target|, share within ``near``.  Columns with
    fewer than max(min_rows, min_share * n) joint rows are marked skipped.
    Flag = corr >= 0.995 and (median |diff| <= 10,000 or share >= 50%).
    """
    n = df.count()
    need = max(min_rows, int(min_share * n))
    long = unpivot(df.select(F.col(target).cast("double").alias("__t"),
                             *[F.col(c).cast("double").alias(c) for c in cols]), cols, ["__t"])
    both = long.where(F.col("value").isNotNull() & F.col("__t").isNotNull())
    d = F.abs(F.col("value") - F.col("__t"))
    res = both.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_joint"), F.corr("value", "__t").alias("corr"),
        F.avg((d <= near).cast("double")).alias("share_near"))
    # each audited column spans the whole table: exact median with bounded tasks
    from comparo.operators.metrics import with_median
    res = with_median(res, both, ["column"], d, "median_abs_diff")
    # a column without any joint row is reported too
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    res = names.join(res, "column", "left").withColumn("n_joint", F.coalesce("n_joint", F.lit(0).cast("long")))
    skipped = F.col("n_joint") < need
    flag = (~skipped) & (F.col("corr") >= 0.995) & ((F.col("median_abs_diff") <= 10000) | (F.col("share_near") >= 0.5))
    return res.withColumn("skipped", skipped).withColumn("leak", F.coalesce(flag, F.lit(False)))


def corr_pairs(df: DataFrame, cols) -> DataFrame:
    """AG16/X1: correlation of every pair in one aggregate, as rows (a, b, corr)."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr")) for a, b in pairs
    ])).alias("p")).select("p.*")


def two_predictor_r2(df: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """R² of y on x1, on (x1, x2) (closed form from pairwise correlations), gain, collinearity."""
    r = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()).agg(
        F.corr(y, x1).alias("r1"), F.corr(y, x2).alias("r2"), F.corr(x1, x2).alias("r12"),
        F.regr_slope(y, x1).alias("slope_1"), F.regr_intercept(y, x1).alias("intercept_1"))
    r2_1 = F.col("r1") * F.col("r1")
    r2_12 = ((F.col("r1") ** 2 + F.col("r2") ** 2 - 2 * F.col("r1") * F.col("r2") * F.col("r12"))
             / (1 - F.col("r12") ** 2))
    return r.select(r2_1.alias("r2_x1"), r2_12.alias("r2_x1_x2"), (r2_12 - r2_1).alias("r2_gain"),
                    ((r2_12 - r2_1) > 0.01).alias("adds_signal"),
                    (F.col("r12") * F.col("r12") > 0.7).alias("collinear"), "slope_1", "intercept_1")


class CoverageError(ValueError):
    """Neither area column gives enough prices per area."""


def ppsf_gate(df: DataFrame, price: str, area: str, fallback: str | None = None, least: float = 0.95, out: str = "ppsf") -> tuple[DataFrame, str, float]:
    """L6 (A2): price per area from ``area``; below ``least`` coverage from ``fallback``; stops if that is too low as well.

    Returns (frame with ``out``, the column used, its coverage); one aggregate for both columns.
    """
    cols = [area] + [fallback] * (fallback is not None and fallback != area)
    per = {c: F.col(price) / F.nullif(F.col(c), F.lit(0)) for c in cols}
    r = df.agg(*[F.avg(per[c].isNotNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    got = [r[f"c{i}"] or 0.0 for i in range(len(cols))]
    for c, g in zip(cols, got):
        if g >= least:
            return df.withColumn(out, per[c]), c, g
    raise CoverageError(f"coverage {dict(zip(cols, got))} is below {least}")
