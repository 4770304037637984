"""Error metrics (Q1-Q15, AG14, AG19) as aggregate expressions.

Every metric is an aggregate expression, so a whole report is one
``groupBy(...).agg(...)`` — one pass, partial aggregation on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(y: str, p: str, within: float = 0.10, tol: float = 1e-9) -> list[Column]:
    """MAE, WAPE, MAPE, RMSE, R², median |e|, share within ``within`` (inclusive)."""
    yc, pc = F.col(y), F.col(p)
    ok = yc.isNotNull() & pc.isNotNull()
    e = F.when(ok, yc - pc)
    ae = F.abs(e)
    n = F.count(e)
    sse = F.sum(e * e)
    return [
        n.alias("n"),
        F.avg(ae).alias("mae"),
        (F.sum(ae) / F.sum(F.when(ok, F.abs(yc)))).alias("wape"),
        F.avg(F.when(ok, ae / F.abs(yc))).alias("mape"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - sse / F.nullif(F.var_pop(F.when(ok, yc)) * n, F.lit(0.0))).alias("r2"),
        F.avg(F.when(ok, (ae / F.abs(yc) <= within + tol).cast("double"))).alias("within_10pct"),
    ]


def with_median(agg: DataFrame, src: DataFrame, by, value: Column | str, out: str) -> DataFrame:
    """Join an exact per-group median (bounded tasks, ``baseline.grouped_median``) to a report."""
    from comparo.operators.baseline import grouped_median
    by = list(by or [])
    v = F.col(value) if isinstance(value, str) else value
    keys = [f"__k{i}" for i in range(len(by))]  # text keys, so that a NULL group keeps its median
    safe = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))).alias(k)
            for c, k in zip(by, keys)]
    m = grouped_median(src.select(*safe, v.alias("__mv")), keys, "__mv", out)
    if not by:  # one number: attach it as a literal
        return agg.withColumn(out, F.lit(m.first()[0]).cast("double"))
    return agg.select("*", *safe).join(m, keys, "left").drop(*keys)


def metrics(df: DataFrame, y: str, p: str, by=None) -> DataFrame:
    """Q1-Q8 (optionally per group, e.g. per split: Q9/Q15); the median |e| is exact."""
    cols = metric_columns(y, p)
    ok = F.col(y).isNotNull() & F.col(p).isNotNull()
    agg = df.groupBy(*(by or [])).agg(*cols)
    return with_median(agg, df, by, F.when(ok, F.abs(F.col(y) - F.col(p))), "median_ae")


def error_by_group(df: DataFrame, y: str, p: str, group: str, k: int = 10, min_n: int = 1) -> DataFrame:
    """Q12: mean absolute % error and count per group, worst ``k`` (top-k is the feature)."""
    ape = F.abs(F.col(y) - F.col(p)) / F.abs(F.col(y))
    return (df.where(F.col(p).isNotNull()).groupBy(group)
              .agg(F.avg(ape).alias("mape"), F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_n)
              .orderBy(F.desc("mape"), F.asc(group)).limit(k))


def against_baseline(df: DataFrame, y: str, base: str, model: str, log_y: str, log_p: str, by: str) -> DataFrame:
    """Q9 (baseline and model side by side per group, improvement in percent) and Q4 (R² on the log
    target, NULL if it does not vary), one pass."""
    from comparo.plans.common import rnd
    yc, n = F.col(y), F.count(F.lit(1))
    ae = {c: F.abs(yc - F.col(c)) for c in (base, model)}
    r2 = lambda c: 1 - F.sum((yc - F.col(c)) ** 2) / F.nullif(F.var_pop(y) * n, F.lit(0.0))
    out = {"mae_baseline": (F.avg(ae[base]), 4), "mae_model": (F.avg(ae[model]), 4), "wape_baseline": (F.sum(ae[base]) / F.sum(F.abs(yc)), 6),
           "wape_model": (F.sum(ae[model]) / F.sum(F.abs(yc)), 6), "r2_baseline": (r2(base), 6), "r2_model": (r2(model), 6),
           "within_10pct": (100 * F.avg((ae[model] / yc <= 0.10 + 1e-9).cast("double")), 6),
           "improvement_pct": (100 * (F.avg(ae[base]) - F.avg(ae[model])) / F.avg(ae[base]), 6),
           "r2_log_premium": (1 - F.sum((F.col(log_y) - F.col(log_p)) ** 2) / F.nullif(F.var_pop(log_y) * n, F.lit(0.0)), 6)}
    return df.groupBy(by).agg(n.alias("n"), *[rnd(c, d).alias(k) for k, (c, d) in out.items()])
