"""Derived features (D2-D14, D16-D20, P14-P16, AG17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comparo.functions.numeric import clip, safe_div


def age_at_list(year: Column, yr_blt: Column, age: Column | None = None, default: float = 20.0) -> Column:
    """Year - clip(yr_blt, 1900, year); else ``age``; floor 0; default 20."""
    from_built = year - clip(yr_blt, F.lit(1900), year)
    raw = F.when(yr_blt.isNotNull(), from_built)
    if age is not None:
        raw = F.when(yr_blt.isNotNull(), from_built).otherwise(age)
    return F.coalesce(clip(raw.cast("double"), 0.0), F.lit(default))


def ratio_columns(df: DataFrame) -> DataFrame:
    """D3-D6, D9 on the sales roles."""
    baths_equiv = F.col("full_baths") + 0.5 * F.col("half_baths")
    return df.select(
        "*",
        safe_div(F.col("bedrooms"), F.col("area")).alias("rooms_per_sqft"),
        baths_equiv.alias("baths_equiv"),
        (baths_equiv / F.greatest(F.col("bedrooms"), F.lit(1))).alias("baths_per_br"),
        safe_div(F.col("maint_fee"), F.col("area")).alias("maint_per_sqft"),
        (F.col("area") / F.greatest(F.col("bedrooms"), F.lit(1))).alias("sqft_per_br"),
    )


def missing_flags(df: DataFrame, cols) -> DataFrame:
    """D7 ``<c>_isna`` and D8 presence flags ``has_<c>``."""
    out = []
    for c in cols:
        out += [F.col(c).isNull().cast("int").alias(f"{c}_isna"),
                F.col(c).isNotNull().cast("int").alias(f"has_{c}")]
    return df.select("*", *out)


def quantile_limits(df: DataFrame, cols, lo: float = 0.005, hi: float = 0.995) -> dict:
    """D14 fit: exact linear-interpolated quantiles, one aggregate for all columns.

    Returns {col: (lo, hi)} — two numbers per column reach the driver.
    Columns are cast to double by the unpivot.
    """
    from comparo.operators.baseline import grouped_quantiles
    long = df.unpivot([], list(cols), "column", "value").where(F.col("value").isNotNull())
    got = {r[0]: (r[1], r[2]) for r in grouped_quantiles(long, ["column"], "value", {"lo": lo, "hi": hi}).collect()}  # one row per column
    return {c: got.get(c, (None, None)) for c in cols}


def median_fill(df: DataFrame, cols, fit_mask: Column) -> DataFrame:
    """NULLs of each column become its exact median over the rows of ``fit_mask``
    (NULL where those rows hold no value); one row per column reaches the driver."""
    from comparo.operators.baseline import grouped_quantiles
    long = df.where(fit_mask).select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "value")
    med = {r[0]: r[1] for r in grouped_quantiles(long, ["column"], "value", {"m": 0.5}).collect()}
    return df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(med.get(c)).cast("double")).alias(f"{c}_filled") for c in cols])


def winsorize(df: DataFrame, limits: dict, suffix: str = "_w") -> DataFrame:
    """D14 apply: clip each column into its fitted limits (NULL stays NULL)."""
    return df.select("*", *[clip(F.col(c), lo, hi).alias(f"{c}{suffix}") for c, (lo, hi) in limits.items()])


def equal_width_bin(x: Column, lo: float, hi: float, bins: int = 5) -> Column:
    """AG17: pandas ``cut(x, bins)`` with right-closed bins over [lo, hi]."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(1))
    return F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((x - F.lit(lo)) / F.lit(hi - lo) * bins))).cast("int")


def poly_features(df: DataFrame, age: str = "age_at_list", area: str = "area", code: str = "loc_code") -> DataFrame:
    """Squares, log1p, location-code interactions."""
    return df.select("*",
                     (F.col(age) * F.col(age)).alias("age_squared"),
                     F.log1p(F.col(age)).alias("age_log"),
                     (F.col(area) * F.col(area)).alias("sqft_squared"),
                     F.log1p(F.col(area)).alias("sqft_log"),
                     (F.col(code) * F.col(age)).alias("location_age"),
                     (F.col(code) * F.col(area)).alias("location_size"))


def per_bedroom(x: Column, bedrooms: Column) -> Column:
    """X / max(bedrooms, 1), missing bedrooms as 1 (parking, baths, area)."""
    return x / F.greatest(F.coalesce(bedrooms, F.lit(1)), F.lit(1))


def list_date_columns(d: Column, month: int = 6, quarter: int = 2, year: int = 2020) -> list[Column]:
    """Month, quarter and year of listing, constants where the date is missing."""
    return [F.coalesce(F.month(d), F.lit(month)).alias("list_month"), F.coalesce(F.quarter(d), F.lit(quarter)).alias("list_quarter"),
            F.coalesce(F.year(d), F.lit(year)).alias("list_year")]
