"""NULL-safe arithmetic.

pandas semantics: NaN and NULL are one thing, clip keeps NULL, division by
zero gives NULL.  Spark's ``greatest``/``least`` skip NULL, so clips guard it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """A / b with 0 → NULL (never ±inf or NaN)."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def clip(x: Column, lo=None, hi=None) -> Column:
    """Pandas ``clip``: NULL stays NULL; bounds may be columns or numbers."""
    y = x
    if lo is not None:
        y = F.greatest(y, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        y = F.least(y, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(x.isNotNull(), y)


def log_or_null(x: Column) -> Column:
    """log for positive x, NULL otherwise (keeps NaN out of aggregates)."""
    return F.when(x > 0, F.log(x))
