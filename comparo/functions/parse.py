"""Text → typed values.

Spark 4 runs with ANSI on, so a bare ``cast`` of bad text raises; all parsers
here return NULL for anything that is not a plain decimal number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the shape a cleaned number must have to be accepted.  It rejects
# 'nan', 'inf', '1d', '1_0', '(5)', '5%' which try_cast would turn into numbers.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _guarded_double(s: Column) -> Column:
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def parse_money(c: Column, strip_space: bool = True, trim: bool = False) -> Column:
    """P1 (strip ``$ , space``), P2 (``strip_space=False``), P3 (``trim=True``)."""
    s = c.cast("string")
    if trim:
        s = F.trim(s)
    s = F.regexp_replace(s, "[$, ]" if strip_space else "[$,]", "")
    return _guarded_double(s)


# Accepted date layouts, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "M/d/yyyy", "yyyy/MM/dd")


def parse_date(c: Column, formats=DATE_FORMATS) -> Column:
    """First layout that parses; NULL otherwise."""
    s = F.trim(c.cast("string"))
    return F.coalesce(*[F.try_to_date(s, f) if hasattr(F, "try_to_date")
                        else F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in formats])


def money_text(c: Column) -> Column:
    """Render a number as ``$1,234.50`` (used to exercise P1 on the test tables)."""
    return F.concat(F.lit("$"), F.format_number(c, 2))
