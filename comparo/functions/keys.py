"""Key and location expressions (F1-F3, F5) and repeatable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(key: Column) -> Column:
    """First 15 hex digits of md5 as a non-negative BIGINT.

    DuckDB computes the same number with
    ``('0x' || substr(md5(key), 1, 15))::BIGINT``, so splits and tie-breaks
    built on it are reproducible in the oracle (xxhash64 has no twin there).
    """
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def hash_bucket(key: Column, seed: int, buckets: int) -> Column:
    """Repeatable bucket in [0, buckets) of ``key`` salted with ``seed`` (SP4/SP5/SP7)."""
    salted = F.concat_ws("|", key.cast("string"), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def fsa_regex(postal: Column) -> Column:
    """first letter-digit-letter of a postal code, NULL when absent."""
    return F.nullif(F.regexp_extract(postal, r"^([A-Za-z][0-9][A-Za-z])", 1), F.lit(""))


def fsa_prefix(postal: Column) -> Column:
    """first three characters after trim, upper-cased; NULL stays NULL (§8 Z14)."""
    return F.nullif(F.upper(F.substring(F.trim(postal), 1, 3)), F.lit(""))


def region_code(sa: Column) -> Column:
    """leading capital letters of the sub-area code."""
    return F.nullif(F.regexp_extract(sa, r"^([A-Z]+)", 1), F.lit(""))


def composite_key(*cols: Column) -> Column:
    """``|``-joined key, only where one string key is wanted."""
    return F.concat_ws("|", *cols)
