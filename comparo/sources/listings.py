"""Raw listing CSV (S1-S3, S13, P1-P8): every column read as text, then ONE typed
projection driven by the column-role catalogue (optional columns resolved at
plan time against the header)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comparo.functions.keys import fsa_prefix, region_code
from comparo.functions.parse import parse_date, parse_money

# The reference's column roles (names as in its CSV export).
TARGETS = ("Sold Price", "Price")
DATE_COLUMNS = ("List Date", "Sold Date", "Confirm Sold Date", "Expiry Date")
NUMERIC_COLUMNS = (
    "Price", "Sold Price", "List Price", "TotFlArea", "MaintFee", "Yr Blt", "Age", "Full Baths", "Half Baths",
    "Tot BR", "Tot Baths", "No. Floor Levels", "Storeys in Building", "Fireplaces", "Floor Area Fin - Total",
    "Floor Area Fin - Main Flr", "Floor Area Fin - Abv Main", "Floor Area Fin - BLW Main",
    "Floor Area Fin - Basement", "Floor Area - Unfinished", "Tot Units in Strata Plan", "Units in Development",
    "# of Kitchens", "# of Pets", "Bds In Bsmt", "Bds Not In Bsmt", "TotalPrkng", "# or % of Rentals Allowed",
    "Bath Ensuite # Of Pcs", "Land Lease Expiry Year", "DOM", "Cumulative DOM", "Price Per SQFT",
    "Sold Price per SqFt", "SP/LP Ratio", "SP/OLP Ratio",
)
# Leaky / after-listing columns: never features.
LEAKY = ("Sold Price", "Sold Price per SqFt", "SP/LP Ratio", "SP/OLP Ratio", "Sold Date", "Confirm Sold Date",
         "DOM", "Cumulative DOM", "Expiry Date", "List Price", "Price", "Price Per SQFT")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV, every column as text (no inference pass over the file)."""
    header = spark.read.option("header", True).csv(path).schema.fieldNames()
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    # a file whose header differs is an error, never columns by position
    return spark.read.option("header", True).option("enforceSchema", False).option("escape", '"').schema(schema).csv(path)


def typed_listings(raw: DataFrame) -> DataFrame:
    """One projection — numbers and money parsed, dates parsed,
    ``target`` = Sold Price else Price, FSA and Region keys; unknown columns kept as text."""
    cols = raw.columns
    out = []
    for c in cols:
        if c in NUMERIC_COLUMNS:
            out.append(parse_money(F.col(f"`{c}`")).alias(c))
        elif c in DATE_COLUMNS:
            out.append(parse_date(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    target = next((t for t in TARGETS if t in cols), None)
    if target:
        out.append(parse_money(F.col(f"`{target}`")).alias("target"))
    if "Postal Code" in cols:
        out.append(fsa_prefix(F.col("`Postal Code`")).alias("FSA"))
    if "S/A" in cols:
        out.append(region_code(F.col("`S/A`")).alias("Region"))
    return raw.select(*out)


def feature_candidates(df: DataFrame) -> list[str]:
    """P23/P25/L5 (A1): numeric columns that are not leaky — plan-time schema inspection."""
    num = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.IntegerType, T.LongType))}
    bad = set(LEAKY) | {"target"}
    return [c for c in df.columns if c in num and c not in bad]
