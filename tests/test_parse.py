"""FX2: money / number text (P1-P3) and dates."""

import datetime as dt

from pyspark.sql import functions as F

from comparo.functions.keys import fsa_prefix, fsa_regex, region_code
from comparo.functions.parse import parse_date, parse_money


def test_money_parse_fixture(spark):
    cases = [("$1,234.50", 1234.5), ("1 200", 1200.0), ("(5)", None), ("5%", None), ("", None),
             ("nan", None), ("inf", None), ("1e3", 1000.0), ("1_0", None), ("1d", None), (None, None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "s string")
    got = [r[0] for r in df.select(parse_money(F.col("s"))).collect()]
    assert got == [e for _, e in cases]


def test_money_parse_variants(spark):
    df = spark.createDataFrame([(" $1,200 ",)], "s string")
    r = df.select(parse_money(F.col("s"), strip_space=False).alias("p2"),
                  parse_money(F.col("s"), strip_space=False, trim=True).alias("p3")).first()
    assert r["p2"] is None and r["p3"] == 1200.0


def test_date_parse(spark):
    df = spark.createDataFrame([("2025-05-01",), ("5/1/2025",), ("garbage",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_date(F.col("s"))).collect()]
    assert got == [dt.date(2025, 5, 1), dt.date(2025, 5, 1), None, None]


def test_location_keys(spark):
    df = spark.createDataFrame([("v2p 1a1", "ABCD12"), (None, None), ("123", "x1")], "pc string, sa string")
    got = df.select(fsa_regex(F.col("pc")), fsa_prefix(F.col("pc")), region_code(F.col("sa"))).collect()
    assert [tuple(r) for r in got] == [("v2p", "V2P", "ABCD"), (None, None, None), (None, "123", None)]
