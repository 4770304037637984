"""K3: weighted isotonic fit in ranges against a plain pool-adjacent-violators and the min-max formula."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparo.operators import isotonic as Iso


def plain(points):
    """Min-max formula over distinct x: {x: value}."""
    xs = sorted({x for x, _, _ in points})
    w = np.array([sum(p[2] for p in points if p[0] == x) for x in xs])
    s = np.array([sum(p[1] * p[2] for p in points if p[0] == x) for x in xs])
    cw, cs = np.r_[0, np.cumsum(w)], np.r_[0, np.cumsum(s)]
    return {x: max(min((cs[b + 1] - cs[a]) / (cw[b + 1] - cw[a]) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "flat"])
@pytest.mark.parametrize("per_range", [500_000, 9])
def test_fit_against_min_max(spark, kind, per_range):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 60, 150).astype(float)
    y = {"noise": x / 10 + rng.normal(size=150), "rising": x * 2, "falling": -x, "flat": np.ones(150)}[kind]
    pts = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, rng.integers(1, 4, 150))]
    rows = pts + [(None, 1.0, 1.0), (3.0, None, 1.0), (3.0, 1e9, 0.0)]
    blocks = Iso.fit(spark.createDataFrame(rows, "x double, y double, w double").repartition(3), "x", "y", "w", points_per_range=per_range)
    want = plain(pts)
    got = {}
    for r in blocks.collect():
        got |= {a: r["value"] for a in want if r["x0"] <= a <= r["x1"]}
    assert got == pytest.approx(want)
    ask = [(None,), (-5.0,), (100.0,)] + [(float(v),) for v in rng.uniform(-2, 62, 40)] + [(a,) for a in want]
    k = sorted(want)
    t = Iso.calibrate(spark.createDataFrame(ask, "x double").withColumn("row", F.lit("clash")).repartition(3), blocks, "x", points_per_range=per_range).collect()
    assert len(t) == len(ask)
    for r in t:
        assert r["calibrated"] is None if r["x"] is None else r["calibrated"] == pytest.approx(np.interp(r["x"], k, [want[a] for a in k]))


def test_without_points(spark):
    none = spark.createDataFrame([], "x double, y double")
    blocks = Iso.fit(none, "x", "y")
    assert blocks.count() == 0
    assert [r["calibrated"] for r in Iso.calibrate(spark.createDataFrame([(1.0,)], "x double"), blocks, "x").collect()] == [None]
    assert Iso.calibrate(none, blocks, "x").count() == 0


def test_plan_does_not_hold_the_range_bounds(spark):
    """400 ranges: their bounds come from a one-row table, so the plans stay small on the driver."""
    rows = spark.range(800).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    blocks = Iso.fit(rows.where("x % 10 = 0"), "x", "y")
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000000")
    try:
        t = Iso.calibrate(rows, blocks, "x", points_per_range=2)
        assert len(t._jdf.queryExecution().analyzed().toString()) < 30_000
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)


def test_many_small_ranges_share_tasks(spark, monkeypatch):
    """ranges of a few points do not become as many bounds on the driver; the fit and the calibration stay exact."""
    assert Iso._tasks(43_000_000, 64) == 1024 and Iso._tasks(10 ** 12, 500_000) == 2_000_000 and Iso._tasks(7, 500_000) == Iso._tasks(0, 9) == 1
    monkeypatch.setattr(Iso, "_MANY", 4)
    monkeypatch.setattr(Iso, "_SHARED", 40)
    rng = np.random.default_rng(6)
    pts = [(float(a), float(a // 9 + rng.normal(scale=4)), float(rng.integers(1, 4))) for a in range(200)]
    df = spark.createDataFrame(pts, "x double, y double, w double").repartition(3)
    blocks = Iso.fit(df, "x", "y", "w", points_per_range=2)
    want = plain(pts)
    got = {}
    for r in blocks.collect():
        got |= {a: r["value"] for a in want if r["x0"] <= a <= r["x1"]}
    assert got == pytest.approx(want)
    t = Iso.calibrate(df.withColumn("x", F.col("x") + 0.5), blocks, "x", points_per_range=2).collect()
    k = sorted(want)
    assert len(t) == 200 and all(r["calibrated"] == pytest.approx(np.interp(r["x"], k, [want[a] for a in k])) for r in t)
