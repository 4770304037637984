"""Causal baseline: FX3/FX4 fixtures, method agreement, brute force, causality."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from comparo.operators import baseline as B
from tests.conftest import SF001, SF01


def _fx3(spark):
    d0 = dt.date(1970, 1, 1)
    data = [("a", dt.date(2020, 1, 1), 1.0), ("a", dt.date(2020, 1, 5), 2.0), ("a", dt.date(2020, 1, 5), 3.0),
            ("a", dt.date(2020, 1, 5), 10.0), ("a", dt.date(2020, 4, 4), 20.0), ("a", dt.date(2020, 4, 4), 30.0)]
    df = spark.createDataFrame([(g, d, (d - d0).days, v) for g, d, v in data], "g string, d date, day int, v double")
    return df


@pytest.mark.parametrize("method,splits", [("sql", None), ("chunked", None), ("chunked", 1), ("chunked", 3)])
def test_fx3_same_day_ties(spark, method, splits):
    t = B.frame_median_by_day(_fx3(spark), ["g"], "v", 90, 1, method=method, value_splits=splits)
    got = sorted((r["day"], r["med"], r["n"]) for r in t.collect())
    assert [(m, n) for _, m, n in got] == [(None, 0), (1.0, 1), (3.0, 3)]


def test_fx4_shrinkage_and_sparse_rule(spark):
    df = spark.createDataFrame([(15, 200.0, 180.0), (14, 200.0, 180.0), (0, None, 180.0), (30, 200.0, 180.0),
                                (0, None, None)], "n_grp long, base_grp double, base_reg double")
    alpha = F.col("n_grp") / (F.col("n_grp") + F.lit(10.0))
    blended = alpha * F.coalesce("base_grp", "base_reg") + (1 - alpha) * F.col("base_reg")
    got = [r[0] for r in df.select(F.when(F.col("n_grp") < 15, F.col("base_reg")).otherwise(blended)).collect()]
    assert got[0] == pytest.approx(192.0) and got[1] == 180.0 and got[2] == 180.0
    assert got[3] == pytest.approx(195.0) and got[4] is None


@pytest.fixture(scope="module")
def priced001(spark):
    from comparo.plans.common import priced
    return priced(spark, SF01).select("sale_key", "fsa", "day", "seq", "ppsf").cache()


@pytest.mark.parametrize("groups", [["fsa"], []])
def test_methods_agree_exactly(priced001, groups):
    """sql window == chunked direct == chunked with value-range splits (the hot-group path)."""
    k = groups + ["day"]
    a = B.frame_median_by_day(priced001, groups, "ppsf", 90, 1, method="sql").toPandas().sort_values(k)
    b = B.frame_median_by_day(priced001, groups, "ppsf", 90, 1, value_splits=1).toPandas().sort_values(k)
    c = B.frame_median_by_day(priced001, groups, "ppsf", 90, 1, value_splits=7).toPandas().sort_values(k)
    for x in (b, c):
        assert len(x) == len(a)
        assert (x["n"].to_numpy() == a["n"].to_numpy()).all()
        assert np.array_equal(x["med"].to_numpy(), a["med"].to_numpy(), equal_nan=True)


def test_chunked_matches_brute_force(spark):
    """A3 generalized: every (group, day) baseline equals the range self-join recomputation."""
    from comparo.plans.common import priced
    p = priced(spark, SF001).select("fsa", "day", "ppsf").toPandas()
    t = B.frame_median_by_day(priced(spark, SF001), ["fsa"], "ppsf", 90, 1).toPandas()
    for r in t.itertuples():
        w = p[(p.fsa == r.fsa) & (p.day >= r.day - 90) & (p.day < r.day)].ppsf
        assert r.n == len(w)
        if len(w):
            assert r.med == pytest.approx(float(np.median(w)), rel=0, abs=1e-9)


def test_lag_row_matches_pandas_reference_semantics(spark):
    """rolling('365D', min_periods).median().shift(1) within the group, in (day, seq) order."""
    from comparo.plans.common import priced
    p = priced(spark, SF001).select("sale_key", "fsa", "day", "seq", "ppsf")
    got = B.lag_row_median(p, ["fsa"], "ppsf", 365, 12).select("sale_key", "lag_med").toPandas()
    pdf = p.toPandas().sort_values(["fsa", "day", "seq"])
    exp = {}
    for _, g in pdf.groupby("fsa"):
        s = pd.Series(g.ppsf.to_numpy(), index=pd.to_datetime(g.day.to_numpy(), unit="D"))
        m = s.rolling("365D", min_periods=12).median().shift(1).to_numpy()
        exp.update(dict(zip(g.sale_key, m)))
    e = got.sale_key.map(exp).to_numpy()
    assert np.allclose(got.lag_med.to_numpy(), e, equal_nan=True, rtol=0, atol=1e-9)


def test_causality_property(spark):
    """Changing prices on day >= t changes no baseline of day <= t."""
    from comparo.plans.common import priced
    p = priced(spark, SF001).select("fsa", "day", "ppsf")
    cut = p.agg(F.percentile_approx("day", 0.5)).first()[0]
    p2 = p.withColumn("ppsf", F.when(F.col("day") >= cut, F.col("ppsf") * 3 + 1).otherwise(F.col("ppsf")))
    a = B.frame_median_by_day(p, ["fsa"], "ppsf", 90, 1).where(F.col("day") <= cut)
    b = B.frame_median_by_day(p2, ["fsa"], "ppsf", 90, 1).where(F.col("day") <= cut)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_history_scoring_uses_only_history(spark):
    """Listings priced from history; a listing never sees its own or later prices."""
    from comparo.plans.common import priced
    p = priced(spark, SF001)
    hist = p.where(F.col("day") < 10000)
    lst = p.where(F.col("day") >= 10000).withColumn("ppsf", F.lit(1e9))
    s = B.causal_baseline(lst, "fsa", "ppsf", 90, 10, 15, history=hist)
    assert s.where(F.col("base_ppsf") > 1e8).count() == 0


def test_rows_median_chunks_equal_window(spark):
    """Position chunks (tiny chunk size forces many boundaries) == SQL ROWS window."""
    from comparo.plans.common import priced
    p = priced(spark, SF001).select("sale_key", "fsa", "day", "seq", "ppsf")
    a = B.rows_median(p, ["fsa"], "ppsf", 30, 5, method="sql").select("sale_key", "rows_med").toPandas()
    b = B.rows_median(p, ["fsa"], "ppsf", 30, 5, chunk_rows=37).select("sale_key", "rows_med").toPandas()
    m = a.merge(b, on="sale_key")
    assert len(m) == len(a) == len(b)
    assert np.allclose(m.rows_med_x.to_numpy(), m.rows_med_y.to_numpy(), equal_nan=True, rtol=0, atol=1e-9)


@pytest.mark.parametrize("q", [0.005, 0.25, 0.5, 0.75])
def test_grouped_quantile_equals_percentile(spark, q):
    """Exact grouped quantiles with bounded tasks are bit-identical to ``percentile``."""
    from comparo.plans.common import priced
    p = priced(spark, SF001)
    exp = {r[0]: r[1] for r in p.groupBy("fsa").agg(F.percentile("ppsf", F.lit(q))).collect()}
    for vs in (1, 4):
        got = {r[0]: r[1] for r in B.grouped_quantile(p, ["fsa"], "ppsf", q, value_splits=vs).collect()}
        assert got == exp


@pytest.mark.parametrize("splits", [1, 3])
def test_history_targets_match_sql(spark, splits):
    """Frames for external target days (B16) agree across methods, with and without value splits."""
    from comparo.plans.common import priced
    p = priced(spark, SF01).select("fsa", "day", "ppsf")
    hist, tg = p.where(F.col("day") < 11000), p.where(F.col("day") >= 11000)
    k = ["fsa", "day"]
    a = B.frame_median_by_day(hist, ["fsa"], "ppsf", 90, 1, method="sql", targets=tg).toPandas().sort_values(k)
    b = B.frame_median_by_day(hist, ["fsa"], "ppsf", 90, 1, value_splits=splits, targets=tg).toPandas().sort_values(k)
    assert len(a) == len(b) == tg.select("fsa", "day").distinct().count()
    assert (a["n"].to_numpy() == b["n"].to_numpy()).all()
    assert np.array_equal(a["med"].to_numpy(), b["med"].to_numpy(), equal_nan=True)


def test_auto_split_picker_engages_for_hot_groups(spark):
    """With a small task bound the picker itself chooses value ranges; results stay exact."""
    from comparo.plans.common import priced
    p = priced(spark, SF001).select("fsa", "day", "ppsf")
    src = p.select("fsa", F.col("day").alias("d"))
    assert B._pick_splits(src, ["fsa"], 90, 40) > 1
    k = ["fsa", "day"]
    a = B.frame_median_by_day(p, ["fsa"], "ppsf", 90, 1, method="sql").toPandas().sort_values(k)
    b = B.frame_median_by_day(p, ["fsa"], "ppsf", 90, 1, max_task_rows=40).toPandas().sort_values(k)
    assert np.array_equal(a["med"].to_numpy(), b["med"].to_numpy(), equal_nan=True)
    g = B.grouped_median(p, ["fsa"], "ppsf", max_task_rows=40).toPandas().set_index("fsa")["median"]
    exp = p.groupBy("fsa").agg(F.percentile("ppsf", F.lit(0.5)).alias("m")).toPandas().set_index("fsa")["m"]
    assert (g.sort_index() == exp.sort_index()).all()


def test_group_without_values_keeps_its_targets(spark):
    """A group whose values are all NULL still gets its target days (n = 0, NULL median) on every path."""
    rows = [("a", 100, 1.0), ("a", 101, 2.0), ("a", 102, 3.0), ("b", 101, None), ("b", 102, None)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    for kw in ({"method": "sql"}, {"value_splits": 1}, {"value_splits": 2}, {"max_task_rows": 1}):
        t = {(r["g"], r["day"]): (r["med"], r["n"]) for r in B.frame_median_by_day(df, ["g"], "v", 5, 1, **kw).collect()}
        assert t[("b", 101)] == (None, 0) and t[("b", 102)] == (None, 0), kw
        assert t[("a", 102)] == (1.5, 2), kw


def test_grouped_quantiles_few_values_null_and_empty_groups(spark):
    """One path for every size: few-valued columns, NULL groups, groups without values, many quantiles."""
    from comparo.plans.common import priced
    p = priced(spark, SF01).select(F.when(F.col("floors") > 1, F.col("floors")).alias("g"), "area", "ppsf")
    p = p.unionByName(spark.createDataFrame([(99, None, None)], "g int, area double, ppsf double"))
    outs = {"a": 0.005, "b": 0.25, "c": 0.5, "d": 0.995, "e": 0.0, "f": 1.0}
    for value in ("area", "ppsf"):
        exp = {r[0]: tuple(r)[1:] for r in p.groupBy("g").agg(*[F.percentile(value, F.lit(q)) for q in outs.values()]).collect()}
        for accuracy in (10_000, 50):
            got = B.grouped_quantiles(p, ["g"], value, outs, accuracy).collect()
            assert {r[0]: tuple(r)[1:] for r in got} == exp and len(got) == len(exp)
    assert B.grouped_quantiles(p.where("g = 99"), [], "area", outs).collect() == [(None,) * 6]
    assert B.grouped_quantiles(p.where("g = -1"), [], "area", outs).collect() == []


def _odd_sales(spark):
    """Hot days, ties, NULL values and keys, repeated rows, a column beside the operator's own."""
    import random
    rng = random.Random(3)
    rows = []
    for g, n, days in (("a", 300, 60), ("b", 120, 400), ("c", 5, 900), (None, 7, 50)):
        for i in range(n):
            d = rng.choice([3, 3, 3, rng.randrange(days)])
            v = None if rng.random() < 0.1 else float(rng.choice([1, 2, 2.5, rng.random() * 10, -4]))
            rows.append((f"{g}{i}", g, d, rng.choice([5, rng.randrange(1 << 60)]), v, "x"))
    rows += rows[:30]
    return rows, spark.createDataFrame(rows, "sale_key string, g string, day int, seq long, v double, row string").repartition(5)


@pytest.mark.parametrize("groups", [["g"], []])
@pytest.mark.parametrize("kw", [{}, {"max_task_rows": 100, "block_rows": 17}, {"max_task_rows": 200, "block_rows": 10_000}, {"max_task_rows": 20, "block_rows": 1}])
def test_lag_row_with_hot_groups(spark, groups, kw):
    """Blocks and value ranges give what one task per group gives."""
    rows, df = _odd_sales(spark)
    pdf = pd.DataFrame(rows, columns=df.columns)

    def ref(x):
        x = x.sort_values(["day", "seq", "sale_key"], kind="stable")
        ser = pd.Series(x.v.to_numpy(), index=pd.to_datetime(x.day.to_numpy(), unit="D"))
        return x.assign(m=ser.rolling("30D", min_periods=3).median().shift(1).to_numpy())

    exp = pd.concat([ref(x) for _, x in pdf[pdf.g.notna()].groupby("g")] + [pdf[pdf.g.isna()].assign(m=np.nan)]) if groups else ref(pdf)
    got = B.lag_row_median(df, groups, "v", 30, 3, out="m", **kw).toPandas()
    canon = lambda f: sorted(zip(f.sale_key, f.m.astype(float).round(9).fillna(-999)))
    assert list(got.columns) == [*df.columns, "m"] and canon(got) == canon(exp)


def test_lag_row_of_nothing(spark):
    _, df = _odd_sales(spark)
    assert B.lag_row_median(df.where("false"), ["g"], "v", 30, 3).count() == 0
    assert B.lag_row_median(df.where("false"), [], "v", 30, 3).count() == 0


def test_value_range(spark):
    b = [1.0, 2.0, 2.0, 5.0, 7.5, 7.5, 9.0, 11.0, 12.0, 13.0]
    for k in (1, 2, 5, 10):
        df = spark.createDataFrame([(b[:k], x) for x in (0.0, 1.0, 2.0, 3.0, 7.5, 8.0, 20.0, None)], "b array<double>, v double")
        for r in df.select("v", B.value_range(F.col("b"), F.col("v"), k + 1).alias("r")).collect():
            assert r["r"] == (None if r["v"] is None else sum(y <= r["v"] for y in b[:k]))


def test_quantile_brackets_narrow_in_rounds(spark, monkeypatch):
    """A loose sketch and a low bound force two rounds; values stay those of ``percentile``."""
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, n in (("a", 4000), ("b", 700), (None, 60)) for v in rng.normal(size=n)] + [("a", 0.0)] * 500 + [("c", None), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    seen = []
    real = B._narrowed
    monkeypatch.setattr(B, "_narrowed", lambda *a: seen.append(real(*a)) or seen[-1])
    qs = {"p10": 0.1, "p50": 0.5, "p93": 0.93}
    got = {r["g"]: r for r in B.grouped_quantiles(df, ["g"], "v", qs, accuracy=20, max_cells=10).collect()}
    want = {r["g"]: r for r in df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(k) for k, q in qs.items()]).collect()}
    assert seen[0][1] >= 2 and set(got) == set(want)
    for g, r in want.items():
        assert [got[g][k] for k in qs] == [r[k] for k in qs]


def test_lag_row_blocks_open_few_ranges(spark, monkeypatch):
    """No table of blocks x value ranges (150 x 64 here), whatever the bounds of a task; small tasks share a kernel."""
    import comparo.session as Ses
    sizes, write = [], Ses.materialize
    monkeypatch.setattr(Ses, "materialize", lambda df: (lambda t: (sizes.append(t.count()), t)[1])(write(df)))
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": "a", "day": np.arange(600) // 20, "seq": np.arange(600), "sale_key": [f"{i:04d}" for i in range(600)], "v": rng.normal(size=600)})
    got = B.lag_row_median(spark.createDataFrame(pdf), ["g"], "v", 10, 3, out="m", max_task_rows=20, block_rows=4).toPandas().sort_values("seq")
    want = pd.Series(pdf["v"].to_numpy(), index=pd.to_datetime(pdf["day"], unit="D")).rolling("10D", min_periods=3).median().shift(1)
    assert np.allclose(got["m"].to_numpy(dtype=float), want.to_numpy(), equal_nan=True)
    assert max(sizes) < 2_000, sizes


def test_run_quantiles_by_cells(monkeypatch):
    """Ranks of long runs are looked up in cells; equal to each run's own quantile, ties and empty runs too."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(B, "_CELL_RUN", 1)
    for n, high in ((1, 3), (700, 5), (5000, 10**9)):
        v = rng.integers(0, high, n) / 7.0
        a = np.sort(rng.integers(0, n, 60))
        b = np.maximum.accumulate(np.minimum(n, a + rng.integers(0, n, 60)))
        for q in (0.5, 0.9, 0.0, 1.0):
            assert B._run_quantiles(v, a, b, q) == [B._quantile(v[x:y], q) if y > x else None for x, y in zip(a, b)]


def test_levels_spare_the_rows_their_shuffles(spark):
    """The level tables are broadcast (small ones), and stretched chunks give what single ones give."""
    rows = [(i, int(d), g, float(v)) for i, (d, g, v) in enumerate(zip(np.random.default_rng(0).integers(0, 900, 4000), "abcd" * 1000, range(4000)))]
    df = spark.createDataFrame(rows, "id long, day int, g string, ppsf double")
    out, names = B.level_candidates(df, "ppsf", [(("g",), 90, 2), ((), 90, 2), (("g",), 365, 2)])
    assert "SortMergeJoin" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and plan.count("strategy=broadcast") == 2
    one, many = [sorted(map(tuple, B.frame_medians(df, ["g"], "ppsf", [90, 365], stretch=k).collect())) for k in (1, 3)]
    assert one == many and len(one) > 1000


def test_ranged_windows_share_one_table(spark, monkeypatch):
    """The value-range path of several windows writes the values once, and equals the direct one."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(int(d), g, float(v)) for d, g, v in zip(rng.integers(0, 900, 3000), "aab" * 1000, rng.integers(0, 400, 3000))], "day int, g string, ppsf double")
    calls = []
    real = B._ranged
    monkeypatch.setattr(B, "_ranged", lambda *a: calls.append(1) or real(*a))
    for groups in (["g"], []):
        direct = sorted(map(tuple, B.frame_medians(df, groups, "ppsf", [90, 365]).collect()))
        cut = sorted(map(tuple, B.frame_medians(df, groups, "ppsf", [90, 365], max_task_rows=300).select(*groups, "day", "med_90", "n_90", "med_365", "n_365").collect()))
        assert direct == cut
    assert len(calls) == 2


@pytest.mark.parametrize("kw", [{}, {"max_task_rows": 40, "block_rows": 4}])
def test_lag_row_carries_only_what_it_keeps(spark, monkeypatch, kw):
    """The tables that the kernels write hold the kept columns only, whatever else the rows have; same medians."""
    from comparo import session
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"sale_key": [f"k{i}" for i in range(400)], "g": [["a", "b", None][i % 3] for i in range(400)], "day": rng.integers(0, 60, 400).astype("int32"),
                        "seq": rng.permutation(400).astype("int64") << 50, "v": np.where(rng.random(400) < 0.1, np.nan, rng.integers(0, 50, 400)), "wide": "x" * 50})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    whole = B.lag_row_median(df, ["g"], "v", 10, 2, out="m", **kw)
    assert whole.columns == [*df.columns, "m"]
    wrote, write = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda t: wrote.append(t.columns) or write(t))
    t = B.lag_row_median(df, ["g"], "v", 10, 2, out="m", keep=["sale_key"], **kw)
    assert t.columns == ["sale_key", "m"]
    key = lambda r: (r["sale_key"], str(r["m"]))
    assert sorted(map(key, t.collect())) == sorted(map(key, whole.collect()))
    assert any("k" in c for c in wrote) and not any(c.startswith("__x") for cols in wrote for c in cols)


def test_ranges_are_cut_in_steps(spark, monkeypatch):
    """More ranges than one sketch bounds are found by sketches of the ranges, with no more than ``_FAN`` numbers each."""
    monkeypatch.setattr(B, "_FAN", 4)
    df = spark.createDataFrame([(g, float((i * 37) % 500)) for g in "ab" for i in range(500)] + [("a", None)], "g string, v double")
    t, n = B.numbered_ranges(df, ["g"], "v", 30)
    rows = t.collect()
    assert 30 <= n <= 64 and len(rows) == 1001 and t.columns == ["g", "v", "r"]
    assert [r["r"] for r in rows if r["v"] is None] == [None]
    for g in "ab":
        own = sorted((r["v"], r["r"]) for r in rows if r["g"] == g and r["v"] is not None)
        rs = [r for _, r in own]
        assert rs == sorted(rs) and 0 <= rs[0] and rs[-1] < n and max(rs.count(x) for x in set(rs)) <= 40
    assert [r["r"] for r in B.numbered_ranges(df, [], "v", 1)[0].collect()].count(0) == 1000
