"""FX6 metrics; subset search against closed form; one-pass leakage audit (FX7)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparo.operators import audit as A
from comparo.operators import metrics as M
from comparo.operators import search as S


def test_fx6_metrics(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 330.0), (400.0, 360.0)], "y double, p double")
    r = M.metrics(df, "y", "p").first()
    assert r["mae"] == pytest.approx(22.5) and r["wape"] == pytest.approx(0.09)
    assert r["mape"] == pytest.approx(0.0875) and r["rmse"] == pytest.approx(675 ** 0.5)
    assert r["median_ae"] == pytest.approx(20.0) and r["r2"] == pytest.approx(1 - 2700 / 50000)
    assert r["within_10pct"] == 1.0


def _rows(spark, n=600, missing=True, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 1] + [0, 1e6, 5, 0]
    y = 1 + 0.2 * x[:, 0] - 0.1 * x[:, 3] + rng.normal(scale=0.1, size=n)
    if missing:
        x[rng.random((n, 4)) < 0.2] = np.nan
    cell = lambda v: None if np.isnan(v) else float(v)
    rows = [(*map(cell, r), float(t), float(np.exp(t)), ["train", "val", "test"][i % 3], "clash") for i, (r, t) in enumerate(zip(x, y))]
    rows += [(1.0, 1.0, 1.0, 1.0, None, 5.0, "train", ""), (1.0, 1.0, 1.0, 1.0, 2.0, None, "test", "")]
    return rows, spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double, y double, price double, split string, block string").repartition(3)


@pytest.mark.parametrize("block_rows,block_subsets", [(8192, 2048), (7, 4)])
def test_search_on_complete_rows_against_lstsq(spark, monkeypatch, block_rows, block_subsets):
    monkeypatch.setattr(S.pack, "__defaults__", ("split", block_rows))
    rows, df = _rows(spark)
    got = {r["subset_id"]: r for r in S.search(df, ["x0", "x1", "x2", "x3"], "y", "price", back="exp", max_size=3, block_subsets=block_subsets).collect()}
    assert len(got) == 4 + 6 + 4
    for sid, r in got.items():
        idx = [int(i) for i in sid.split(",")]
        part = {}
        for name in ("train", "val", "test"):
            own = [q for q in rows if q[6] == name and q[4] is not None and q[5] is not None and all(q[i] is not None for i in idx)]
            part[name] = (np.array([[q[i] for i in idx] for q in own]), np.array([q[4] for q in own]), np.array([q[5] for q in own]))
        x, y, _ = part["train"]
        m = x.mean(axis=0)
        b = np.linalg.lstsq(np.c_[np.ones(len(x)), x - m], y, rcond=None)[0]
        fit = lambda x: b[0] + (x - m) @ b[1:]
        r2 = lambda t, p: 1 - ((t - p) ** 2).sum() / ((t - t.mean()) ** 2).sum()
        xv, yv, _ = part["val"]
        xt, _, price = part["test"]
        assert (r["n_train"], r["n_val"], r["n_test"]) == (len(x), len(xv), len(xt))
        assert r["r2_train"] == pytest.approx(r2(y, fit(x)), abs=1e-9) and r["r2_val"] == pytest.approx(r2(yv, fit(xv)), abs=1e-9)
        assert r["mae_test"] == pytest.approx(np.abs(price - np.exp(fit(xt))).mean(), rel=1e-9) and r["r2_test"] == pytest.approx(r2(price, np.exp(fit(xt))), abs=1e-9)


def test_singular_subset_is_isolated(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i % 3), 7.0, float(i), ["train", "test"][i % 2]) for i in range(50)],
                               "a double, b double, c double, d double, y double, split string")
    sc = {r["subset_id"]: r for r in S.search(df, ["a", "b", "c", "d"], "y", "y", back="raw", min_non_null=10, min_size=1, max_size=2).collect()}
    assert sc["0,1"]["status"] == sc["3"]["status"] == "singular" and sc["0,1"]["mae_test"] is None
    assert sc["0,2"]["status"] == "ok" and sc["0,2"]["mae_test"] == pytest.approx(0, abs=1e-9)


def test_search_without_rows(spark):
    _, df = _rows(spark)
    t = S.search(df.where("split = 'none'"), ["x0", "x1"], "y", "price", min_non_null=-1, max_size=2).collect()
    assert [r["status"] for r in t] == ["singular"] * 3


def test_given_and_required_features(spark):
    _, df = _rows(spark, missing=False)
    cols = ["x0", "x1", "x2", "x3"]
    every = {r["subset_id"]: r for r in S.search(df, cols, "y", "price", max_size=2).collect()}
    one = S.search(df, cols, "y", "price", only=("x3", "x0")).collect()
    assert len(one) == 1 and one[0]["mae_test"] == pytest.approx(every["0,3"]["mae_test"])
    some = {r["subset_id"] for r in S.search(df, cols, "y", "price", max_size=2, require_one_of=("x2",)).collect()}
    assert some == {k for k in every if "2" in k.split(",")}
    with pytest.raises(ValueError):
        S.candidate_features(df, cols, require_one_of=("nope",))


def test_killed_and_replayed_batches(spark, tmp_path):
    """A batch that dies before its mark, and one written twice, add nothing; the resumed run does the rest only."""
    subs = S.subsets(spark, [f"f{i}" for i in range(6)], 1, 3).select("subset_id", "n_features")
    store, ran = S.ResultStore(spark, str(tmp_path / "store")), []

    def score(b):
        ran.append(b)
        if b == 2 and ran.count(2) == 1:
            store.write(2, subs.limit(3), commit=False)
            raise RuntimeError("killed")
        return subs.where(S.batch_of(5) == b)

    with pytest.raises(RuntimeError):
        S.search_in_batches(store, 5, score)
    assert store.progress(subs.count()).first()["n_batches"] == 2
    store.write(0, subs.where(S.batch_of(5) == 0))
    assert S.search_in_batches(store, 5, score) == 3 and ran == [0, 1, 2, 2, 3, 4]
    got = [r["subset_id"] for r in store.results(subs.schema).collect()]
    assert sorted(got) == sorted(r["subset_id"] for r in subs.collect()) and len(got) == len(set(got))
    assert store.progress(len(got)).first()["percent"] == 100.0


def test_leakage_audit_fx7(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(2e5, 9e5, 2000)
    rows = [(float(a), float(a), float(a + rng.uniform(-1000, 1000)), float(rng.normal()),
             float(a) if i < 50 else None) for i, a in enumerate(t)]
    df = spark.createDataFrame(rows, "target double, copy double, noisy double, unrelated double, sparse double")
    r = {x["column"]: x for x in A.leakage_audit(df, "target", ["copy", "noisy", "unrelated", "sparse"]).collect()}
    assert r["copy"]["leak"] and r["noisy"]["leak"] and not r["unrelated"]["leak"]
    assert r["sparse"]["skipped"] and not r["sparse"]["leak"]


def test_test_rows_stay_where_they_are(spark, monkeypatch):
    """few subsets are broadcast to the blocks of test rows, which no shuffle brings together; many are joined on salts, with the same scores."""
    from comparo.operators import search as S
    df = spark.createDataFrame([(float(i % 7), float(i % 5), float(i % 3), ["train", "val", "test"][i % 3 if i % 2 else 2], 10.0 + i % 11) for i in range(300)],
                               "a double, b double, c double, split string, p double").withColumn("y", F.log1p("p"))
    ready = S.prepare(df, ["a", "b", "c"], "y", "p")
    scores = S.score_subsets(S.subsets(spark, ready["features"], 1, 2), ready["sums"], 3)
    got, plans, was = [], [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for most in (50_000, 0):
            monkeypatch.setattr(S, "BROADCAST_SUBSETS", most)
            t = S.test_scores(ready["packed"], scores, 3, ready["mean_y"])
            plans.append("SortMergeJoin" in t._jdf.queryExecution().executedPlan().toString())
            got.append({r["subset_id"]: (r["n_test"], round(r["mae_test"], 9)) for r in t.collect()})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plans == [False, True] and got[0] == got[1] and len(got[0]) == 3  # c does not vary in train


def test_search_rows_are_not_numbered(spark, monkeypatch):
    """the rows of the search are split by comparison; no window sorts them."""
    from comparo import session
    from comparo.plans import q_search as Q
    wrote, write = [], session.materialize
    monkeypatch.setattr(Q, "materialize", lambda df: wrote.append(df) or write(df))
    f = Q._frame(spark, "/root/testdata/sf0.001")
    assert "Window" not in wrote[0]._jdf.queryExecution().optimizedPlan().toString()
    n = f.count()
    assert {r["split"]: r["count"] for r in f.groupBy("split").count().collect()} == {"train": int(0.7 * n), "val": int(0.8 * n) - int(0.7 * n), "test": n - int(0.8 * n)}
