"""Splits (SP1-SP9), weights (WT1/WT2), encoders (E6-E9) on FX5 and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from comparo.functions.keys import hash60
from comparo.operators import encode as E
from comparo.operators import split as S
from comparo.operators.ordering import with_position
from comparo.operators.weights import recency_weight


def _fx5(spark, same_day=False):
    d0 = dt.date(2020, 1, 1)
    rows = [(i, d0 if same_day else d0 + dt.timedelta(days=i), "a" if i % 2 else "b", float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "key long, d date, cat string, y double")
    return df.select("*", F.col("key").cast("string").alias("sale_key"),
                     F.datediff("d", F.lit("1970-01-01").cast("date")).alias("day"),
                     hash60(F.col("key").cast("string")).alias("seq"))


@pytest.mark.parametrize("same_day", [False, True])
def test_70_10_20_counts(spark, same_day):
    s = S.temporal_split(_fx5(spark, same_day), (0.7, 0.8))
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 7, "val": 1, "test": 2}
    pos = sorted(r[0] for r in s.select("pos").collect())
    assert pos == list(range(1, 11))


def test_position_matches_global_row_number(spark):
    from comparo.plans.common import priced
    from tests.conftest import SF001
    p = priced(spark, SF001)
    a = with_position(p).select("sale_key", "pos")
    from pyspark.sql import Window
    b = p.select("sale_key", F.row_number().over(Window.orderBy("day", "seq")).alias("pos"))
    assert a.exceptAll(b).count() == 0


def test_kfold_contiguous_sizes(spark):
    df = spark.range(1, 13).withColumnRenamed("id", "pos")
    f = S.kfold_contiguous(df, 12, 5)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes == [2, 2, 2, 3, 3]


def test_time_series_blocks(spark):
    df = spark.range(1, 3001).withColumnRenamed("id", "pos")
    b, s = S.time_series_blocks(df, 3000)
    assert s == 3
    c = {r["block"]: r["count"] for r in b.groupBy("block").count().collect()}
    assert c == {0: 750, 1: 750, 2: 750, 3: 750}


def test_recency_weight(spark):
    df = spark.createDataFrame([(dt.date(2019, 1, 1),), (dt.date(2010, 1, 1),)], "d date")
    w = [r[0] for r in df.select(recency_weight(F.col("d"), "2020-01-01", 365.0, 0.05)).collect()]
    assert w[0] == pytest.approx(0.5, abs=2e-3) and w[1] == 0.05


def test_ordered_te_fx5(spark):
    d0 = dt.date(2020, 1, 1)
    rows = [("k1", d0, "a", 1.0), ("k2", d0 + dt.timedelta(days=1), "a", 2.0),
            ("k3", d0 + dt.timedelta(days=2), "a", 6.0), ("k4", d0 + dt.timedelta(days=3), "a", 0.0)]
    df = (spark.createDataFrame(rows, "sale_key string, d date, cat string, y double")
          .withColumn("day", F.datediff("d", F.lit("1970-01-01").cast("date")))
          .withColumn("seq", hash60(F.col("sale_key")))
          .withColumn("split", F.when(F.col("sale_key") == "k4", "test").otherwise("train")))
    got = {r["sale_key"]: r["cat_te"] for r in E.ordered_te(df, "cat", "y", F.col("split") == "train").collect()}
    assert got["k1"] == 3.0 and got["k2"] == 1.0 and got["k3"] == 1.5 and got["k4"] == 1.5


def test_kfold_shrunk_fx5(spark):
    # count 10, mean 4 out of fold, global mean 2, k = 10 -> 3
    rows = [(f"k{i}", "a", 4.0, 1) for i in range(10)] + [(f"j{i}", "b", 0.0, 0) for i in range(10)] + \
           [("x", "a", 0.0, 0)]
    df = spark.createDataFrame(rows, "sale_key string, cat string, y double, fold int").withColumn("split", F.lit("train"))
    got = {r["sale_key"]: r["cat_te"] for r in E.kfold_te(df, "cat", "y", "fold", F.col("split") == "train",
                                                          shrink_k=10.0).collect()}
    gm = 40.0 / 21
    assert got["x"] == pytest.approx(0.5 * 4.0 + 0.5 * gm)


def test_hash_split_is_repeatable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("sale_key"))
    a = S.hash_split(df).select("sale_key", "split")
    b = S.hash_split(df.repartition(7)).select("sale_key", "split")
    assert a.exceptAll(b).count() == 0
    share = a.where(F.col("split") != "test").count() / 1000
    assert 0.75 < share < 0.85


def test_one_hot_blocks_are_aligned_to_train(spark):
    """Fixed width, unseen values empty or other, NULL as its own value where asked."""
    from pyspark.sql import functions as F
    from comparo.operators import encode as E
    train = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")] * 2 + [(None, "z"), ("c", None)], "g string, h string")
    rest = spark.createDataFrame([(1, "a", "x"), (2, "new", "new"), (3, None, None), (4, "c", "z")], "id int, g string, h string")
    specs = [("g", E.vocabulary(train, "g", na="NA"), {"na": "NA"}), ("h", E.vocabulary(train, "h", min_count=2, other="__OTHER__"), {"other": "__OTHER__"}),
             ("g", E.vocabulary(train, "g", top=1), {})]
    t = E.one_hot(rest, specs)
    got = {r["id"]: r["onehot"] for r in t.collect()}
    # blocks: NA a b c | x y other | a
    assert {k: sorted(v["indices"]) for k, v in got.items()} == {1: [1, 4, 7], 2: [6], 3: [0, 6], 4: [3, 6]}
    assert {v["size"] for v in got.values()} == {8} and t.columns == ["id", "g", "h", "onehot"]
    vec = {r["id"]: r["onehot_vector"] for r in E.to_vector(t).collect()}
    assert vec[1].size == 8 and sorted(i for i, x in enumerate(vec[1].toArray()) if x) == [1, 4, 7]
    assert E.one_hot(rest.where("false"), specs).count() == 0
    none = E.vocabulary(train.where("false"), "g")
    assert E.one_hot(rest, [("g", none, {})]).where(F.size("onehot.indices") > 0).count() == 0


def test_ppsf_gate_stops(spark):
    import pytest
    from comparo.operators import audit as A
    rows = [(100.0, 10.0 if i % 10 else None, 20.0 if i % 3 else 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "price double, a double, b double")
    assert A.ppsf_gate(df, "price", "a", "b", least=0.9)[1] == "a"
    assert A.ppsf_gate(df, "price", "b", "a", least=0.9)[1] == "a"
    with pytest.raises(A.CoverageError):
        A.ppsf_gate(df, "price", "a", "b")
    with pytest.raises(A.CoverageError):
        A.ppsf_gate(df.where("false"), "price", "a")


def test_several_windows_in_one_shuffle(spark):
    """frame_medians = frame_median_by_day per window, with and without value ranges."""
    from comparo.operators import baseline as B
    import random
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("ab"), rng.randrange(200), float(rng.randrange(50))) for _ in range(600)], "g string, day int, v double")
    for groups in (["g"], []):
        for kw in ({}, {"max_task_rows": 60}):
            t = {tuple(r[c] for c in [*groups, "day"]): r for r in B.frame_medians(df, groups, "v", [10, 50], **kw).collect()}
            for length in (10, 50):
                for r in B.frame_median_by_day(df, groups, "v", length).collect():
                    o = t[tuple(r[c] for c in [*groups, "day"])]
                    assert (o[f"n_{length}"], o[f"med_{length}"]) == (r["n"], r["med"])


def test_positions_do_not_depend_on_the_buckets(spark):
    """SP1: the number of day buckets (known or unknown table size) changes the plan, not the order."""
    import random
    from comparo.operators import ordering as O
    rng = random.Random(6)
    rows = [(rng.randrange(5), rng.randrange(1 << 60), rng.choice("ab"), float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "day int, seq long, g string, v double").repartition(4)
    assert [O.bucket_bits(n) for n in (None, 0, 10, 10 ** 6, 3 * 10 ** 6, 10 ** 12)] == [10, 0, 0, 0, 2, 10]
    want = {(d, s): i for i, (d, s, _, _) in enumerate(sorted(rows))}
    for n in (None, 300, 3 * 10 ** 6):
        assert {(r["day"], r["seq"]): r["pos"] - 1 for r in O.with_position(df, rows=n).collect()} == want
        got = {(r["day"], r["seq"]): (r["run_n"], r["run_v"]) for r in O.exclusive_running(df, ["g"], ["v"], rows=n).collect()}
        for g in "ab":
            total, count = 0.0, 0
            for d, s, x, v in sorted(rows):
                if x == g:
                    assert got[d, s] == (count, total)
                    total, count = total + v, count + 1


@pytest.mark.parametrize("day_rows", [1_000_000, 3])
@pytest.mark.parametrize("kind", ["spread", "one_day", "copies", "all_alike"])
def test_cut_split_is_the_split_by_position(spark, monkeypatch, kind, day_rows):
    """Cuts inside a day, inside a bucket of a hot day and among rows of equal key; and no row is shuffled for it."""
    import random
    rng = random.Random(3)
    key = {"spread": lambda i: (rng.randrange(9), rng.randrange(1 << 60)), "one_day": lambda i: (5, rng.randrange(1 << 60)),
           "copies": lambda i: (i % 3, (i % 4) << 57), "all_alike": lambda i: (7, 11)}[kind]
    df = spark.createDataFrame([(i, *key(i)) for i in range(50)], "id int, day int, seq long").repartition(3)
    monkeypatch.setattr(S, "DAY_ROWS", day_rows)
    for fr, names in (((0.7, 0.8), ("train", "val", "test")), ((0.0, 1.0), ("a", "b", "c")), ((0.01,), ("a", "b"))):
        got = S.cut_split(df, fr, names).collect()
        want = S.temporal_split(df, fr, names).collect()
        assert len(got) == 50 and sorted((r["day"], r["seq"], r["split"]) for r in got) == sorted((r["day"], r["seq"], r["split"]) for r in want)
    assert S.cut_split(df.where("id < 0")).count() == 0
    if kind == "spread":
        assert "Exchange" not in S.cut_split(df.sparkSession.createDataFrame(df.collect(), df.schema))._jdf.queryExecution().executedPlan().toString()


def test_rows_narrowed_before_joins(spark):
    """lineitem meets supplier as a broadcast and is never shuffled for the position of the split."""
    from comparo.plans.q_metrics import evaluated
    from conftest import SF001
    e = evaluated(spark, SF001)
    assert e.columns == ["sold_price", "day", "seq", "pred", "split"]
    from comparo.plans.common import priced
    plan = priced(spark, SF001).select("day", "ppsf", "fsa")._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "concat_ws" not in plan  # a key that is not read is not made
    plan = priced(spark, SF001).select("day", "seq", "ppsf")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_few_values_do_not_shuffle_the_rows(spark, monkeypatch):
    """a vocabulary of few values is broadcast whatever its estimated size; a larger one is joined, with the same rows."""
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 7 else "z") for i in range(300)] + [(300, None)], "id int, t string")
    voc, was = df.where("t <> 'z'").select("t").distinct(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = []
        for most in (100, 1):
            monkeypatch.setattr(E, "SMALL_VOCABULARY", most)
            t = E.map_to_vocab(df, "t", voc, "hot")
            got.append((sorted(map(tuple, t.select("id", F.coalesce("hot", F.lit("-"))).collect())), "SortMergeJoin" in t._jdf.queryExecution().executedPlan().toString()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got[0][0] == got[1][0] and [g[1] for g in got] == [False, True]


@pytest.mark.parametrize("module, name, read", [
    ("q_encode", "te_kfold", {"complex", "y"}), ("q_encode", "standardize", {"area", "list_price"}), ("q_encode", "onehot_min_freq_other", {"partkey"}),
    ("q_features", "winsorized", {"list_price", "area", "maint_fee"}), ("q_features", "bin_median_impute", {"area", "maint_fee"}), ("q_features", "median_fill", {"maint_fee", "tax"}),
    ("q_split", "weights_recency", {"list_date", "sold_price"}), ("q_split", "weights_wape_normalized", {"list_date", "sold_price"}), ("q_split", "folds_time_series", set())])
def test_only_what_a_query_reads_is_written(spark, monkeypatch, module, name, read):
    """The split writes no column that its query does not read, and takes no positions."""
    import importlib

    from comparo import session
    wrote, write = [], session.materialize
    monkeypatch.setattr(session, "materialize", lambda df: wrote.append(df) or write(df))
    importlib.import_module(f"comparo.plans.{module}")
    from comparo.plans.registry import all_queries
    all_queries()[name](spark, "/root/testdata/sf0.001")
    assert set(wrote[0].columns) == {"sale_key", "day"} | read
    assert "Window" not in wrote[0]._jdf.queryExecution().optimizedPlan().toString()


def test_cuts_of_time_series_blocks(spark):
    """blocks by comparison with the rows at their ends are the blocks by position."""
    df = spark.createDataFrame([(i // 9, (i * 7919) % 1009) for i in range(107)], "day int, seq long")
    for n, splits in ((74, 4), (107, None), (3, 5)):
        ends = S.time_series_cuts(n, splits)
        got = S.cut_at(df, ends, range(len(ends) + 1), 107, out="block").where(F.col("block") < len(ends))
        want = S.time_series_blocks(with_position(df).where(F.col("pos") <= n), n, splits)[0]
        assert sorted(map(tuple, got.select("day", "seq", "block").collect())) == sorted(map(tuple, want.select("day", "seq", "block").collect()))


def test_fold_tables_do_not_shuffle_the_rows(spark):
    """the category and fold totals of a K-fold encoding are broadcast once they are known to be small."""
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 10 else None, i % 4, float(i % 13), i % 5 > 0) for i in range(200)], "id int, c string, fold int, y double, tr boolean")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        t = E.kfold_te(df, "c", "y", "fold", F.col("tr"))
        assert "SortMergeJoin" not in t._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_keys_are_made_after_the_joins(spark):
    """F16: no text key passes the shuffle of a join; the plan makes it above all joins."""
    from comparo.plans.common import priced
    plan = priced(spark, "/root/testdata/sf0.001").select("sale_key", "list_price")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("concat_ws") < plan.index("Join") and plan.count("concat_ws") == plan[:plan.index("Join")].count("concat_ws")
