"""Feature-subset search.

Instead of fitting one model per subset in a driver loop, the search is:

1. ``subsets``: all subsets of sizes a..b, grown level by level with a
   join against the k-row feature table (broadcast: its size is k) -
   distributed and ordered, never listed on the driver;
2. ``profile``: one aggregate gives counts, train means and the row count;
3. ``pack``: the rows of the search (split, features less their train means, target) as
   blocks of a fixed number of rows, written once; what misses a feature keeps its pattern;
4. ``gram``: pairwise sums of [1, x_1..x_k, y] per (split, missing-value
   pattern), added up from blocks.  A subset's sums are those of the patterns that miss
   none of its features, so complete-row fits of every subset come from one pass;
5. ``score_subsets``: tasks over the subset table solve each subset's normal equations
   from those sums: exact train R2, validation R2/RMSE and the coefficients, a table;
   a singular system gives status 'singular' (T4);
6. ``test_scores``: blocks of coefficients meet blocks of test rows by a join on
   (coefficient block, salt); a task multiplies the two matrices, goes back to
   price space and adds up errors.  Neither rows nor coefficients pass the driver.

Stated difference from the reference: linear models for the wide screen
(boosted trees for a shortlist, see ``model.py``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from comparo.session import materialize

#: Rows of one packed block, subsets of one coefficient block, copies of a coefficient block.
BLOCK_ROWS, BLOCK_SUBSETS, SALTS = 8192, 2048, 16
#: Solved subsets (a few hundred bytes each) whose coefficients are broadcast to the test rows.
BROADCAST_SUBSETS = 50_000
#: Bound on what the pattern sums may hold on the driver (patterns x splits x (k + 2)^2 doubles).
MAX_GRAM_BYTES = 256 << 20


def candidate_features(df: DataFrame, catalogue, min_non_null: int = 100, limit: int | None = None, require_one_of=None) -> list[str]:
    """Catalogue columns with more than ``min_non_null`` values, all, or the first ``limit`` (T9: 10;
    one aggregate).  P26: ``require_one_of`` columns head the catalogue; none of them qualifying is an error."""
    row = df.agg(*[F.count(c).alias(c) for c in catalogue]).first()
    return restrict([c for c in catalogue if row[c] > min_non_null], require_one_of)[:limit]


def restrict(features, require_one_of=None) -> list[str]:
    """The candidate list, if it holds at least one of the required columns."""
    if require_one_of and not set(require_one_of) & set(features):
        raise ValueError(f"none of {list(require_one_of)} is a candidate feature")
    return list(features)


def containing(subs: DataFrame, require_one_of) -> DataFrame:
    """P26 on the subsets: those that hold at least one of the named features."""
    return subs.where(F.arrays_overlap("features", F.array(*[F.lit(c) for c in require_one_of])))


def subsets(spark: SparkSession, features, min_size: int = 1, max_size: int = 4) -> DataFrame:
    """Every subset of sizes min..max as (subset_id, idx, features, n_features)."""
    f = spark.createDataFrame([(i, n) for i, n in enumerate(features)], "fid int, fname string")
    fb = F.broadcast(f)  # k rows
    level = f.select(F.array("fid").alias("idx"), F.array("fname").alias("features"), F.col("fid").alias("last"))
    out = level if min_size <= 1 else None
    for size in range(2, max_size + 1):
        level = (level.join(fb, fb["fid"] > level["last"])
                      .select(F.concat("idx", F.array("fid")).alias("idx"),
                              F.concat("features", F.array("fname")).alias("features"),
                              F.col("fid").alias("last")))
        if size >= min_size:
            out = level if out is None else out.unionByName(level)
    return out.select(F.concat_ws(",", F.transform("idx", lambda x: x.cast("string"))).alias("subset_id"),
                      "idx", "features", F.size("idx").alias("n_features"))


def given_subset(spark: SparkSession, features, names) -> DataFrame:
    """One named subset of ``features``, in the shape of ``subsets``."""
    idx = sorted(list(features).index(n) for n in names)
    return spark.range(1).select(F.lit(",".join(map(str, idx))).alias("subset_id"), F.array(*[F.lit(i) for i in idx]).alias("idx"),
                                 F.array(*[F.lit(features[i]) for i in idx]).alias("features"), F.lit(len(idx)).alias("n_features"))


def profile(rows: DataFrame, cols, y: str, split: str = "split") -> tuple[dict, dict]:
    """({column: number of values}, {column or y: train mean, 0 if there is none}) in one aggregate."""
    train = F.col(split) == "train"
    r = rows.agg(*[F.count(c).alias(f"n_{c}") for c in cols],
                 *[F.avg(F.when(train, F.col(c).cast("double"))).alias(f"m_{c}") for c in [*cols, y]]).first()
    return {c: r[f"n_{c}"] for c in cols}, {c: r[f"m_{c}"] or 0.0 for c in [*cols, y]}


def pack(rows: DataFrame, cols, y: str, price: str, means: dict, split: str = "split", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """split, salt, n, x (block of n rows: features less their means, NaN where missing; y less its
    mean; price; as little-endian doubles).  Rows without y or price take no part.  Written once."""
    cols, k = list(cols), len(cols)
    sel = rows.where(F.col(y).isNotNull() & F.col(price).isNotNull()).select(
        F.col(split).alias("split"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
        F.col(y).cast("double").alias("y"), F.col(price).cast("double").alias("price"))
    shift = np.array([means[c] for c in cols] + [means[y], 0.0])

    def run(batches):
        held: dict[str, list] = {}

        def out(name):
            x = np.concatenate(held.pop(name))
            for a in range(0, len(x), block_rows):
                part = np.ascontiguousarray(x[a:a + block_rows])
                count[0] += 1
                yield pa.record_batch([pa.array([name], pa.string()), pa.array([count[0] % SALTS], pa.int32()), pa.array([len(part)], pa.int32()),
                                       pa.array([part.tobytes()], pa.binary())], ["split", "salt", "n", "x"])

        count = [0]
        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            x = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1, k + 3)], axis=1) - shift
            for name in sorted(set(names)):
                held.setdefault(name, []).append(x[names == name])
                if sum(map(len, held[name])) >= block_rows:
                    yield from out(name)
        for name in list(held):
            yield from out(name)

    return materialize(sel.mapInArrow(run, "split string, salt int, n int, x binary"))


def gram(packed: DataFrame, k: int, splits=("train", "val")) -> dict[str, dict[int, np.ndarray]]:
    """{split: {pattern: sums}}: pairwise sums of [1, x_1..x_k, y] over the rows whose missing
    features are the bits of ``pattern`` (their values count as 0)."""
    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for name, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = np.frombuffer(raw).reshape(n, k + 2)
                gaps = np.isnan(x[:, :k])
                bits = gaps @ (1 << np.arange(k, dtype=np.int64))
                z = np.concatenate([np.ones((n, 1)), np.where(gaps, 0.0, x[:, :k]), x[:, k:k + 1]], axis=1)
                for p in np.unique(bits).tolist():
                    part = z[bits == p]
                    sums[name, p] = sums.get((name, p), 0.0) + part.T @ part
        keys = list(sums)
        yield pa.record_batch([pa.array([s for s, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.int64()),
                               pa.array([sums[q].ravel() for q in keys], pa.list_(pa.float64()))], ["split", "pattern", "g"])

    each = packed.where(F.col("split").isin(*splits)).select("split", "n", "x").mapInArrow(run, "split string, pattern long, g array<double>")
    total = each.select("split", "pattern", F.posexplode("g").alias("at", "v")).groupBy("split", "pattern", "at").agg(F.sum("v").alias("v"))
    whole = materialize(total.groupBy("split", "pattern").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("g")))
    if whole.count() * (k + 2) ** 2 * 8 > MAX_GRAM_BYTES:
        raise ValueError("too many missing-value patterns: take fewer candidate features or fill them first")
    out: dict = {name: {} for name in splits}
    for r in whole.collect():  # bounded above
        out[r["split"]][r["pattern"]] = np.array([c["v"] for c in r["g"]]).reshape(k + 2, k + 2)
    return out


def complete(sums: dict[int, np.ndarray], idx, k: int) -> np.ndarray:
    """Sums over the rows that miss none of the features ``idx``."""
    used = sum(1 << i for i in idx)
    got = [g for p, g in sums.items() if not p & used]
    return sum(got[1:], got[0]) if got else np.zeros((k + 2, k + 2))


def _solve(g: np.ndarray, idx) -> np.ndarray | None:
    """Least squares with intercept from pairwise sums; None if singular or without rows."""
    k, n = g.shape[0] - 2, g[0, 0]
    if n < 1:
        return None
    sel = [1 + i for i in idx]
    mean_x, mean_y = g[0, sel] / n, g[0, k + 1] / n
    cxx = g[np.ix_(sel, sel)] - n * np.outer(mean_x, mean_x)
    cxy = g[sel, k + 1] - n * mean_x * mean_y
    d = np.sqrt(np.clip(np.diag(cxx), 0, None))
    # the sums are of centred values: what is left of a constant column is rounding
    if np.any(d <= 1e-7 * np.sqrt(np.clip(np.diag(g)[sel], 0, None))) or not d.all():
        return None
    a = cxx / np.outer(d, d)
    if np.linalg.cond(a) > 1e12:
        return None
    beta = np.linalg.solve(a, cxy / d) / d
    return np.r_[mean_y - beta @ mean_x, beta]


def _sse(g: np.ndarray, idx, coef: np.ndarray) -> tuple[float, float, float]:
    """(SSE, SST, n) of the linear predictor ``coef`` on the rows summarized by ``g``."""
    k = g.shape[0] - 2
    sel = [0] + [1 + i for i in idx]
    sse = g[k + 1, k + 1] - 2 * coef @ g[sel, k + 1] + coef @ g[np.ix_(sel, sel)] @ coef
    n = g[0, 0]
    return max(sse, 0.0), g[k + 1, k + 1] - g[0, k + 1] ** 2 / n if n else 0.0, n


SCORE_SCHEMA = T.StructType([
    T.StructField("subset_id", T.StringType()), T.StructField("n_features", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("dense", T.ArrayType(T.DoubleType())),
    T.StructField("used", T.LongType()), T.StructField("n_train", T.LongType()), T.StructField("n_val", T.LongType()),
    T.StructField("r2_train", T.DoubleType()), T.StructField("r2_val", T.DoubleType()),
    T.StructField("rmse_val", T.DoubleType()), T.StructField("status", T.StringType())])


def score_subsets(subs: DataFrame, sums: dict, k: int) -> DataFrame:
    """Exact linear fit per subset; ``dense`` holds the intercept and one coefficient per
    candidate (0 if not in the subset) on centred features, ``used`` the bits of its features."""
    bc = subs.sparkSession.sparkContext.broadcast((sums["train"], sums["val"]))  # bounded by MAX_GRAM_BYTES

    def run(batches):
        train, val = bc.value
        for pdf in batches:
            out = []
            for sid, idx, feats, nf in zip(pdf["subset_id"], pdf["idx"], pdf["features"], pdf["n_features"]):
                idx = [int(i) for i in idx]
                gt, gv = complete(train, idx, k), complete(val, idx, k)
                used, n = sum(1 << i for i in idx), (round(gt[0, 0]), round(gv[0, 0]))
                coef = _solve(gt, idx)
                if coef is None:
                    out.append((sid, int(nf), list(feats), None, used, *n, None, None, None, "singular"))
                    continue
                sse_t, sst_t, _ = _sse(gt, idx, coef)
                sse_v, sst_v, n_v = _sse(gv, idx, coef)
                dense = np.zeros(k + 1)
                dense[[0, *(i + 1 for i in idx)]] = coef
                out.append((sid, int(nf), list(feats), dense.tolist(), used, *n, 1 - sse_t / sst_t if sst_t > 0 else None,
                            1 - sse_v / sst_v if sst_v > 0 else None, float(np.sqrt(sse_v / n_v)) if n_v else None, "ok"))
            yield pd.DataFrame(out, columns=[f.name for f in SCORE_SCHEMA.fields])

    return subs.mapInPandas(run, SCORE_SCHEMA)


#: How a prediction of the target goes back to a price.
BACK = {"expm1": np.expm1, "exp": np.exp, "raw": lambda z: z}


def test_scores(packed: DataFrame, scores: DataFrame, k: int, mean_y: float, back: str = "expm1", split: str = "test",
                block_subsets: int = BLOCK_SUBSETS) -> DataFrame:
    """subset_id, n_test, mae_test, r2_test in price space, for every solved subset on its complete rows."""
    solved = scores.where(F.col("status") == "ok")
    # blocks by hash: about half full on average, so a block stays near its size at any number of subsets
    n_solved = solved.count()
    blocks = max(1, -(-n_solved // (block_subsets // 2)))
    models = (solved.select("subset_id", "dense", "used", F.pmod(F.xxhash64("subset_id"), F.lit(blocks)).cast("int").alias("block"))
              .groupBy("block").agg(F.collect_list(F.struct("subset_id", "dense", "used")).alias("m")))
    on = ["block"]
    if n_solved <= BROADCAST_SUBSETS:
        # the rows stay where they are: on salts, a fixed number of tasks would share them, however many they are
        models = F.broadcast(models)
    else:
        models, on = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["block", "salt"]
    rows = packed.where(F.col("split") == split).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    out = "subset_id string, n long, err double, sse double, s double, ss double"
    name = back

    def run(batches):
        held: dict = {}
        for b in batches:
            for block, n, raw, m in zip(*(b.column(i) for i in range(4))):
                block = block.as_py()
                if block not in held:
                    m = m.as_py()
                    dense = np.array([r["dense"] for r in m])
                    miss = np.array([[r["used"] >> i & 1 for i in range(k)] for r in m], float)
                    held[block] = ([r["subset_id"] for r in m], dense, miss, np.zeros((5, len(m))))
                _, dense, miss, total = held[block]
                x = np.frombuffer(raw.as_buffer()).reshape(n.as_py(), k + 2)
                gaps = np.isnan(x[:, :k])
                price = x[:, k + 1]
                z = np.where(gaps, 0.0, x[:, :k]) @ dense[:, 1:].T + dense[:, 0] + mean_y
                miss_price = price[:, None] - BACK[name](z)
                ok = np.ones_like(miss_price) if not gaps.any() else ((gaps.astype(float) @ miss.T) == 0).astype(float)
                total += np.stack([ok.sum(axis=0), (np.abs(miss_price) * ok).sum(axis=0), (miss_price ** 2 * ok).sum(axis=0),
                                   (price[:, None] * ok).sum(axis=0), (price[:, None] ** 2 * ok).sum(axis=0)])
        for ids, _, _, t in held.values():
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(t[0].astype(np.int64)), *(pa.array(t[i]) for i in range(1, 5))], ["subset_id", "n", "err", "sse", "s", "ss"])

    got = rows.join(models, on).select("block", "n", "x", "m").mapInArrow(run, out)
    n = F.sum("n")
    sst = F.sum("ss") - F.sum("s") * F.sum("s") / n
    return got.groupBy("subset_id").agg(n.alias("n_test"), (F.sum("err") / F.when(n > 0, n)).alias("mae_test"),
                                        F.when(sst > 0, 1 - F.sum("sse") / sst).alias("r2_test"))


def prepare(rows: DataFrame, cols, y: str, price: str, *, min_non_null: int = 100, limit: int | None = None,
            require_one_of=None, fill: float | None = None, only=None) -> dict:
    """What every subset's fit needs, made once: candidates, packed rows, pairwise sums, mean of y.
    ``fill`` replaces missing features (E12) once candidates are counted; without it each subset
    takes the rows that miss none of its features (T9).  ``only`` (T10) takes ``cols`` as they are."""
    counts, means = profile(rows, cols, y)
    feats = list(cols) if only is not None else restrict([c for c in cols if counts[c] > min_non_null], require_one_of)[:limit]
    if fill is not None:
        rows = rows.select([F.coalesce(F.col(c).cast("double"), F.lit(float(fill))).alias(c) if c in feats else F.col(c) for c in rows.columns])
    packed = pack(rows, feats, y, price, means)
    return {"features": feats, "packed": packed, "sums": gram(packed, len(feats)), "mean_y": means[y], "means": means}


def fits(prepared: dict, subs: DataFrame, back: str = "expm1", block_subsets: int = BLOCK_SUBSETS) -> DataFrame:
    """subset_id, n_features, features, n_train, n_val, r2_train, r2_val, rmse_val, n_test, mae_test,
    r2_test, status of the given subsets."""
    k = len(prepared["features"])
    scores = materialize(score_subsets(subs, prepared["sums"], k))
    tests = test_scores(prepared["packed"], scores, k, prepared["mean_y"], back, block_subsets=block_subsets)
    return scores.join(tests, "subset_id", "left").drop("dense", "used")


def search(rows: DataFrame, cols, y: str, price: str, *, back: str = "expm1", min_size: int = 1, max_size: int = 4, only=None,
           require_one_of=None, block_subsets: int = BLOCK_SUBSETS, choose=None, **options) -> DataFrame:
    """``fits`` of every subset of the qualified candidates (see ``prepare``) or of the
    one subset ``only``.  ``require_one_of`` (P26) keeps subsets that hold one of the named features,
    ``choose`` filters the subset table (resume)."""
    ready = prepare(rows, cols, y, price, only=only, require_one_of=require_one_of, **options)
    spark, feats = rows.sparkSession, ready["features"]
    subs = given_subset(spark, feats, only) if only is not None else subsets(spark, feats, min_size, max_size)
    if require_one_of:
        subs = containing(subs, require_one_of)
    return fits(ready, choose(subs) if choose else subs, back, block_subsets)


def top_per_size(scores: DataFrame, metric: str = "mae_test", k: int = 10, descending: bool = False,
                 sizes=None) -> DataFrame:
    """Best ``k`` subsets per feature count.

    One ``orderBy().limit(k)`` per size (TakeOrdered: partial top-k per
    partition, then a merge of k rows each) instead of a window over a size
    partition that may hold millions of subsets; ranks are numbered on the
    k-row result.
    """
    o = F.desc_nulls_last(metric) if descending else F.asc_nulls_last(metric)
    if sizes is None:
        sizes = [r[0] for r in scores.select("n_features").distinct().collect()]  # a handful of sizes
    out = None
    for n in sorted(sizes):
        part = scores.where(F.col("n_features") == n).orderBy(o, F.asc("subset_id")).limit(k)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("n_features").orderBy(o, F.asc("subset_id"))  # ≤ k rows per partition
    return out.withColumn("rank", F.row_number().over(w))


def summary_by_size(scores: DataFrame, metric: str = "mae_test") -> DataFrame:
    """Best (lowest, and which subset), worst, mean and count per feature count."""
    best = F.when(F.col(metric).isNotNull(), F.struct(metric, "subset_id"))
    return scores.groupBy("n_features").agg(F.min(metric).alias("best"), F.min(best)["subset_id"].alias("best_subset"),
                                            F.max(metric).alias("worst"), F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n_models"),
                                            F.sum((F.col("status") != "ok").cast("int")).alias("n_failed"))


def feature_presence(scores: DataFrame, metric: str = "mae_test", top: int = 100) -> DataFrame:
    """Share of the top K = min(``top``, n) solved models (lowest ``metric``) that contain each feature."""
    best = scores.where(F.col(metric).isNotNull()).orderBy(F.asc(metric), F.asc("subset_id")).limit(top)
    n = F.sum(F.lit(1)).over(Window.partitionBy())  # at most ``top`` rows
    each = best.withColumn("__k", n).select("__k", F.explode("features").alias("feature"))
    return (each.groupBy("feature").agg(F.count(F.lit(1)).alias("n_in_top"), F.max("__k").alias("__k"))
            .select("feature", "n_in_top", (F.col("n_in_top") / F.col("__k")).alias("share")))


def ranked(scores: DataFrame, metric: str = "mae_test", parts: int | None = None) -> DataFrame:
    """Results in order of ``metric`` (range-partitioned sort), failed subsets last."""
    return scores.orderBy(F.asc_nulls_last(metric), F.asc("subset_id"))


def remaining(subs: DataFrame, done: DataFrame) -> DataFrame:
    """Subsets without a stored result (anti join on the subset id)."""
    return subs.join(done.select("subset_id"), "subset_id", "left_anti")


# ---------------------------------------------------------------------------
# Results in batches under a manifest
# ---------------------------------------------------------------------------

def batch_of(batches: int):
    """Batch of a subset: a hash of its id, so a replay deals the same subsets."""
    return F.pmod(F.xxhash64("subset_id", F.lit(17)), F.lit(batches)).cast("int")


class ResultStore:
    """Search results below ``path``: one folder per batch attempt and a manifest of those that count.

    ``write`` puts a batch into a folder of its own and then a mark (batch id, folder, number of
    rows) into ``manifest``; only marked folders are read, and of several marks of one
    batch the smallest folder name.  A batch that was cut off, or written twice by a replay, adds
    nothing.
    """

    MARKS = "batch int, folder string, n_rows long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self, name: str) -> bool:
        jvm, p = self.spark._jvm, f"{self.path}/{name}"
        h = jvm.org.apache.hadoop.fs.Path(p)
        return h.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(h)

    def marks(self) -> DataFrame:
        """batch, folder, n_rows of the batches that count (one row each)."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], self.MARKS)
        m = self.spark.read.schema(self.MARKS).parquet(f"{self.path}/manifest")
        return m.groupBy("batch").agg(F.min(F.struct("folder", "n_rows")).alias("m")).select("batch", "m.folder", "m.n_rows")

    def write(self, batch: int, results: DataFrame, commit: bool = True) -> None:
        """One batch; ``commit=False`` stops before the mark, as a crash would."""
        import uuid
        folder = f"batch={batch}-{uuid.uuid4().hex}"
        results.write.parquet(f"{self.path}/{folder}")
        if commit:
            n = self.spark.read.parquet(f"{self.path}/{folder}").count()
            row = self.spark.range(1, numPartitions=1).select(F.lit(batch).cast("int").alias("batch"), F.lit(folder).alias("folder"), F.lit(n).cast("long").alias("n_rows"))
            row.write.mode("append").parquet(f"{self.path}/manifest")

    def results(self, schema) -> DataFrame:
        folders = [r["folder"] for r in self.marks().collect()]  # one row a batch
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def progress(self, total: int) -> DataFrame:
        """n_batches, n_done, n_total, percent."""
        return self.marks().agg(F.count(F.lit(1)).alias("n_batches"), F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_done")).select(
            "n_batches", "n_done", F.lit(total).cast("long").alias("n_total"), (100.0 * F.col("n_done") / F.lit(max(total, 1))).alias("percent"))


def search_in_batches(store: ResultStore, batches: int, score, stop_before: int | None = None) -> int:
    """``score(batch)`` for every batch the store does not hold; returns how many were run.
    ``stop_before`` leaves off before that batch."""
    done = {r["batch"] for r in store.marks().collect()}  # one row a batch
    todo = [b for b in range(batches) if b not in done and (stop_before is None or b < stop_before)]
    for b in todo:
        store.write(b, score(b))
    return len(todo)
