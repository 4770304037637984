"""Queries: feature-subset search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from comparo.operators import search as S
from comparo.operators.split import cut_split
from comparo.plans.common import PRICED_SQL, SPLIT_SQL, priced, rnd, with_sql
from comparo.plans.registry import query
from comparo.session import materialize, scratch_path

# The candidate catalogue in its order (list_price is left out:
# a hard exclude, T8).
CATALOGUE = ("area", "bedrooms", "floors", "yr_blt", "full_baths", "half_baths", "maint_fee",
             "discount", "tax", "linenumber")
MIN_SIZE, MAX_SIZE = 1, 4


def _frame(spark, sf_dir, fractions=(0.7, 0.8), names=("train", "val", "test")):
    """Split, features (NULLs kept), price and its log1p: only what the search reads.  Written once and compared with the
    rows at the cuts: no task sorts or numbers rows."""
    p = materialize(priced(spark, sf_dir).select("day", "seq", "sold_price", *CATALOGUE))
    return cut_split(p, fractions, names).drop("day").withColumn("y", F.log1p("sold_price"))


def _subsets(spark, sf_dir):
    feats = S.candidate_features(priced(spark, sf_dir), CATALOGUE, 100)
    return S.subsets(spark, feats, MIN_SIZE, MAX_SIZE), feats


def _subsets_sql():
    counts = ", ".join(f"count({c}) AS {c}" for c in CATALOGUE)
    order = ", ".join(f"('{c}', {i})" for i, c in enumerate(CATALOGUE))
    parts = [f"""cnt AS (UNPIVOT (SELECT {counts} FROM priced) ON {', '.join(CATALOGUE)} INTO NAME fname VALUE nn),
cat AS (SELECT * FROM (VALUES {order}) v(fname, cpos)),
f AS (SELECT CAST(row_number() OVER (ORDER BY cpos) - 1 AS INTEGER) AS fid, fname
      FROM cnt JOIN cat USING (fname) WHERE nn > 100),
s1 AS (SELECT CAST(fid AS VARCHAR) AS subset_id, fname AS features_text, fid AS last, 1 AS n_features, [fid] AS idx FROM f)"""]
    for k in range(2, MAX_SIZE + 1):
        parts.append(f"""s{k} AS (SELECT s.subset_id || ',' || f.fid AS subset_id,
        s.features_text || ',' || f.fname AS features_text, f.fid AS last, {k} AS n_features, list_append(s.idx, f.fid) AS idx
        FROM s{k - 1} s JOIN f ON f.fid > s.last)""")
    union = " UNION ALL ".join(f"SELECT subset_id, features_text, n_features, idx FROM s{k}"
                               for k in range(MIN_SIZE, MAX_SIZE + 1))
    parts.append(f"subs AS ({union})")
    return PRICED_SQL + ",\n" + ",\n".join(parts)


SUBSETS_SQL = _subsets_sql()


@query("subsets_1_to_4", sql=with_sql(SUBSETS_SQL, """
SELECT subset_id, features_text, CAST(n_features AS INTEGER) AS n_features FROM subs"""))
def subsets_1_to_4(spark, sf_dir):
    """All subsets of sizes 1-4 of the data-qualified candidates, generated by joins."""
    subs, _ = _subsets(spark, sf_dir)
    return subs.select("subset_id", F.concat_ws(",", "features").alias("features_text"), "n_features")


@query("subset_counts", sql=with_sql(SUBSETS_SQL, """
SELECT CAST(n_features AS INTEGER) AS n_features, count(*) AS n_subsets,
       sum(count(*)) OVER () AS n_total FROM subs GROUP BY n_features"""))
def subset_counts(spark, sf_dir):
    """Subsets per size and in total."""
    from pyspark.sql import Window
    subs, _ = _subsets(spark, sf_dir)
    c = subs.groupBy("n_features").agg(F.count(F.lit(1)).alias("n_subsets"))
    return c.withColumn("n_total", F.sum("n_subsets").over(Window.partitionBy()))  # ≤ 4 rows



def scored(spark, sf_dir, **options):
    """Scores of all subsets (NULL features count as 0, E12): exact train, validation and price-space
    test figures; MAE rounded, so that subsets that span the same space tie."""
    t = S.search(_frame(spark, sf_dir), CATALOGUE, "y", "sold_price", fill=0.0, min_size=MIN_SIZE, max_size=MAX_SIZE, **options)
    return t.withColumn("mae_test", rnd("mae_test", 4))


def _fits_sql(y: str, back: str, size: int, fill: bool, frame: str) -> str:
    """CTEs that score every subset of ``subs`` from the rows: least squares on at most four features by
    elimination on their correlations, then errors of each row.  ``frame``: CTE with split, price, y and
    the list xs of features."""
    v = [f"xs[idx[{t}] + 1]" for t in range(1, size + 1)]
    whole = " AND ".join(f"(n_features < {t} OR {x} IS NOT NULL)" for t, x in enumerate(v, 1))
    pairs = [(i, j) for i in range(1, size + 1) for j in range(1, i)]
    stats = ", ".join([f"stddev_pop(v{t}) AS s{t}, avg(v{t}) AS m{t}, covar_pop(v{t}, y) AS cy{t}" for t in range(1, size + 1)]
                      + [f"covar_pop(v{i}, v{j}) AS c{i}{j}" for i, j in pairs])
    steps = []
    for t in range(1, size + 1):
        for j in range(1, t):
            less = "".join(f" - l{t}{m} * l{j}{m} * d{m}" for m in range(1, j))
            steps.append(f"(CASE WHEN n_features < {t} THEN 0 ELSE c{t}{j} / (s{t} * s{j}) END{less}) / d{j} AS l{t}{j}")
        less = "".join(f" - l{t}{m} * l{t}{m} * d{m}" for m in range(1, t))
        steps.append(f"CASE WHEN n_features < {t} THEN 1 WHEN s{t} < 1e-9 THEN NULL ELSE nullif(greatest(1.0{less} - 1e-10, 0), 0) + 1e-10 END AS d{t}")
        less = "".join(f" - l{t}{m} * z{m}" for m in range(1, t))
        steps.append(f"CASE WHEN n_features < {t} THEN 0 ELSE cy{t} / s{t} END{less} AS z{t}")
    for t in range(size, 0, -1):
        less = "".join(f" - l{m}{t} * g{m}" for m in range(t + 1, size + 1))
        steps.append(f"z{t} / d{t}{less} AS g{t}")
    steps += [f"CASE WHEN n_features < {t} THEN 0 ELSE g{t} / s{t} END AS b{t}" for t in range(1, size + 1)]
    steps.append("my" + "".join(f" - b{t} * coalesce(m{t}, 0)" for t in range(1, size + 1)) + " AS b0")
    pred = "b0" + "".join(f" + b{t} * coalesce(v{t}, 0)" for t in range(1, size + 1))
    vs = ", ".join(f"{x} AS v{t}" for t, x in enumerate(v, 1))
    return f"""seen AS (SELECT s.*, split, price, {y} AS y, {vs} FROM {frame} r, subs s WHERE {whole}),
st AS (SELECT subset_id, any_value(n_features) AS n_features, count(*) AS n_train, avg(y) AS my, {stats} FROM seen WHERE split = 'train' GROUP BY subset_id),
fit AS (SELECT *, {', '.join(steps)} FROM st),
err AS (SELECT seen.subset_id, split, price, y, {pred} AS z FROM seen JOIN fit USING (subset_id)),
sc AS (SELECT subset_id, 1 - sum((y - z) ** 2) FILTER (split = 'train') / (var_pop(y) FILTER (split = 'train') * count(*) FILTER (split = 'train')) AS r2_train,
  1 - sum((y - z) ** 2) FILTER (split = 'val') / (var_pop(y) FILTER (split = 'val') * count(*) FILTER (split = 'val')) AS r2_val,
  sqrt(avg((y - z) ** 2) FILTER (split = 'val')) AS rmse_val,
  count(*) FILTER (split = 'test' AND z IS NOT NULL) AS n_test, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
  avg(abs(price - {back})) FILTER (split = 'test') AS mae_test,
  1 - sum((price - {back}) ** 2) FILTER (split = 'test') / (var_pop(price) FILTER (split = 'test') * count(*) FILTER (split = 'test')) AS r2_test FROM err GROUP BY subset_id),
scores AS (SELECT subs.*, n_train, n_val, r2_train, r2_val, rmse_val, CASE WHEN mae_test IS NOT NULL THEN n_test END AS n_test, round(1e-9 + mae_test, 4) AS mae_test, r2_test,
  CASE WHEN mae_test IS NULL THEN 'singular' ELSE 'ok' END AS status FROM subs JOIN sc USING (subset_id))"""


_XS = ", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE)" for c in CATALOGUE)
FRAME_SQL = f"rws AS (SELECT split, sold_price AS price, [{_XS}] AS xs FROM spl)"
_EXP = "(exp(z) - 1)"
_SUBS_ONLY = SUBSETS_SQL[len(PRICED_SQL):]
SCORES_SQL = SPLIT_SQL + _SUBS_ONLY + ",\n" + FRAME_SQL + ",\n" + _fits_sql("ln(1 + price)", _EXP, MAX_SIZE, True, "rws")
_SHOWN = """subset_id, CAST(n_features AS INTEGER) AS n_features, features_text, n_train, n_val, round(1e-9 + r2_train, 6) AS r2_train, round(1e-9 + r2_val, 6) AS r2_val,
 round(1e-9 + rmse_val, 6) AS rmse_val, n_test, mae_test, round(1e-9 + r2_test, 6) AS r2_test, status"""


def _shown(t):
    return t.select("subset_id", "n_features", F.concat_ws(",", "features").alias("features_text"), "n_train", "n_val", rnd("r2_train").alias("r2_train"),
                    rnd("r2_val").alias("r2_val"), rnd("rmse_val").alias("rmse_val"), "n_test", "mae_test", rnd("r2_test").alias("r2_test"), "status")


@query("subset_scores_linear", sql=with_sql(SCORES_SQL, f"SELECT {_SHOWN} FROM scores"))
def subset_scores_linear(spark, sf_dir):
    """Exact linear fit, validation and price-space test figures of every subset."""
    return _shown(scored(spark, sf_dir))


@query("subset_top10_per_size", sql=with_sql(SCORES_SQL, """
SELECT CAST(n_features AS INTEGER) AS n_features, CAST(rank AS INTEGER) AS rank, subset_id, mae_test, round(1e-9 + r2_test, 6) AS r2_test
FROM (SELECT *, row_number() OVER (PARTITION BY n_features ORDER BY mae_test NULLS LAST, subset_id) AS rank FROM scores) WHERE rank <= 10"""))
def subset_top10_per_size(spark, sf_dir):
    """Ten best subsets per size by price-space test MAE."""
    t = S.top_per_size(materialize(scored(spark, sf_dir)), "mae_test", 10, sizes=range(MIN_SIZE, MAX_SIZE + 1))
    return t.select("n_features", "rank", "subset_id", "mae_test", rnd("r2_test").alias("r2_test"))


@query("subset_summary_by_size", sql=with_sql(SCORES_SQL, """
SELECT CAST(n_features AS INTEGER) AS n_features, min(mae_test) AS best, arg_min(subset_id, (mae_test, subset_id)) FILTER (mae_test IS NOT NULL) AS best_subset, max(mae_test) AS worst,
       round(1e-9 + avg(mae_test), 4) AS mean, count(*) AS n_models, count(*) FILTER (status <> 'ok') AS n_failed FROM scores GROUP BY 1"""))
def subset_summary_by_size(spark, sf_dir):
    """T5: best / worst / mean price-space MAE per size."""
    s = S.summary_by_size(scored(spark, sf_dir))
    return s.select("n_features", "best", "best_subset", "worst", rnd("mean", 4).alias("mean"), "n_models", "n_failed")


PRESENCE_SQL = """
top AS (SELECT * FROM scores WHERE mae_test IS NOT NULL ORDER BY mae_test, subset_id LIMIT 100)
SELECT feature, count(*) AS n_in_top, round(1e-9 + count(*) / (SELECT count(*) FROM top), 6) AS share
FROM (SELECT unnest(string_split(features_text, ',')) AS feature FROM top) GROUP BY feature"""


@query("feature_presence_top100", sql=with_sql(SCORES_SQL, PRESENCE_SQL))
def feature_presence_top100(spark, sf_dir):
    """Feature shares among the top min(100, n) subsets by MAE."""
    t = S.feature_presence(scored(spark, sf_dir), "mae_test", 100)
    return t.select("feature", "n_in_top", rnd("share").alias("share"))


_RAW = ", ".join(f"CAST({c} AS DOUBLE)" for c in CATALOGUE)
_HOLDS = " OR ".join(f"list_contains(string_split(features_text, ','), '{c}')" for c in ("maint_fee", "tax"))
COMPLETE_SQL = SPLIT_SQL + _SUBS_ONLY.replace("subs AS (", "every AS (") + f""",
subs AS (SELECT * FROM every WHERE n_features <= 2),
rws AS (SELECT CASE WHEN split = 'test' THEN 'test' ELSE 'train' END AS split, sold_price AS price, [{_RAW}] AS xs FROM spl),
""" + _fits_sql("price", "z", 2, False, "rws")


@query("subset_complete_rows", sql=with_sql(COMPLETE_SQL, f"SELECT {_SHOWN} FROM scores"))
def subset_complete_rows(spark, sf_dir):
    """First ten candidates, sizes 1-2, raw price, 80/20 split; each subset on the rows that miss none of its features."""
    f = _frame(spark, sf_dir, (0.8,), ("train", "test"))
    t = S.search(f.withColumn("y", F.col("sold_price")), CATALOGUE, "y", "sold_price", back="raw", limit=10, min_size=1, max_size=2)
    return _shown(t.withColumn("mae_test", rnd("mae_test", 4)))


@query("subset_given", sql=with_sql(SCORES_SQL, f"SELECT {_SHOWN} FROM scores WHERE features_text = 'area,full_baths,tax'"))
def subset_given(spark, sf_dir):
    """One named subset."""
    t = S.search(_frame(spark, sf_dir), CATALOGUE, "y", "sold_price", fill=0.0, only=("tax", "area", "full_baths"))
    return _shown(t.withColumn("mae_test", rnd("mae_test", 4)))


@query("subset_required_features", sql=with_sql(SCORES_SQL, f"SELECT {_SHOWN} FROM scores WHERE {_HOLDS}"))
def subset_required_features(spark, sf_dir):
    """Only subsets with a maintenance fee or a tax."""
    return _shown(scored(spark, sf_dir, require_one_of=("maint_fee", "tax")))


@query("subset_batches", sql=with_sql(SCORES_SQL, """
r AS (SELECT *, row_number() OVER (ORDER BY mae_test NULLS LAST, subset_id) AS rank, count(*) OVER () AS n_total FROM scores)
SELECT CAST(rank AS INTEGER) AS rank, subset_id, mae_test, 4 AS n_batches, n_total AS n_done, n_total, 100.0 AS percent FROM r WHERE rank <= 100"""))
def subset_batches(spark, sf_dir):
    """Four batches under a manifest, left off after the second, a batch cut off before its mark and
    one written twice; resumed.  Top 100 and the progress record are read from the store."""
    from pyspark.sql import Window
    ready = S.prepare(_frame(spark, sf_dir), CATALOGUE, "y", "sold_price", fill=0.0)
    subs = S.subsets(spark, ready["features"], MIN_SIZE, MAX_SIZE)
    store = S.ResultStore(spark, scratch_path(spark, f"search-batches-{uuid.uuid4().hex}"))

    def score(b):
        t = S.fits(ready, subs.where(S.batch_of(4) == b))
        return t.select("subset_id", "n_features", "features", rnd("mae_test", 4).alias("mae_test"), "status")

    S.search_in_batches(store, 4, score, stop_before=2)
    schema = "subset_id string, n_features int, features array<string>, mae_test double, status string"
    first = store.results(schema)
    store.write(2, first.limit(5), commit=False)  # cut off before its mark: adds nothing
    store.write(1, first.where(S.batch_of(4) == 1))  # a replay: adds nothing
    S.search_in_batches(store, 4, score)
    res, total = store.results(schema), subs.count()
    top = res.orderBy(F.asc_nulls_last("mae_test"), "subset_id").limit(100)
    w = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("mae_test"), "subset_id")  # 100 rows
    done = store.progress(total).first()
    return top.select(F.row_number().over(w).alias("rank"), "subset_id", "mae_test", F.lit(done["n_batches"]).cast("int").alias("n_batches"),
                      F.lit(done["n_done"]).alias("n_done"), F.lit(done["n_total"]).alias("n_total"), F.lit(done["percent"]).alias("percent"))


@query("subset_resume", sql=with_sql(SUBSETS_SQL, """
SELECT CAST(n_features AS INTEGER) AS n_features, count(*) AS n_remaining FROM subs WHERE n_features > 2 GROUP BY 1"""))
def subset_resume(spark, sf_dir):
    """Results of a first run (sizes 1-2) are written to the shared checkpoint folder; the
    resumed run anti-joins the subset table against them and scores none of them again."""
    small = scored(spark, sf_dir, choose=lambda subs: subs.where("n_features <= 2"))
    done = materialize(small.select("subset_id"))
    subs, _ = _subsets(spark, sf_dir)
    return S.remaining(subs, done).groupBy("n_features").agg(F.count(F.lit(1)).alias("n_remaining"))


# The learner kinds compared on a subset.
KINDS = ("gbt", "random_forest", "linear")


@query("subset_model_kinds", sql=with_sql(SUBSETS_SQL, f"""
SELECT subset_id, kind FROM subs, (VALUES {', '.join(f"('{k}')" for k in KINDS)}) v(kind)"""))
def subset_model_kinds(spark, sf_dir):
    """Every subset with every model kind; the kinds are a literal of three, exploded."""
    subs, _ = _subsets(spark, sf_dir)
    return subs.select("subset_id", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
