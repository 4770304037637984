"""Queries: encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from comparo.operators import encode as E
from comparo.operators import split as S
from comparo.plans.common import SPLIT_SQL, cut_frame, priced, rnd, split_frame, with_sql
from comparo.plans.registry import query



def _train():
    return F.col("split") == "train"


@query("label_encode", sql=with_sql(SPLIT_SQL, """
c1 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS type_code
       FROM (SELECT DISTINCT coalesce(type_dwel, 'Unknown') AS v FROM spl)),
c2 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS complex_code
       FROM (SELECT DISTINCT coalesce(complex, 'Unknown') AS v FROM spl))
SELECT sale_key, type_code, complex_code
FROM spl JOIN c1 ON coalesce(type_dwel, 'Unknown') = c1.v JOIN c2 ON coalesce(complex, 'Unknown') = c2.v"""))
def label_encode(spark, sf_dir):
    """Alphabetical codes, NULL → 'Unknown'."""
    p = E.label_codes(priced(spark, sf_dir), "type_dwel", out="type_code")
    p = E.label_codes(p, "complex", out="complex_code")
    return p.select("sale_key", "type_code", "complex_code")


@query("onehot_top20", sql=with_sql(SPLIT_SQL, """
top AS (SELECT complex FROM spl WHERE split = 'train' AND complex IS NOT NULL
        GROUP BY complex ORDER BY count(*) DESC, complex LIMIT 20)
SELECT sale_key, top.complex AS complex_hot
FROM spl LEFT JOIN top ON spl.complex = top.complex"""))
def onehot_top20(spark, sf_dir):
    """Hot value among the 20 most frequent train values (NULL = all-zero row)."""
    s = cut_frame(spark, sf_dir, ["complex"])
    top = E.top_values(s.where(_train()), "complex", 20)
    return E.map_to_vocab(s, "complex", top, "complex_hot", small=True).select("sale_key", "complex_hot")


@query("onehot_min_freq_other", sql=with_sql(SPLIT_SQL, """
keep AS (SELECT partkey FROM spl WHERE split = 'train' GROUP BY partkey HAVING count(*) >= 30)
SELECT sale_key, CASE WHEN keep.partkey IS NOT NULL THEN CAST(spl.partkey AS VARCHAR) ELSE '__OTHER__' END AS address_bin
FROM spl LEFT JOIN keep ON spl.partkey = keep.partkey"""))
def onehot_min_freq_other(spark, sf_dir):
    """Addresses with ≥ 30 train rows kept, the rest binned to '__OTHER__'."""
    s = cut_frame(spark, sf_dir, ["partkey"]).withColumn("address", F.col("partkey").cast("string"))
    keep = E.frequent_values(s.where(_train()), "address", 30)
    return E.map_to_vocab(s, "address", keep, "address_bin", other="__OTHER__").select("sale_key", "address_bin")


@query("te_ordered", sql=with_sql(SPLIT_SQL, """
tr AS (SELECT sale_key, complex, day, seq,
              sum(y) OVER w AS cs, count(*) OVER w AS cc
       FROM spl WHERE split = 'train'
       WINDOW w AS (PARTITION BY complex ORDER BY day, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT avg(y) AS gm FROM spl WHERE split = 'train'),
te AS (SELECT sale_key, complex, day, seq, coalesce(cs / NULLIF(cc, 0), gm) AS te FROM tr, g),
last AS (SELECT complex, arg_max(te, (day, seq)) AS last_te FROM te GROUP BY complex)
SELECT sale_key, round(1e-9 + te, 6) AS complex_te FROM te
UNION ALL
SELECT s.sale_key, round(1e-9 + coalesce(l.last_te, g.gm), 6) FROM spl s LEFT JOIN last l USING (complex), g
WHERE s.split <> 'train'"""))
def te_ordered(spark, sf_dir):
    """Expanding mean of earlier train rows per category; val/test take the last train value."""
    s = E.ordered_te(cut_frame(spark, sf_dir, ["complex", "y"]), "complex", "y", _train())
    return s.select("sale_key", rnd("complex_te").alias("complex_te"))


_KF = SPLIT_SQL + """,
kf AS (SELECT spl.*, CAST(('0x' || substr(md5(sale_key || '|42'), 1, 8))::BIGINT % 5 AS INTEGER) AS fold FROM spl),
tr AS (SELECT * FROM kf WHERE split = 'train'),
g AS (SELECT sum(y) AS s, count(y) AS n FROM tr),
cf AS (SELECT complex, fold, sum(y) AS s_cf, count(y) AS n_cf FROM tr GROUP BY 1, 2),
c AS (SELECT complex, sum(y) AS s_c, count(y) AS n_c FROM tr GROUP BY 1),
f AS (SELECT fold, sum(y) AS s_f, count(y) AS n_f FROM tr GROUP BY 1)"""


@query("te_kfold", sql=with_sql(_KF, """
SELECT tr.sale_key, round(1e-9 + coalesce(CASE WHEN c.n_c - coalesce(cf.n_cf, 0) > 0
                    THEN (c.s_c - coalesce(cf.s_cf, 0)) / (c.n_c - coalesce(cf.n_cf, 0)) END,
                  (g.s - f.s_f) / (g.n - f.n_f)), 6) AS complex_te
FROM tr JOIN c USING (complex) LEFT JOIN cf USING (complex, fold) JOIN f USING (fold), g
UNION ALL
SELECT kf.sale_key, round(1e-9 + coalesce(c.s_c / c.n_c, g.s / g.n), 6)
FROM kf LEFT JOIN c USING (complex), g WHERE kf.split <> 'train'"""))
def te_kfold(spark, sf_dir):
    """Shuffled 5-fold target encoding by subtraction, unsmoothed."""
    s = S.kfold_hash(cut_frame(spark, sf_dir, ["complex", "y"]))
    return E.kfold_te(s, "complex", "y", "fold", _train()).select("sale_key", rnd("complex_te").alias("complex_te"))


_KFC = SPLIT_SQL + """,
s80 AS (SELECT *, CASE WHEN pos <= floor(0.8 * n_all) THEN 'train' ELSE 'test' END AS split80 FROM spl),
t AS (SELECT *, count(*) OVER () AS n_tr FROM s80 WHERE split80 = 'train'),
ff AS (SELECT *, n_tr // 5 AS q, n_tr % 5 AS r FROM t),
tr AS (SELECT *, CAST(CASE WHEN pos - 1 < r * (q + 1) THEN (pos - 1) // (q + 1)
                           ELSE r + (pos - 1 - r * (q + 1)) // q END AS INTEGER) AS fold FROM ff),
g AS (SELECT sum(y) / count(y) AS gm FROM tr),
cf AS (SELECT fsa, fold, sum(y) AS s_cf, count(y) AS n_cf FROM tr GROUP BY 1, 2),
c AS (SELECT fsa, sum(y) AS s_c, count(y) AS n_c FROM tr GROUP BY 1),
o AS (SELECT tr.sale_key, c.n_c - coalesce(cf.n_cf, 0) AS n_o, c.s_c - coalesce(cf.s_cf, 0) AS s_o
      FROM tr JOIN c USING (fsa) LEFT JOIN cf USING (fsa, fold))"""


@query("te_kfold_shrunk", sql=with_sql(_KFC, """
SELECT o.sale_key, round(1e-9 + CASE WHEN n_o > 0 THEN n_o / (n_o + 10.0) * (s_o / n_o) + (1 - n_o / (n_o + 10.0)) * gm END, 6)
       AS fsa_te
FROM o, g
UNION ALL
SELECT s80.sale_key, round(1e-9 + coalesce(c.n_c / (c.n_c + 10.0) * (c.s_c / c.n_c) + (1 - c.n_c / (c.n_c + 10.0)) * gm, gm), 6)
FROM s80 LEFT JOIN c USING (fsa), g WHERE s80.split80 = 'test'"""))
def te_kfold_shrunk(spark, sf_dir):
    """Contiguous 5-fold FSA encoding with shrinkage n/(n+10) over the 80% train."""
    s = S.temporal_split(priced(spark, sf_dir).withColumn("y", F.log("ppsf")), (0.8,), ("train", "test"))
    tr = s.where(_train())
    n = tr.count()
    s = S.kfold_contiguous(s, n).withColumn("fold", F.when(_train(), F.col("fold")))
    return E.kfold_te(s, "fsa", "y", "fold", _train(), shrink_k=10.0).select(
        "sale_key", rnd("fsa_te").alias("fsa_te"))


@query("te_time_series", sql=with_sql(SPLIT_SQL, """
t AS (SELECT *, count(*) OVER () AS n_tr FROM spl WHERE split = 'train'),
p AS (SELECT *, least(5, greatest(2, n_tr // 1000)) AS s FROM t),
q AS (SELECT *, n_tr - s * (n_tr // (s + 1)) AS first, n_tr // (s + 1) AS size FROM p),
b AS (SELECT *, CASE WHEN pos <= first THEN 0 ELSE (pos - first - 1) // size + 1 END AS block FROM q),
cb AS (SELECT type_dwel, block, sum(y) AS s_cb, count(y) AS n_cb FROM b GROUP BY 1, 2),
cum AS (SELECT type_dwel, block,
               sum(s_cb) OVER (PARTITION BY type_dwel ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s_prev,
               sum(n_cb) OVER (PARTITION BY type_dwel ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_prev
        FROM cb),
bb AS (SELECT block, sum(s_cb) AS s_b, sum(n_cb) AS n_b FROM cb GROUP BY 1),
pr AS (SELECT block, sum(s_b) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                   / sum(n_b) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM bb),
g AS (SELECT avg(y) AS gm FROM b),
fullc AS (SELECT type_dwel, sum(s_cb) AS s_c, sum(n_cb) AS n_c FROM cb GROUP BY 1)
SELECT b.sale_key, round(1e-9 + CASE WHEN b.block = 0 THEN NULL
                              ELSE coalesce((cum.s_prev + 50.0 * pr.prior) / (cum.n_prev + 50.0), pr.prior) END, 6)
       AS type_dwel_te
FROM b LEFT JOIN cum USING (type_dwel, block) LEFT JOIN pr USING (block)
UNION ALL
SELECT spl.sale_key, round(1e-9 + coalesce((fullc.s_c + 50.0 * g.gm) / (fullc.n_c + 50.0), g.gm), 6)
FROM spl LEFT JOIN fullc USING (type_dwel), g WHERE spl.split <> 'train'"""))
def te_time_series(spark, sf_dir):
    """Expanding-block encoding with smoothing m = 50 (prior = earlier blocks' mean)."""
    s = split_frame(spark, sf_dir, columns=["sale_key", "type_dwel"])
    tr = s.where(_train())
    n = tr.count()
    s = S.time_series_blocks(s, n)[0].withColumn("block", F.when(_train(), F.col("block")))
    return E.time_series_te(s, "type_dwel", "y", "block", _train(), 50.0).select(
        "sale_key", rnd("type_dwel_te").alias("type_dwel_te"))


@query("standardize", sql=with_sql(SPLIT_SQL, """
st AS (SELECT avg(area) AS ma, stddev_pop(area) AS sa, avg(list_price) AS ml, stddev_pop(list_price) AS sl
       FROM spl WHERE split = 'train')
SELECT sale_key, round(1e-9 + (area - ma) / sa, 6) AS area_z, round(1e-9 + (list_price - ml) / sl, 6) AS list_price_z
FROM spl, st"""))
def standardize(spark, sf_dir):
    """Z-scores with train mean and population sd."""
    s = E.standardize(cut_frame(spark, sf_dir, ["area", "list_price"]), ["area", "list_price"], _train())
    return s.select("sale_key", rnd("area_z").alias("area_z"), rnd("list_price_z").alias("list_price_z"))


@query("onehot_all_values", sql=with_sql(SPLIT_SQL, """
voc AS (SELECT DISTINCT coalesce(title, 'NA') AS v FROM spl WHERE split = 'train')
SELECT sale_key, voc.v AS title_hot
FROM spl LEFT JOIN voc ON coalesce(spl.title, 'NA') = voc.v"""))
def onehot_all_values(spark, sf_dir):
    """vocabulary = every train value (NULL → 'NA'); unseen values → all-zero row (NULL)."""
    s = cut_frame(spark, sf_dir, ["title"]).withColumn("title_na", F.coalesce(F.col("title"), F.lit("NA")))
    voc = s.where(_train()).select("title_na").distinct()
    return E.map_to_vocab(s, "title_na", voc, "title_hot").select("sale_key", "title_hot")


_BLOCKS = (("complex", {"na": "NA"}, {}), ("type_dwel", {}, {"top": 20}), ("partkey", {}, {"min_count": 30}), ("suppkey", {"other": "__OTHER__"}, {"min_count": 30}))


def _blocks_sql():
    parts, rows, offset = [], [], "0"
    for i, (col, how, fit) in enumerate(_BLOCKS):
        v = f"coalesce(CAST({col} AS VARCHAR), 'NA')" if "na" in how else f"CAST({col} AS VARCHAR)"
        pick = f"ORDER BY count(*) DESC, v LIMIT {fit['top']}" if "top" in fit else f"HAVING count(*) >= {fit['min_count']}" if "min_count" in fit else ""
        parts.append(f"""k{i} AS (SELECT {v} AS v FROM spl WHERE split = 'train' AND {v} IS NOT NULL GROUP BY v {pick}),
v{i} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS idx FROM k{i}{" UNION ALL SELECT '__OTHER__', count(*) FROM k" + str(i) if "other" in how else ""})""")
        at = f"coalesce(v{i}.idx, (SELECT max(idx) FROM v{i}))" if "other" in how else f"v{i}.idx"
        rows.append(f"SELECT sale_key, CAST({at} + {offset} AS INTEGER) AS idx FROM spl {'LEFT ' if 'other' in how else ''}JOIN v{i} ON {v} = v{i}.v")
        offset += f" + (SELECT count(*) FROM v{i})"
    return with_sql(SPLIT_SQL, ",\n".join(parts) + f"""
SELECT sale_key, CAST({offset} AS INTEGER) AS width, idx, 1.0 AS value FROM ({' UNION ALL '.join(rows)})""")


@query("onehot_blocks", sql=_blocks_sql())
def onehot_blocks(spark, sf_dir):
    """Four blocks (all values, top 20, 30 rows or more, the same with an other bin) in one sparse
    row of fixed width, aligned to train; one result row per set entry."""
    s = cut_frame(spark, sf_dir, [c for c, _, _ in _BLOCKS])
    specs = [(c, E.vocabulary(s.where(_train()), c, **how, **fit), how) for c, how, fit in _BLOCKS]
    t = E.one_hot(s, specs).select("sale_key", F.col("onehot.size").alias("width"), F.explode(F.arrays_zip("onehot.indices", "onehot.values")).alias("e"))
    return t.select("sale_key", "width", F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
