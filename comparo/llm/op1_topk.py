"""Exact top-k inner-product search with multi-resolution segment statistics.

Vectors become integer vectors floor(scale * x).  To compare, both sides are
turned onto the principal axes of the queries, so that the leading coordinates
carry most of a score.  A level cuts the axes into segments, one for each of its
leading axes and ``REST`` for the others; a segment keeps its mean and deviation
(a single axis has deviation zero).  For two vectors

    q.x = sum over segments of  len * mean_q * mean_x + centred parts
        <= sum over segments of len * (mean_q * mean_x + dev_q * dev_x),

which is the lower bound |q - x|^2 >= sum len * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)
of segment statistics, written for inner products.  The levels run coarse to
fine, each over the queries and candidates that the one before left open, and
add only the products of their new leading axes.  The best candidates by the
finest bound are scored first and set a query's threshold, its k-th score so far;
what still reaches it gets exact products of the integer vectors.

Layout: the stated queries are taken in blocks of bounded bytes; one block is
broadcast at a time and the whole table streams past it without a shuffle.
Every task keeps each query's k best and hands them to a top-k per query.

Nulls: a null id, a null vector, or one holding null or non-finite components
takes no part; only vectors of equal length are compared.  Repeated candidate
rows each take a place; a query id has one vector (the smallest, if rows
differ), and no row with the query's own id is its candidate.  Ties go to the
smaller id.  Empty tables give an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import saved, table

SCALE, K, EVERY = 1024, 10, 100
#: Shares of the axes that a level takes one by one, and segments of the others.
LEVELS, REST = (1 / 16, 1 / 4, 1 / 2, 3 / 4), 4
#: Bytes of the queries of one broadcast block, and vectors compared at once.
BLOCK_BYTES, CHUNK = 32 << 20, 1024
_SCHEMA = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).filter("vec_id is not null and x is not null")
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return d.filter(~F.coalesce(bad, F.lit(True))).select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def principal_axes(v: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the directions of most energy first."""
    f = v / max(float(np.abs(v).max(initial=0)), 1.0)
    return np.linalg.eigh(f.T @ f)[1][:, ::-1]


def leads(width: int) -> list[int]:
    """Leading axes of each level, coarse to fine."""
    return sorted({int(width * share) for share in LEVELS})


def segment_statistics(v: np.ndarray, segments: int = REST) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, both times the root of the segment's length, so
    that a bound is a plain product of matrices."""
    edges = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    mean, dev = np.empty((len(v), len(edges) - 1)), np.empty((len(v), len(edges) - 1))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        s, root = v[:, a:b], np.sqrt(b - a)
        mean[:, i] = s.mean(axis=1) * root
        dev[:, i] = s.std(axis=1) * root
    return mean, dev


class Block:
    """Queries of one length, their statistics, the k best so far, and how many pairs were
    met (``pairs``), left open by each level (``left``) and scored (``scored``)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, axes: np.ndarray):
        self.ids, self.v, self.k, self.axes = ids, v, k, axes
        self.r = v.astype(np.float64) @ axes
        self.leads = leads(v.shape[1])
        self.stats = [segment_statistics(self.r[:, a:]) for a in self.leads]
        self.score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.top = float(np.abs(v).max(initial=0))
        self.pairs, self.left, self.scored = 0, [0] * len(self.leads), 0

    def add(self, qi: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Merge scored pairs into the k best of their queries."""
        if not len(qi):
            return
        touched = np.unique(qi)
        q = np.concatenate([np.repeat(touched, self.k), qi])
        s = np.concatenate([self.score[touched].ravel(), score])
        x = np.concatenate([self.vec[touched].ravel(), vec])
        order = np.lexsort((x, ~s, q))  # ~s: descending without overflow
        q, s, x = q[order], s[order], x[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        self.score[touched] = s[keep].reshape(-1, self.k)
        self.vec[touched] = x[keep].reshape(-1, self.k)

    def exact(self, qi: np.ndarray, xi: np.ndarray, v: np.ndarray) -> np.ndarray:
        if self.top * float(np.abs(v).max(initial=0)) * max(v.shape[1], 1) < 2**62:
            return np.concatenate([np.einsum("ij,ij->i", self.v[qi[a:a + 16384]], v[xi[a:a + 16384]]) for a in range(0, len(qi), 16384)] or [np.empty(0, np.int64)])
        wide = [sum(int(a) * int(b) for a, b in zip(self.v[q], v[x])) for q, x in zip(qi, xi)]
        return np.array([min(max(s, -(2**63) + 1), 2**63 - 1) for s in wide], np.int64)

    def take(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Score what a chunk of candidates can contribute."""
        if not v.shape[1]:
            qi, xi = np.nonzero(self.ids[:, None] != ids[None, :])
            self.add(qi, ids[xi], np.zeros(len(qi), np.int64))
            return
        f = v.astype(np.float64)
        slack = 1e-9 * self.top * float(np.abs(f).max(initial=0)) * v.shape[1] + 1e-6
        r = f @ self.axes
        rows, cols = np.arange(len(self.ids)), np.arange(len(ids))  # with open pairs
        open_ = self.ids[:, None] != ids[None, :]
        self.pairs += int(open_.sum())
        known, done = np.zeros(open_.shape), 0
        for level, (lead, (mq, dq)) in enumerate(zip(self.leads, self.stats)):
            mx, dx = segment_statistics(r[cols, lead:])
            known += self.r[rows, done:lead] @ r[cols, done:lead].T
            bound = known + mq[rows] @ mx.T + dq[rows] @ dx.T + slack
            open_ &= bound >= self.score[rows, -1:].astype(np.float64)
            self.left[level] += int(open_.sum())
            i, j = open_.any(axis=1), open_.any(axis=0)
            if not i.any():
                return
            if not (i.all() and j.all()):
                rows, cols, sub = rows[i], cols[j], np.ix_(i, j)
                known, bound, open_ = known[sub], bound[sub], open_[sub]
            done = lead
        bound[~open_] = -np.inf
        n = min(self.k, len(cols))
        best = np.argpartition(-bound, n - 1, axis=1)[:, :n]  # scored first: they set the threshold
        qi, xi = np.repeat(np.arange(len(rows)), n), best.ravel()
        some = open_[qi, xi]
        qi, xi = qi[some], xi[some]
        self.score_pairs(rows[qi], cols[xi], ids, v)
        open_[qi, xi] = False
        open_ &= bound >= self.score[rows, -1:].astype(np.float64)
        qi, xi = np.nonzero(open_)
        for a in range(0, len(qi), 65536):
            q, x = qi[a:a + 65536], xi[a:a + 65536]
            some = bound[q, x] >= self.score[rows[q], -1].astype(np.float64)
            self.score_pairs(rows[q[some]], cols[x[some]], ids, v)

    def score_pairs(self, qi: np.ndarray, xi: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.scored += len(qi)
        self.add(qi, ids[xi], self.exact(qi, xi, v))

    def rows(self) -> pa.RecordBatch:
        full = self.vec.ravel() != np.iinfo(np.int64).max
        return pa.record_batch([pa.array(np.repeat(self.ids, self.k)[full]), pa.array(self.vec.ravel()[full]), pa.array(self.score.ravel()[full])],
                               ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score.  Both inputs: vec_id, v (array of long)."""
    spark = vectors.sparkSession
    q = saved(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    sizes = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    per = max(1, block_bytes // (8 * (sizes.d or 1) + 64))
    blocks = -(-sizes.n // per) if sizes.n else 0
    # blocks by hash: their number follows the queries, their size does not
    q = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1))))
    parts = []
    for b in range(blocks):
        got = q.filter(F.col("block") == b).select("vec_id", "v").toArrow()  # at most about block_bytes
        ids, vs = got.column(0).to_numpy(), got.column(1).to_pylist()
        by_len: dict[int, list[int]] = {}
        for i, v in enumerate(vs):
            by_len.setdefault(len(v), []).append(i)
        own = [(ids[i], np.array([vs[j] for j in i], np.int64).reshape(len(i), n)) for n, i in by_len.items()]
        held = spark.sparkContext.broadcast([(i, v, principal_axes(v)) for i, v in own])

        def search(batches, held=held):
            own = {v.shape[1]: [Block(i[a:a + CHUNK], v[a:a + CHUNK], k, axes) for a in range(0, len(i), CHUNK)] for i, v, axes in held.value}
            for batch in batches:
                ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
                for n in np.unique(lengths):
                    if n in own:
                        some = np.flatnonzero(lengths == n)
                        v = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), n)
                        for block in own[n]:
                            for a in range(0, len(some), CHUNK):
                                block.take(ids[some[a:a + CHUNK]], v[a:a + CHUNK])
            for blocks_ in own.values():
                for block in blocks_:
                    yield block.rows()

        parts.append(vectors.select("vec_id", "v").mapInArrow(search, _SCHEMA))
    if not parts:
        parts = [spark.createDataFrame([], _SCHEMA)]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.filter(F.col("vec_id") % EVERY == 0))


OP1_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
