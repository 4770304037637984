"""Embedding whitening by QDWH spectral divide-and-conquer.

Vectors become integer vectors x = floor(scale * c) + shift.  The covariance V
of all of them is split recursively: the polar factor U of V - sigma I (QDWH:
the dynamically weighted Halley iteration, by QR while the smallest singular
value is far off and by Cholesky after that) gives the projector (I + U) / 2 onto
the subspace of the eigenvalues above sigma; V is compressed to that subspace
and its complement, and both are split again until a block is one component.
Blocks that lie wholly below the wanted components are not split.  The
components, divided by the square roots of their eigenvalues, are a dims x k
matrix that travels with the tasks and whitens every row.

Work on Spark: one aggregate for n and the sums, one pass of Arrow batches that
adds up the products of the centred vectors, one pass that projects.  Centring
comes before multiplying: whole numbers x - round(mean) are multiplied, so sums
are exact up to 2^53 and do not depend on partitions; the rest of the mean (at
most a half) is taken off the finished matrix.  What reaches the driver is dims x dims
numbers, whatever the number of rows.

Nulls: a null vector, or one holding null or non-finite entries, takes no part;
a null id stays a row.  Vectors of another length than the most frequent one
(ties: the longest) take no part.  Repeated rows count and return as often as
they are there.  Components whose eigenvalue is zero to working precision
(fewer different vectors than components) cannot be whitened and are left out,
so equal vectors or an empty table give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from comparo.llm.common import saved, table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal factor of a symmetric nonsingular matrix by QDWH."""
    m = len(a)
    alpha = min(np.linalg.norm(a, "fro"), np.abs(a).sum(axis=0).max())
    x = a / alpha
    r = np.abs(np.diag(np.linalg.qr(x, mode="r"))).min() / np.sqrt(m)
    low = min(1.0, max(r / np.sqrt(m), EPS))
    eye = np.eye(m)
    for _ in range(60):
        l2 = low * low
        d = np.cbrt(4 * (1 - l2) / (l2 * l2))
        s = np.sqrt(1 + d)
        ha = s + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - l2) / (l2 * s))
        hb = (ha - 1) ** 2 / 4
        hc = ha + hb - 1
        if hc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(hc) * x, eye]))
            new = (hb / hc) * x + (ha - hb / hc) / np.sqrt(hc) * (q[:m] @ q[m:].T)
        else:
            w = np.linalg.cholesky(eye + hc * (x.T @ x))
            half = np.linalg.solve(w, x.T)
            new = (hb / hc) * x + (ha - hb / hc) * np.linalg.solve(w.T, half).T
        new = (new + new.T) / 2
        low = min(1.0, low * (ha + hb * l2) / (1 + hc * l2))
        moved, x = np.linalg.norm(new - x, "fro"), new
        if moved <= (5 * EPS) ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def split(a: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if ``a`` is a multiple of the identity."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m), "fro")
    if spread <= 4 * m * EPS * np.linalg.norm(a, "fro"):
        return None
    rng = np.random.default_rng(seed)
    # the mean has eigenvalues on both sides; the others only help when it meets an eigenvalue
    for shift in (np.median(np.diag(a)), mean, *(mean + spread / np.sqrt(m) * t for t in (0.05, -0.05, 0.15, -0.15, 0.3, -0.3))):
        u = polar(a - shift * np.eye(m))
        p = (u + np.eye(m)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < m or np.linalg.norm(p @ p - p, "fro") > 1e-8:
            continue
        v = np.linalg.qr(p @ rng.standard_normal((m, k)))[0]
        full = np.linalg.qr(p @ v, mode="complete")[0]
        if np.linalg.norm(full[:, k:].T @ a @ full[:, :k], "fro") <= 1e-10 * np.linalg.norm(a, "fro"):
            return full[:, :k], full[:, k:]
    raise ArithmeticError("no shift separates the eigenvalues")


def spectral(a: np.ndarray, components: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix."""
    a = (a + a.T) / 2
    m = len(a)
    want = m if components is None else min(components, m)
    stack, done, values, basis = [np.eye(m)], 0, [], []
    while stack and done < want:
        q = stack.pop()
        block = q.T @ a @ q
        block = (block + block.T) / 2
        parts = split(block, done) if q.shape[1] > 1 else None
        if parts is None:
            values.extend(np.diag(block))
            basis.append(q)
            done += q.shape[1]
            continue
        above, below = (np.linalg.qr(q @ p)[0] for p in parts)
        if done + above.shape[1] < want:  # else the lower block holds none of the wanted ones
            stack.append(below)
        stack.append(above)
    e, v = np.array(values), np.hstack(basis) if basis else np.empty((m, 0))
    at = np.argsort(-e, kind="stable")[:want]
    return e[at], v[:, at]


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double): the rows that take part."""
    v = F.col(col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & (F.size(v) > 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & sound)
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == most["d"]) if most else rows.filter(F.lit(False))


def _matrix(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    """Integer vectors of one batch, one row each, as whole doubles."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).reshape(batch.num_rows, -1) + shift


def moments(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, list[int], np.ndarray] | None:
    """n, the exact sums per dimension and the covariance (divisor n); None without rows."""
    def sums(batches):
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                s = _matrix(b, scale, shift).astype(np.int64).sum(axis=0)
                total, n = s if total is None else total + s, n + b.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(len(total)), pa.int32()), "s": pa.array(total, pa.int64()), "n": pa.array([n] * len(total), pa.int64())})

    got = rows.select("v").mapInArrow(sums, "dim int, s long, n long").groupBy("dim").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("dim").collect()  # one row a dimension
    if not got:
        return None
    n, s = int(got[0]["n"]), [int(r["s"]) for r in got]
    middle = np.array([round(x / n) for x in s], float)

    def products(batches):
        total = None
        for b in batches:
            if b.num_rows:
                y = _matrix(b, scale, shift) - middle
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "p": pa.array(list(total), pa.list_(pa.float64()))})

    each = rows.select("v").mapInArrow(products, "i int, p array<double>").select("i", F.posexplode("p").alias("j", "p"))
    entries = each.groupBy("i", "j").agg(F.sum("p").alias("p")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "p"))).alias("r"))
    cov = np.zeros((len(s), len(s)))
    for r in entries.collect():  # one row a dimension
        cov[r["i"]] = [x["p"] for x in r["r"]]
    rest = np.array([float(x - n * int(m)) / n for x, m in zip(s, middle)])
    return n, s, cov / n - np.outer(rest, rest)


def fit(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> dict:
    """The whitening of all ``rows`` (vec_id, v): n, sums, eigenvalues, unit eigenvectors (columns), trace; {} without rows."""
    m = moments(rows, scale, shift)
    if m is None:
        return {}
    n, sums, cov = m
    e, v = spectral(cov, components)
    ok = e > max(np.trace(cov), 0.0) * len(cov) * EPS
    return {"n": n, "sums": sums, "values": e[ok], "vectors": v[:, ok], "trace": float(np.trace(cov)), "scale": scale, "shift": shift}


def whitened(rows: DataFrame, model: dict) -> DataFrame:
    """vec_id, deviation (exact, of n * x - S), w (array of double: one value a component)."""
    out = "vec_id long, deviation long, w array<double>"
    if not model or not len(model["values"]):
        return rows.sparkSession.createDataFrame([], out)
    n, sums, scale, shift = model["n"], np.array(model["sums"], object), model["scale"], model["shift"]
    turn = model["vectors"] / np.sqrt(model["values"])
    middle = np.array([float(int(s) // n) for s in sums])  # whole part; the rest is below 1, so no digits are lost
    rest = np.array([float(int(s) % n) / n for s in sums])

    def run(batches):
        for b in batches:
            x = _matrix(b, scale, shift)
            far = np.abs(x - middle).max(initial=0.0) + 1
            if far * far * n * n * x.shape[1] < 2.0 ** 62:
                gap = (x - middle).astype(np.int64) * n - (sums - middle.astype(np.int64).astype(object) * n).astype(np.int64)
                deviation = (gap * gap).sum(axis=1)
            else:  # exact integers of any size; beyond 64 bits the Arrow conversion raises
                gap = x.astype(np.int64).astype(object) * n - sums
                deviation = [int(d) for d in (gap * gap).sum(axis=1)]
            w = (x - middle - rest) @ turn
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(deviation, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))],
                                             names=["vec_id", "deviation", "w"])

    return rows.select("vec_id", "v").mapInArrow(run, out)


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity (JVM sums)."""
    w = [F.col("w")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = white.agg(F.count(F.lit(1)).alias("n"), *[F.sum(w[i]).alias(f"s{i}") for i in range(k)], *[F.sum(w[i] * w[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    if not r["n"] or not k:
        return 0.0
    return max(abs(r[f"p{i}_{j}"] / r["n"] - r[f"s{i}"] * r[f"s{j}"] / r["n"] ** 2 - (i == j)) for i, j in pairs)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    white = saved(whitened(rows, model), "whitened")
    if not model or not len(model["values"]):
        none = F.lit(0.0)
        return white.select("vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", none.alias("whitened"), none.alias("explained"), none.alias("identity_error"))
    k = len(model["values"])
    explained = F.array(*[F.lit(float(e / model["trace"])) for e in model["values"]])
    return white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(float(identity_error(white, k))).alias("identity_error"))
