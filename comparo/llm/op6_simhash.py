"""SimHash near-duplicates by the generalised pigeonhole principle.

A 64-bit fingerprint has bit b set if b is set in over half the XXH64 values
(seed 42) of the text's word shingles.  Fingerprints at most ``max_bits``
apart are linked; a component is what links reach.

Search on distinct fingerprints (copies collapse before any join):

1. Bit correlations over all fingerprints group the 64 bits into
   ``max_bits + 1`` partitions, correlated bits together.
2. For each fingerprint, dynamic programming picks thresholds T_i >= -1 with
   sum(T_i) = max_bits - m + 1 that minimise the estimated number of
   candidates (exact count of its own value, neighbouring values estimated
   from the bits' odds).  T_i = -1 leaves partition i out.
3. Probes (values within T_i) meet an index of partition values; pairs are
   verified by bit distance.
4. A value held by more than ``dense`` fingerprints is not joined.  All its
   holders and all fingerprints that probe it list the points at up to
   ``max_bits / 2`` flips (two fingerprints at most ``max_bits`` apart share
   such a point) and link to the point's smallest fingerprint: linear in the
   group, no pair is lost.

Nulls: a null text has no word (fingerprint 0, linked like any other); a null
doc_id never becomes a component id unless the whole component has none.
Repeated rows and ties give equal rows.  Empty input gives an empty result.
Other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import saved, table
from comparo.llm.components import components

SHINGLE, MAX_BITS, DENSE = 3, 2, 128
_PIECE = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    w = text.encode("utf-8").lower().split() if text else []  # bytes.lower() maps A-Z only
    if not w:
        return 0
    if len(w) < shingle:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle))))
    n = max(1, len(w) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    on = np.zeros(64, np.int64)
    for i in range(0, n, _PIECE):
        bits = np.unpackbits(h[i:i + _PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        on += np.add.reduce(bits, axis=0, dtype=np.uint16 if len(bits) < 65536 else np.int64)
    return int(np.packbits(2 * on > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): id, text hash and fingerprint (signed long) of every row."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, th long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of fingerprints, set counts of each bit and of each pair of bits
    (64 x 64 sums: one task emits 4,096 rows whatever it reads)."""
    def run(batches):
        acc = np.zeros((64, 64), np.int64)
        n = 0
        for b in batches:
            x = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8),
                              axis=1, bitorder="little").astype(np.float64)
            acc += (x.T @ x).astype(np.int64)
            n += len(x)
        yield pa.record_batch([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(acc.ravel(), n))], ["k", "v"])

    got = fps.select("fp").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    v = np.zeros(4097, np.int64)
    for r in got:
        v[r.k] = r.v
    m = v[:4096].reshape(64, 64)
    return int(v[4096]), np.diag(m).copy(), m


def bit_groups(n: int, on: np.ndarray, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of the bits: each is filled with the bit most correlated with it."""
    p = on / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for i in range(m):
        want = 64 // m + (i < 64 % m)
        g = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(g[0])
        while len(g) < want:
            b = max(left, key=lambda b: (corr[b, g].mean(), -b))
            g.append(b)
            left.remove(b)
        groups.append(sorted(g))
    return groups


def part_value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for j, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def allocate(own: np.ndarray, near: np.ndarray, max_bits: int) -> np.ndarray:
    """Thresholds by dynamic programming.  ``own`` (rows x m): fingerprints with
    the row's value; ``near`` (rows x m x max_bits): estimated fingerprints at
    exactly 1..max_bits flips.  Returns rows x m thresholds, -1 = left out."""
    rows, m = own.shape
    want = max_bits - m + 1
    cost = np.concatenate([np.zeros((rows, m, 1)), own[:, :, None], own[:, :, None] + np.cumsum(near, axis=2)], axis=2)
    cost[:, :, 1:] += 0.5 * np.array([1] + [1 + sum(_choose(22, j) for j in range(1, t + 1)) for t in range(1, max_bits + 1)])  # probes sent
    low, high = -m, max_bits
    best = np.full((rows, high - low + 1), np.inf)
    best[:, -low] = 0
    back = []
    for i in range(m):
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for t in range(-1, max_bits + 1):
            for s in range(low, high + 1):
                if low <= s - t <= high:
                    c = best[:, s - t - low] + cost[:, i, t + 1]
                    better = c < new[:, s - low]
                    new[better, s - low] = c[better]
                    pick[better, s - low] = t
        best = new
        back.append(pick)
    out, s = np.zeros((rows, m), np.int8), np.full(rows, want)
    for i in reversed(range(m)):
        out[:, i] = back[i][np.arange(rows), s - low]
        s = s - out[:, i]
    return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) at most
    ``max_bits`` apart: every verified pair outside dense values, stars within."""
    m = max_bits + 1
    n, on, both = bit_moments(fps)
    groups = bit_groups(n, on, both, m)
    p = np.clip(on / max(n, 1), 1e-3, 1 - 1e-3)

    def values(batches):
        for b in batches:
            fp = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            yield pa.record_batch([pa.array(np.tile(fp.view(np.int64), m)), pa.array(np.repeat(np.arange(m, dtype=np.int32), len(fp))),
                                   pa.array(np.concatenate([part_value(fp, g) for g in groups]).view(np.int64))], ["fp", "part", "val"])

    vals = fps.select("fp").mapInArrow(values, "fp long, part int, val long")
    counts = vals.groupBy("part", "val").agg(F.count("*").alias("c"))
    index = saved(vals.join(counts, ["part", "val"]), "simhash-index")
    held = index.groupBy("fp").agg(*[F.max(F.when(F.col("part") == i, F.col("c"))).alias(f"c{i}") for i in range(m)])

    def probes(batches):
        for b in batches:
            signed = np.ascontiguousarray(b.column(0).to_numpy(zero_copy_only=False))
            fp = signed.view(np.uint64)
            own = np.stack([b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(m)], axis=1).astype(float)
            near = np.zeros((len(fp), m, max_bits))
            vs = [part_value(fp, g) for g in groups]
            for i, g in enumerate(groups):
                x = (vs[i][:, None] >> np.arange(len(g), dtype=np.uint64)) & np.uint64(1)
                q = np.where(x == 1, p[g], 1 - p[g])
                at = n * np.prod(q, axis=1)
                power = [np.ones(len(fp))] + [(((1 - q) / q) ** k).sum(axis=1) for k in range(1, max_bits + 1)]
                sym = [np.ones(len(fp))]  # elementary symmetric sums of the flips' odds
                for k in range(1, max_bits + 1):
                    sym.append(sum((-1) ** (j - 1) * sym[k - j] * power[j] for j in range(1, k + 1)) / k)
                    near[:, i, k - 1] = at * sym[k]
            t = allocate(own, near, max_bits)
            for i, g in enumerate(groups):
                for r in range(max_bits + 1):  # values at exactly r flips
                    rows = np.flatnonzero(t[:, i] >= r)
                    masks = np.array([sum(1 << j for j in c) for c in combinations(range(len(g)), r)], np.uint64)
                    for at in range(0, len(rows), 2048):
                        some = rows[at:at + 2048]
                        pv = (vs[i][some][:, None] ^ masks[None, :]).ravel()
                        yield pa.record_batch([pa.array(np.repeat(signed[some], len(masks))), pa.array(np.full(len(pv), i, np.int32)),
                                               pa.array(pv.view(np.int64)), pa.array(np.full(len(pv), r, np.int32))], ["fp", "part", "val", "flips"])

    ask = saved(held.select("fp", *[f"c{i}" for i in range(m)]).mapInArrow(probes, "fp long, part int, val long, flips int")
                .join(counts, ["part", "val"]).filter("c > 1 or flips > 0"), "simhash-probes")  # own value, held once: nobody else there
    pairs = (ask.filter(F.col("c") <= dense).select("part", "val", "fp")
             .join(index.filter(F.col("c") <= dense).select("part", "val", F.col("fp").alias("other")), ["part", "val"])
             .filter("fp <> other"))
    pairs = pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= max_bits)
    pairs = pairs.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v"))

    crowd = (index.filter(F.col("c") > dense).select("fp").union(ask.filter(F.col("c") > dense).select("fp"))).distinct()
    radius = (max_bits + 1) // 2
    flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    masks = F.array(*[F.lit(x - (1 << 64) if x >> 63 else x).cast("long") for x in flips])
    points = crowd.select("fp", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("k")).filter("k > 1").select("point", "hub")
    stars = points.join(hubs, "point").filter("fp <> hub")
    if max_bits % 2:
        stars = stars.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= max_bits)
    stars = stars.select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row of ``docs`` (doc_id,
    text); ``root`` is the component's smallest fingerprint, as a signed number."""
    if max_bits % 2:
        raise ValueError("max_bits is even: dense groups meet at half that many flips")
    f = saved(fingerprints(docs, shingle), "simhash")
    distinct = saved(f.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    roots = components(links(distinct, max_bits, dense))
    member = distinct.join(roots.select(F.col("v").alias("fp"), F.col("u").alias("root")), "fp", "left")
    member = member.select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    comp = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    return f.join(member.select("fp", "root").join(comp, "root"), "fp").select("doc_id", "th", "fp", "root", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """One row of ``docs``, all columns, of each component: smallest doc_id (null last), then text hash."""
    near = near_duplicates(docs, shingle, max_bits, dense)
    reps = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("r"))
    reps = reps.select(F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th")).distinct()
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    kept = d.join(reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    # rows with one doc_id and text: the least by all columns, so reruns agree
    one = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(*[F.to_json(F.struct(F.col("row").getField(c))) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0)))
    return kept.withColumn("_n", one).filter("_n = 1").select("row.*")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
