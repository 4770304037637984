"""Quality classifier: interpolated modified Kneser-Ney language model.

The model is over character n-grams of order ``ORDER``, trained on all trusted
documents (``labels.quality = 1``).  One pass lists every n-gram type of the
corpus with its count in trusted text; counts, continuation counts, contexts
and discounts are grouped and joined as distributed tables.  Every type that
occurs anywhere gets its probability, interpolated down to single characters.

Scoring: types are cut into shards of at most ``SHARD_TYPES`` (hash ranges).
One shard at a time, of that proven size, is broadcast and joined with the
n-grams of all documents, which adds up to each document's log-probability.
Perplexities are compared with a quantile of the trusted documents of the same
language, which are scored for it by a model that has not seen them: trusted ids
are dealt to two folds, and each fold is scored by a model of the other (exact to the stated bin width; languages without trusted documents
use that of all trusted ones).

Nulls: a null text is empty (one n-gram, the end mark); null language is a
language of its own; a null doc_id is never trusted.  Rows that repeat doc_id, language and
text give one row.  Long texts count whole.  No trusted rows: everything is
kept.  No rows: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import mix, saved, table

ORDER = 5
#: Documents up to this quantile of their language's trusted perplexities are kept.
QUANTILE = 0.99
BINS = 1000  # bins of log-perplexity per unit
SHARD_TYPES = 1 << 21
#: Trusted ids are broadcast up to this number (8 bytes each).
MAX_BROADCAST_IDS = 1 << 22
#: Characters handled at once.
BLOCK = 1 << 22
#: Names of the models: of all trusted text, and without the text of fold 0 or 1.
MODELS = ("", "0", "1")
FOLD_SEED = 11
_START, _END = "\x02", "\x03"


def padded(text: str | None, order: int = ORDER) -> str:
    return _START * (order - 1) + (text or "") + _END


def codes(cp: np.ndarray, order: int = ORDER) -> np.ndarray:
    """64-bit hash of every run of ``order`` code points."""
    c = cp.astype(np.uint64)
    h = np.zeros(len(c) - order + 1, np.uint64)
    for j in range(order):
        h = h * np.uint64(0x100000001B3) + c[j:len(c) - order + 1 + j] + np.uint64(1)
    return mix(h)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(texts: list[str], order: int):
    """(joined padded texts, starts of the n-grams, document of each part): bounded
    blocks; a long text is cut into parts that overlap by order - 1 characters."""
    some, size = [], 0
    for d, t in enumerate(texts):
        t = padded(t, order)
        for a in range(0, len(t) - order + 1, BLOCK):
            part = t[a:a + BLOCK + order - 1]
            if some and size + len(part) > BLOCK:
                yield some
                some, size = [], 0
            some.append((d, part))
            size += len(part)
    if some:
        yield some


def _grams(some: list[tuple[int, str]], order: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Joined text, codes of the n-grams inside the parts, their positions, first n-gram of each part."""
    text = "".join(p for _, p in some)
    n = np.array([len(p) for _, p in some])
    ends = np.cumsum(n)
    ok = np.ones(len(text), bool)
    for j in range(1, order):
        ok[ends - j] = False
    at = np.flatnonzero(ok)
    return text, codes(code_points(text), order)[at], at, np.cumsum(n - order + 1) - (n - order + 1)


def fold_of(doc_id) -> "F.Column":
    return F.pmod(F.xxhash64(doc_id, F.lit(FOLD_SEED)), F.lit(2)).cast("int")


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of each value among the distinct ones, those in order of appearance, and where each appears first."""
    at, values = pd.factorize(h)
    first = np.empty(len(values), np.int64)
    first[at[::-1]] = np.arange(len(h) - 1, -1, -1)
    return at, values, first


def type_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c, c0, c1): every n-gram type of ``docs`` (text, fold: 0 or 1, null if not trusted)
    and its count in trusted text (0 for others), in all and without fold 0 or 1."""
    def counted(flag, texts):
        for some in _blocks(texts, order):
            text, h, at, _ = _grams(some, order)
            own, _, first = _distinct(h)
            n = np.bincount(own, minlength=len(first)) if flag is not None else np.zeros(len(first), np.int64)
            none = np.zeros(len(first), np.int64)
            starts = at[first].tolist()
            yield pa.record_batch([pa.array([text[j:j + order] for j in starts], pa.string()), pa.array(n if flag == 1 else none), pa.array(n if flag == 0 else none)], ["g", "c0", "c1"])

    def run(batches):
        held: dict = {0: [], 1: [], None: []}  # texts by fold, up to a block
        size = dict.fromkeys(held, 0)
        for b in batches:
            for t, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held[f].append(t)
                size[f] += len(t or "")
                if size[f] >= BLOCK - 8 * order * len(held[f]):
                    yield from counted(f, held[f])
                    held[f], size[f] = [], 0
        for f, texts in held.items():
            if texts:
                yield from counted(f, texts)

    rows = docs.select("text", "fold").mapInArrow(run, "g string, c0 long, c1 long").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return rows.select("g", (F.col("c0") + F.col("c1")).alias("c"), "c0", "c1")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types that occur 1 to 4 times."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return min(max(d1, 0.05), 1.0), min(max(d2, 0.05), 2.0), min(max(d3, 0.05), 3.0)


def probabilities(types: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p, p0, p1): interpolated probability of the last character after the others, for
    all types, by the models of the counts c, c0 and c1."""
    levels = {order: types.select("g", *(f"c{m}" for m in MODELS))}
    for n in range(order - 1, 0, -1):  # continuation counts: how many types one longer end in this one
        up = levels[n + 1]
        levels[n] = saved(up.groupBy(F.substring("g", 2, n).alias("g")).agg(*[F.sum((F.col(f"c{m}") > 0).cast("long")).alias(f"c{m}") for m in MODELS]), f"kn-{n}")
    p = None
    for n in range(1, order + 1):
        t = levels[n]
        k = t.agg(*[F.sum((F.col(f"c{m}") == i).cast("long")).alias(f"n{m}_{i}") for m in MODELS for i in range(1, 5)], F.count("*").alias("v")).first()
        d = {m: discounts([k[f"n{m}_{i}"] or 0 for i in range(1, 5)]) for m in MODELS}
        cut = {m: F.when(F.col(f"c{m}") >= 3, d[m][2]).when(F.col(f"c{m}") == 2, d[m][1]).when(F.col(f"c{m}") == 1, d[m][0]).otherwise(0.0) for m in MODELS}
        over = {m: F.greatest(F.col(f"c{m}") - cut[m], F.lit(0.0)) for m in MODELS}
        t = t.withColumn("ctx", F.substring("g", 1, n - 1) if n > 1 else F.lit(""))
        ctx = t.groupBy("ctx").agg(*[F.sum(f"c{m}").alias(f"total{m}") for m in MODELS], *[F.sum(cut[m]).alias(f"mass{m}") for m in MODELS])
        if n == 1:
            one = ctx.first()
            total, mass = ({m: (one[f"{x}{m}"] or 0) if one else 0 for m in MODELS} for x in ("total", "mass"))
            v = max(k.v, 1)
            p = t.select("g", *[(over[m] / total[m] + mass[m] / total[m] / v if total[m] else F.lit(1.0 / v)).alias(f"p{m}") for m in MODELS])
        else:
            low = p.select(F.col("g").alias("tail"), *[F.col(f"p{m}").alias(f"q{m}") for m in MODELS])
            t = t.withColumn("tail", F.substring("g", 2, n - 1)).join(low, "tail").join(ctx, "ctx")
            p = t.select("g", *[F.when(F.col(f"total{m}") > 0, over[m] / F.col(f"total{m}") + F.col(f"mass{m}") / F.col(f"total{m}") * F.col(f"q{m}"))
                                .otherwise(F.col(f"q{m}")).alias(f"p{m}") for m in MODELS])
        if n < order:
            p = saved(p, f"kn-p{n}")
    return p


class Table:
    """Open addressing from n-gram codes to rows of log-probabilities, one column a model."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.rows = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.values = np.concatenate([np.zeros((1, values.shape[1])), values])
        left = np.arange(len(keys))
        slot = keys & self.mask
        while len(left):
            free = self.keys[slot[left]] == 0
            some = left[free]
            self.keys[slot[some]] = keys[some]
            won = self.keys[slot[some]] == keys[some]
            self.rows[slot[some[won]]] = some[won] + 1
            left = np.concatenate([left[~free], some[~won]])
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def get(self, h: np.ndarray) -> np.ndarray:
        """Rows of ``values``; 0, a row of zeros, where a code is not held."""
        at = h & self.mask
        out = np.zeros(len(h), np.int32)
        k = self.keys[at]
        hit = k == h
        out[hit] = self.rows[at[hit]]
        left = np.flatnonzero(~hit & (k != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            k = self.keys[at[left]]
            hit = k == h[left]
            out[left[hit]] = self.rows[at[left[hit]]]
            left = left[~hit & (k != 0)]
        return out


_TABLES: dict[str, Table] = {}


def shard_sums(docs: DataFrame, held, order: int = ORDER) -> DataFrame:
    """lang, doc_id, th, n (n-grams), lp (log-probability of those in the shard) and
    own (that by the model without the document's fold; lp if not trusted)."""
    token = uuid.uuid4().hex

    def run(batches):
        if token not in _TABLES:  # one table per worker at a time
            _TABLES.clear()
            _TABLES[token] = Table(*held.value)
        t = _TABLES[token]
        for b in batches:
            texts = b.column(3).to_pylist()
            model = np.array([0 if f is None else f + 1 for f in b.column(4).to_pylist()], np.int64)
            lp, own, n = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for some in _blocks(texts, order):
                _, h, _, first = _grams(some, order)
                doc = np.array([d for d, _ in some])
                at, types, _ = _distinct(h)
                values = t.values[t.get(types)]
                sums = [np.add.reduceat(np.ascontiguousarray(values[:, m])[at], first) if m in model[doc] or not m else None for m in range(values.shape[1])]
                np.add.at(lp, doc, sums[0])
                np.add.at(own, doc, np.choose(model[doc], [sums[0] if x is None else x for x in sums]))
                np.add.at(n, doc, np.diff(np.append(first, len(h))))
            yield pa.record_batch([*(b.column(i) for i in range(3)), pa.array(n), pa.array(lp), pa.array(own)], ["doc_id", "lang", "th", "n", "lp", "own"])

    return docs.select("doc_id", "lang", "th", "text", "fold").mapInArrow(run, "doc_id long, lang string, th long, n long, lp double, own double")


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER, shard_types: int = SHARD_TYPES) -> DataFrame:
    """doc_id, lang, trusted, n_grams, log_ppl, unseen_ppl (a trusted document's by the model without its fold)."""
    spark = docs.sparkSession
    good = saved(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct(), "kn-trusted")
    if good.count() <= MAX_BROADCAST_IDS:  # else the texts are joined by a shuffle
        good = F.broadcast(good)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                    F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))
    flagged = d.join(good, F.col("doc_id") == F.col("_id"), "left").withColumn("fold", F.when(F.col("_id").isNotNull(), fold_of(F.col("doc_id")))).drop("_id")
    types = saved(type_counts(flagged, order), "kn-types")

    def coded(batches):
        for b in batches:
            gs = b.column(0).to_pylist()
            cp = code_points("".join(gs)).reshape(-1, order)
            h = codes(cp.ravel(), order)[::order] if len(gs) else np.empty(0, np.uint64)
            yield pa.record_batch([pa.array(h.view(np.int64)), *(b.column(i + 1) for i in range(len(MODELS)))], ["code", *(f"lp{m}" for m in MODELS)])

    p = saved(probabilities(types, order).select("g", *[F.log(f"p{m}").alias(f"lp{m}") for m in MODELS])
              .mapInArrow(coded, ", ".join(["code long", *(f"lp{m} double" for m in MODELS)])), "kn-scores")
    shards = max(1, -(-p.count() // (shard_types // 2)))  # half full on average
    parts = []
    for s in range(shards):
        own = p.filter(F.pmod(F.xxhash64("code"), F.lit(shards)) == s).limit(shard_types + 1).toArrow()
        if len(own) > shard_types:
            raise RuntimeError("a shard of the model is larger than its bound")
        held = spark.sparkContext.broadcast((own.column(0).to_numpy().view(np.uint64), np.stack([own.column(i + 1).to_numpy() for i in range(len(MODELS))], axis=1)))
        parts.append(shard_sums(flagged, held, order).withColumn("shard", F.lit(s)))
    total = parts[0]
    for x in parts[1:]:
        total = total.union(x)
    lp, own = ([F.max(F.when(F.col("shard") == s, F.col(c))) for s in range(shards)] for c in ("lp", "own"))
    sums = total.groupBy("doc_id", "lang", "th").agg(F.max("n").alias("n_grams"), sum(lp[1:], lp[0]).alias("lp"), sum(own[1:], own[0]).alias("own"))
    sums = sums.join(good, F.col("doc_id") == F.col("_id"), "left")
    return sums.select("doc_id", "lang", F.col("_id").isNotNull().alias("trusted"), "n_grams", (-F.col("lp") / F.col("n_grams")).alias("log_ppl"),
                       F.when(F.col("_id").isNotNull(), -F.col("own") / F.col("n_grams")).alias("unseen_ppl"))


def classified(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER, shard_types: int = SHARD_TYPES) -> DataFrame:
    """doc_id, lang, trusted, n_grams, perplexity, threshold, kept."""
    p = saved(perplexities(docs, labels, order, shard_types).withColumn("bin", F.floor(F.col("log_ppl") * BINS).cast("long")), "kn-perplexity")
    hist = p.filter("trusted").groupBy("lang", F.floor(F.col("unseen_ppl") * BINS).cast("long").alias("bin")).agg(F.count("*").alias("c"))

    def limits(h: DataFrame, by: list[str]) -> DataFrame:
        order_ = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*by)
        return (h.withColumn("cum", F.sum("c").over(order_)).withColumn("all", F.sum("c").over(whole))
                .filter(F.col("cum") >= quantile * F.col("all")).groupBy(*by).agg(F.min("bin").alias("limit")))

    own = limits(hist, ["lang"]).select(F.col("lang").alias("_lang"), "limit")
    # one histogram of at most a few ten thousand bins
    rest = limits(hist.groupBy("bin").agg(F.sum("c").alias("c")).withColumn("one", F.lit(1)), ["one"]).first()
    fall = F.lit(rest.limit if rest else (1 << 62))
    j = p.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    limit = F.coalesce(F.col("limit"), fall)
    return j.select("doc_id", "lang", "trusted", "n_grams", F.exp("log_ppl").alias("perplexity"),
                    F.exp((limit + 1) / F.lit(float(BINS))).alias("threshold"), (F.col("bin") <= limit).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
