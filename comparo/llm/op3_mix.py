"""Mixing sources to target weights by Sainte-Lague apportionment.

Weights 5, 2, 1 repeat over the sources in code-point order (null last).  The
mix is as large as all documents together; a target stops at ``max_repeat``
times its source's size and the excess is shared again by weight.

Sources are cut into shards (seeded hash of the row).  A source at its cap gets
``max_repeat`` whole passes; Sainte-Lague (highest quotients v / (2s + 1)) deals
the other targets in words, first to the sources, then to the shards of each.
A shard whose quota is q of its n words takes q // n whole passes and, from a
seeded start, the next q % n words of its seeded document order, cyclically.

Bounds: shards number at most ``MAX_SHARDS`` plus the sources (their size
grows with the input instead), and one row per source and shard reaches the
driver; more than ``MAX_SOURCES`` sources raise an error.  Documents never do.

Nulls: a null text has size 0 and is never taken; a null source is a source of
its own; a null doc_id is an id like any other.  Repeated rows are taken one by
one.  No rows, or no words at all: targets and taken are 0.  Other columns are
ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import ascii_word_count, saved, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
SEED = 20240611
MAX_SHARDS = 1 << 14
MIN_SHARD = 1 << 15
MAX_SOURCES = 1_000_000


def capped_targets(sizes: list[int], weights: list[float], total: float, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Shares of ``total`` by weight; what exceeds ``max_repeat`` times a size
    is shared again among the others until no target is above its cap."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_ and left > 0:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > max_repeat * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(max_repeat * sizes[i])
            open_.discard(i)
        left -= sum(target[i] for i in over)
    return target


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by highest quotients v / (2s + 1); ties to the earlier entry.
    Seats that every quotient order would give are dealt at once, the rest one
    by one.  Entries at their cap leave the contest."""
    n = len(votes)
    caps = caps or [seats] * n
    got = [0] * n
    total = sum(votes)
    if total <= 0:
        return got
    # with divisor d every entry has round(v / d) seats; a divisor a little too large never gives too many
    low, high = 0.0, 2.0 * max(votes) + 1
    give = lambda d: [min(c, int(v / d + 0.5)) for v, c in zip(votes, caps)]
    for _ in range(80):
        mid = (low + high) / 2
        if sum(give(mid)) <= seats:
            high = mid
        else:
            low = mid
    got = give(high)
    heap = [(-v / (2 * s + 1), i) for i, (v, s, c) in enumerate(zip(votes, got, caps)) if s < c and v > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """doc_id, source_no, shard, h (seeded hash of doc_id, text and source), size, source_size,
    target, taken: words of each document that the mix takes, repeats counted."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.col("source").cast("string").alias("source"), ascii_word_count(F.col("text")).alias("size"),
                    F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("h"))
    slim = saved(d.select("doc_id", "source", "size", "h"), "mix-sizes")
    per_source = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per_source.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = [int(r["size"]) for r in per_source]
    total = sum(sizes)
    target = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total, max_repeat)
    shard_tokens = max(MIN_SHARD, -(-total // MAX_SHARDS))

    shards = [max(1, -(-s // shard_tokens)) for s in sizes]
    known = spark.createDataFrame([(r.source, i, sizes[i], float(target[i]), shards[i]) for i, r in enumerate(per_source)],
                                  "src string, source_no int, source_size long, target double, n_shards int")
    # one row per source, at most MAX_SOURCES: the check above bounds this broadcast
    dealt = (slim.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("src")))
             .withColumn("shard", F.pmod(F.xxhash64("h", F.lit(1)), F.col("n_shards").cast("long")).cast("int")))
    cells = dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect()  # at most MAX_SHARDS + sources rows
    full = [t >= max_repeat * n for t, n in zip(target, sizes)]
    open_ = [0.0 if f else t for f, t in zip(full, target)]
    quota = [max_repeat * n if f else q for f, n, q in zip(full, sizes, sainte_lague(open_, int(round(sum(open_)))))]
    by_source: dict[int, list] = {}
    for c in sorted(cells, key=lambda c: (c.source_no, c.shard)):
        by_source.setdefault(c.source_no, []).append(c)
    plan = []
    for i, own in by_source.items():
        held = [int(c["size"]) for c in own]
        got = sainte_lague([float(n) for n in held], quota[i], [max_repeat * n for n in held])
        for c, n, q in zip(own, held, got):
            start = int(np.random.default_rng([seed, i, c.shard]).integers(n)) if n else 0
            passes, rest = divmod(q, n) if n else (0, 0)
            # the rest: words start .. start + rest - 1, cyclic
            plan.append((i, c.shard, passes, start if rest else 0, min(start + rest, n) if rest else 0, max(start + rest - n, 0) if rest else 0))
    quotas = spark.createDataFrame(plan, "source_no int, shard int, passes int, a long, b long, wrap long")
    order = Window.partitionBy("source_no", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum("size").over(order)
    placed = dealt.withColumn("e", end).withColumn("s", F.col("e") - F.col("size")).join(F.broadcast(quotas), ["source_no", "shard"])
    cut = lambda lo, hi: F.greatest(F.lit(0), F.least("e", hi) - F.greatest("s", lo))
    return placed.select("doc_id", "source_no", "shard", "h", "size", "source_size", "target",
                         (F.col("passes") * F.col("size") + cut("a", "b") + cut(F.lit(0), "wrap")).cast("long").alias("taken"))


#: Shards whose cut documents are rounded together (a task's rows: at most three a shard).
ROUND_SHARDS = 4096


def whole_copies(odd: list) -> dict[int, int]:
    """h to copies for rows (source_no, shard, h, taken, size), each rounded up or
    down.  What rounding leaves over of a source's words goes on to its next
    document: long ones first, so that short ones make up for them, then in seeded order."""
    out, left = {}, {}
    for r in sorted(odd, key=lambda r: (r.source_no, -int(r.size_).bit_length(), r.shard, r.h)):
        n, part = divmod(r.taken, r.size_)
        have = left.get(r.source_no, 0) + part
        up = part > 0 and 2 * have >= r.size_
        left[r.source_no] = have - r.size_ * up
        out[r.h] = n + up
    return out


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as it is taken.  Cut
    documents (those at the ends of a shard's run of words, at most three a shard)
    are rounded to whole copies by ``whole_copies``, one task for ``ROUND_SHARDS`` shards of a
    source, so a source ends within half a document of its target for each of these; rows
    alike in doc_id, text and source count together.  Documents without words are never taken."""
    seed, spark = options.get("seed", SEED), docs.sparkSession
    m = saved(mixture(docs, **options).filter("size > 0").groupBy("source_no", "shard", "h")
              .agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("rows")), "mix-taken")
    even = (F.col("taken") % (F.col("size") * F.col("rows"))) == 0

    def rounded(f: pd.DataFrame) -> pd.DataFrame:
        f = f.rename(columns={"size": "size_"})
        copies = whole_copies(list(f.itertuples(index=False)))
        n = f["h"].map(copies).to_numpy(dtype="int64")
        return pd.DataFrame({"_h": f["h"], "_n": n // f["rows"], "_more": n % f["rows"]})

    odd = m.filter(~even).select("source_no", "shard", "h", "taken", "size", "rows")
    cut = saved(odd.groupBy("source_no", F.floor(F.col("shard") / ROUND_SHARDS).alias("_slice")).applyInPandas(rounded, "_h long, _n long, _more long"), "mix-cut")
    m = m.filter(even & (F.col("taken") > 0)).select(F.col("h").alias("_h"), (F.col("taken") / (F.col("size") * F.col("rows"))).cast("long").alias("_n"),
                                                     F.lit(0).cast("long").alias("_more")).union(cut.filter("_n > 0 or _more > 0"))
    d = docs.select(F.struct("*").alias("row"), F.xxhash64(F.lit(seed), "doc_id", "text", "source").alias("_h")).join(m, "_h")
    if cut.filter("_more > 0").limit(1).count():  # number those rows within the partitions they lie in, then across them
        some = saved(d.filter("_more > 0").withColumn("_part", F.spark_partition_id()), "mix-repeated")
        before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = (some.groupBy("_h", "_part").agg(F.count("*").alias("_rows"))
                 .select("_h", "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")))
        rank = F.row_number().over(Window.partitionBy("_h", "_part").orderBy(F.lit(1))) + F.col("_before")
        some = some.join(parts, ["_h", "_part"]).withColumn("_n", F.col("_n") + (rank <= F.col("_more")).cast("long")).filter("_n > 0")
        d = d.filter("_more = 0").select("row", "_n").union(some.select("row", "_n"))
    return d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("row.*")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
