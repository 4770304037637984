"""Quality rules with host-level verdicts.

Every document gets text figures and two kinds of rules.  Base rules reject a
document by itself: fewer than ``min_words`` words, or over 20% of its words in
5-word windows that the text repeats.  Soft rules (symbols, repeated lines,
word length, base failures) are counted per host, here ``source``.  A host's failure rate under
each rule is shrunk with a beta prior fitted to all hosts by moments; a host is
bad under a rule if its shrunk rate is above the prior's mean by more than the share ``excess``,
that is, worse than the other hosts.  A document goes if it fails a base rule, or
fails a soft rule while its host is bad under that rule or under the base rules:
good hosts get the benefit of the doubt, and a document that breaks no rule
stays whatever its host.  Of hosts that do not differ none is bad.

Nulls: a null text has no word (base_failed), an empty or blank one neither; very long texts are read whole, one in memory at a time per worker; a null source is a host of its
own.  Repeated rows count one by one.  No rows: empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from comparo.llm.common import rolling, saved, table

MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 10, 5, 20
#: A document fails a soft rule beyond these.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINE_SHARE, WORD_CHARS = 0.1, 0.3, (2.0, 12.0)
#: A host is worse than the others beyond this share of their mean rate; rates closer than ``TIE`` are equal.
EXCESS, TIE = 0.0, 1e-9
SYMBOLS = "#*$%&|<>"
RULES = ("base", "symbols", "dup_lines", "word_length")


def repeated_words(ws: list[bytes], k: int = WINDOW) -> int:
    """Words in k-word windows found at least twice in the text, the first included.
    Windows that meet in a hash are compared word by word."""
    n = len(ws)
    if n <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, n)
    if len(number) == n:
        return 0
    h = rolling(ids.astype(np.uint64) + np.uint64(1), k)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.flatnonzero(s[1:] == s[:-1])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    span = np.arange(k)
    equal = np.concatenate([(ids[a[i:i + 65536, None] + span] == ids[b[i:i + 65536, None] + span]).all(axis=1) for i in range(0, len(a), 65536)])
    if not equal.all():  # a hash collision: compare the windows themselves
        seen: dict[tuple, int] = {}
        hit = np.zeros(n - k + 1, bool)
        for i in range(n - k + 1):
            j = seen.setdefault(tuple(ids[i:i + k]), i)
            if j != i:
                hit[i] = hit[j] = True
    else:
        hit = np.zeros(n - k + 1, bool)
        hit[a] = hit[b] = True
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def text_figures(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8")
    ws = raw.split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(ws), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(ws)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id, host and the text figures of every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            got = np.array([text_figures(t) for t in b.column(2).to_pylist()], np.int64).reshape(-1, 6)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(got[:, i].copy()) for i in range(6))], ["doc_id", "host", *names])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{n} long" for n in names))


def failed_rules(f: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    mean = F.col("word_chars") / words
    return f.withColumns({
        "fail_base": base, "fail_symbols": F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * words,
        "fail_dup_lines": F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"),
        "fail_word_length": (F.col("n_words") > 0) & ~mean.between(*WORD_CHARS)})


def host_verdicts(f: DataFrame, excess: float = EXCESS) -> DataFrame:
    """One row per host: n, and for each rule its failures, shrunk rate and verdict."""
    hosts = f.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in RULES])
    stats = [F.count("*").alias("m"), F.avg(1 / F.col("n")).alias("inv")]
    for r in RULES:
        rate = F.col(f"k_{r}") / F.col("n")
        stats += [F.avg(rate).alias(f"p_{r}"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias(f"v_{r}")]
    s = hosts.agg(*stats).first()
    out = hosts
    for r in RULES:
        p = min(max(s[f"p_{r}"] if s[f"p_{r}"] is not None else 0.5, 1e-4), 1 - 1e-4)
        # between-host variance: what is observed less what sampling alone gives
        between = max((s[f"v_{r}"] or 0.0) - p * (1 - p) * (s["inv"] or 0.0), 0.0)
        weight = min(max(p * (1 - p) / between - 1, 2.0), 1e4) if between > 0 else 1e4 if s["m"] > 1 else 2.0
        rate = (F.col(f"k_{r}") + weight * p) / (F.col("n") + weight)
        out = out.withColumn(f"rate_{r}", rate).withColumn(f"bad_{r}", rate > p * (1 + excess) + TIE)
    return out


def judged(docs: DataFrame, excess: float = EXCESS) -> DataFrame:
    """Every row's figures, failures, its host's rates and ``kept``."""
    f = saved(failed_rules(figures(docs)), "host-figures")
    v = host_verdicts(f, excess).withColumnRenamed("host", "_host")
    j = f.join(v, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    bad = F.lit(False)
    for r in RULES[1:]:
        bad = bad | (F.col(f"fail_{r}") & (F.col(f"bad_{r}") | F.col("bad_base")))
    return j.withColumn("kept", ~F.col("fail_base") & ~bad)


def op9_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("fail_base").alias("base_failed"), "kept")


OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\v\\f\\r]')) AS ls FROM d),
g AS (SELECT r, i, list_slice(ws, i, i + {WINDOW - 1}) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM h, range({WINDOW}) t(j) GROUP BY r),
f AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[ \\t\\n\\v\\f\\r]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
x AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS f_base,
        n_symbols > {MAX_SYMBOLS_PER_WORD} * greatest(n_words, 1) AS f_symbols, n_dup_lines > {MAX_DUP_LINE_SHARE} * n_lines AS f_dup_lines,
        n_words > 0 AND NOT (word_chars / greatest(n_words, 1) BETWEEN {WORD_CHARS[0]} AND {WORD_CHARS[1]}) AS f_word_length FROM f),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (f_{r}) AS DOUBLE) AS k_{r}" for r in RULES)} FROM x GROUP BY source),
pr AS (SELECT count(*) AS m, avg(1 / n) AS inv, {", ".join(f"least(greatest(avg(k_{r} / n), 1e-4), 1 - 1e-4) AS p_{r}, coalesce(var_samp(k_{r} / n), 0) AS v_{r}" for r in RULES)} FROM hosts),
be AS (SELECT *, {", ".join(f"greatest(v_{r} - p_{r} * (1 - p_{r}) * inv, 0) AS b_{r}" for r in RULES)} FROM pr),
wt AS (SELECT *, {", ".join(f"CASE WHEN b_{r} > 0 THEN least(greatest(p_{r} * (1 - p_{r}) / b_{r} - 1, 2), 1e4) WHEN m > 1 THEN 1e4 ELSE 2.0 END AS w_{r}" for r in RULES)} FROM be),
bad AS (SELECT source, {", ".join(f"(k_{r} + w_{r} * p_{r}) / (n + w_{r}) > p_{r} * {1 + EXCESS} + {TIE} AS bad_{r}" for r in RULES)} FROM hosts, wt)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
       NOT f_base AND NOT ({" OR ".join(f"f_{r} AND (bad_{r} OR bad_base)" for r in RULES[1:])}) AS kept
FROM x JOIN bad ON x.source IS NOT DISTINCT FROM bad.source
"""
