"""Substring dedup: recurring 20-word passages, located with Aho-Corasick automata.

A window is ``window`` consecutive words of one document.  Every word covered by
a window whose word sequence also starts earlier (smaller doc_id, or earlier in
the same document) is removed; windows are judged on the input.

1. Anchors.  Every window has an anchor, the leftmost of its ``gram``-word runs
   with the smallest hash, so equal windows have equal anchors.  Anchors are
   counted over all documents; a window whose anchor occurs once cannot recur.
2. Passages.  Neighbouring windows with one recurring anchor form a passage (at
   most ``2 * window - gram`` words).  Equal passages are confirmed by grouping
   on the anchor's and the passage's hash (128 bits): all but the first lose all their words.
3. Automata.  Different passages of one anchor go to one shard.  A shard
   confirms the windows that recur among its passages, compiles them into an
   Aho-Corasick automaton over words (each word one symbol, so matches are
   exact) and streams its passages through it; every hit that is not the
   window's first occurrence is removed.  Shards hold at most ``SHARD_WINDOWS``
   windows at a time.  An anchor with more than ``dense`` different passages has
   their windows grouped by hash instead, so no task gathers an unbounded number
   (32,768 passages: about half a million windows, some 100 MB).

Order of occurrences: doc_id (null first), then text hash, then position; rows
that share doc_id and text are one document and get equal results.  A null
text has no words.  Texts of any length are read whole.  No rows: empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from comparo.llm.common import dropped, rolling, run_hashes, saved, table, words

WINDOW, GRAM, DENSE = 20, 5, 1 << 15
SHARD_WINDOWS = 100_000
_MIN = -(1 << 63)


_POS = 21
_CHUNK = 1 << (_POS - 1)


def anchors_of(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``gram``-word runs and the position of each window's anchor,
    from the words' hashes.  Minima run over the upper hash bits with the
    position below them, so that one minimum finds value and leftmost place;
    texts beyond ``_CHUNK`` words go in overlapping parts."""
    g = rolling(h, gram)
    n, w = len(h) - window + 1, window - gram + 1
    if n < 1:
        return g, np.empty(0, np.int64)
    out = []
    for a in range(0, n, _CHUNK):
        part = g[a:a + _CHUNK + w - 1]
        m = (part & ~np.uint64((1 << _POS) - 1)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < w:  # minima over span, then up to twice as much
            step = min(span, w - span)
            m = np.minimum(m[:-step], m[step:])
            span += step
        out.append((m & np.uint64((1 << _POS) - 1)).astype(np.int64) + a)
    return g, out[0] if len(out) == 1 else np.concatenate(out)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))


def _keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_MIN)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("th"))


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(h, k, pos): anchor hash, hash of doc_id and text, position."""
    def run(batches):
        for b in batches:
            hs, ks, ps = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g, p = anchors_of(word_hashes(words(t)), window, gram)
                if len(p):
                    u = p[np.flatnonzero(np.diff(p, prepend=-1))]
                    hs.append(g[u])
                    ps.append(u.astype(np.int32))
                    ks.append(np.full(len(u), k, np.int64))
            if hs:
                yield pa.record_batch([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(ks)), pa.array(np.concatenate(ps))], ["h", "k", "pos"])

    return docs.select(F.xxhash64("doc", "th").alias("k"), "text").mapInArrow(run, "h long, k long, pos int")


def passage_rows(docs: DataFrame, hints: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, c, doc, th, start, size, body): passages with a recurring anchor.
    ``body`` is given at the passage's first sight in a task."""
    j = (docs.select("doc", "th", "text", F.xxhash64("doc", "th").alias("k")).join(hints, "k").select("doc", "th", "text", "at"))

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            out: list[tuple] = []
            for doc, th, t, at in zip(*(b.column(i).to_pylist() for i in range(4))):
                ws = words(t)
                h = word_hashes(ws)
                g, p = anchors_of(h, window, gram)
                if not len(p):
                    continue
                first = np.flatnonzero(np.diff(p, prepend=-1))
                last = np.append(first[1:], len(p))
                mine = np.isin(p[first], np.array(at))
                first, last = first[mine], last[mine]
                if not len(first):
                    continue
                keys = g[p[first]].view(np.int64).tolist()
                ends = last - 1 + window
                for key, c, s, e in zip(keys, run_hashes(h, first, ends).view(np.int64).tolist(), first.tolist(), ends.tolist()):
                    if c in seen:
                        body = None
                    else:
                        body = b" ".join(ws[s:e])
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(c)
                    out.append((key, c, doc, th, s, e - s, body))
                if len(out) > 50_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return j.mapInArrow(run, "key long, c long, doc long, th long, start int, size int, body binary")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["key", "c", "doc", "th", "start", "size", "body"])


def window_rows(passages: DataFrame, window: int) -> DataFrame:
    """(a, b, doc, th, start): 128-bit hash of every window of the passages."""
    def run(batches):
        for bt in batches:
            out = []
            for doc, th, start, body in zip(*(bt.column(i).to_pylist() for i in range(4))):
                ws = body.split(b" ")
                for i in range(len(ws) - window + 1):
                    d = xxhash.xxh3_128_digest(b" ".join(ws[i:i + window]))
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, th, start + i))
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), [pa.int64()] * 4 + [pa.int32()])], ["a", "b", "doc", "th", "start"])

    return passages.select("doc", "th", "start", "body").mapInArrow(run, "a long, b long, doc long, th long, start int")


#: Words that one character each can stand for; beyond, two characters from disjoint ranges do.
SINGLE = 1_000_000


def _symbols(bodies: list[bytes]) -> tuple[list[str], int]:
    """The bodies with a fixed number of characters (1 or 2, returned too) for each word.  With two,
    first and second characters differ in range, so that a match begins at a word."""
    number: dict[bytes, int] = {}
    ids = [[number.setdefault(w, len(number)) for w in body.split(b" ")] for body in bodies]
    if len(number) <= SINGLE:
        letter = [chr(n + 1 if n < 0xD7FF else n + 0x801) for n in range(len(number))]  # no surrogates
    else:
        letter = [chr(0x10000 + n // 0xD000) + chr(1 + n % 0xD000) for n in range(len(number))]
    return ["".join([letter[n] for n in row]) for row in ids], 1 if len(number) <= SINGLE else 2


def shard_hits(passages: list[tuple], window: int = WINDOW) -> list[tuple]:
    """(doc, th, start, size) to remove from the passages (doc, th, start, body),
    each of which stands at its first occurrence: Aho-Corasick over words."""
    texts, k = _symbols([body for _, _, _, body in passages])
    first: dict[str, tuple] = {}
    again: set[str] = set()
    for (doc, th, start, _), t in zip(passages, texts):
        for i in range(len(t) // k - window + 1):
            w, place = t[i * k:(i + window) * k], (doc, th, start + i)
            old = first.get(w)
            if old is None:
                first[w] = place
            else:
                if old != place:
                    again.add(w)
                if place < old:
                    first[w] = place
    if not again:
        return []
    machine = ahocorasick.Automaton()
    for w in again:
        machine.add_word(w, first[w])
    machine.make_automaton()
    out = []
    for (doc, th, start, _), t in zip(passages, texts):
        for end, place in machine.iter(t):
            at = (doc, th, start + (end + 1) // k - window)
            if at != place:
                if out and out[-1][:2] == at[:2] and out[-1][2] <= at[2] <= out[-1][2] + out[-1][3]:
                    out[-1] = (doc, th, out[-1][2], at[2] + window - out[-1][2])
                else:
                    out.append((*at, window))
    return out


def automata_hits(several: DataFrame, window: int) -> DataFrame:
    """Removals among different passages of one anchor.  Input sorted by key in each partition."""
    def run(batches):
        held: list[tuple] = []
        n, last = 0, None

        def emit(rows):
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc", "th", "start", "size"])

        for b in batches:
            for key, doc, th, start, body in zip(*(b.column(i).to_pylist() for i in range(5))):
                if n >= SHARD_WINDOWS and key != last:
                    if rows := shard_hits(held, window):
                        yield emit(rows)
                    held, n = [], 0
                held.append((doc, th, start, body))
                n += body.count(b" ") + 2 - window
                last = key
        if held and (rows := shard_hits(held, window)):
            yield emit(rows)

    return several.select("key", "doc", "th", "start", "body").mapInArrow(run, "doc long, th long, start int, size int")


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, dense: int = DENSE) -> DataFrame:
    """(doc, th, gone): for documents that lose words, their parts to remove (start, size)."""
    d = _keys(docs)
    place = F.struct("doc", "th", "start")
    a = saved(anchor_rows(d, window, gram), "substr-anchors")
    often = a.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h")
    hints = saved(a.join(often, "h").groupBy("k").agg(F.collect_list("pos").alias("at")), "substr-hints")
    dropped(a)
    p = saved(passage_rows(d, hints, window, gram), "substr-passages")
    dropped(hints)
    kinds = saved(p.groupBy("key", "c").agg(F.min(place).alias("first")), "substr-kinds")
    # all but the first of equal passages go whole
    copies = (p.select("key", "c", "doc", "th", "start", "size").join(kinds, ["key", "c"])
              .filter(place > F.col("first")).select("doc", "th", "start", "size"))
    shared = saved(kinds.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "substr-shared")
    # only passages that share their anchor with a different one need their words
    bodies = (p.filter("body IS NOT NULL").select("key", "c", "body").join(shared, "key")
              .groupBy("key", "c").agg(F.max("n").alias("n"), F.max("body").alias("body")))
    several = kinds.join(bodies, ["key", "c"]).select("key", "n", "first.doc", "first.th", "first.start", "body")
    n = int(several.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = automata_hits(several.filter(F.col("n") <= dense).repartition(n, "key").sortWithinPartitions("key"), window)
    crowd = window_rows(several.filter(F.col("n") > dense), window)
    least = crowd.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("k")).filter("k > 1").select("a", "b", "first")
    crowd = crowd.join(least, ["a", "b"]).filter(place > F.col("first")).select("doc", "th", "start", F.lit(window).alias("size"))
    found = saved(hits.union(crowd), "substr-found")  # its shuffles end before those of the copies begin
    spans = copies.union(found)
    gone = saved(spans.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "size")).alias("gone")), "substr-gone")
    for t in (p, kinds, shared, found):
        dropped(t)
    return gone


def kept_words(ws: list[bytes], gone) -> list[bytes]:
    if not gone:
        return ws
    edge = np.zeros(len(ws) + 1, np.int64)
    s = np.array([x["start"] for x in gone])
    np.add.at(edge, s, 1)
    np.add.at(edge, s + np.array([x["size"] for x in gone]), -1)
    return [ws[i] for i in np.flatnonzero(np.cumsum(edge)[:len(ws)] == 0)]


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, dense: int = DENSE, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by blanks as ``text``
    (``digest``: their SHA-256 as ``kept_sha256`` instead)."""
    gone = removals(docs, window, gram, dense)
    name = "kept_sha256" if digest else "text"
    j = _keys(docs).select("doc", "th", "doc_id", "text").join(gone, ["doc", "th"], "left").select("doc_id", "text", "gone")

    def run(batches):
        for b in batches:
            n, r, out = [], [], []
            for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                ws = words(t)
                kept = kept_words(ws, g)
                body = b" ".join(kept)
                n.append(len(ws))
                r.append(len(ws) - len(kept))
                out.append(hashlib.sha256(body).hexdigest() if digest else body.decode("utf-8"))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_words", "n_removed", name])

    return j.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), digest=True)


OP2_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM g),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM f WHERE nth > 1), range({WINDOW}) t(j)),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN gone ON e.doc_id = gone.doc_id AND e.i = gone.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
