"""Best-fit packing with large-item matching.

Every document becomes its token ids and one closing id; longer ones are cut
into pieces of ``capacity`` tokens.  Pieces are packed into as few sequences
as the method can:

* pieces above a third of the capacity go at most two to a sequence: from the
  longest down, each is matched with the longest partner that still fits;
* smaller ones, longest first, go into the fullest sequence that holds them.

Only lengths matter, so the method runs on the length histogram (at most
``capacity`` rows, a proven bound): it deals whole runs of equal pieces to
whole runs of equal sequences.  A piece finds its place by its rank among the
pieces of its length.  Ranks are taken within (length, salt) groups whose
offsets come from their counts, so a length that a third of all pieces share
is split over ``SALTS`` tasks.

Nulls: a null text is empty (one closing id); a null doc_id is kept as it is.
Repeated rows are packed one by one.  Very long texts are cut into pieces.  No
rows: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import saved, table

CAPACITY, EOS, SALTS = 4096, 1, 64
#: Words whose ids a worker remembers between batches.
CACHE = 700_000
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: Closing marks that the tokenizer parts from a letter before them; none belongs to a special token.
_TAIL = b".,;:!?*$%&#"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyz")


class WordIds(dict):
    """Ids (little-endian uint32 bytes) of lower-case words without closing marks.
    The tokenizer never joins characters across white space, parts closing marks
    from a letter before them and lower-cases: a text's ids are those of its
    words, a word's those of its core and marks."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(_BREAK)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def forget(self) -> None:
        """Back to at most CACHE words: the latest go, the frequent ones came early."""
        while len(self) > CACHE:
            self.popitem()

    def of(self, ws: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all the words; new ones are encoded together."""
        out, later, fresh, get = {}, [], set(), self.get
        for w in ws:
            if b"<" in w:  # may hold special tokens, whose case and marks matter
                out[w] = np.array(self._encode(w.decode("utf-8")), "<u4").tobytes()
                continue
            core = w.rstrip(_TAIL)
            low = core.lower()
            if core and low[-1] in _LETTERS:
                tail = w[len(core):]
            else:
                low, tail = w.lower(), b""
            v = get(low)
            if v is not None and not tail:
                out[w] = v
                continue
            if v is None:
                fresh.add(low)
            if tail and tail not in self:
                fresh.add(tail)
            later.append((w, low, tail))
        plain, other = [], []
        for w in fresh:
            t = w.decode("utf-8")
            (plain if t.isalpha() and "\u0130" not in t else other).append(t)
        for i in range(0, len(plain), 2000):  # letters only: one piece each, which ends with a word-end token
            self._store(plain[i:i + 2000], " ", lambda ids: np.flatnonzero(self.last[ids]) + 1, 0)
        for i in range(0, len(other), 500):
            self._store(other[i:i + 500], _BREAK, lambda ids: np.append(np.flatnonzero(ids == self.mark), len(ids)), 1)
        for w, low, tail in later:
            out[w] = self[low] + self[tail] if tail else self[low]
        return out

    def _store(self, some: list[str], between: str, ends, skip: int) -> None:
        ids = np.array(self._encode(between.join(some)), "<u4")
        cut = ends(ids)
        if len(cut) != len(some):
            for w in some:
                self[w.encode("utf-8")] = np.array(self._encode(w), "<u4").tobytes()
            return
        raw, at = ids.tobytes(), 0
        for w, end in zip(some, (4 * cut).tolist()):
            self[w.encode("utf-8")] = raw[at:end]
            at = end + 4 * skip

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


_BREAK = "<|endoftext|>"
_WORDS: dict[str, WordIds] = {}


def token_bytes(texts: list[str | None], path: str, eos: int = EOS):
    """Ids of each whole text and the closing id, as little-endian uint32."""
    ids = _WORDS.get(path)
    if ids is None:
        ids = _WORDS[path] = WordIds(path)
    close = int(eos).to_bytes(4, "little")
    split = [t.encode("utf-8").split() if t else [] for t in texts]
    own = ids.of(set().union(*split))
    ids.forget()
    for ws in split:
        yield b"".join(map(own.__getitem__, ws)) + close


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, raw in zip(b.column(0).to_pylist(), token_bytes(b.column(1).to_pylist(), path, eos)):
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            cols = list(zip(*out)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(arrays, names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, _SCHEMA + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Runs (length, first rank, number, first sequence, per sequence, offset)
    and the number of sequences.  Piece ``first + j`` of that length goes to
    sequence ``first sequence + j // per`` at ``offset + (j % per) * length``."""
    left = {k: v for k, v in histogram.items() if v}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple] = []
    gaps: dict[int, list] = defaultdict(list)  # gap -> [(first sequence, number)]
    order: list[int] = []  # gaps with sequences, ascending
    n_seq = 0

    def give(length: int, number: int, first: int, per: int, offset: int) -> None:
        runs.append((length, taken[length], number, first, per, offset))
        taken[length] += number
        left[length] -= number

    def gap(size: int, first: int, number: int) -> None:
        if size > 0 and number > 0:
            if not gaps[size]:
                insort(order, size)
            gaps[size].append((first, number))

    big = sorted(k for k in left if 3 * k > capacity)  # ascending
    for a in reversed(big):
        while left[a]:
            at = bisect_left(big, min(a, capacity - a) + 1) - 1
            while at >= 0 and (left[big[at]] == 0 or (big[at] == a and left[a] < 2)):
                at -= 1
            b = big[at] if at >= 0 else 0
            number = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            give(a, number, n_seq, 1, 0)
            if b:
                give(b, number, n_seq, 1, a)
            gap(capacity - a - b, n_seq, number)
            n_seq += number
    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):
                fresh = -(-left[size] // (capacity // size))
                gap(capacity, n_seq, fresh)
                n_seq += fresh
                continue
            g = order[at]
            first, number = gaps[g].pop()
            if not gaps[g]:
                order.pop(at)
            per = g // size
            full = min(number, left[size] // per)
            if full:
                give(size, full * per, first, per, capacity - g)
                gap(g - per * size, first, full)
            rest = left[size]
            if full < number:
                some = 0 < rest < per
                if some:
                    give(size, rest, first + full, rest, capacity - g)
                    gap(g - rest * size, first + full, 1)
                gap(g, first + full + some, number - full - some)
    return runs, n_seq


def placed(parts: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """``parts`` with sequence_id and offset.  Equal rows are interchangeable."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    p = parts.withColumn("_salt", salt)
    cells = p.groupBy("length", "_salt").agg(F.count("*").alias("_n"))  # at most capacity x salts rows
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_salt", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    hist = {r.length: r.n for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(hist, capacity)
    runs.sort()
    table_ = np.array(runs or [(0, 0, 0, 0, 1, 0)], np.int64)

    def place(batches):
        key = (table_[:, 0] << 44) + table_[:, 1]
        at = {}
        for b in batches:
            at = {n: i for i, n in enumerate(b.schema.names)}
            length, rank = (b.column(at[c]).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            i = np.searchsorted(key, (length << 44) + rank, side="right") - 1
            j = rank - table_[i, 1]
            arrays = [b.column(k) for n, k in at.items() if n != "_rank"]
            yield pa.record_batch(arrays + [pa.array(table_[i, 3] + j // table_[i, 4]), pa.array(table_[i, 5] + (j % table_[i, 4]) * length)],
                                  [n for n in at if n != "_rank"] + ["sequence_id", "offset"])

    # cells: the bound above makes the broadcast safe at any input size
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (p.withColumn("_row", rank).join(F.broadcast(cells.select("length", "_salt", "_before")), ["length", "_salt"])
              .select(*parts.columns, (F.col("_row") + F.col("_before")).cast("long").alias("_rank")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """Placement of every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return placed(saved(pieces(docs, tokenizer, capacity, eos), "pack-pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, eos: int = EOS) -> DataFrame:
    """The packed sequences themselves: sequence_id and at most ``capacity`` ids."""
    full = placed(saved(pieces(docs, tokenizer, capacity, eos, with_ids=True), "pack-ids"), capacity)
    own = full.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return own.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
