"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word enters as a word embedding (vocabulary of the training sample, one
entry for all other words) joined with the mean embedding of its character
trigrams, all of them.  A run of more than ``PIECE`` bytes without white space
enters as several words: its parts between separators (punctuation, no-break
spaces), those still longer as overlapping pieces.  Forward and backward GRUs read windows of ``WINDOW`` words, an
attention layer pools their states, a logistic layer scores the window.  All
overlapping windows of a whole text are scored; the text's logit is the largest,
calibrated on the training sample.  Training and inference are numpy.

Labels: at most ``max_per_class`` different labelled documents of each class (smallest
seeded hash of doc_id; repeated rows count once) are fetched to train on; of a text longer than
``MAX_TRAIN_CHARS`` characters, ``SECTIONS`` sections of together that length, evenly spaced from its first to its
last character.  That bound holds at any input size.  Label, language, source and id are
never inputs of a score.  Training picks, for each document, its highest windows
and a random one, again in every round.

At inference a word's input projections are computed once per worker and looked
up afterwards.

Nulls: a null text is an empty one, which gets the score of a window without
words; a null doc_id is kept (held_out false).  Repeated rows get equal scores.
Very long texts are scored in bounded blocks of windows.  No labels: every score is 0.
No rows: empty result.  Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import table

WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
MAX_VOCAB, MIN_DF, CHAR_ROWS = 20_000, 3, 2048
MAX_PER_CLASS, MAX_TRAIN_CHARS, ROUNDS, MIN_STEPS, BATCH, SEED = 1200, 20_000, 10, 200, 256, 7
THRESHOLD = 0.7
#: Sections that a longer labelled text is trained on.
SECTIONS = 20
#: Rows of a worker's table of input projections, and windows computed at once.
CACHE_ROWS, WINDOWS = 300_000, 2048
#: Longest word in bytes, and the step between the pieces of a longer one.
PIECE, STEP = 32, 16
_EDGE = b".,;:!?\"'()[]{}|#*$%&<>-_/\\"


_SEPARATOR = re.compile(b"(?:[" + re.escape(_EDGE) + b"+=@~^`]|\xc2\xa0|\xe2\x80[\x80-\x8b\xaf]|\xe3\x80[\x80-\x82]|\xef\xbc\x8c)+")


def normal(w: bytes) -> bytes:
    return w.strip(_EDGE).lower()


def pieces(run: bytes) -> list[bytes]:
    """Words of a run longer than ``PIECE``: parts between separators, longer
    parts cut at characters into pieces that overlap by about PIECE - STEP bytes."""
    out = []
    for part in _SEPARATOR.split(run):
        a = 0
        while len(part) - a > PIECE:
            b = a + PIECE
            while b > a + PIECE - 4 and part[b] & 0xC0 == 0x80:  # not inside a character
                b -= 1
            out.append(part[a:b])
            a += STEP
            while a < b and part[a] & 0xC0 == 0x80:
                a += 1
        if part[a:]:
            out.append(part[a:])
    return out or [b""]


def tokens(text: str | None) -> list[bytes]:
    """White-space words as bytes, runs longer than ``PIECE`` in pieces."""
    ws = text.encode("utf-8").split() if text else []
    if ws and max(map(len, ws)) > PIECE:
        ws = [p for w in ws for p in (pieces(w) if len(w) > PIECE else (w,))]
    return ws


def trigrams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character trigram rows (words x those of the longest, 0 = none) and their numbers."""
    width = max(map(len, ws), default=0) or 1
    flat = np.array([b"^" + w + b"$" for w in ws], dtype=f"S{width + 2}")
    c = flat.view(np.uint8).reshape(len(ws), width + 2).astype(np.int64)
    g = ((c[:, :-2] * 131 + c[:, 1:-1]) * 137 + c[:, 2:]) * 2654435761 % 2**32 % (CHAR_ROWS - 1) + 1
    g[c[:, 2:] == 0] = 0
    return g, np.maximum((g > 0).sum(axis=1), 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _uniform(rng, *shape):
    return rng.uniform(-1, 1, shape) / np.sqrt(shape[0])


def new_parameters(vocab: int, rng, prior: np.ndarray) -> dict[str, np.ndarray]:
    """``prior``: log odds of the vocabulary's words, the start of one word dimension."""
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    p = {"word": rng.normal(0, 0.1, (vocab, WORD_DIM)), "char": rng.normal(0, 0.1, (CHAR_ROWS, CHAR_DIM))}
    p["word"][:, 0] = prior
    p["word"][0] = 0
    p["char"][0] = 0
    for s in "fb":
        p |= {f"w{s}": _uniform(rng, d, 3 * h), f"u{s}": _uniform(rng, h, 3 * h), f"g{s}": np.zeros(3 * h)}
    return p | {"wa": _uniform(rng, 2 * h, ATTENTION), "va": rng.normal(0, 0.1, ATTENTION), "out": _uniform(rng, 2 * h), "bias": np.zeros(1)}


def _run(xg, u, mask, back: bool):
    """GRU over time.  xg: windows x time x 3h input projections."""
    n, t, _ = xg.shape
    h = HIDDEN
    state, kept = np.zeros((n, h), xg.dtype), []
    out = np.zeros((n, t, h), xg.dtype)
    for i in (reversed(range(t)) if back else range(t)):
        hu = state @ u
        zr = _sigmoid(xg[:, i, :2 * h] + hu[:, :2 * h])
        z, r = zr[:, :h], zr[:, h:]
        c = np.tanh(xg[:, i, 2 * h:] + r * hu[:, 2 * h:])
        new = z * state + (1 - z) * c
        m = mask[:, i:i + 1]
        kept.append((i, state, z, r, c, hu[:, 2 * h:]))
        state = m * new + (1 - m) * state
        out[:, i] = state
    return out, kept


def _run_back(dout, kept, u, mask):
    h = HIDDEN
    n, t, _ = dout.shape
    dx, du, ds = np.zeros((n, t, 3 * h)), np.zeros_like(u), np.zeros((n, h))
    for i, prev, z, r, c, hc in reversed(kept):
        ds = ds + dout[:, i]
        m = mask[:, i:i + 1]
        dn = ds * m
        dz, dc, dp = dn * (prev - c), dn * (1 - z), dn * z + ds * (1 - m)
        da = dc * (1 - c * c)
        dr = da * hc
        gz, gr, gh = dz * z * (1 - z), dr * r * (1 - r), da * r
        g = np.concatenate([gz, gr, gh], axis=1)
        du += prev.T @ g
        dx[:, i] = np.concatenate([gz, gr, da], axis=1)
        ds = dp + g @ u.T
    return dx, du


def forward(p, vid, grams, count, mask):
    """Logits of windows.  vid: windows x time; grams: windows x time x trigrams."""
    x = np.concatenate([p["word"][vid], p["char"][grams].sum(axis=2) / count[:, :, None]], axis=2)
    runs = [_run(x @ p[f"w{s}"] + p[f"g{s}"], p[f"u{s}"], mask, s == "b") for s in "fb"]
    hs = np.concatenate([runs[0][0], runs[1][0]], axis=2)
    a = np.tanh(hs @ p["wa"])
    e = np.where(mask > 0, a @ p["va"], -1e9)
    al = np.exp(e - e.max(axis=1, keepdims=True)) * mask
    al /= np.maximum(al.sum(axis=1, keepdims=True), 1e-9)
    pooled = (al[:, :, None] * hs).sum(axis=1)
    return pooled @ p["out"] + p["bias"][0], (x, runs, hs, a, al, pooled)


def gradients(p, vid, grams, count, mask, y, weight):
    logit, (x, runs, hs, a, al, pooled) = forward(p, vid, grams, count, mask)
    dl = weight * (_sigmoid(logit) - y)
    g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()])}
    dpool = dl[:, None] * p["out"]
    dal = (hs * dpool[:, None, :]).sum(axis=2)
    de = al * (dal - (al * dal).sum(axis=1, keepdims=True))
    dh = al[:, :, None] * dpool[:, None, :]
    g["va"] = np.einsum("nt,nta->a", de, a)
    dt = de[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("nth,nta->ha", hs, dt)
    dh += dt @ p["wa"].T
    dx = np.zeros_like(x)
    for s, (_, kept), part in (("f", runs[0], dh[:, :, :HIDDEN]), ("b", runs[1], dh[:, :, HIDDEN:])):
        dg, g[f"u{s}"] = _run_back(part, kept, p[f"u{s}"], mask)
        g[f"w{s}"] = np.einsum("ntd,ntg->dg", x, dg)
        g[f"g{s}"] = dg.sum(axis=(0, 1))
        dx += dg @ p[f"w{s}"].T
    dx *= mask[:, :, None]
    g["word"] = np.zeros_like(p["word"])
    np.add.at(g["word"], vid.ravel(), dx[:, :, :WORD_DIM].reshape(-1, WORD_DIM))
    g["word"][0] = 0  # words outside the vocabulary speak through their characters only
    dc = dx[:, :, WORD_DIM:] / count[:, :, None]
    g["char"] = np.zeros_like(p["char"])
    np.add.at(g["char"], grams.ravel(), np.broadcast_to(dc[:, :, None, :], (*grams.shape, CHAR_DIM)).reshape(-1, CHAR_DIM))
    g["char"][0] = 0
    return g


def window_starts(n: int) -> range:
    """Starts of all overlapping windows; the last one reaches the end."""
    return range(0, max(n - WINDOW, 0) + STRIDE, STRIDE) if n > WINDOW else range(1 if n else 0)


def train(rows: list[tuple[str, int]], prior_weight: tuple[float, float] = (1.0, 1.0), seed: int = SEED) -> dict:
    """Model from (text, label) rows.  ``prior_weight``: how many documents a
    sampled one of class 0 and 1 stands for, used in the calibration."""
    if len({y for _, y in rows}) < 2:
        return {}
    rng = np.random.default_rng(seed)
    docs = [[normal(w) for w in tokens(t)] for t, _ in rows]
    y = np.array([lab for _, lab in rows], float)
    df: dict[bytes, list[int]] = {}
    for d, lab in zip(docs, y):
        for w in set(d):
            df.setdefault(w, [0, 0])[int(lab)] += 1
    vocab = sorted((w for w, (a, b) in df.items() if a + b >= MIN_DF and w), key=lambda w: (-sum(df[w]), w))[:MAX_VOCAB]
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    odds = np.array([0.0] + [np.log((df[w][1] + 0.5) / (n1 + 1)) - np.log((df[w][0] + 0.5) / (n0 + 1)) for w in vocab])
    sure = np.array([0.0] + [min(1.0, sum(df[w]) / 20) for w in vocab])
    ids = {w: i + 1 for i, w in enumerate(vocab)}
    p = new_parameters(len(vocab) + 1, rng, np.clip(odds * sure, -4, 4) / 2)

    spell = sorted({w for d in docs for w in d})
    at = {w: i + 1 for i, w in enumerate(spell)}
    g, c = trigrams(spell)
    grams = np.concatenate([np.zeros((1, g.shape[1]), np.int64), g])
    count = np.concatenate([[1], c]).astype(float)
    width = np.array([1] + [max(len(w), 1) for w in spell])
    vids = np.array([0] + [ids.get(w, 0) for w in spell])
    starts = [(d, s) for d, ws in enumerate(docs) for s in window_starts(len(ws))]
    of = np.array([d for d, _ in starts])
    win = np.zeros((len(starts), WINDOW), np.int32)
    flat = [np.array([at[w] for w in ws], np.int32) for ws in docs]
    for i, (d, s) in enumerate(starts):
        part = flat[d][s:s + WINDOW]
        win[i, :len(part)] = part
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    lo = np.searchsorted(of, np.arange(len(docs)))
    hi = np.searchsorted(of, np.arange(len(docs)), side="right")
    score = np.where(win > 0, np.clip(odds * sure, -4, 4)[vids[win]], -9).max(axis=1)
    step = epoch = 0
    batch = min(BATCH, max(32, len(docs) // 4))
    while epoch < ROUNDS or step < MIN_STEPS:
        if epoch:
            score = fast_logits(p, vids, grams, count, win)
        pick = []
        for d in range(len(docs)):
            if hi[d] > lo[d]:
                own = lo[d] + np.argsort(-score[lo[d]:hi[d]], kind="stable")[:2]
                pick += [(own[0], y[d])]
                if not y[d]:
                    pick += [(i, 0.0) for i in (*own[1:], rng.integers(lo[d], hi[d]))]
        rng.shuffle(pick)
        epoch += 1
        if not pick:
            break
        for i in range(0, len(pick), batch):
            some = pick[i:i + batch]
            w = win[[int(a) for a, _ in some]]
            lab = np.array([b for _, b in some])
            some_grams = grams[:, :int(width[w].max())][w]
            grad = gradients(p, vids[w], some_grams, count[w], (w > 0).astype(float), lab, np.full(len(lab), 1 / len(lab)))
            step += 1
            for k in p:
                m, v = moments[k]
                m += 0.1 * (grad[k] - m)
                v += 0.001 * (grad[k] ** 2 - v)
                p[k] -= 0.01 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    score = fast_logits(p, vids, grams, count, win)
    top = np.array([score[a:b].max() if b > a else p["bias"][0] for a, b in zip(lo, hi)])
    weight = np.where(y > 0, prior_weight[1], prior_weight[0])
    cal = np.array([1.0, 0.0])  # where the ridge below pulls to
    x = np.stack([np.clip(top, -12, 12), np.ones_like(top)], axis=1)
    for _ in range(100):
        q = _sigmoid(x @ cal)
        grad_c = x.T @ (weight * (q - y)) + (cal - np.array([1.0, 0.0]))
        hess = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + np.eye(2)
        cal = cal - np.clip(np.linalg.solve(hess, grad_c), -1, 1)
    cal[0] = max(cal[0], 0.05)
    return {"p": {k: v.astype(np.float32) for k, v in p.items()}, "ids": ids, "cal": cal}


def fast_logits(p, vids, grams, count, win) -> np.ndarray:
    """Logits of training windows through per-word input projections."""
    q = Projections(p, None)
    q.add(vids[1:], grams[1:], count[1:])  # row 0 is there
    return np.concatenate([q.logits(win[i:i + WINDOWS]) for i in range(0, len(win), WINDOWS)]) if len(win) else np.zeros(0)


class Projections(dict):
    """Word to row of both GRUs' input projections; row 0 stands for no word.

    The network runs feature-major: the gates of both directions are rows of one
    array (update, reset, candidate; each forward then backward), windows are its
    columns, and one step moves the forward and the backward network.
    """

    def __init__(self, p, ids):
        super().__init__()
        h = HIDDEN
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.ids = ids
        # sigma(x) = (1 + tanh(x / 2)) / 2: gates are halved here, so that one tanh serves all
        half = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), h)
        self.of_word = [self.p["word"] @ (self.p[f"w{s}"][:WORD_DIM] * half) + self.p[f"g{s}"] * half for s in "fb"]
        self.of_char = [self.p[f"w{s}"][WORD_DIM:] * half for s in "fb"]
        self.u = np.zeros((6 * h, 2 * h), np.float32)
        for k, s in enumerate("fb"):
            for gate in range(3):
                self.u[(2 * gate + k) * h:(2 * gate + k + 1) * h, k * h:(k + 1) * h] = (self.p[f"u{s}"] * half)[:, gate * h:(gate + 1) * h].T
        self.pending: list[bytes] = []
        self._empty()

    def _empty(self) -> None:
        self.rows, self.n = [np.zeros((1024, 3 * HIDDEN), np.float32) for _ in "fb"], 1

    def add(self, vid: np.ndarray, grams: np.ndarray, count: np.ndarray) -> None:
        """Append rows of words, from vocabulary rows and trigrams."""
        m = self.n + len(vid)
        if m > len(self.rows[0]):
            self.rows = [np.concatenate([r[:self.n], np.zeros((max(m, 2 * self.n) - self.n, r.shape[1]), np.float32)]) for r in self.rows]
        size = (grams > 0).sum(axis=1)
        order = np.argsort(-size, kind="stable")
        across = np.ascontiguousarray(grams[order].T)
        sums, char = np.zeros((len(vid), CHAR_DIM), np.float32), self.p["char"]
        longer = len(vid) - np.searchsorted(np.sort(size), np.arange(len(across)), side="right")
        for row, k in zip(across, longer.tolist()):  # the k words with more trigrams than this place
            sums[:k] += char[row[:k]]
        mean = np.empty_like(sums)
        mean[order] = sums
        mean /= count[:, None].astype(np.float32)
        for r, word, c in zip(self.rows, self.of_word, self.of_char):
            r[self.n:m] = word[vid] + mean @ c
        self.n = m

    def __missing__(self, w: bytes) -> int:
        self.pending.append(w)
        i = self[w] = self.n + len(self.pending) - 1
        return i

    def settle(self) -> None:
        if self.pending:
            ws = [normal(w) for w in self.pending]
            g, c = trigrams(ws)
            get = self.ids.get
            self.add(np.array([get(w, 0) for w in ws]), g, c)
            self.pending = []

    def forget(self) -> None:
        if self.n > CACHE_ROWS:
            self.clear()
            self._empty()

    def logits(self, win: np.ndarray) -> np.ndarray:
        (n, t), h = win.shape, HIDDEN
        at = np.ascontiguousarray(win.T)
        mask = at > 0
        full = mask.all(axis=1)
        hs = np.empty((t, 2 * h, n), np.float32)
        state, hu = np.zeros((2 * h, n), np.float32), np.empty((6 * h, n), np.float32)
        x, rows = np.empty((6 * h, n), np.float32), np.empty((n, 3 * h), np.float32)
        gates = x.reshape(3, 2, h, n)
        for i in range(t):
            for k, j in ((0, i), (1, t - 1 - i)):
                np.take(self.rows[k], at[j], axis=0, out=rows, mode="clip")
                gates[:, k] = rows.T.reshape(3, h, n)
            np.matmul(self.u, state, out=hu)
            zr, c = x[:4 * h], hu[4 * h:]
            zr += hu[:4 * h]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            c *= zr[2 * h:]
            c += x[4 * h:]
            np.tanh(c, out=c)
            new = state - c
            new *= zr[:2 * h]
            new += c
            for part, j in ((slice(0, h), i), (slice(h, 2 * h), t - 1 - i)):
                if not full[j]:
                    new[part] = np.where(mask[j], new[part], state[part])
                hs[j, part] = new[part]
            state = new
        e = np.matmul(self.p["va"], np.tanh(np.matmul(self.p["wa"].T, hs)))  # time x windows
        e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e *= mask
        al = e / np.maximum(e.sum(axis=0), 1e-9)
        return (al * np.matmul(self.p["out"], hs)).sum(axis=0) + self.p["bias"][0]


class Scorer:
    def __init__(self, model: dict):
        self.model, self.words = model, Projections(model["p"], model["ids"]) if model else None

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts, 0 to 1."""
        if not self.model:
            return np.zeros(len(texts))
        top = np.full(len(texts), -np.inf)
        rows, of = [], []

        def flush():
            if rows:
                win, doc = np.concatenate(rows), np.concatenate(of)
                self.words.settle()
                got = np.concatenate([self.words.logits(win[a:a + WINDOWS]) for a in range(0, len(win), WINDOWS)])
                np.maximum.at(top, doc, got)
                rows.clear()
                of.clear()
                self.words.forget()

        held = 0
        for d, t in enumerate(texts):
            ws = tokens(t)
            if not ws:
                continue
            for a in range(0, len(ws), 1 << 16):  # long texts in parts that overlap by a window
                part = ws[a:a + (1 << 16) + WINDOW]
                ids = np.fromiter(map(self.words.__getitem__, part), np.int32, len(part))
                n = len(window_starts(len(ids)))
                pad = np.zeros((n - 1) * STRIDE + WINDOW, np.int32)
                pad[:len(ids)] = ids[:len(pad)]
                rows.append(np.lib.stride_tricks.sliding_window_view(pad, WINDOW)[::STRIDE])
                of.append(np.full(n, d))
                held += n
                if held >= 4 * WINDOWS:
                    flush()
                    held = 0
        flush()
        top[~np.isfinite(top)] = self.words.p["bias"][0]
        a, c = self.model["cal"]
        return _sigmoid(a * np.clip(top, -12, 12) + c)


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def excerpt(text) -> "F.Column":
    """The text, or the sections of one longer than ``MAX_TRAIN_CHARS`` characters."""
    size = MAX_TRAIN_CHARS // SECTIONS
    n = F.char_length(text)
    step = (n - size) / (SECTIONS - 1)
    parts = [F.substring(text, F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(SECTIONS)]
    return F.when(n <= MAX_TRAIN_CHARS, text).otherwise(F.concat_ws(" ", *parts))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, seed: int = SEED) -> dict:
    """Train on at most ``max_per_class`` labelled documents of each class, never held-out ones."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct())
    total = {r.toxic: r.n for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = None
    for c in (0, 1):
        part = lab.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_per_class)
        some = part if some is None else some.union(part)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    # at most 2 x max_per_class ids: a bounded broadcast; repeated rows are merged before anything is counted
    some_text = text.join(F.broadcast(some), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("th"), excerpt(F.col("text")).alias("text"))
    found = (some_text.groupBy("doc_id", "toxic", "th").agg(F.min("text").alias("text"))
             .withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "toxic").orderBy("th"))).filter(F.col("nth") <= max_per_class))
    rows = []
    for c in (0, 1):  # one text of every id before a second of any
        rows += (found.filter(F.col("toxic") == c).orderBy("nth", F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_per_class)
                 .select("doc_id", "toxic", "text").collect())
    rows = sorted((r.doc_id, r.toxic, r.text) for r in rows)
    n = {c: max(1, sum(r[1] == c for r in rows)) for c in (0, 1)}
    return train([(t, lab_) for _, lab_, t in rows], (total.get(0, 1) / n[0], total.get(1, 1) / n[1]), seed)


_SCORERS: dict[str, Scorer] = {}


def _scorer(token: str, held) -> Scorer:
    """One scorer per worker and fitted model (``token`` is unique to the fit)."""
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = Scorer(held.value)
    return _SCORERS[token]


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary and matrices of fixed size
    token = uuid.uuid4().hex

    def run(batches):
        s = _scorer(token, held)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(s.scores(b.column(1).to_pylist()).astype(np.float64))], ["doc_id", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    token, at = uuid.uuid4().hex, docs.columns.index("text")

    def run(batches):
        s = _scorer(token, held)
        for b in batches:
            yield b.filter(pa.array(s.scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
