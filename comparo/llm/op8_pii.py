"""Personal data by weak supervision.

Candidates: the base spans of four kinds (email, ip, card, phone; regular
expressions with their checks) and looser spans of the same kinds: emails with
``at``/``dot`` spelled out (in brackets or between blanks) or blanks around the
@, addresses of IP version 6 with three groups or more, phone-like digit groups without a plus, cards with
dots or dashes doubled up.  Every candidate gets votes (for, against, abstain)
from regex, gazetteer and context labelers.  Votes form a small pattern, so
the whole corpus reduces to counts per (kind, pattern): at most 3^7 * 8 rows.
On these counts expectation-maximisation estimates each labeler's reliability
and each pattern's probability of being personal data; a logistic span
classifier over votes and shape features is then trained with these soft labels
and decides on the looser spans.  Base spans stay whatever it says.

Spans are code points, end exclusive, non-overlapping within a kind; a looser
span that touches a base span of any kind is not a candidate.

Nulls: a null text is empty, a null doc_id is kept.  Empty texts have no span
(the hash of the empty string).  Texts of any length are searched whole, in
linear time.  Repeated rows are treated alike.  No rows: empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from comparo.llm.common import saved, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a start inside a digit run ends where the run's start does
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}) ?[\[(] ?(?:at|AT|@) ?[\])] ?([A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]{1,63}){1,4})")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z.-])")
_LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z.])[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){3}(?![0-9A-Za-z])")
_SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} (?:at|AT) [A-Za-z0-9-]{2,63}(?: (?:dot|DOT) [A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9-])")
_SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} {0,2}@ {0,2}[A-Za-z0-9-]{1,63}(?:(?: \. |\.)[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9-])")
_V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]{0,38}::)[0-9A-Fa-f:]{3,39})(?![0-9A-Za-z:])")
_TRUNK_PHONE = re.compile(r"(?<![0-9A-Za-z+./-])(?:00[1-9][0-9]{0,2}|0[0-9]{2,4})[ /-]?[0-9]{2,8}(?:[ /-][0-9]{2,8}){0,3}(?![0-9A-Za-z/-]|\.[0-9])")
_DIGITS = re.compile(r"[^0-9]+")
#: Cue words, fixed values of the context labelers.
CUES = {"email": ("mail", "e-mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
        "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono")}
COUNTER_CUES = ("version", "isbn", "figure", "section", "page", "total", "sum")
#: Fixed gazetteers: common last labels of mail domains, test prefixes of numbers, reserved network prefixes.
DOMAIN_ENDS = frozenset("com org net edu gov mil int io ai app dev info biz name co us ca mx br ar cl uk ie de at ch fr be nl lu es pt it gr "
                        "pl cz sk hu ro bg se no dk fi is ee lv lt ua ru tr il in cn hk tw jp kr sg au nz za eu".split())
RESERVED_NETS = ("0.", "127.", "255.", "::", "fe80:", "ff0")
ROUNDS = 50
#: A looser span is kept at this probability, and only if more labelers speak for it than against it.
KEEP = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the four base kinds."""
    out, end, p = [], 0, t.find("@")
    while p >= 0:
        s = p
        while s > end and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, p + 1) if s < p else None
        if m:
            end = m.end()
            out.append((0, s, end))
        else:
            end = max(end, p + 1)  # no local part crosses an @
        p = t.find("@", end)
    for m in _IP.finditer(t):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (y.lstrip("0") for y in m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13:
            d = _DIGITS.sub("", m[0]) if m.end() - m.start() < 64 else ""
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def looser_spans(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base: (kind number, start, end), clear of base spans."""
    found = []
    if "(" in t or "[" in t:
        found += [(0, m.start(), m.end()) for m in _AT.finditer(t)]
    if " dot " in t or " DOT " in t:
        found += [(0, m.start(), m.end()) for m in _SPOKEN.finditer(t)]
    if "@ " in t or " @" in t:
        found += [(0, m.start(), m.end()) for m in _SPACED.finditer(t)]
    if ":" in t:
        found += [(1, m.start(), m.end()) for m in _V6.finditer(t) if len(m[0].replace("::", ":").strip(":").split(":")) >= 3 and re.search("[0-9]", m[0])]
    found += [(2, m.start(), m.end()) for m in _LOOSE_CARD.finditer(t)]
    found += [(3, m.start(), m.end()) for m in _LOOSE_PHONE.finditer(t)]
    found += [(3, m.start(), m.end()) for m in _TRUNK_PHONE.finditer(t)]
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    out, last = [], {}
    for kind, s, e in sorted(found, key=lambda x: (x[1], x[0])):
        i = int(np.searchsorted(starts, e, side="left")) - 1
        if (i >= 0 and ends[i] > s) or last.get("any", -1) > s:
            continue
        last["any"] = e
        out.append((kind, s, e))
    return out


def _is_v6(span: str) -> bool:
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def votes(t: str, kind: int, s: int, e: int, is_base: bool) -> tuple[int, ...]:
    """-1, 0 or 1 from each labeler: strict pattern, checksum or range, gazetteer,
    cue before, counter cue before, clean edges, digit variety."""
    span = t[s:e]
    before = t[max(0, s - 40):s].lower()
    digits = _DIGITS.sub("", span)
    strict = 1 if is_base else 0
    if kind == 0:
        check = 1 if any(c in span for c in "@([") else 0  # words alone say nothing
        gaz = 1 if re.split(r"[.\s()\[\]]+", span.lower().rstrip(")] "))[-1] in DOMAIN_ENDS else -1
    elif kind == 1:
        good = _is_v6(span) if ":" in span else all(x == "0" or not x.startswith("0") for x in span.split("."))
        check = 1 if good else -1
        gaz = -1 if span.lower().startswith(RESERVED_NETS) else 0
    elif kind == 2:
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gaz = 1 if digits[:1] in "3456" else -1
    else:
        check = 1 if 9 <= len(digits) <= 15 else -1
        gaz = -1 if len(digits) == 8 and digits[:2] in ("19", "20") else 0
    cue = 1 if any(c in before for c in CUES[KINDS[kind]]) else 0
    counter = -1 if any(c in before for c in COUNTER_CUES) else 0
    edge = 1 if (s == 0 or not t[s - 1].isalnum()) and (e == len(t) or not t[e].isalnum()) else -1
    variety = 0 if kind == 0 else 1 if len(set(digits)) >= 3 else -1
    return strict, check, gaz, cue, counter, edge, variety


LABELERS = 7


def pattern(kind: int, v: tuple[int, ...]) -> int:
    out = kind
    for x in v:
        out = out * 3 + x + 1
    return out


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and vote matrix of pattern codes."""
    v = np.zeros((len(codes), LABELERS), np.int64)
    c = codes.copy()
    for j in reversed(range(LABELERS)):
        v[:, j] = c % 3 - 1
        c //= 3
    return c, v


def reliabilities(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation on vote patterns with counts n.  Each kind and
    labeler has P(vote | personal) and P(vote | not).  Returns every pattern's
    probability and the table kind x labeler x class x vote."""
    table_ = np.zeros((len(KINDS), LABELERS, 2, 3))
    score = v.sum(axis=1)
    p = np.clip(0.5 + 0.15 * score, 0.05, 0.95)
    for _ in range(rounds):
        post = np.zeros((len(n), 2))
        for k in range(len(KINDS)):
            own = kinds == k
            w = n[own] * p[own]
            u = n[own] * (1 - p[own])
            prior = (w.sum() + 1) / (n[own].sum() + 2)
            lg = np.stack([np.full(own.sum(), np.log(1 - prior)), np.full(own.sum(), np.log(prior))], axis=1)
            for j in range(LABELERS):
                for c, weight in ((0, u), (1, w)):
                    # a vote's meaning is anchored: pseudo-counts say that votes for are likelier on personal data
                    anchor = np.array([1.0, 2.0, 4.0]) if c else np.array([4.0, 2.0, 1.0])
                    q = np.bincount(v[own, j] + 1, weights=weight, minlength=3) + 0.01 * n[own].sum() * anchor / 7 + anchor
                    table_[k, j, c] = q / q.sum()
                    lg[:, c] += np.log(table_[k, j, c][v[own, j] + 1])
            post[own] = np.exp(lg - lg.max(axis=1, keepdims=True))
        new = post[:, 1] / np.maximum(post.sum(axis=1), 1e-300)
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, table_


def _features(kinds: np.ndarray, v: np.ndarray) -> np.ndarray:
    one = np.eye(len(KINDS))[kinds]
    return np.concatenate([one, v == 1, v == -1], axis=1).astype(float)


def train_classifier(kinds: np.ndarray, v: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic span classifier by Newton steps on the soft labels."""
    x = _features(kinds, v)
    w = np.zeros(x.shape[1])
    if not len(n):
        return w
    scale = n / n.sum()
    for _ in range(rounds):
        y = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (scale * (y - p)) + 1e-3 * w
        h = (x * (scale * np.maximum(y * (1 - y), 1e-6))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and loose: lists of [kind, start, end, pattern] flattened."""
    def run(batches):
        for b in batches:
            base, loose = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                own = base_spans(t)
                base.append([x for k, s, e in own for x in (k, s, e, pattern(k, votes(t, k, s, e, True)))])
                loose.append([x for k, s, e in looser_spans(t, own) for x in (k, s, e, pattern(k, votes(t, k, s, e, False)))])
            kind = pa.list_(pa.int64())
            yield pa.record_batch([b.column(0), pa.array(base, kind), pa.array(loose, kind)], ["doc_id", "base", "loose"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, base array<long>, loose array<long>")


def found(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, base and spans: lists of [kind, start, end] flattened, by kind and start."""
    c = saved(candidates(docs), "pii-candidates")
    codes = F.concat("base", "loose")
    code = F.explode(F.transform(F.sequence(F.lit(4), F.size(codes), F.lit(4)), lambda i: F.element_at(codes, i.cast("int"))))
    seen = c.filter(F.size(codes) > 0).select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()  # at most 4 * 3^7 rows
    arr = np.array(sorted((r.code, r.n) for r in seen), np.int64).reshape(-1, 2)
    kinds, v = unpack(arr[:, 0])
    p, _ = reliabilities(kinds, v, arr[:, 1].astype(float))
    w = train_classifier(kinds, v, arr[:, 1].astype(float), p)
    prob = 1 / (1 + np.exp(-np.clip(_features(kinds, v) @ w, -30, 30)))
    good = {int(k) for k, x, s in zip(arr[:, 0], prob, v.sum(axis=1)) if x >= keep and s > 0}

    def run(batches):
        for b in batches:
            base, spans = [], []
            for own, more in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                mine = sorted((own[i], own[i + 1], own[i + 2]) for i in range(0, len(own), 4))
                added = [(more[i], more[i + 1], more[i + 2]) for i in range(0, len(more), 4) if more[i + 3] in good]
                base.append([x for s in mine for x in s])
                spans.append([x for s in sorted(mine + added) for x in s])
            kind = pa.list_(pa.int64())
            yield pa.record_batch([b.column(0), pa.array(base, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    return c.mapInArrow(run, "doc_id long, base array<long>, spans array<long>")


def redacted(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id and text with every span replaced by its kind's name in brackets.
    Rows that share a doc_id must share a text."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = found(docs, keep).select(F.col("doc_id").alias("_id"), "spans").dropDuplicates(["_id"])

    def run(batches):
        for b in batches:
            out = []
            for t, flat in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if t is not None and flat:
                    parts, at = [], 0
                    for s, e, k in sorted((flat[i + 1], flat[i + 2], flat[i]) for i in range(0, len(flat), 3)):
                        if e > at:
                            parts += [t[at:max(s, at)], f"[{KINDS[k]}]" if s >= at else ""]
                            at = e
                    t = "".join(parts) + t[at:]
                out.append(t)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return d.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def _joined(flat: list[int]) -> str:
    return ",".join(f"{KINDS[flat[i]]}:{flat[i + 1]}:{flat[i + 2]}" for i in range(0, len(flat), 3))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            base = b.column(1).to_pylist()
            n = [[sum(k == j for k in x[::3]) for x in base] for j in range(4)]
            yield pa.record_batch(
                [b.column(0), *(pa.array(c, pa.int64()) for c in n), pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base], pa.string()),
                 pa.array([_joined(x) for x in b.column(2).to_pylist()], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return found(table(spark, sf_dir, "documents")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
