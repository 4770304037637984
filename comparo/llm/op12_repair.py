"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation should read ``(system? (user assistant)+)?``.  A lattice node is
(rows taken, state of that grammar); its edges are the edits Keep, Rerole (to
user or assistant), Delete and Insert (an empty user or assistant turn) with
their costs.  One heap grows from the start, another from the accepting ends;
when they meet, both go on until every crossing of the cheapest cost is
settled.  Of all cheapest edit sequences the one with the ASCII-least
initials (its audit) is taken: nodes that lie on a cheapest path to a crossing
are marked, and a walk from the start takes the least letter that stays on them.
In a state a letter leads to one node, so no audit into a node is a prefix of another one of
the same cost and the least concatenation is found without comparing strings.

Faults, the first of each row counts: blank (no character but white space),
duplicate (role and text seen earlier), truncated (last such character not one
of ``.!?``).  Blank and duplicate rows must go; a truncated row that stays
costs extra.

Work on Spark: rows are ranked inside (conversation, turn) and checked for copies
by hash inside (conversation, role, text hash), so a long conversation is spread
over tasks; only two characters a row and its order key meet in the task that
searches the lattice, texts do not.  The edits are joined back to the rows.

Nulls: role and text read as one space, a null turn sorts first and counts in no
gap, a null conv_id is a conversation of its own.  Rows of one turn are ordered by
role, then text; repeated rows are duplicates.  Texts of any length are taken
whole.  Empty tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from comparo.llm.common import saved, table

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that fits, and the states before one.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,), START: (), SYSTEM: ()}
#: Where a kept row of each initial may stand: initial -> (states before, state after).
KEPT = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}


def _onward(node: int, initials: str, faults: str) -> Iterator[tuple[str, int, int]]:
    """letter, cost, next node: in ASCII order of the letters."""
    i, q = node >> 2, node & 3
    if i < len(initials):
        yield "D", DELETE, node + 4
    yield "I", INSERT, (i << 2) | NEXT[q]
    if i < len(initials) and faults[i] != "d":
        more = CUT if faults[i] == "t" else 0
        before, after = KEPT.get(initials[i], ((), 0))
        if q in before:
            yield "K", KEEP + more, ((i + 1) << 2) | after
        yield "R", REROLE + more, ((i + 1) << 2) | NEXT[q]


def _backward(node: int, initials: str, faults: str) -> Iterator[tuple[int, int]]:
    """cost, node before."""
    i, q = node >> 2, node & 3
    for p in BEFORE[q]:
        yield INSERT, (i << 2) | p
    if i:
        yield DELETE, node - 4
        if faults[i - 1] != "d":
            more = CUT if faults[i - 1] == "t" else 0
            before, after = KEPT.get(initials[i - 1], ((), 0))
            if after == q:
                for p in before:
                    yield KEEP + more, ((i - 1) << 2) | p
            for p in BEFORE[q]:
                yield REROLE + more, ((i - 1) << 2) | p


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """Cost and audit of the cheapest, then ASCII-least edits.

    One character a row: its role's initial, and its fault (``d`` must go, ``t``
    truncated, else sound).
    """
    n = len(initials)
    ends = ((n << 2) | START, (n << 2) | ASSISTANT)
    ahead, back = {}, {}  # settled distances from the start, to an end
    best_a, best_b = {START: 0}, {e: 0 for e in ends}
    heap_a, heap_b = [(0, START)], [(0, e) for e in ends]
    heapq.heapify(heap_b)
    meet = best_b.get(START, float("inf"))

    def settle(heap, best, done, other, edges):
        nonlocal meet
        d, v = heapq.heappop(heap)
        if v in done:
            return
        done[v] = d
        if v in other:
            meet = min(meet, d + other[v])
        for cost, w in edges(v):
            if d + cost < best.get(w, float("inf")):
                best[w] = d + cost
                heapq.heappush(heap, (d + cost, w))
                if w in other:
                    meet = min(meet, d + cost + other[w])

    def out(v):
        return ((c, w) for _, c, w in _onward(v, initials, faults))

    def into(v):
        return _backward(v, initials, faults)

    while heap_a and heap_b and heap_a[0][0] + heap_b[0][0] <= meet:
        if heap_a[0][0] <= heap_b[0][0]:
            settle(heap_a, best_a, ahead, best_b, out)
        else:
            settle(heap_b, best_b, back, best_a, into)
    far_a, far_b = max(ahead.values(), default=0), max(back.values(), default=0)
    while heap_a and heap_a[0][0] <= far_a:  # the rest of the outermost rings: ties of crossings
        settle(heap_a, best_a, ahead, best_b, out)
    while heap_b and heap_b[0][0] <= far_b:
        settle(heap_b, best_b, back, best_a, into)

    cross = [v for v, d in ahead.items() if any(w in back and d + c + back[w] == meet for c, w in out(v)) or d + back.get(v, float("inf")) == meet]
    useful, stack = set(cross), cross
    while stack:
        v = stack.pop()
        for c, p in into(v):
            if p in ahead and p not in useful and ahead[p] + c == ahead[v]:
                useful.add(p)
                stack.append(p)
    audit, v, spent = [], START, 0
    while not (v in ends and spent == meet):
        for letter, c, w in _onward(v, initials, faults):
            if (w in back and spent + c + back[w] == meet) or (w in useful and ahead[w] == spent + c):
                audit.append(letter)
                v, spent = w, spent + c
                break
        else:
            raise AssertionError("no cheapest edge")
    return int(meet), "".join(audit)


def outcome(initials: str, audit: str) -> tuple[list[int], list[str | None]]:
    """For each turn of the repaired conversation: the row it comes from (-1: inserted) and its new role (None: unchanged)."""
    at, roles, i, q = [], [], 0, START
    for letter in audit:
        if letter != "D":
            q = KEPT[initials[i]][1] if letter == "K" else NEXT[q]
            at.append(-1 if letter == "I" else i)
            roles.append(None if letter == "K" else "user" if q == USER else "assistant")
        i += letter != "I"
    return at, roles


def flagged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, k (place among the rows of one turn), role, text, fault (blank, duplicate, truncated or null)."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    core = F.rtrim(F.col("text"), F.lit(WHITE))
    t = saved(t.select("conv_id", "turn", "k", "role", "text", (core == "").alias("_blank"), (~F.substring(core, -1, 1).isin(".", "!", "?")).alias("_cut"),
                       F.xxhash64("text").alias("_h1"), F.xxhash64(F.lit(1), "text").alias("_h2")), "turns")
    same = Window.partitionBy("conv_id", "role", "_h1", "_h2").orderBy(F.asc_nulls_first("turn"), "k")
    keys = t.select("conv_id", "turn", "k", "role", "_blank", "_cut", "_h1", "_h2").withColumn("_again", F.row_number().over(same) > 1)
    found = keys.select("conv_id", "turn", "k", F.when(F.col("_blank"), "blank").when(F.col("_again"), "duplicate").when(F.col("_cut"), "truncated").alias("fault"),
                        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x").alias("initial"))
    out = saved(found, "turn-faults")
    out._comparo_turns = t.select("conv_id", "turn", "k", "role", "text")
    return out


_EDITS = "conv_id long, audit string, cost long, illegal long, at array<int>, roles array<string>"


def edits(found: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, rows (array of turn, k), at, roles."""
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", "t").otherwise("k")
    count = lambda f: F.count(F.when(F.col("fault") == f, 1)).alias(f)
    each = found.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "k", "initial", code.alias("code")))).alias("rows"), count("blank"), count("duplicate"), count("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    each = saved(each.select("conv_id", F.array_join(F.transform("rows", lambda r: r["initial"]), "").alias("initials"), F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("faults"),
                             F.transform("rows", lambda r: F.struct(r["turn"].alias("turn"), r["k"].alias("k"))).alias("rows"), "gaps", "blank", "duplicate", "truncated"), "turn-codes")

    def search(frames):
        for f in frames:
            out = []
            for c, initials, faults in zip(f["conv_id"], f["initials"], f["faults"]):
                cost, audit = cheapest(initials, faults)
                at, roles = outcome(initials, audit)
                wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                out.append((c, audit, cost, wrong, at, roles))
            p = pd.DataFrame(out, columns=["conv_id", "audit", "cost", "illegal", "at", "roles"])
            yield p.assign(conv_id=p["conv_id"].astype("Int64"))

    got = each.select("conv_id", "initials", "faults").mapInPandas(search, _EDITS)
    return each.drop("initials", "faults").alias("e").join(got.alias("g"), F.col("e.conv_id").eqNullSafe(F.col("g.conv_id"))).select("e.*", "g.audit", "g.cost", "g.illegal", "g.at", "g.roles")


def repaired(found: DataFrame, plan: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, seq (from 0), role, text, turn and k of the row each comes from (null: inserted)."""
    place = F.when(F.col("p.at") >= 0, F.element_at("rows", F.col("p.at") + 1))
    steps = plan.select("conv_id", "rows", F.posexplode(F.arrays_zip("at", "roles")).alias("seq", "p")).select(
        "conv_id", "seq", place.alias("row"), F.col("p.roles").alias("new")).select("conv_id", "seq", F.col("row.turn").alias("turn"), F.col("row.k").alias("k"), "new")
    t = found._comparo_turns.alias("t")
    s = steps.alias("s")
    match = F.col("s.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("s.turn").eqNullSafe(F.col("t.turn")) & (F.col("s.k") == F.col("t.k"))
    return s.join(t, match, "left").select("s.conv_id", "s.seq", F.coalesce("s.new", "t.role").alias("role"), F.coalesce("t.text", F.lit("")).alias("text"), "s.turn", "s.k")


def _key(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conv: DataFrame) -> DataFrame:
    """The contract's damage, one fault by the checksum of ``conv_id:turn``."""
    c = conv.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                    F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn"))) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    return c.filter("how <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                       F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    found = flagged(damaged(conv))
    plan = saved(edits(found), "turn-edits")
    said = repaired(found, plan).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.concat("role", F.lit(":"), "text").alias("line")))).alias("ls")).select(
        "conv_id", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("whole"))
    ids = conv.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i")
    p, s = plan.alias("p"), said.alias("s")
    j = ids.join(p, F.col("i.conv_id").eqNullSafe(F.col("p.conv_id")), "left").join(s, F.col("i.conv_id").eqNullSafe(F.col("s.conv_id")), "left")
    zero = [F.coalesce(F.col(f"p.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select("i.conv_id", *zero, F.coalesce("p.audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("s.whole", F.lit("")), 256).alias("repaired_sha256"))


_STEP = "{{'c': {s}.c + {c}, 'a': {s}.a || '{l}', 't': {s}.t || {t}}}"
_FAR = 1_000_000_000


def _go(s: str, cost: str, letter: str, text: str = "''") -> str:
    return _STEP.format(s=s, c=cost, l=letter, t=text)


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _when(cond: str, option: str) -> str:
    return f"CASE WHEN {cond} THEN {option} ELSE {{'c': {_FAR}, 'a': '', 't': ''}} END"


_U, _A, _ROW = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || r.role || ':' || r.text"
_AS_U, _AS_A = "chr(10) || 'user:' || r.text", "chr(10) || 'assistant:' || r.text"
_MORE = "CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END"
_STAYS = "r.fault IS NULL OR r.fault = 'truncated'"
#: States q0 (start), q1 (system), q2 (user), q3 (assistant), each a struct (cost, audit, text), after insertions.
_CLOSED = f"""q0, q1, {_least('q2', *(_go(q, '3', 'I', _U) for q in ('q0', 'q1', 'q3')))} AS i2,
  {_least('q3', _go(_least('q2', *(_go(q, '3', 'I', _U) for q in ('q0', 'q1', 'q3'))), '3', 'I', _A))} AS i3"""
OP12_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
-- zlib's crc32, bit by bit from its polynomial
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
crc AS (SELECT *, list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(k)), lambda i: CAST(ascii(decode(k)[i + 1]) AS BIGINT)),
   lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c FROM src),
how AS (SELECT *, xor(c, 4294967295) % 20 AS how FROM crc),
hurt AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
   CASE WHEN how = 1 THEN '' WHEN how = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM how WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM hurt),
again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM placed),
rws AS (SELECT conv_id, turn, i, role, text, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial,
   CASE WHEN core = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN core[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM again),
states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS q0, {{'c': {_FAR}::BIGINT, 'a': '', 't': ''}} AS q1, {{'c': {_FAR}::BIGINT, 'a': '', 't': ''}} AS q2, {{'c': {_FAR}::BIGINT, 'a': '', 't': ''}} AS q3 FROM rws
  UNION ALL
  SELECT s.conv_id, r.i, {_go('q0', '4', 'D')},
    {_least(_go('q1', '4', 'D'), _when(f"({_STAYS}) AND initial = 's'", _go('q0', _MORE, 'K', _ROW)))},
    {_least(_go('i2', '4', 'D'), *(_when(f"({_STAYS}) AND initial = 'u'", _go(q, _MORE, 'K', _ROW)) for q in ('q0', 'q1', 'i3')), *(_when(_STAYS, _go(q, f'3 + {_MORE}', 'R', _AS_U)) for q in ('q0', 'q1', 'i3')))},
    {_least(_go('i3', '4', 'D'), _when(f"({_STAYS}) AND initial = 'a'", _go('i2', _MORE, 'K', _ROW)), _when(_STAYS, _go('i2', f'3 + {_MORE}', 'R', _AS_A)))}
  FROM (SELECT conv_id, i, {_CLOSED} FROM states) s JOIN rws r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1),
best AS (SELECT conv_id, {_least('q0', 'i3')} AS b FROM (SELECT conv_id, i, {_CLOSED} FROM states) s
  WHERE i = (SELECT max(r.i) FROM rws r WHERE r.conv_id IS NOT DISTINCT FROM s.conv_id)),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM rws),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
