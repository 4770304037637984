"""op12: the search against an exhaustive one, the operator against a plain rewrite, odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from comparo.llm import op12_repair as R

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(initials, faults):
    """Every edit sequence up to a number of insertions, by definition."""
    best = None

    def go(i, roles, audit, cost, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(initials) and GRAMMAR.match(roles):
            best = min(best or (cost, audit), (cost, audit))
        if inserts:
            for r in "ua":
                go(i, roles + r, audit + "I", cost + 3, inserts - 1)
        if i < len(initials):
            go(i + 1, roles, audit + "D", cost + 4, inserts)
            if faults[i] != "d":
                more = 3 * (faults[i] == "t")
                go(i + 1, roles + initials[i], audit + "K", cost + more, inserts)
                for r in "ua":
                    go(i + 1, roles + r, audit + "R", cost + 3 + more, inserts)

    go(0, "", "", 0, 3)
    return best


def test_search_against_exhaustive():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product("ktd", repeat=n):
                a, b = "".join(initials), "".join(faults)
                assert R.cheapest(a, b) == exhaustive(a, b), (a, b)
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(4, 6)
        a, b = "".join(rng.choice("suuaax") for _ in range(n)), "".join(rng.choice("kkkktd") for _ in range(n))
        assert R.cheapest(a, b) == exhaustive(a, b), (a, b)


def dynamic(initials, faults):
    """Cheapest (cost, audit) by a table over rows and states, strings carried along."""
    far = (10 ** 9, "")

    def close(q):
        q[2] = min(q[2], *((q[p][0] + 3, q[p][1] + "I") for p in (0, 1, 3)))
        q[3] = min(q[3], (q[2][0] + 3, q[2][1] + "I"))
        return q

    q = close([(0, ""), far, far, far])
    for c, f in zip(initials, faults):
        new = [(x[0] + 4, x[1] + "D") for x in q]
        if f != "d":
            more = 3 * (f == "t")
            for p, after in {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}.get(c, []):
                new[after] = min(new[after], (q[p][0] + more, q[p][1] + "K"))
            for p, after in ((0, 2), (1, 2), (3, 2), (2, 3)):
                new[after] = min(new[after], (q[p][0] + 3 + more, q[p][1] + "R"))
        q = close(new)
    return min(q[0], q[3])


def test_search_on_long_conversations():
    rng = random.Random(4)
    for n in (40, 400, 3000):
        a, b = "".join(rng.choice("uaua" if i % 50 else "sx") for i in range(n)), "".join(rng.choice("kkkkkkkkktd") for _ in range(n))
        assert R.cheapest(a, b) == dynamic(a, b)
        cost, audit = R.cheapest(a, b)
        at, roles = R.outcome(a, audit)
        assert GRAMMAR.match("".join(r[0] if r else a[i] for i, r in zip(at, roles))) and [i for i in at if i >= 0] == [
            i for i, x in enumerate(x for x in audit if x != "I") if x != "D"]


def plain(rows):
    """The contract, row by row."""
    out, by = {}, {}
    for c, t, r, x in rows:
        by.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if how:
            x = "" if how == 1 else re.sub("[.!?]", "", x) if how == 2 else x
            by[c] += [(t is not None, t or 0, "user" if how == 4 else r, x)] * (1 + (how == 3))
    for c, rs in by.items():
        rs.sort()
        seen, faults, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, r, x in rs:
            core = x.rstrip(" \t\n\x0b\x0c\r")
            f = "blank" if not core else "duplicate" if (r, x) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((r, x))
            faults += {None: "k", "truncated": "t"}.get(f, "d")
            if f:
                counts[f] += 1
        initials = "".join(r[0] if r and r[0] in "sua" else "x" for _, _, r, _ in rs)
        ts = [t for ok, t, *_ in rs if ok]
        cost, audit = dynamic(initials, faults) if rs else (0, "")
        at, roles = R.outcome(initials, audit)
        text = "\n".join(f"{role or rs[i][2]}:{rs[i][3] if i >= 0 else ''}" for i, role in zip(at, roles))
        out[c] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *counts.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                  hashlib.sha256(text.encode()).hexdigest())
    return out


def _rows():
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 9)):
            role = ["user", "assistant"][t % 2] if rng.random() < 0.8 else rng.choice(["system", "tool", "", None, "user", "unsure"])
            rows.append((c, t if rng.random() < 0.9 else None, role, rng.choice(["Fine.", "So?", "cut off", "", "  \n", None, "Wow! \t\n", "a.b", "Über…", "Well." * 3])))
    rows += [(None, i, "user" if i % 2 else "assistant", f"no id {i}.") for i in range(5)]
    rows += [(777, i, ["user", "assistant"][i % 2], "x. " * 3000 + str(i) + ".") for i in range(30)]
    rows += [(778, None, "user", None)] * 3
    dropped = [(c, 0, "user", "Gone.") for c in range(1000, 1100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped
    return rows + dropped + rows[:4]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_operator_against_plain_rewrite_and_sql(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame([(*r, 1, 2, "f", "i", 0) for r in rows], SCHEMA + ", k long, seq long, fault string, initial string, how long").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in R.op12_repair(spark, str(tmp_path)).collect()}
    assert got == plain(rows)
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert {r[0]: tuple(r)[1:] for r in db.sql(R.OP12_SQL).fetchall()} == got


def test_repaired_rows(spark):
    found = R.flagged(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "More?"), (1, 2, "assistant", "Yes.")], SCHEMA))
    plan = R.edits(found)
    assert plan.first()["audit"] == "KIKK" and plan.first()["cost"] == 3
    assert [(r["role"], r["text"], r["turn"]) for r in R.repaired(found, plan).orderBy("seq").collect()] == [("user", "Hi.", 0), ("assistant", "", None), ("user", "More?", 1), ("assistant", "Yes.", 2)]


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", None)]])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["conv_id"]: tuple(r)[1:] for r in R.op12_repair(spark, str(tmp_path)).collect()} == plain(rows)
