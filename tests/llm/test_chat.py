"""op13: exact round trips, typed parts, the mask, odd rows."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from comparo.llm import op13_chat as C

SCHEMA = "conv_id long, turn long, role string, text string, parts_n long, segments string, body string"
TEXTS = ["", "plain", "\\", "\\:", "<\\:s>", "<s><s></s>", "a</s>[INST] ok [/INST]", "[[INST]", "<|turn|>user<|says|>x<|end|>", "<<|image|>", "<|image|>", "<", "|>", "<|segment|>",
         "see ![a](x.png) and ![b](y.MP3)![c](z.pdf)!", "![<|end|>](a\\b.png)", "![", "![x]( y.png)", "![x](y.png", "![[x](y.png)", "<![x](y.png)s>", "line\n![two\nlines](x.png)", "Üñí 字 ![字](ü.wav) 𝄞", "<<SYS>><</SYS>>", "$1 $0 \\$1", "\\\\<s>\\:"]


def _rows():
    rows = []
    for i, t in enumerate(TEXTS):
        rows += [(i, 0, "system" if i % 3 else None, t, 1, "x", "y"), (i, 1, "user", t + "!", 1, "x", "y"), (i, 2, "assistant", t, 1, "x", "y"), (i, None, "assistant", None, 1, "x", "y")]
    rows += [(500, 3, "assistant", "".join(TEXTS) * 300, 1, "x", "y"), (None, 0, "user", "no id", 1, "x", "y"), (501, 0, "a<s>b\\|", "odd role", 1, "x", "y")]
    return rows + [rows[5], rows[5], rows[10]]


def _want(rows):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        out[c] = (len(ts), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in ts).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_odd_rows(spark, tmp_path):
    rows = _rows()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in C.op13_chat(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    want = _want(rows + [(-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    twin = {r[0]: r for r in db.sql(C.OP13_SQL).fetchall()}
    assert {c: tuple(r) for c, r in got.items()} == twin


def test_no_control_string_survives_in_a_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", C.escaped(F.col("t")).alias("e")).withColumn("u", C.unescaped(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in C.CONTROLS)


def test_attachments_keep_order_and_tokens(spark):
    part = lambda t, **k: (t, k.get("text"), k.get("ref"), k.get("source"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    rows = [(1, 0, "user", [part("text", text="look <|image|> "), part("image", ref="a.png", source="![](a.png)", width=57, height=28), part("audio", ref="b.wav", seconds=2.5), part("odd", text="?"), part(None, text="!")]),
            (1, 1, "assistant", [part("document", ref="c.pdf", pages=3, source="{c}"), part("image", ref="d")]), (1, 2, "user", None), (2, 0, "user", [])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = {r["conv_id"]: r for r in C.formatted(turns).withColumn("f", C.text_of(F.col("segments"))).collect()}
    assert got[1]["f"] == "<|turn|>user<|says|>look <\\:|image|> <|image|><|audio|>?!<|end|><|turn|>assistant<|says|><|document|><|image|><|end|><|turn|>user<|says|><|end|>"
    assert [(a["ordinal"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [(0, 0, "image", "a.png", 3), (1, 0, "audio", "b.wav", 63), (2, 1, "document", "c.pdf", 2400), (3, 1, "image", "d", 1024)]
    assert [s["text"] for s in got[1]["segments"] if s["loss"]] == ["<|document|><|image|>"]
    back = {r["conv_id"]: r for r in C.read_back(C.formatted(turns)).collect()}
    assert back[1]["loss"] == "{c}" and back[1]["turns"][0]["text"] == "look <|image|> ![](a.png)?!" and len(back[2]["turns"]) == 1


def test_markdown_parts(spark):
    text = "a![x](1.png)![y](2.mp3) b ![z](3.pdf)"
    r = spark.createDataFrame([(text,)], "t string").select(C.parts_of(F.col("t")).alias("p")).first()["p"]
    assert [(p["type"], p["ref"]) for p in r] == [("text", None), ("image", "1.png"), ("audio", "2.mp3"), ("text", None), ("document", "3.pdf")]
    assert "".join(p["source"] for p in r) == text


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in C.op13_chat(spark, str(tmp_path)).collect()] == [-7]
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_main_path_has_no_python(spark):
    plan = C.op13_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD", plan)


@pytest.mark.parametrize("text", ["![" * 100_000, "![a](" * 50_000, "\\" * 200_000 + "<s>"])
def test_long_runs_stay_linear(spark, text):
    rows = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.formatted(rows)).first()["loss"] == text
