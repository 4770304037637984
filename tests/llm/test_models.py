"""Trained operators: brute-force twins, held-out accuracy, awkward rows; pipeline and shared helpers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from odd import SCHEMA, docs_frame, odd_rows

from comparo.llm import op4_toxicity as tox, op5_quality as lm
from comparo.llm.common import rolling
from comparo.llm.components import components

SF = "/root/testdata/sf0.01"


# ---- 4 toxicity

def tox_rows(n=240, seed=3):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("the", "ing", "ou", "er", "st") for b in ("an", "th", "re", "on", "ha", "ed")]
    out = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        y = i % 4 == 0
        for _ in range(4 if y else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["dreckhund", "dreckerei", "idiot"]))
        out.append((" ".join(w), int(y)))
    return out


@pytest.fixture(scope="module")
def model():
    return tox.train(tox_rows())


def test_toxicity_learns(model):
    fresh = tox_rows(seed=4)
    s = tox.Scorer(model).scores([t for t, _ in fresh])
    y = np.array([y for _, y in fresh])
    assert ((s >= tox.THRESHOLD) == y).mean() > 0.95 and (s >= 0).all() and (s <= 1).all()


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = tox.new_parameters(7, rng, rng.normal(0, 1, 7))
    vid = rng.integers(0, 7, (3, 5))
    grams, count = tox.trigrams([b"ab", b"abc", b"x"])
    grams, count = grams[np.arange(15) % 3].reshape(3, 5, -1), count[np.arange(15) % 3].reshape(3, 5).astype(float)
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], float)
    y, w = np.array([1.0, 0.0, 1.0]), np.full(3, 1 / 3)
    loss = lambda: float((w * (np.logaddexp(0, z := tox.forward(p, vid, grams, count, mask)[0]) - y * z)).sum())
    g = tox.gradients(p, vid, grams, count, mask, y, w)
    for k in p:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[k].shape)
            if k in ("word", "char") and at[0] == 0:
                continue
            old = p[k][at]
            p[k][at] = old + 1e-5
            up = loss()
            p[k][at] = old - 1e-5
            down = loss()
            p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_toxicity_inference_equals_training_network(model):
    s = tox.Scorer(model)
    for text in ("one idiot here", " ".join(["thean", "ingre", "dreckhund"] * 40)):
        ws = [tox.normal(w) for w in text.encode().split()]
        best = -1e9
        for a in tox.window_starts(len(ws)):
            part = ws[a:a + tox.WINDOW]
            g, c = tox.trigrams(part)
            p = {k: v.astype(float) for k, v in model["p"].items()}
            z = tox.forward(p, np.array([[model["ids"].get(w, 0) for w in part]]), g[None], c[None].astype(float), np.ones((1, len(part))))[0][0]
            best = max(best, z)
        a, c = model["cal"]
        assert s.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-(a * max(-12, min(12, best)) + c))), abs=1e-3)


def test_toxicity_whole_long_text(model):
    s = tox.Scorer(model)
    calm = " ".join(t for t, y in tox_rows(seed=9) if not y)
    long = " ".join([calm] * 12)
    assert len(long.split()) > (1 << 16)
    assert s.scores([long + " idiot dreckhund idiot dreckerei"])[0] > 0.9 > s.scores([calm])[0]


def test_toxicity_scores_the_whole_of_a_long_run(model):
    s = tox.Scorer(model)
    calm = ["thean", "ingre", "ouha", "erth", "stan", "theed", "inghareon"]
    long = [calm[i % 7] for i in range(40)]
    for sep in ("_", "-", "\u00a0", "/", ""):
        clean, toxic = sep.join(long), sep.join(long[:35] + ["dreckhund", "idiot", "dreckerei"] + long[35:])
        a, b = s.scores([clean, toxic])
        assert a < b and (b > 0.9 > a if sep else b - a > 0.01), (sep, a, b)
    word = b"\xe4\xb8\xad\xe6\x96\x87" * 200
    got = tox.pieces(word)
    assert all(len(p) <= tox.PIECE for p in got) and all(p.decode() for p in got)
    assert {word[i:i + 9] for i in range(0, len(word) - 8, 3)} <= {p[i:i + 9] for p in got for i in range(len(p) - 8)}
    assert tox.trigrams([b"a" * 17 + b"bcd"])[1][0] == 20


def test_toxicity_odd_rows(spark, model):
    rows = odd_rows()
    docs = docs_frame(spark, rows)
    got = tox.scored(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
    assert tox.clean(docs, model).columns == docs.columns
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert tox.fit(docs, labels) == {}
    assert {r.score for r in tox.scored(docs, {}).collect()} == {0.0}
    assert tox.scored(spark.createDataFrame([], SCHEMA), model).collect() == []


def test_toxicity_repeated_rows_do_not_fill_the_sample(spark, monkeypatch):
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1][:24]
    rows = [(i, f"text {i}", "en", "s") for i in ids]
    flat = [(i, 1, n % 2) for n, i in enumerate(ids)]
    seen = []
    monkeypatch.setattr(tox, "train", lambda some, weight, seed: seen.append((sorted(some), weight)) or {})
    tox.fit(docs_frame(spark, rows), spark.createDataFrame(flat, "doc_id long, quality int, toxic int"), max_per_class=12)
    for hot in (0, 1):
        tox.fit(docs_frame(spark, rows + rows[hot:hot + 1] * 300), spark.createDataFrame(flat + flat[hot:hot + 1] * 300, "doc_id long, quality int, toxic int"), max_per_class=12)
    assert len(seen[0][0]) == 24 and seen == [seen[0]] * 3


def test_toxicity_trains_on_a_class_of_long_texts_only(spark, monkeypatch):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    calm = " ".join(f"word{i % 97}" for i in range(9000))
    rows = [(i, (calm if n % 2 else calm.replace("word7 ", "dreckhund ")) + " last.", "en", "s") for n, i in enumerate(ids)] + [(9000, None, "en", "s")]
    labels = spark.createDataFrame([(i, 1, (n + 1) % 2) for n, i in enumerate(ids)] + [(9000, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(tox, "train", lambda some, weight, seed: seen.extend(some) or {})
    tox.fit(docs_frame(spark, rows), labels)
    assert len(seen) == 40 and {y for _, y in seen} == {0, 1}
    size = tox.MAX_TRAIN_CHARS // tox.SECTIONS
    for t, _ in seen:
        assert len(t) == tox.MAX_TRAIN_CHARS + tox.SECTIONS - 1 and t[-5:] == "last." and t[:size] in (calm[:size], calm.replace("word7 ", "dreckhund ")[:size])


def test_toxicity_held_out_accuracy(spark):
    d = tox.op4_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(d) > 50 and sum(r.predicted == r.toxic for r in d) / len(d) > 0.93
    none = tox.op4_toxicity(spark, SF).filter("score < 0 or score > 1 or score is null").count()
    assert none == 0


# ---- 5 quality

def brute_kn(trusted, order):
    grams = [Counter() for _ in range(order + 1)]
    for t in trusted:
        t = lm.padded(t, order)
        grams[order].update(t[i:i + order] for i in range(len(t) - order + 1))
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    d = [None] + [lm.discounts([sum(c == i for c in grams[n].values()) for i in range(1, 5)]) for n in range(1, order + 1)]
    ctx = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in grams[n].items():
            ctx[n][g[:-1]].append(c)

    def p(g, v):
        if not g:
            return 1 / v
        n = len(g)
        cs = ctx[n].get(g[:-1], [])
        if not cs:
            return p(g[1:], v)
        cut = lambda c: d[n][min(c, 3) - 1] if c else 0.0
        c = grams[n].get(g, 0)
        return max(c - cut(c), 0) / sum(cs) + sum(map(cut, cs)) / sum(cs) * p(g[1:], v)

    return p


@pytest.mark.parametrize("shard_types", [1 << 20, 700])
def test_quality_model(spark, shard_types):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("aabbbcde  \n") for _ in range(n))
    rows = [(i, text(rng.randint(0, 120)), "en" if i % 3 else "de", "s") for i in range(60)] + [(70, None, "en", "s"), (71, "ZZQ!", None, "s"), (None, "abc", "fr", "s")]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(50)] + [(2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm.perplexities(docs_frame(spark, rows + rows[1:2]), labels, order=3, shard_types=shard_types).collect()}
    assert len(got) == len(rows)
    good = {i for i in range(0, 50, 2)}
    p = brute_kn([t for i, t, _, _ in rows if i in good], 3)
    v = len({c for _, t, _, _ in rows for c in lm.padded(t, 3)[2:]})
    for i, t, _, _ in rows:
        s = lm.padded(t, 3)
        grams = [s[j:j + 3] for j in range(len(s) - 2)]
        assert got[i].n_grams == len(grams) and got[i].trusted == (i in good)
        assert got[i].log_ppl == pytest.approx(-sum(math.log(p(g, v)) for g in grams) / len(grams), rel=1e-9)


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    p = brute_kn(["".join(rng.choice("abc") for _ in range(50)) for _ in range(5)], 3)
    assert sum(p("ab" + c, 4) for c in "abc\x03") == pytest.approx(1)


def test_quality_classes(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = lm.classified(docs, labels).join(labels, "doc_id").collect()
    good = [r.kept for r in got if r.quality == 1]
    assert sum(good) / len(good) > 0.97
    assert sum(not r.kept for r in got if r.quality == 0) / max(1, sum(r.quality == 0 for r in got)) > 0.3


def test_quality_keeps_unseen_documents_of_a_rare_language(spark):
    rng = random.Random(8)
    stems = {la: ["".join(rng.choice(ab) for _ in range(rng.randint(3, 7))) for _ in range(600)] for la, ab in (("en", "etaoinshrdlu"), ("es", "eaosrnidlctumpqvz"))}
    text = lambda la, n: " ".join(rng.choice(stems[la]) for _ in range(n))
    rows = [(i, text("en", 60), "en", "s") for i in range(300)] + [(1000 + i, text("es", 60), "es", "s") for i in range(140)]
    labels = spark.createDataFrame([(i, 1, 0) for i in (*range(200), *range(1000, 1040))], "doc_id long, quality int, toxic int")
    got = lm.classified(docs_frame(spark, rows), labels).collect()
    for la in ("en", "es"):
        unseen = [r.kept for r in got if r.lang == la and not r.trusted]
        assert len(unseen) == 100 and sum(unseen) >= 90


def test_quality_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_frame(spark, odd_rows())
    assert all(r.kept for r in lm.classified(docs, none).collect())
    assert lm.classified(spark.createDataFrame([], SCHEMA), none).collect() == []


# ---- helpers and pipeline

def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, i) for i in range(6000, 6100)]
    got = {r.v: r.u for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rolling_equals_by_content():
    v = np.array([3, 1, 4, 1, 5, 3, 1, 4, 1, 5, 9], np.uint64)
    h = rolling(v, 3)
    assert h[0] == h[5] and h[1] == h[6] and len(set(h.tolist())) == len({tuple(v[i:i + 3].tolist()) for i in range(9)})


def test_pipeline(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cur, sizes = docs, []
    from comparo.llm.common import saved
    for name, stage in corpus_pipeline.STAGES:
        cur = saved(stage(spark, cur, SF), f"test-{name}")
        sizes.append(cur.count())
        if name != "pack":
            assert cur.columns == docs.columns
    toxic, lines, near, mixed, packed = sizes
    assert lines == toxic < docs.count() and near < lines and 0 < mixed and packed >= mixed
    assert cur.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 4096").count() == 0


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_pipeline_on_odd_rows(spark, tmp_path, kind):
    """Nulls, empty and long texts, copies, repeated rows, columns that clash; and empty tables."""
    import corpus_pipeline
    rows = odd_rows() if kind == "odd" else []
    docs_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet")) if rows else spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, i % 3 == 0) for i in range(40)] if rows else []
    spark.createDataFrame([(a, b, int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if not rows:
        assert packed == []
        return
    assert packed and {r.doc_id for r in packed} <= {r[0] for r in rows}
    used = defaultdict(int)
    for r in packed:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096
    # every stage keeps the columns, and none but the mix makes rows
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    cols, n = cur.columns, cur.count()
    from comparo.llm.common import saved
    for name, stage in corpus_pipeline.STAGES[:-1]:
        cur = saved(stage(spark, cur, str(tmp_path)), f"odd-{name}")
        assert cur.columns == cols and (name == "mix" or cur.count() <= n)
        n = cur.count()
