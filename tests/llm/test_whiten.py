"""op11: spectral splitting against LAPACK, the operator against numpy, odd rows."""

import math

import numpy as np
import pytest

from comparo.llm import op11_whiten as W


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1], [9, 9, 9, 1, 1], [1, 1, 1], [100, 1e-9, 1e-12, 0], [7], [2.0, 0.0], [3, 2, 2, 2, 2, 1, 0, 0]])
def test_spectral_of_known_eigenvalues(values):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((len(values),) * 2))[0]
    a = q @ np.diag(np.array(values, float)) @ q.T
    e, v = W.spectral(a)
    np.testing.assert_allclose(e, sorted(values, reverse=True), atol=1e-12 * max(values))
    np.testing.assert_allclose(v.T @ v, np.eye(len(values)), atol=1e-13)
    np.testing.assert_allclose(v @ np.diag(e) @ v.T, (a + a.T) / 2, atol=1e-12 * max(values))


def test_spectral_takes_the_largest_only():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64)) * np.linspace(1, 3, 64)
    a = np.cov(x.T)
    e, v = W.spectral(a, 8)
    le, lv = np.linalg.eigh(a)
    np.testing.assert_allclose(e, le[::-1][:8], rtol=1e-13)
    np.testing.assert_allclose(np.abs((v * lv[:, ::-1][:, :8]).sum(axis=0)), 1, atol=1e-12)


def test_polar_of_an_ill_conditioned_matrix():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((6, 6)))[0]
    u = W.polar(q @ np.diag([1, -1e-10, 1e-5, -3, 2, 1e-13]) @ q.T)
    np.testing.assert_allclose(u @ u, np.eye(6), atol=1e-12)
    assert round(np.trace(u)) == 2


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, n long, deviation long").repartition(3)


def test_operator_against_numpy(spark, tmp_path):
    rng = np.random.default_rng(7)
    x = (rng.standard_normal((200, 12)) * np.linspace(0.05, 0.4, 12)).astype(np.float32)
    rows = [(i, [float(c) for c in r], 0, "clash", -1, -2) for i, r in enumerate(x)]
    rows += [rows[3], (None, rows[9][1], 1, None, 0, 0), (900, None, 0, None, 0, 0), (901, [None] + rows[0][1][1:], 0, None, 0, 0),
             (902, [float("nan")] * 12, 0, None, 0, 0), (903, [float("inf")] * 12, 0, None, 0, 0), (904, [0.5] * 3, 0, None, 0, 0), (905, [], 0, None, 0, 0)]
    _frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = W.op11_whiten(spark, str(tmp_path)).collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 12 and all(c is not None and math.isfinite(c) for c in r[1])]
    ints = [[math.floor(1024 * c) + 100_000 for c in r[1]] for r in kept]
    n, s = len(ints), [sum(c) for c in zip(*ints)]
    assert len(got) == n * 8 and {r["n"] for r in got} == {n}
    a = np.array(ints, float)
    cov = np.cov(a.T, bias=True)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    want = (a - np.array(s) / n) @ v / np.sqrt(e)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for row, full, w in zip(kept, ints, want):
        for k in range(8):
            for r in by[(row[0], k + 1)]:
                assert r["deviation"] == sum((n * c - t) ** 2 for c, t in zip(full, s))
                assert abs(r["explained"] - e[k] / np.trace(cov)) < 1e-12
                sign = signs.setdefault(k, 1 if r["whitened"] * w[k] > 0 else -1)
                assert abs(sign * r["whitened"] - w[k]) < 1e-8
    assert max(r["identity_error"] for r in got) < 1e-9


def test_integers_beyond_the_fast_path_stay_exact(spark):
    rows = W.usable(spark.createDataFrame([(i, [float(i * 37 % 11) * 1e5, float(i * i % 7) * 1e5]) for i in range(40)], "vec_id long, embedding array<double>"))
    m = W.fit(rows, 2)
    ints = {i: (i * 37 % 11 * 102_400_000 + 100_000, i * i % 7 * 102_400_000 + 100_000) for i in range(40)}
    s = [sum(c[d] for c in ints.values()) for d in (0, 1)]
    want = {i: sum((40 * c[d] - s[d]) ** 2 for d in (0, 1)) for i, c in ints.items()}
    if max(want.values()) < 2 ** 63:
        assert {r["vec_id"]: r["deviation"] for r in W.whitened(rows, m).collect()} == want
    else:
        with pytest.raises(Exception):
            W.whitened(rows, m).collect()


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.5])], [(1, None), (2, [float("nan")])], [(1, [0.25, 0.5])] * 5])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = W.op11_whiten(spark, str(tmp_path))
    assert out.collect() == [] and dict(out.dtypes)["component"] == "int"


def test_fewer_directions_than_components(spark, tmp_path):
    rows = [(i, [float(i % 5) / 8, float(i % 3) / 8, 0.5]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = W.op11_whiten(spark, str(tmp_path)).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9
