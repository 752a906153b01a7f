"""Whitening: inertia counts, eigenvalues and vectors against numpy's, exact sums, awkward rows."""

import numpy as np
import pytest

from fieldtopo.llm import whitening as W


def _symmetric(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = (q * np.asarray(values, float)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("seed", range(8))
def test_counts_equal_the_spectrum(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 20))
    a = rng.standard_normal((d, d))
    a = a + a.T
    if seed % 2:
        np.fill_diagonal(a, 0)  # needs pivots of two
    values = np.linalg.eigvalsh(a)
    for s in [*rng.uniform(values[0] - 1, values[-1] + 1, 20), *(values[:-1] + np.diff(values) / 2)]:
        assert W.positives(a, s) == int((values > s).sum())
    assert W.positives(np.zeros((3, 3)), 0.0) == 0 and W.positives(np.zeros((0, 0)), 1.0) == 0


@pytest.mark.parametrize("values", [[9, 8, 7, 1, 0.5], [5, 5, 5, 1], [4, 4 - 1e-9, 3, 3 - 1e-13, 1e-3, 1e-9], [1e12, 1, 1e-6], [0, 0, 0], [2.0], [7, 7, 0, 0, 0], list(np.linspace(3, 1, 30)), [1e-30, 1e-31]])
def test_leading_components(values):
    a = _symmetric(values)
    got, vectors, sure = W.leading(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
    scale = max(abs(want).max(), 1e-300)
    assert np.allclose(got, want, atol=1e-12 * scale, rtol=1e-9) and sure.all()
    assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-10)
    assert np.abs(a @ vectors.T - vectors.T * got).max() <= 1e-11 * scale


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, deviation string, label string")


def test_whitened_rows(spark):
    rng = np.random.default_rng(3)
    c = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12)) / 5).astype(np.float32)
    rows = [(i, [float(x) for x in v], "a", "b", "kept") for i, v in enumerate(c)]
    rows += [rows[5], (None, rows[6][1], "a", "b", "kept"), (900, None, "", "", ""), (901, [1.0, None], "", "", ""), (902, [float("nan")] * 12, "", "", ""), (903, [float("-inf")] * 12, "", "", ""), (904, [0.5, 0.25], "", "", "short"), (905, [], "", "", "none")]
    df = _frame(spark, rows).repartition(5)
    used = [r for r in rows if r[0] is None or r[0] < 900 or r[0] > 903]
    x = np.full((len(used), 12), W.SHIFT, np.int64)
    for i, r in enumerate(used):
        x[i, : len(r[1])] = np.floor(1024 * np.asarray(r[1], np.float32).astype(float)).astype(np.int64) + W.SHIFT
    model = W.fit(df)
    n, s = len(used), x.sum(axis=0)
    assert model.n == n and model.sums.tolist() == s.tolist()
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert np.allclose(model.values, values, rtol=1e-10) and np.isclose(model.trace, np.trace(y.T @ y / n)) and model.certified.all()
    got = W.transform(df, model).collect()
    assert len(got) == n and {r.label for r in got} == {"kept", "short", "none"}
    want = {(r[0], tuple(r[1])): (y[i] @ vectors / np.sqrt(values), int(((n * x[i] - s) ** 2).sum())) for i, r in enumerate(used)}
    sign = np.sign(np.sum(model.vectors.T * vectors, axis=0))
    for r in got:
        w, deviation = want[r.vec_id, tuple(r.embedding)]
        assert np.allclose(np.array(r.whitened) * sign, w, atol=1e-8) and r.deviation == deviation
    assert W.identity_error(df, model) < 1e-10


def test_no_variance_large_entries_and_empty(spark):
    same = _frame(spark, [(i, [1.0, 2.0], "", "", "") for i in range(3)])
    model = W.fit(same)
    got = W.transform(same, model).collect()
    assert [list(r.whitened) for r in got] == [[0.0, 0.0]] * 3 and all(r.deviation == 0 for r in got) and model.explained().tolist() == [0.0, 0.0]
    assert W.identity_error(same, model) == 0.0
    one_axis = _frame(spark, [(i, [float(i), 1.0], "", "", "") for i in range(5)])
    assert W.identity_error(one_axis, W.fit(one_axis)) < 1e-12 and W.fit(one_axis).varies().tolist() == [True, False]
    huge = _frame(spark, [(i, [3e38 * (-1) ** i, float(i)], "", "", "") for i in range(6)])
    assert {r.deviation for r in W.transform(huge, W.fit(huge)).collect()} == {None}
    assert W.fit(_frame(spark, [])) is None and W.fit(_frame(spark, [(1, None, "", "", "")])) is None


def test_query(spark, sf_dir):
    got = W.op11_whitening(spark, sf_dir).toPandas()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    c = np.array(vectors["embedding"].tolist()).astype(np.float32).astype(float)
    x = np.floor(1024 * c).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    assert len(got) == 8 * n and (got["n"] == n).all() and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9 and got["certified"].all()
    explained = got.groupby("component")["explained"].first()
    assert np.allclose(explained, values / np.trace(y.T @ y / n), rtol=1e-9)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[vectors["vec_id"]].to_numpy()
    want = y @ axes / np.sqrt(values)
    assert np.allclose(np.abs(wide), np.abs(want), atol=1e-7)
    deviation = got.groupby("vec_id")["deviation"].first().loc[vectors["vec_id"]].to_numpy()
    assert (deviation == ((n * x - s) ** 2).sum(axis=1)).all()
