"""Whitening against numpy's eigendecomposition, and the rank-one updates by themselves."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H

from terroir.llm import queries, whitening


def check_spectrum(s, x):
    y = x - x.mean(0)
    m = y.T @ y
    scale = max(np.abs(m).max(), 1e-300)
    assert np.abs(s.q.T @ s.q - np.eye(s.q.shape[1])).max(initial=0) < 1e-11
    assert np.abs(s.q * s.d @ s.q.T - m).max() < 1e-10 * scale
    assert np.allclose(s.mean, x.mean(0)) and s.n == len(x)


@pytest.mark.parametrize("kind", ["plain", "repeated", "integers", "low rank", "constant", "axes"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * np.linspace(0.01, 9, 12)
    if kind == "repeated":
        x[40:] = x[7]
    if kind == "integers":
        x = np.floor(x)
    if kind == "low rank":
        x = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 12))
    if kind == "constant":
        x = np.ones((400, 12))
    if kind == "axes":      # equal eigenvalues everywhere
        x = np.tile(np.vstack([np.eye(12), -np.eye(12)]), (10, 1))
    parts = [whitening.Spectrum(12, 12) for _ in range(3)]
    whole = whitening.Spectrum(12, 12)
    for i, row in enumerate(x):
        whole.add(row)
        parts[0 if i < 5 else 1 + i % 2].add(row)
    check_spectrum(whole, x)
    check_spectrum(parts[0].combine(parts[1]).combine(parts[2]), x)


def expected(x, components):
    x = x.astype(np.int64)
    n, total = len(x), x.sum(0)
    y = (x - total // n) - (total % n) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return ((n * x - total) ** 2).sum(1), y @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)


def test_whitening_of_embeddings(spark):
    got = queries.op12_embedding_whitening(spark, H.SF).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{H.SF}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r.embedding for r in rows], dtype=float)) + 1_000_000
    deviation, white, share = expected(x, 32)
    assert list(got.vec_id) == [r.vec_id for r in rows for _ in range(32)] and set(got.n) == {len(rows)}
    z = got.whitened.to_numpy().reshape(-1, 32)
    assert np.abs(z * np.sign((z * white).sum(0)) - white).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(-1, 32).T == deviation).all()
    assert np.allclose(got.explained.to_numpy()[:32], share, rtol=1e-10) and got.identity_error.max() < 1e-9


def test_whitening_beyond_the_basis(spark):
    """More dimensions than basis vectors: passes go on until the residual is that of double precision."""
    rng = np.random.default_rng(9)
    data = rng.normal(size=(400, 40)) * np.linspace(3, 0.5, 40)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(5)
    rows = whitening.integers(table)
    got = whitening.whiten(rows, whitening.fit(rows, components=4, extra=4)).toPandas().sort_values(["vec_id", "component"])
    _, white, share = expected(np.floor(64 * data) + 1_000_000, 4)
    z = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(z * np.sign((z * white).sum(0)) - white).max() < 1e-8
    assert np.allclose(got.explained.to_numpy()[:4], share, rtol=1e-10)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i * i % 11), 1.0]) for i in range(30)]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [1.0, nan, 2.0]), (93, [inf, 0.0, 0.0]), (94, []), (95, [1.0]), (96, [1e300, 0.0, 0.0])]
    rows = [(*r, "x", 0, 0) for r in good + bad + [(None, good[3][1]), good[4]]]
    schema = "vec_id long, embedding array<double>, x string, component int, n long"
    ints = whitening.integers(spark.createDataFrame(rows, schema))
    out = whitening.whiten(ints, whitening.fit(ints)).toPandas()
    kept = [r for r in good + [(None, good[3][1]), good[4]]]
    deviation, white, share = expected(np.floor(64 * np.array([v for _, v in kept])) + 1_000_000, 2)
    assert len(out) == 2 * len(kept) and set(out.component) == {1, 2} and set(out.n) == {len(kept)}   # a constant dimension has no component
    assert out.vec_id.isna().sum() == 2 and np.allclose(sorted(out[out.component == 1].deviation), sorted(deviation))
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        t = whitening.integers(spark.createDataFrame(few, "vec_id long, embedding array<double>"))
        assert whitening.whiten(t, whitening.fit(t)).count() == 0
