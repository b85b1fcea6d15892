from fractions import Fraction

import numpy as np
import pytest
from conftest import SMALL

from braidwork.llm import whitening as w


def residual(a, values, vectors):
    scale = np.linalg.norm(a, 2)
    return max(np.abs(vectors.T @ vectors - np.eye(len(a))).max(), np.abs(a @ vectors - vectors * values).max() / scale)


def with_values(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    return (a + a.T) / 2


CASES = {
    "spread": np.geomspace(1, 1e-3, 40),
    "two alike": np.array([5, 5, 3, 1.0, 0.5]),
    "near alike": np.array([2, 2 - 1e-9, 2 - 2e-9, 1, 1 - 1e-7, 0.1]),
    "one chain": 1 + 1e-8 * np.arange(30),
    "all alike": np.ones(12),
    "flat": np.array([3, 1, 0, 0, 0.0]),
    "large": 1e18 * np.linspace(1, 2, 20),
    "one": np.array([7.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_eigenvectors_to_double_precision(name):
    a = with_values(CASES[name])
    values, vectors = w.eigen(a)
    assert residual(a, values, vectors) < 2e-15
    assert np.allclose(values, np.sort(CASES[name])[::-1], rtol=0, atol=1e-14 * np.abs(a).max() * len(a))
    start = np.linalg.eigh((a / np.abs(a).max()).astype(np.float32))[1]
    if len(a) > 1 and name != "all alike":
        assert residual(a, values, start.astype(float)) > 1e-9


def exact(vectors):
    """n, sums, deviations and the covariance in fractions."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    d = [[n * c - t for c, t in zip(row, s, strict=True)] for row in x]
    dims = range(len(s))
    cov = np.array([[float(sum(Fraction(r[i] * r[j], n**3) for r in d)) for j in dims] for i in dims])
    return n, [sum(c * c for c in row) for row in d], cov, np.array(d, float) / n


def by_vector(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append(r)
    return out


def test_whitened_against_exact_moments(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(400, 10)) @ rng.normal(size=(10, 10)) + 3).astype(np.float32)
    data = [(i, v.tolist(), "own") for i, v in enumerate(x)] + [(900, None, ""), (901, [], ""), (902, [float("nan")] + [0.0] * 9, ""), (903, [None] + [0.0] * 9, ""), (904, [float("inf")] * 10, "")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, id string").repartition(7)
    n, deviation, cov, centred = exact(x)
    got = by_vector(w.whitened(df, components=6))
    assert sorted(got) == list(range(400))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:6], vectors[:, ::-1][:, :6]
    want = centred @ vectors / np.sqrt(values)
    white = np.array([got[i][0]["white"] for i in range(400)])
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white - want * signs).max() < 1e-9
    for i in range(400):
        r = got[i][0]
        assert (r["n"], r["deviation"]) == (n, deviation[i])
        assert np.allclose(r["share"], values / np.trace(cov), rtol=1e-12)
        assert r["identity_error"] < 1e-9


def test_lengths_repeats_and_flat_directions(spark):
    rng = np.random.default_rng(4)
    long = [(i, rng.normal(size=3).tolist()) for i in range(50)]
    plane = [(100 + i, [float(i % 7), float(i % 5), 0.0, 1.0]) for i in range(70)]
    data = [*long, long[0], (None, [0.5, 0.5, 0.5]), *plane, (500, [1.0] * 5), (501, [1.0] * 6), (502, [1.0] * 6), (503, [3e38, 1.0]), (504, [-3e38, 0.0])]
    got = by_vector(w.whitened(spark.createDataFrame(data, "vec_id long, embedding array<float>")))
    assert len(got[0]) == 2 and len(got[None]) == 1 and got[0][0]["n"] == 52
    assert {len(r["white"]) for i in range(50) for r in got[i]} == {3}
    assert {len(got[100 + i][0]["white"]) for i in range(70)} == {2}
    assert 500 not in got or not got[500][0]["white"]
    assert 501 not in got or not got[501][0]["white"]
    assert got[503][0]["deviation"] == 2**63 - 1 and len(got[503][0]["white"]) == 1
    assert abs(abs(got[503][0]["white"][0]) - 1) < 1e-9


def test_query(spark, tmp_path):
    rows = w.op13_whitening(spark, SMALL).collect()
    n = {r["vec_id"] for r in rows}
    assert len(rows) == 32 * len(n) and {r["component"] for r in rows} == set(range(1, 33))
    assert {r["n"] for r in rows} == {len(n)} and max(r["identity_error"] for r in rows) < 1e-9
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert w.op13_whitening(spark, str(tmp_path)).collect() == []
