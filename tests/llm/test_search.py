import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import hnsw, topk


def test_topk_against_all_scores(spark):
    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(700, 12))).astype(int)
    x[50:90] = x[50]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<long>")
    got = {}
    for r in topk.search(df, df.filter(F.col("id") % 10 == 0), 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["id"], r["score"])
    for q in range(0, 700, 10):
        scores = x @ x[q]
        order = [int(i) for i in np.lexsort((np.arange(700), -scores)) if i != q][:7]
        assert [got[q][k] for k in range(1, 8)] == [(i, int(scores[i])) for i in order]


def brute(vectors, queries, k):
    """Lists of (id, score) by query over all rows of the query's length; vectors: (id, list)."""
    out = {}
    for q, x in queries:
        found = [(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(y) == len(x)]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def test_topk_of_mixed_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(5)
    data = [(i, rng.integers(-99, 99, int(rng.choice([1, 2, 3, 17]))).tolist()) for i in range(300)]
    data += [(300, [6_400_000_000, 3]), (301, [-6_400_000_000, 2**31]), (302, [2**26, 2**27 + 1]), (303, rng.integers(-9, 9, 5000).tolist()), (304, rng.integers(-9, 9, 5000).tolist())]
    df = spark.createDataFrame(data, "id long, vec array<long>")
    assert lists(topk.search(df, df, 9)) == {q: v for q, v in brute(data, data, 9).items() if v}


def test_topk_saturates(spark):
    df = spark.createDataFrame([(1, [3e38, 1.0]), (2, [3e38, 2.0]), (3, [-3e38, 0.0])], "vec_id long, embedding array<float>").withColumn("id", F.lit("own")).withColumn("score", F.lit(0))
    top = 2**63 - 1
    for _ in range(3):
        assert lists(topk.search(topk.whole_numbers(df), topk.whole_numbers(df), 2)) == {1: [(2, top), (3, -top - 1)], 2: [(1, top), (3, -top - 1)], 3: [(1, -top - 1), (2, -top - 1)]}


def test_topk_ties_where_scores_saturate(spark):
    rng = np.random.default_rng(8)
    x = rng.choice([-1, 1], size=(60, 3)) * rng.choice([1, 3, 2**31, 2**62], size=(60, 3))
    data = [(i, [int(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "id long, vec array<long>")
    want = {}
    for q, v in data:
        scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, y, strict=True)))), i) for i, y in data if i != q]
        want[q] = [(i, -s) for s, i in sorted(scores)[:25]]
    for _ in range(2):
        assert lists(topk.search(df, df, 25)) == want


def test_topk_prunes_where_vectors_cluster(spark, monkeypatch):
    monkeypatch.setattr(topk, "START", 256)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 48))
    x = np.floor(64 * (centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 48)) * 0.05)).astype(int)
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id long, vec array<long>")
    found, figures = topk.searched(df, df.filter("id % 300 = 0"), 5)
    assert lists(found) == brute(data, data[::300], 5)
    assert figures["rounds"] >= 2 and figures["scored"] <= 0.3 * figures["pairs"]


def clusters(n, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for size in (300, 60, 9, 2, *[1] * 300):
        centre = rng.normal(size=dims)
        out += [centre + rng.normal(size=dims) * 0.12 for _ in range(size)]
    out = np.array(out)[rng.permutation(len(out))][:n].astype(np.float32)
    out[:5] = out[0]
    return out


@pytest.mark.parametrize("least", [0.95, 0.98])
def test_vector_links_against_all_pairs(spark, least):
    x = clusters(600).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(df, least=least).collect()}
    want = {i: (int(near[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))}
    found = sum(g[0] for g in got.values()) / max(1, near.sum())
    assert found >= 0.99 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_beam_recall():
    x = hnsw._unit(clusters(660, seed=4).astype(float))
    graph = hnsw.Graph(x)
    a, _ = graph._beams(x.astype(np.float32), 0.95, hnsw.BEAM)
    assert len(a) >= 0.9 * (x @ x.T >= 0.95).sum()


def rare_pairs(n, seed):
    """Unrelated unit vectors, one in twenty with a single partner at a cosine of about 0.96."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    own = np.arange(0, n // 2, 10)
    x[own + n // 2] = x[own] + rng.normal(size=(len(own), 64)) * 0.28
    return hnsw._unit(x)


def test_rare_links_in_a_large_shard():
    x = rare_pairs(6000, 3)
    true = {tuple(p) for p in np.argwhere(np.triu(x @ x.T >= 0.95, 1))}
    graph = hnsw.Graph(x)
    a, b, _, _ = graph.within(x.astype(np.float32), 0.95, graph.tuned(0.95))
    found = {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True) if p[0] != p[1]}
    assert len(true) > 200 and len(found & true) >= 0.98 * len(true)


def test_every_node_is_reached():
    x = hnsw._unit(np.concatenate([clusters(660, seed=7), np.tile(clusters(1, seed=8), (200, 1)) + np.random.default_rng(1).normal(size=(200, 24)) * 1e-3]).astype(float))
    graph = hnsw.Graph(x)
    seen, front = {graph.entry}, [graph.entry]
    while front:
        front = [int(j) for i in front for j in graph.layers[0][i] if j >= 0 and j not in seen and not seen.add(int(j))]
    assert len(seen) == len(x)


@pytest.mark.parametrize("shards", [None, 6])
def test_audit_of_links(spark, shards):
    """Links within shards and across them."""
    x = np.concatenate([rare_pairs(3000, 9), rare_pairs(2500, 10)])
    df = spark.createDataFrame([(i, v.tolist(), "own") for i, v in enumerate(x)], "vec_id long, embedding array<double>, node string")
    out, audit = hnsw.linked(df, shards=shards)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    counts = {r["id"]: r["n_links"] for r in out.collect()}
    assert sum(counts.values()) >= 0.98 * near.sum() and all(counts[i] <= near[i].sum() for i in counts)
    got = audit.first()
    assert got["true"] > 0 and got["found"] >= 0.9 * got["true"]
