import heapq

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from braidwork.operators import graph as g
from braidwork.operators import spectra
from braidwork.session import cut
from braidwork.sources.trade import trade_edges

GRAPHS = {
    0: (4, [(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0)], [0, 0, 1, 1]),  # complete
    1: (4, [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 4.0)], [0, 0, 1, 1]),  # path
    2: (6, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 0.5)], [0, 0, 0, 1, 1, 1]),  # two triangles and a bridge
    3: (3, [(0, 1, -2.0)], [0, 1, 1]),  # a negative edge and an isolated node
    4: (4, [(0, 1, 1.0), (1, 2, -1.0), (2, 3, 1.0), (0, 3, -1.0)], [0, 1, 0, 1]),  # signed cycle
}


def matrix(net):
    n, edges, _ = GRAPHS[net]
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] = w[b, a] = x
    return w


@pytest.fixture(scope="module")
def frames(spark):
    edges = [(net, a, b, x) for net, (_, es, _) in GRAPHS.items() for a, b, x in es]
    nodes = [(net, i, z) for net, (n, _, zs) in GRAPHS.items() for i, z in enumerate(zs)]
    return g.symmetrised(spark.createDataFrame(edges, "net int, src int, dst int, w double")), spark.createDataFrame(nodes, "net int, node int, community int")


def value(df, column):
    return {r["net"]: r[column] for r in df.collect()}


def test_modularity_is_the_pairwise_form(frames):
    got = value(g.modularity(*frames), "modularity")
    for net, (_, _, z) in GRAPHS.items():
        a, z = np.abs(matrix(net)), np.array(z)
        s, m = a.sum(1), a.sum()
        assert np.isclose(got[net], ((a - np.outer(s, s) / m) * (z[:, None] == z[None, :])).sum() / m)


def test_participation_and_isolated_nodes(frames):
    got = value(g.participation(*frames), "participation")
    for net, (n, _, z) in GRAPHS.items():
        a, z = np.abs(matrix(net)), np.array(z)
        own = [1 - sum((a[i, z == c].sum() / a[i].sum()) ** 2 for c in set(z)) if a[i].sum() else 1.0 for i in range(n)]
        assert np.isclose(got[net], np.mean(own))


def test_clustering(frames):
    got = value(g.clustering(*frames), "clustering")
    assert [round(got[k], 6) for k in range(5)] == [1.0, 0.0, round((4 + 2 / 3) / 6, 6), 0.0, 0.0]


def test_strength_and_signs(frames):
    got, neg = value(g.strength_cv(*frames), "cv_strength"), value(g.frac_negative(frames[0]), "frac_negative")
    for net in GRAPHS:
        w = matrix(net)
        s = np.abs(w).sum(1)
        assert np.isclose(got[net], s.std() / s.mean()) and np.isclose(neg[net], (w[w != 0] < 0).mean())


def test_path_measures(frames):
    edges, nodes = frames
    paths = g.geodesics(edges, nodes)
    got, cvs = value(g.efficiency(paths, nodes), "efficiency"), value(g.betweenness_cv(edges, nodes, paths), "cv_betweenness")
    assert np.isclose(got[0], 1) and cvs[0] == 0
    d = {(0, 1): 1, (1, 2): 0.5, (2, 3): 0.25, (0, 2): 1.5, (1, 3): 0.75, (0, 3): 1.75}
    assert np.isclose(got[1], 2 * sum(1 / x for x in d.values()) / 12)
    b = np.array([0, 2, 2, 0])
    assert np.isclose(cvs[1], b.std() / b.mean())
    assert np.isclose(got[3], 2 * 2 / 6) and cvs[3] == 0  # the isolated node adds no path


def test_spectra(frames):
    got = value(g.lambda_ratio(*frames), "lambda_ratio")
    for net in GRAPHS:
        ev = np.sort(np.abs(np.linalg.eigvalsh(matrix(net))))
        assert np.isclose(got[net], ev[-2] / ev[-1])


def test_spectra_by_joins(spark, frames):
    """All networks through products with edges; also ones whose eigenvalues are alike, or come in pairs of both signs."""
    edges, nodes = frames
    rng = np.random.default_rng(1)
    more = {10: np.ones((12, 12)) - np.eye(12), 11: np.kron(np.eye(9), [[0, 1.0], [1, 0]]), 12: np.diag(np.ones(30), 1)[:30, :30], 13: np.triu(rng.normal(size=(60, 60)) * (rng.random((60, 60)) < 0.15), 1), 14: np.zeros((3, 3))}
    more = {k: np.triu(m, 1) + np.triu(m, 1).T for k, m in more.items()}
    edges = edges.union(spark.createDataFrame([(k, int(i), int(j), float(m[i, j])) for k, m in more.items() for i, j in np.argwhere(m)], "net int, src int, dst int, w double"))
    nodes = nodes.select("net", "node").union(spark.createDataFrame([(k, i) for k, m in more.items() for i in range(len(m))], "net int, node int"))
    got = {r["net"]: (r["first"], r["second"]) for r in spectra.largest(edges, nodes, whole=0).collect()}
    for net, m in ({k: matrix(k) for k in GRAPHS} | more).items():
        ev = np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1]
        assert np.allclose(got[net], ev[:2], rtol=0, atol=1e-6 * max(ev[0], 1e-9))


def test_spectrum_of_a_large_network(spark):
    """10,000 nodes in cliques and stars, whose eigenvalues are known: size - 1, and both signs of the root of the leaves."""
    edges, n = [], 0
    for size in (70, 55, 40, 40, 30):
        edges += [(n + i, n + j, 1.0) for i in range(size) for j in range(size) if i != j]
        n += size
    for leaves in (2500, 1600, 1600, 400, 3000):
        edges += [e for i in range(1, leaves + 1) for e in ((n, n + i, -1.0), (n + i, n, -1.0))]
        n += leaves + 1
    nodes = spark.range(10_000).select(F.lit(0).alias("net"), F.col("id").alias("node"))
    assert n <= 10_000
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["src", "dst", "w"])).select(F.lit(0).alias("net"), "src", "dst", "w")
    got = spectra.largest(df, nodes).first()
    assert np.allclose((got["first"], got["second"]), (69, 3000**0.5), rtol=1e-6)
    assert abs(value(spectra.second_share(df, nodes), "lambda_ratio")[0] - 3000**0.5 / 69) < 1e-6


def test_paths_of_a_sparse_network(spark):
    """Distances and betweenness of 150 nodes against Brandes' algorithm node by node."""
    rng, n = np.random.default_rng(4), 150
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (320, 2)).tolist() if p[0] != p[1]}
    rows = [(0, a, b, float(rng.integers(1, 4))) for a, b in sorted(pairs)]
    edges = g.symmetrised(spark.createDataFrame(rows, "net int, src int, dst int, w double"))
    nodes = spark.createDataFrame([(0, i, 0) for i in range(n)], "net int, node int, community int")
    near = {i: {} for i in range(n)}
    for _, a, b, w in rows:
        near[a][b] = near[b][a] = 12 // int(w)  # lengths in twelfths are exact
    want, lengths = np.zeros(n), {}
    for s in range(n):
        order, dist, ways, heap = [], {s: 0}, {s: 1}, [(0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v in order or d > dist[v]:
                continue
            order.append(v)
            for u, step in near[v].items():
                if u not in dist or d + step < dist[u]:
                    dist[u], ways[u] = d + step, ways[v]
                    heapq.heappush(heap, (d + step, u))
                elif d + step == dist[u]:
                    ways[u] += ways[v]
        lengths |= {(s, v): d / 12 for v, d in dist.items()}
        passed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u, step in near[v].items():
                if u in dist and dist[u] + step == dist[v]:
                    passed[u] += ways[u] / ways[v] * (1 + passed[v])
        for v in order[1:]:
            want[v] += passed[v] / 2
    paths = g.geodesics(edges, nodes)
    got = {(r["src"], r["dst"]): r["d"] for r in paths.collect()}
    assert got.keys() == lengths.keys() and all(abs(got[p] - lengths[p]) < 1e-9 for p in lengths)
    found = {r["node"]: r["betweenness"] for r in g.betweenness(edges, nodes, paths).collect()}
    assert np.allclose([found[i] for i in range(n)], want)


def test_trade_graph_follows_its_tables(spark, tmp_path):
    """A table that is rewritten within a session gives another graph."""
    for name in ("lineitem", "orders", "customer", "supplier"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    whole = trade_edges(spark, str(tmp_path)).count()
    few = spark.read.parquet(f"{SMALL}/lineitem.parquet").filter("l_orderkey % 50 = 1")
    few.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert 0 < trade_edges(spark, str(tmp_path)).count() < whole


def test_betweenness_shares_equal_paths(spark):
    square = [(0, a, b, 1.0) for a, b in ((0, 1), (1, 2), (2, 3), (0, 3))]
    edges = g.symmetrised(spark.createDataFrame(square, "net int, src int, dst int, w double"))
    nodes = spark.createDataFrame([(0, i, 0) for i in range(4)], "net int, node int, community int")
    got = g.betweenness(edges, nodes, g.geodesics(edges, nodes)).orderBy("node").collect()
    assert [r["betweenness"] for r in got] == [0.5, 0.5, 0.5, 0.5]


def test_paths_of_random_networks(spark):
    """Distances and betweenness against plain relaxation and enumeration."""
    rng, n = np.random.default_rng(2), 9
    w = np.triu(np.where(rng.random((n, n)) < 0.4, rng.integers(1, 4, (n, n)), 0), 1).astype(float)
    edges = g.symmetrised(spark.createDataFrame([(0, int(i), int(j), float(w[i, j])) for i, j in np.argwhere(w)], "net int, src int, dst int, w double"))
    nodes = spark.createDataFrame([(0, i, 0) for i in range(n)], "net int, node int, community int")
    w = w + w.T
    d = np.where(w > 0, 1 / np.where(w > 0, w, 1), np.inf)
    np.fill_diagonal(d, 0)
    length = d.copy()
    for k in range(n):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    paths = g.geodesics(edges, nodes)
    assert {(r["src"], r["dst"]): round(r["d"], 9) for r in paths.collect()} == {(i, j): round(d[i, j], 9) for i, j in np.argwhere(np.isfinite(d)).tolist()}

    def ways(i, j):
        if i == j:
            return [[i]]
        return [[*p, j] for m in range(n) if m != j and np.isfinite(length[m, j]) and np.isclose(d[i, m] + length[m, j], d[i, j]) for p in ways(i, m)]

    want = np.zeros(n)
    for i in range(n):
        for j in range(i + 1, n):
            found = ways(i, j) if np.isfinite(d[i, j]) else []
            for p in found:
                want[p[1:-1]] += 1 / len(found)
    got = {r["node"]: r["betweenness"] for r in g.betweenness(edges, nodes, paths).collect()}
    assert np.allclose([got[i] for i in range(n)], want)


def test_blocks(frames):
    rows = {(r["net"], r["r"], r["s"]): r for r in g.block_values(*frames).collect()}
    for net, (_, _, z) in GRAPHS.items():
        w, z = matrix(net), np.array(z)
        for r in set(z):
            for s in set(z):
                block = w[np.ix_(z == r, z == s)]
                nz = block[block != 0]
                got = rows[net, r, s]
                assert np.isclose(got["mean"], nz.mean() if nz.size else 0) and np.isclose(got["sd"], nz.std() if nz.size > 1 else 0) and np.isclose(got["density"], (block != 0).mean())


def test_motif_order(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (2.0, 2.0, 1.0), (1.0, 1.0, 2.0), (3.0, 1.0, 2.0)], "rr double, ss double, rs double")
    assert [r[0] for r in df.select(g.motif(F.col("rr"), F.col("ss"), F.col("rs"))).collect()] == ["degenerate", "assortative", "disassortative", "core_periphery"]


def _small_designs(spark, n):
    from braidwork.sources.designs import supplier_designs

    return supplier_designs(spark, SMALL).limit(n)


def test_measures_of_whole_networks(spark):
    """Eight measures of matrices against the plans over edges: isolated nodes, no edges at all, equal and signed weights."""
    rng, n = np.random.default_rng(7), 7
    w, z = np.zeros((6, n, n)), rng.integers(0, 3, (6, n))
    for k in range(1, 6):
        m = np.triu(np.where(rng.random((n, n)) < 0.2 + 0.1 * k, rng.integers(1, 4, (n, n)), 0), 1) * (rng.choice([-1.0, 1.0], (n, n)) if k > 2 else 1.0)
        w[k] = m + m.T
    edges = spark.createDataFrame([(int(k), int(i), int(j), float(w[k, i, j])) for k, i, j in np.argwhere(w)], "net long, src int, dst int, w double")
    nodes = spark.createDataFrame([(k, i, int(z[k, i])) for k in range(6) for i in range(n)], "net long, node int, community int")
    got = g.measured(w, z)
    rows = {r["net"]: r for r in g.all_descriptors(edges, nodes).collect()}
    assert len(rows) == 6
    for name, values in got.items():
        assert np.allclose(values, [rows[k][name] for k in range(6)], atol=1e-9), name


def test_networks_stay_in_their_tasks(spark):
    """Sizes and measures of sampled networks are those of their edges; nothing is kept but a row for each."""
    from braidwork.operators import designs as d

    own = _small_designs(spark, 10)
    edges, nodes = d.networks(own, 24)
    ids = sorted(r["net"] for r in nodes.select("net").distinct().collect())
    got = {r["net"]: r for r in d.network_sizes(own, 24).collect()}
    want = edges.groupBy("net").agg(F.count("*").alias("edges"), F.max(F.abs("w")).alias("top"), F.avg((F.col("w") < 0).cast("double")).alias("negative"))
    want = {r["net"]: r for r in want.join(nodes.groupBy("net").agg(F.count_distinct("community").alias("communities")), "net").collect()}
    assert got.keys() == want.keys() and all(got[k][c] == want[k][c] for k in got for c in ("edges", "top", "communities")) and all(np.isclose(got[k]["negative"], want[k]["negative"]) for k in got)
    whole = {r["net"]: r for r in d.described(own, 24).collect()}
    joined = {r["net"]: r for r in g.descriptors(edges, nodes).collect()}
    assert sorted(whole) == ids and all(np.isclose(whole[k][m], joined[k][m], atol=1e-9) for k in ids for m in d.MEASURES)


def test_network_queries_keep_no_edges(spark):
    """Queries over sampled networks write no edges: their plans read the tables alone."""
    from braidwork.plans import design_queries

    for query in (design_queries.sample_networks, design_queries.network_descriptors):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" not in plan and "Join" not in plan


def test_two_sided_radius(spark):
    """Against numpy: lines of the same pair add up, signed weights, and more products than a basis holds."""
    rng = np.random.default_rng(6)
    n = 3000
    left, right, w = rng.integers(0, 90, n) * 7, rng.integers(0, 150, n) - 40, rng.normal(size=n)
    edges = spark.createDataFrame(pd.DataFrame({"left": left, "right": right, "w": w}))
    m = np.zeros((700, 200))
    np.add.at(m, (left, right + 40), w)
    want = np.linalg.svd(m, compute_uv=False)[0]
    assert np.isclose(spectra.two_sided(edges), want, rtol=1e-9, atol=0)
    assert spectra.two_sided(edges.limit(0)) is None


def test_supply_radius_writes_its_edges_once(spark, monkeypatch):
    """One table is kept, however many products are taken; where a side is too wide, joins give the same."""
    from braidwork.plans import graph_queries

    kept = []
    monkeypatch.setattr(spectra, "cut", lambda df: kept.append(1) or cut(df))
    got = graph_queries.supply_radius(spark, SMALL).first()["radius"]
    assert len(kept) == 1
    monkeypatch.setattr(spectra, "SIDE", 1)
    assert graph_queries.supply_radius(spark, SMALL).first()["radius"] == got
