import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from braidwork.operators import designs as d
from braidwork.operators import dynamics, graph, logs
from braidwork.operators import sequence as q
from braidwork.operators import vectors as v
from braidwork.plans.sequence_queries import _inputs
from braidwork.sources import designs as files
from braidwork.sources import sinks
from braidwork.streaming import reservoirs as stream


def series(spark):
    rng = np.random.default_rng(0)
    return {run: rng.normal(size=n) for run, n in ((1, 40), (2, 3), (3, 17))}


def frame(spark, data):
    return spark.createDataFrame([(run, t, float(x)) for run, xs in data.items() for t, x in enumerate(xs)], "run long, step long, value double")


def dealt(spark, path, batches=4):
    """Events in files, each a batch, that bring a run's rows in no order and some of them twice."""
    rows = stream.numbered(spark.read.parquet(f"{SMALL}/events.parquet")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(batches))).cache()
    for b in range(batches):
        part = rows.filter((F.col("b") == b) | (F.lit(b == batches - 1) & (F.col("nth") % 7 == 0))).drop("b")
        part.orderBy(F.rand(b)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(rows.drop("b").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_stream_is_the_batch(spark, tmp_path):
    """The same contexts from a stream in shuffled batches as from one fold, each once."""
    own = [stream.reservoir(7 + i, 5, 3) for i in range(2)]
    out = stream.run_once(stream.contexts(dealt(spark, str(tmp_path)), own), str(tmp_path / "s")).collect()
    got = {(r["run"], r["step"]): r["context"] for r in out}
    parts = [q.states(_inputs(spark, SMALL), r).collect() for r in own]
    want = {(r["run"], r["step"]): [*r["state"], *other["state"]] for r, other in zip(sorted(parts[0]), sorted(parts[1]), strict=True)}
    assert len(out) == len(want) and got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_tap_survives_a_failure(spark, tmp_path):
    """A batch that fails after it was written comes again after a restart and leaves its rows once; states go on."""
    path, own = str(tmp_path), [stream.reservoir(3, 4, 3)]
    read, record, failed = dealt(spark, path), stream.recorder(f"{path}/tap"), []

    def once(batch, number):
        record(batch, number)
        if number == 1 and not failed:
            failed.append(batch.count())
            raise RuntimeError("lost after writing")

    with pytest.raises(Exception, match="lost after writing"):
        stream.tapped(stream.contexts(read, own, reset=True), path, once)
    got = stream.tapped(stream.contexts(read, own, reset=True), path, once).collect()
    assert failed
    rows = stream.numbered(spark.read.parquet(f"{SMALL}/events.parquet")).orderBy("run", "nth").collect()
    x, done, want = {}, {}, {}
    for r in rows:
        start = np.zeros(4) if done.get(r["run"], True) else x[r["run"]]
        x[r["run"]] = own[0].update(start, np.array(r["u"]))
        want[r["run"], r["nth"]] = (done.get(r["run"], True), r["u"], x[r["run"]])
        done[r["run"]] = r["done"]
    assert len(got) == len(want)
    for r in got:
        fresh, u, state = want[r["run"], r["nth"]]
        assert r["fresh"] == fresh and r["u"] == u and np.allclose(r["context"], state)


def test_overdue_rows_pass_in_order(spark):
    """Where a row never comes, those behind it are let through by the timer, in order."""

    class Held:
        def __init__(self):
            self.value = None

        exists = lambda self: self.value is not None
        get = lambda self: self.value or []
        put = update = lambda self, v: setattr(self, "value", v)
        clear = lambda self: setattr(self, "value", None)

    class Handle:
        timers = []
        getValueState = getListState = lambda self, *a: Held()
        listTimers = lambda self: self.timers
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

    class Clock:
        getCurrentProcessingTimeInMs = lambda self: 1000

    own = stream.Ordered([stream.reservoir(1, 3, 1)], None, False, False, 50)
    own.init(Handle())
    rows = pd.DataFrame([(3, 3, 3, [0.3], False), (0, 0, 0, [0.1], False), (2, 2, 2, [0.2], False)], columns=["nth", "step", "id", "u", "done"])
    first = pd.concat(own.handleInputRows((1,), iter([rows]), Clock()))
    assert first["nth"].tolist() == [0] and own.handle.timers == [1050]
    late = pd.concat(own.handleExpiredTimer((1,), Clock(), None))
    assert late["nth"].tolist() == [2, 3] and own.handle.timers == [] and own.early.value is None
    want = own.reservoirs[0].fold(np.array([[0.1], [0.2], [0.3]]))
    assert np.allclose(late["context"].tolist(), want[1:])


def test_leaky_fold_is_numpy(spark):
    data = series(spark)
    got = {r["run"]: r["state"] for r in q.leaky_fold(frame(spark, data), 0.3, 0.7, 0.5).collect()}
    for run, xs in data.items():
        x = 0.0
        for u in xs:
            x = 0.7 * x + 0.3 * np.tanh(0.7 * u + 0.5 * x)
        assert np.isclose(got[run], x)


def test_ranks_are_the_svd(spark):
    data = series(spark)
    got = {r["run"]: r["rank"] for r in q.delay_ranks(frame(spark, data), 4, 0.9).collect()}
    assert got.keys() == {1, 3}  # too short a run is left out
    for run in got:
        y = data[run]
        h = np.stack([y[i : len(y) - 4 + i + 1] for i in range(4)], axis=1)
        s = np.linalg.svd(h - h.mean(axis=0), compute_uv=False) ** 2
        assert got[run] == np.searchsorted(np.cumsum(s) / s.sum(), 0.9) + 1
    assert q.choose_rank(frame(spark, {1: [1.0]}), 4).first()[0] == 1


def test_same_for_any_partitioning(spark):
    data = frame(spark, series(spark))
    want = None
    for n in (1, 4, 16):
        got = sorted((r["run"], round(r["score"], 9)) for r in logs.recency_score(data.repartition(n), 10).collect())
        want = want or got
        assert got == want
        picks = sorted(map(tuple, v.maxmin(data.select(F.lit(1).alias("g"), (F.col("run") * 100 + F.col("step")).alias("id"), F.array("value").alias("v")).repartition(n), 4, "g", "id").collect()))
        assert len(picks) == 4


def test_ridge_is_numpy(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(80, 2)), np.arange(80) % 2
    y = x @ [1.5, -2] + 0.3 + rng.normal(size=80) * 0.1
    df = spark.createDataFrame([(int(k), float(a), float(b), float(t)) for k, (a, b), t in zip(g, x, y, strict=True)], "g int, a double, b double, t double")
    got = {(r["g"], r["feature"]): r["weight"] for r in v.ridge(df, ["a", "b"], "t", 0.7, "g").collect()}
    for k in (0, 1):
        xs, ys = x[g == k], y[g == k]
        xc, yc = xs - xs.mean(0), ys - ys.mean()
        w = np.linalg.solve(xc.T @ xc + 0.7 * np.eye(2), xc.T @ yc)
        assert np.allclose([got[k, "a"], got[k, "b"], got[k, "intercept"]], [*w, ys.mean() - xs.mean(0) @ w])


def test_pca_is_the_svd(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) @ np.diag([3, 1, 0.2])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, v array<double>")
    means, loadings, share = v.pca(df)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(share, s**2 / (s**2).sum()) and np.allclose(np.abs(loadings), np.abs(vt)) and np.allclose(means, x.mean(0))
    pcs = np.array([r["pc"] for r in v.projected(df, means, loadings, 2).orderBy("id").collect()])
    assert np.allclose(pcs, (x - x.mean(0)) @ loadings[:2].T)


def test_networks(spark):
    keys = spark.range(25).select("id", F.element_at(F.array(*map(F.lit, d.STRATA)), (F.col("id") % 5 + 1).cast("int")).alias("stratum"))
    designs = d.sampled(keys)
    edges, nodes = d.networks(designs, 40, 0.8)
    w = edges.toPandas()
    for net, own in w.groupby("net"):
        m = np.zeros((40, 40))
        m[own["src"], own["dst"]] = own["w"]
        assert np.allclose(m, m.T) and not m.diagonal().any() and np.isclose(np.abs(np.linalg.eigvalsh(m)).max(), 0.8), net
    assert nodes.count() == 25 * 40
    other = d.networks(d.sampled(keys.repartition(7)), 40, 0.8)[0]
    assert edges.exceptAll(other).count() == 0


def test_density_keeps_its_mean(spark):
    rows = spark.createDataFrame([(k, 0.05, rho) for k in d.COMMUNITIES for rho in (0.25, 1.0, 4.0)], "K int, p0 double, rho double")
    p = d.density(F.col("rho"), F.col("K"), F.col("p0"), F.lit(False), F.lit(0.5), F.col("r"), F.col("s"))
    out = d.grid(rows).withColumn("p", p).groupBy("K", "rho").agg(F.avg("p").alias("mean"))
    assert out.filter("abs(mean - 0.05) > 1e-9").count() == 0


def test_sizes_sum_up(spark):
    shares = spark.createDataFrame([(1, i, float(x), 17) for i, x in enumerate([5, 3, 3, 0.1])], "g int, k int, share double, total int")
    n = [r["n"] for r in d.apportion(shares, "total", "g", "k").orderBy("k").collect()]
    assert sum(n) == 17 and min(n) >= 1
    with pytest.raises(ValueError):
        d.dirichlet_sizes(np.random.default_rng(0), 3, 4, 1.0)


def test_unknown_motif_is_an_error(spark):
    df = spark.createDataFrame([("odd",)], "m string")
    with pytest.raises(Exception, match="unknown motif"):
        df.select(d.omega(F.col("m"), F.lit(0), F.lit(0), F.lit(1.0), F.lit(0.0), F.lit(0.5), F.lit(1))).collect()


def test_files(spark, tmp_path):
    line = "null,2,0.1,1,1,1,inf,0.5,0,5,0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8"
    (tmp_path / "d.csv").write_text("stratum,K,p0,centre_u,sigma_ratio,rho,size_alpha,f,core_fraction,seed,contrast_u,modularity,participation,clustering,efficiency,cv_strength,cv_betweenness,lambda_ratio,frac_negative\n" + line)
    row = files.read_designs(spark, str(tmp_path / "none.csv"), str(tmp_path / "d.csv")).first()
    assert row["stratum"] == "null" and row["size_alpha"] == float("inf") and row["frac_negative"] == 0.8
    dist = spark.createDataFrame([(0, 1, "state", 0.5)], "i int, j int, component string, dist double")
    sinks.write_distances(dist, str(tmp_path / "out"), rank=3, n_delays=10)
    assert spark.read.parquet(str(tmp_path / "out/distances")).first()["component"] == "state"
    assert files.with_default(dist, "core_fraction", 0.2).first()["core_fraction"] == 0.2
    ranked = spark.createDataFrame([("top", 1, "a", 1.5)], "side string, rank int, seed_name string, score double")
    sinks.write_report(ranked, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == "top 1. a: 1.5000"


def test_rejects_values_that_are_not_finite(spark):
    edges = graph.symmetrised(spark.createDataFrame([(1, 0, 1, 1.0)], "net int, src int, dst int, w double"))
    nodes = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0)], "net int, node int, community int")
    assert [r["net"] for r in graph.descriptors(edges, nodes).collect()] in ([1], [1, 2], [2, 1])


def test_blocks_are_checked(spark):
    def blocks(*rows):
        return spark.createDataFrame([(1, *r) for r in rows], "net int, r int, s int, value double")

    good = blocks((0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 3.0))
    assert dynamics.checked_blocks(good, 2, 0, 3).count() == 4
    assert dynamics.checked_blocks(dynamics.constant_blocks(good.select("net").distinct(), 3, 0.5), 3).count() == 9
    for bad, k, bounds, says in (
        (good, 3, (), "not 3 by 3"),
        (blocks((0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)), 2, (), "not 2 by 2"),
        (blocks((0, 0, 1.0), (0, 1, 2.0), (1, 0, 2.5), (1, 1, 3.0)), 2, (), "symmetric"),
        (good, 2, (0.0, 2.5), "beyond"),
    ):
        with pytest.raises(Exception, match=says):
            dynamics.checked_blocks(bad, k, *bounds).collect()


def test_lookups_and_seeds(spark):
    df = spark.createDataFrame([("True", -1, "7"), ("False", -1, None), ("False", 3, "7")], "flag string, seed int, array_id string")
    got = df.select(F.size(logs.models_of(F.col("flag"))), logs.resolved_seed(F.col("seed"), F.col("array_id"))).collect()
    assert [tuple(r) for r in got] == [(4, 7), (3, 0), (3, 3)]
    for flag in ("maybe", None):
        with pytest.raises(Exception, match="unknown kind"):
            df.limit(1).select(logs.models_of(F.lit(flag).cast("string"))).collect()


def test_runs_that_are_too_short_are_an_error(spark):
    short = frame(spark, {1: [1, 2, 3], 2: [1]})
    assert q.whole_runs(short, 1).count() == 4
    with pytest.raises(Exception, match="1 runs are shorter"):
        q.whole_runs(short, 3).collect()


def test_inputs_of_another_width_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 1, [0.5, 1.0])], "run long, step long, id long, u array<double>")
    with pytest.raises(Exception, match="different widths"):
        q.states(df, stream.reservoir(1, 4, 3)).collect()


def test_positions_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("run"), F.xxhash64("id").alias("step"))
    got = logs.positions(df.repartition(4), "run").toPandas()
    for _, own in got.groupby("run"):
        assert own.sort_values("step")["pos"].tolist() == list(range(len(own)))


def test_moments_and_projections(spark):
    """Standardising, components and their shares against numpy."""
    x = np.random.default_rng(4).normal(size=(300, 9)) @ np.random.default_rng(5).normal(size=(9, 9)) + 100
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").repartition(5)
    c = np.cov(x.T, bias=True)
    for r in v.moments(df).collect():
        assert r["n"] == 300 and np.isclose(r["cov"], c[r["i"], r["j"]]) and np.isclose(r["mean_i"], x[:, r["i"]].mean())
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    means, loadings, share = v.pca(v.standardised(df, v.pool_stats(df)))
    u, s, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    assert np.allclose(share, s**2 / (s**2).sum()) and np.allclose(np.abs(loadings @ vt.T), np.eye(9), atol=1e-6)
    got = v.projected(v.standardised(df, v.pool_stats(df)), means, loadings, 3).orderBy("id").collect()
    assert np.allclose([r["pc"] for r in got], z @ loadings[:3].T)


def test_guards_and_maps(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, 5)], "k int, x int")
    with pytest.raises(Exception, match="missing: 1, such as 2"):
        dynamics.guarded(a, b, "k").collect()
    with pytest.raises(Exception, match="missing: 2"):
        dynamics.guarded(a, b.limit(0), "k").collect()
    with pytest.raises(Exception, match="1 are there, 20 are needed"):
        dynamics.guarded(a.filter("k = 1"), b, "k", least=20).collect()
    assert [tuple(r) for r in dynamics.guarded(a.filter("k = 1"), b, "k").collect()] == [(1, 5)]
    asked = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), ("z", 1), ("z", 3)], "task string, k int")
    made = spark.createDataFrame([("x", 1, 0), ("x", 1, 1), ("y", 1, 2), ("z", 1, 3), ("z", 3, 4)], "task string, k int, t int")
    assert sorted(map(tuple, dynamics.whole_tasks(asked, made, "task", "k").collect())) == [("y", 1, 2), ("z", 1, 3), ("z", 3, 4)]
    assert {r["task"] for r in dynamics.whole_tasks(asked, made, "task", "k", least=2).collect()} == {"z"}
    rng = np.random.default_rng(0)
    amap, bmap, rows = np.array([[0.5, 0.2], [-0.1, 0.7]]), np.array([[1.0, -0.5]]), []
    for run in (1, 2):
        x = np.zeros(2)
        for t in range(60):
            u = rng.normal(size=1)
            x = x @ amap + u @ bmap
            rows.append((run, t, x.tolist(), u.tolist()))
    maps = dynamics.fitted(spark.createDataFrame(rows, "run long, step long, state array<double>, u array<double>"), np.eye(2), 1e-9)
    for r in maps.collect():
        assert np.allclose(r["state_map"], amap.ravel(), atol=1e-5) and np.allclose(r["control_map"], bmap.ravel(), atol=1e-5)
    assert {(r["component"], round(r["dist"], 4)) for r in dynamics.dynamical_distances(maps, 2).collect()} == {("joint", 0.0), ("state", 0.0), ("control", 0.0)}


def test_motifs_of_designs_join_nothing(spark):
    """The plan has no join whose side could be broadcast, and gives what joined blocks give."""
    from braidwork.plans import design_queries

    got = design_queries.omega_motifs(spark, SMALL)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    joined = graph.motifs(design_queries.omega_grid(spark, SMALL).withColumnRenamed("id", "net"), "mu").groupBy("motif").count()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in joined.collect()}
