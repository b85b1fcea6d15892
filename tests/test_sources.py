"""Array files, folders of logs and what is written by key."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from braidwork.operators import vectors as v
from braidwork.sources import arrays, designs, sinks


def test_array_files(spark, tmp_path):
    rng, data, again = np.random.default_rng(0), {}, tmp_path / "again"
    tmp_path = tmp_path / "in"
    tmp_path.mkdir()
    for task, stratum, seed, part, shape in (("Hopper-v4", "core_periphery", 12, "Ct", (30, 4)), ("Hopper-v4", "null", 3, "Ot", (5, 2)), ("Ant-v4", "mixed", 12, "Ct", (1, 3)), ("Ant-v4", "mixed", 7, "Ot", (4,))):
        data[task, stratum, seed, part] = x = rng.normal(size=shape).astype(np.float32 if seed == 3 else float)
        (tmp_path / task).mkdir(exist_ok=True)
        np.save(tmp_path / task / f"{task}_{stratum}_{seed}_{part}.npy", x)
    (tmp_path / "notes.npy").write_bytes(b"no array")
    reader = arrays.Reader({"path": str(tmp_path), "block": "20"})
    assert list(reader.pushFilters([EqualTo(("task",), "Hopper-v4"), In(("seed",), (12, 99)), GreaterThan(("t",), 3)])) == [GreaterThan(("t",), 3)]
    assert [(b.keys[2], b.first, b.rows) for b in reader.partitions()] == [(12, a, 5) for a in range(0, 30, 5)]
    spark.dataSource.register(arrays.Trajectories)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("trajectories").option("block", 7).load(str(tmp_path))
    got = {}
    for r in df.orderBy("t").collect():
        got.setdefault((r["task"], r["stratum"], r["seed"], r["part"]), []).append(r["x"])
    assert got.keys() == data.keys() and all(np.array_equal(np.array(got[k]), data[k].reshape(len(data[k]), -1)) for k in data)
    one = df.filter("task = 'Ant-v4' and part = 'Ct' and t >= 0")
    assert [r["x"] for r in one.collect()] == data["Ant-v4", "mixed", 12, "Ct"].tolist()
    rows = df.filter("task = 'Hopper-v4'")
    assert arrays.write_arrays(rows, str(again)) == 2
    back = spark.read.format("trajectories").load(str(again))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))


def test_logs_are_discovered(spark, tmp_path):
    log = spark.createDataFrame([("PPO", 0, 1, 0.5), ("PPO", 11, 2, 0.7), ("RES_PPO_0.0003", 2, 3, 0.9), ("RES_PPO_0.0003", 2, 4, 1.0)], "model string, seed int, step long, value double")
    sinks.write_logs(log, str(tmp_path / "er" / "deep"))
    log.drop("model", "seed").write.parquet(str(tmp_path / "er" / "other"))
    got = designs.discovered(spark, str(tmp_path)).select("model", "seed", "step", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, log.collect()))


def test_written_by_key(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.3)], "task string, seed int, x double")
    path = str(tmp_path / "out")
    assert sorted(map(tuple, sinks.write_missing(df.filter("task = 'a'"), path, "task", "seed").collect())) == [("a", 1), ("a", 2)]
    before = {f.name for f in (tmp_path / "out").rglob("*.parquet")}
    assert [tuple(r) for r in sinks.write_missing(df.withColumn("x", F.col("x") + 5), path, "task", "seed").collect()] == [("b", 1)]
    assert sinks.write_missing(df, path, "task", "seed").count() == 0
    assert {(r["task"], r["seed"]): r["x"] for r in spark.read.parquet(path).collect()} == {("a", 1): 0.1, ("a", 2): 0.2, ("b", 1): 5.3}
    assert before < {f.name for f in (tmp_path / "out").rglob("*.parquet")}


@pytest.mark.parametrize("rows", [7, 1000])
def test_pairs_in_blocks(spark, rows):
    x = np.random.default_rng(1).normal(size=(40, 6))
    df = spark.createDataFrame([(i * 3, r.tolist(), bool(i % 3)) for i, r in enumerate(x)], "id long, v array<double>, top boolean")
    want = {(i * 3, j * 3): float(np.linalg.norm(x[i] - x[j])) for i in range(40) for j in range(i + 1, 40)}
    got = [(r["i"], r["j"], r["dist"]) for r in v.pairwise(df, "id", rows=rows).collect()]
    assert len(got) == len(want) and all(abs(want[i, j] - d) < 1e-12 for i, j, d in got)
    sums = {r["pair"]: (r["n"], r["mean_dist"]) for r in v.label_distances(df, "id", "top", rows=rows).collect()}
    for name, kind in (("Bottom-Bottom", 0), ("Top-Bottom", 1), ("Top-Top", 2)):
        own = [d for (i, j), d in want.items() if bool(i // 3 % 3) + bool(j // 3 % 3) == kind]
        assert sums[name][0] == len(own) and abs(sums[name][1] - np.mean(own)) < 1e-12


def test_report_rounds_as_sql(spark, tmp_path):
    """Scores that end in a half, and missing ones, against DuckDB's own format."""
    scores = [float(f"{i / 1e6}") for i in range(150_000_050, 150_002_050, 100)] + [-0.00005, 2.5e-5, float("-inf"), float("nan")]
    ranked = spark.createDataFrame([("top", i, f"n{i}", x) for i, x in enumerate(scores)], "side string, rank int, seed_name string, score double")
    sinks.write_report(ranked, str(tmp_path / "report"))
    want = duckdb.connect().execute("SELECT format('{} {}. {}: {:.4f}', 'top', i, 'n' || i, x) FROM (SELECT unnest(?::DOUBLE[]) AS x, unnest(range(0, ?)) AS i) ORDER BY i", [scores, len(scores)]).fetchall()
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == [w[0] for w in want]


def test_pairs_copy_rows_a_few_times(spark):
    """A row is copied once for each of a few large blocks, and tables of many pieces give what numpy gives."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 2))
    x[4000:] = x[:1000] + 1e-7 * rng.normal(size=(1000, 2))  # pairs whose squares cancel
    df = spark.createDataFrame([(i, a.tolist(), bool(i % 3)) for i, a in enumerate(x)], "id long, v array<double>, top boolean")
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    dist = v.pairwise(df, "id")
    assert dist.rdd.getNumPartitions() == v.BLOCKS * (v.BLOCKS + 1) // 2
    near = {(r["i"], r["j"]): r["dist"] for r in dist.filter("dist < 1e-5").collect()}
    i, j = np.nonzero(np.triu(far < 1e-5, 1))
    assert near.keys() == set(zip(i.tolist(), j.tolist(), strict=True)) and np.allclose([near[k] for k in sorted(near)], far[i, j], rtol=1e-9, atol=0)
    total = dist.agg(F.count("*"), F.sum("dist")).first()
    assert total[0] == 5000 * 4999 // 2 and np.isclose(total[1], far.sum() / 2)


def test_labels_of_pairs_need_few_copies(spark):
    rng = np.random.default_rng(4)
    x, top = rng.normal(size=(3000, 3)), rng.random(3000) < 0.3
    df = spark.createDataFrame([(i, a.tolist(), bool(t)) for i, (a, t) in enumerate(zip(x, top, strict=True))], "id long, v array<double>, top boolean")
    out = v.label_distances(df, "id", "top")
    assert v.all_pairs(df, "id", ["v"], lambda x, y, same: {"n": np.array([len(x["id"])])}, "n long").rdd.getNumPartitions() == 36
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(3000, 1)]
    kind = (top[:, None].astype(int) + top[None])[np.triu_indices(3000, 1)]
    got = {r["pair"]: (r["n"], r["mean_dist"]) for r in out.collect()}
    for k, name in enumerate(("Bottom-Bottom", "Top-Bottom", "Top-Top")):
        assert got[name][0] == (kind == k).sum() and np.isclose(got[name][1], far[kind == k].mean())


def test_vectors_of_unlike_length_are_an_error(spark):
    df = spark.createDataFrame([(i, [1.0] * (1 + i % 2)) for i in range(20)], "id long, v array<double>")
    with pytest.raises(Exception, match="can't be compared"):
        v.pairwise(df, "id").collect()
