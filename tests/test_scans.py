"""Runs that span many ranges, scanned and transformed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from braidwork.operators import fourier, logs, scans
from braidwork.operators import sequence as q


@pytest.fixture(scope="module")
def log(spark):
    """One run holds most rows; others are short; labels hold nulls and stretches across ranges."""
    rng = np.random.default_rng(3)
    rows = []
    for run, n in ((1, 900), (2, 1), (3, 2), (4, 120), (5, 3)):
        label = None
        for step in rng.permutation(5000)[:n].tolist():
            rows.append((run, step, float(rng.integers(-5, 6)), None, False))
    frame = pd.DataFrame(rows, columns=["run", "step", "value", "label", "done"]).sort_values(["run", "step"], ignore_index=True)
    frame["label"] = np.repeat(rng.choice(["a", "b", None], 400), rng.integers(1, 60, 400))[: len(frame)]
    frame["done"] = rng.random(len(frame)) < 0.02
    return frame, spark.createDataFrame(frame.sample(frac=1, random_state=1), "run long, step long, value double, label string, done boolean").repartition(6)


@pytest.fixture(params=["3", "40"])
def ranges(spark, request):
    """Few ranges, and so many that a long run fills dozens."""
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def test_a_run_lies_in_many_ranges(log, ranges):
    own = scans.Ranges(log[1], ["run"], ["step"]).rows
    per = {r["_range"]: r["count"] for r in own.filter("run = 1").groupBy("_range").count().collect()}
    assert len(per) >= ranges // 2 and max(per.values()) <= 2.5 * len(log[0]) / ranges


def test_carries(log, ranges):
    frame, df = log
    got = scans.Ranges(df, ["run"], ["step"]).carried(sums={"upto": F.col("value")}, last={"prev": F.col("label")}).toPandas().sort_values(["run", "step"], ignore_index=True)
    by = frame.groupby("run")
    assert got["pos"].tolist() == by.cumcount().tolist()
    assert np.allclose(got["upto"], by["value"].cumsum() - frame["value"])
    assert got["prev_known"].tolist() == (by.cumcount() > 0).tolist()
    assert [x if isinstance(x, str) else None for x in got["prev"]] == [x if isinstance(x, str) else None for x in by["label"].shift()]


def test_delays_episodes_islands_energy(log, ranges):
    frame, df = log
    runs = {r: own.reset_index(drop=True) for r, own in frame.groupby("run")}
    for d in (1, 2, 5, 30):
        got = sorted(map(tuple, q.delay_embed(df, d).collect()))
        assert got == [(r, int(own["step"][i]), *own["value"][i : i + d]) for r, own in runs.items() for i in range(len(own) - d + 1)]
    got = {(r["run"], r["step"]): r["episode"] for r in logs.episodes(df).collect()}
    assert got == {(r, int(s)): int(n) for r, own in runs.items() for s, n in zip(own["step"], own["done"].cumsum() - own["done"], strict=True)}
    want = []
    for r, own in runs.items():
        labels = [x if isinstance(x, str) else None for x in own["label"]]
        cuts = [0, *[i for i in range(1, len(labels)) if labels[i] != labels[i - 1]], len(labels)]
        want += [(r, str(labels[a]), a, b, (a + b) / 2) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert sorted((r["run"], str(r["label"]), r["start"], r["end"], r["centre"]) for r in q.islands(df, "label").collect()) == sorted(want)
    got = {r["run"]: r["rank"] for r in q.energy_rank(df, 0.8).collect()}
    for r, own in runs.items():
        v = np.sort(own["value"])[::-1] ** 2
        assert v.sum() == 0 or got[r] == int(np.argmax(np.cumsum(v) >= 0.8 * v.sum())) + 1


@pytest.mark.parametrize(("n", "factor"), [(1000, 1 << 16), (997, 1 << 16), (997, 100), (1024, 1 << 16), (1500, 30), (2, 1 << 16)])
def test_transform_in_blocks(spark, n, factor):
    """Lengths that split, primes, and those that only a chirp can do."""
    x = np.random.default_rng(n).normal(size=n) + 3
    rows = [(7, i, float(v)) for i, v in enumerate(x)] + [(8, i, float(i)) for i in range(5)]
    got = fourier.dft(spark.createDataFrame(rows, "run long, step long, value double"), short=5 if n > 5 else 1, cells=200, factor=factor).toPandas().sort_values(["run", "k"])
    for run, want in ((7, np.fft.rfft(x)), (8, np.fft.rfft(np.arange(5.0)))):
        own = got[got["run"] == run]
        assert own["k"].tolist() == list(range(len(want))) and np.allclose(own["re"] + 1j * own["im"], want, atol=1e-8 * n)


def test_transform_of_a_long_run(spark):
    """A million points over many tasks."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("step"), (F.sin(F.col("id") * 0.37) + (F.col("id") * 7919 % 1009) / 1009).alias("value"))
    i = np.arange(n)
    want = np.abs(np.fft.rfft(np.sin(i * 0.37) + (i * 7919 % 1009) / 1009))
    got = q.dft_magnitude(df).toPandas().sort_values("k")["magnitude"].to_numpy()
    assert np.allclose(got, want, rtol=1e-9, atol=1e-5)
