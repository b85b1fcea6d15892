"""Joins on common keys, sums in order and names, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import common
from braidwork.llm.components import components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joined_is_a_join(spark, monkeypatch, how):
    monkeypatch.setattr(common, "COMMON", 20)
    rng = np.random.default_rng(1)
    keys = [int(k) if k >= 0 else None for k in np.minimum(rng.geometric(0.02, 600), 200) - 3]
    rows = spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "i long, a long, b string").cache()
    table = spark.createDataFrame([(k, "x", k * 2) for k in range(0, 150, 2)], "a long, b string, value long")
    shared = common.common(rows, ["a", "b"])
    assert shared is not None and 0 < shared.count() < 30
    plain = sorted(map(str, rows.join(table, ["a", "b"], how).select("i", "a", "b", "value").collect()))
    assert sorted(map(str, common.joined(rows, table, ["a", "b"], how, shared).select("i", "a", "b", "value").collect())) == plain
    monkeypatch.setattr(common, "COMMON", 10_000)
    assert common.common(rows, ["a", "b"]) is None


def test_running_sums(spark):
    rng = np.random.default_rng(2)
    data = [(int(k), int(w), float(w) / 4) for k, w in zip(rng.permutation(3000), rng.integers(0, 9, 3000), strict=True)]
    df = spark.createDataFrame(data, "k long, w long, x double").repartition(6)
    upto, half = 0, 0.0
    for r in common.running(df, [F.col("k")], {"w": "before", "x": "half"}).orderBy("k").collect():
        assert (r["before"], r["half"]) == (upto, half)
        upto, half = upto + r["w"], half + r["x"]
    assert common.running(df.limit(0), [F.col("k")], {"w": "before"}).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(common, "COMMON", 5)
    rng = np.random.default_rng(3)
    links = [(5000, i) for i in range(200)] + [(300 + i, 301 + i) for i in range(40)] + [tuple(map(int, p)) for p in rng.integers(400, 700, (150, 2))] + [(340, 3)]
    label = {x: x for p in links for x in p}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def test_unused_names():
    assert common.unused(["own", "TAG", "x"], "own", "tag", "own") == ["own_", "tag_", "own__"]
