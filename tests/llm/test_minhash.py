import itertools
import random

import numpy as np
import pytest

from braidwork.llm import minhash
from braidwork.llm.components import components


def shingles(text, k=2):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(ids, pairs):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("blocks", [False, True])
def test_against_all_pairs(spark, monkeypatch, blocks):
    if blocks:
        for name, n in (("FEW", 4), ("X_BLOCK", 16), ("Y_BLOCK", 32)):
            monkeypatch.setattr(minhash, name, n)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    base, texts = [rnd.choice(words) for _ in range(120)], []
    for _ in range(200):
        own = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 6, 8, 10, 12])):
            own[rnd.randrange(120)] = rnd.choice(words)
        texts.append(" ".join(own))
    texts += texts[:20] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    texts += ["", None, "One", "one"] + ["common phrase here now then " + " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))) for _ in range(40)]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    sets = {i: shingles(t) for i, t in zip(ids, texts, strict=True)}
    close = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(ids, close)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    for r in minhash.near_duplicates(df, k=2).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["id"]]), want[r["id"]], want[r["id"]] == r["id"])


def test_estimates():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 40_000).astype(np.uint64)
    off = []
    for j in (0.0, 0.5, 0.8, 0.95):
        for _ in range(30):
            n = 1500
            shared = int(2 * n * j / (1 + j))
            own = rng.permutation(pool)[: 2 * n - shared]
            a, b = own[:n], own[n - shared :]
            x, y = (minhash.registers(np.unique(s))[None] for s in (a, b))
            off.append(minhash.corrected(x, y, np.array([float(n)]), np.array([float(n)]))[0] - j)
    assert abs(np.mean(off)) < 0.01 and np.max(np.abs(off)) < 6 * 0.045


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 60)] + [(300, 300)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 60)}
