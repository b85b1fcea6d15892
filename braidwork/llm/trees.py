"""Boosted trees, applied inside tasks or compiled to columns.

``boost`` fits them on the driver from the arrays that it is given, ``boost_table`` from all rows of a DataFrame: tasks
add up gradients by node, feature and bin, and only these sums, whose number the rows don't change, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from braidwork.llm.common import counted, cut, laid_out, small_batches


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. Rows with x[feature] <= threshold go left."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.place(x)]

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right))
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return at

    def add(self, g: float, h: float, ridge: float) -> int:
        """A new leaf."""
        for values, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, float(-g / (h + ridge)))):
            values.append(v)
        return len(self.feature) - 1

    def paths(self) -> list[list[tuple[int, str, float]]]:
        """The conjunctions that lead to each node below the root."""
        out: list[list[tuple[int, str, float]]] = []

        def walk(node: int, path: list[tuple[int, str, float]]) -> None:
            if path:
                out.append(path)
            if self.feature[node] >= 0:
                walk(self.left[node], [*path, (self.feature[node], "<=", self.threshold[node])])
                walk(self.right[node], [*path, (self.feature[node], ">", self.threshold[node])])

        walk(0, [])
        return out


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Cuts between values, at most so many for each feature."""
    out = []
    for column in x.T:
        values = np.unique(column)
        mid = (values[1:] + values[:-1]) / 2
        out.append(mid if len(mid) <= most else np.unique(np.quantile(column, np.linspace(0, 1, most + 2)[1:-1])))
    return out


def fit_tree(x: np.ndarray, codes: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float) -> Tree:
    tree = Tree([], [], [], [], [])

    def grow(rows: np.ndarray, left_depth: int) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        node = tree.add(g, h, ridge)
        best = (1e-6, -1, 0)
        if left_depth and len(rows) >= 2 * least:
            for f, cut in enumerate(cuts):
                if len(cut):
                    c = codes[rows, f]
                    gs, hs, ns = (np.bincount(c, w, len(cut) + 1).cumsum()[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
                    gain[(ns < least) | (len(rows) - ns < least)] = -1
                    if gain.max() > best[0]:
                        best = (gain.max(), f, int(gain.argmax()))
        if best[1] >= 0:
            _, f, k = best
            go = codes[rows, f] <= k
            tree.feature[node], tree.threshold[node] = f, float(cuts[f][k])
            tree.left[node] = grow(rows[go], left_depth - 1)
            tree.right[node] = grow(rows[~go], left_depth - 1)
        return node

    grow(np.arange(len(x)), depth)
    return tree


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        return 1 / (1 + np.exp(-(self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x))))))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0, bins: int = 32) -> Boosted:
    """Gradient boosting with logistic loss."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(share / (1 - share))), rate, [])
    if len(y) < 2 * least or y.min() == y.max():
        return model
    cuts = _bins(x, bins)
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = fit_tree(x, codes, cuts, p - y, p * (1 - p), depth, least, ridge)
        model.trees.append(tree)
        margin += rate * tree.predict(x)
    return model


#: Gradients are added up in whole units, so the sums don't depend on how rows are dealt out.
UNIT = 2.0**-24
#: So many rounds' trees are added to a row's margins inside tasks before the margins are written.
KEPT = 10
#: What a block of rows holds beside its codes and margins.
COLUMNS = {"fold": np.int32, "part": np.int32, "y": np.float64, "n": np.int64}


def table_cuts(rows: DataFrame, most: int) -> list[np.ndarray]:
    """``_bins`` of all rows of ``x, n``, each counting n times."""
    values = rows.select("n", F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("n").alias("n"))
    places = F.array(*[F.lit(float(q)) for q in np.linspace(0, 1, most + 2)[1:-1]])
    found = values.groupBy("f").agg(F.count("*").alias("k"), F.sort_array(F.collect_list("v")).alias("v"), F.percentile("v", places, F.col("n")).alias("q"))
    out = {}
    for r in found.select("f", "k", "q", F.when(F.col("k") <= most + 1, F.col("v")).alias("v")).collect():  # a row for each feature
        v = np.array(r["v"] or [])
        out[r["f"]] = (v[1:] + v[:-1]) / 2 if len(v) else np.unique(r["q"])
    return [out[f] for f in sorted(out)]


def boost_table(rows: DataFrame, folds: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0, bins: int = 32) -> tuple[list[Boosted], DataFrame]:
    """``boost`` from all of ``fold, part, y, x, n``, where a row counts n times.

    The first model comes from all rows, the model after it of each fold from the rows of the other folds. Beside
    them ``fold, part, y, n, p`` with the probability by the model that hasn't seen the row.
    """
    small_batches(rows.sparkSession)
    cuts = table_cuts(rows, bins)
    features, width = len(cuts), max((len(c) for c in cuts), default=0) + 1

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch.pop("x").to_list())
                codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                yield batch.assign(codes=[r.tobytes() for r in codes])

    table, seen = counted(rows.select("fold", "part", "y", "x", "n").mapInPandas(coded, "fold int, part int, y double, n long, codes binary").groupBy("fold", "part", "y", "codes").agg(F.sum("n").alias("n")))
    sizes = {r["fold"]: (r["n"], r["y"]) for r in table.groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y").cast("long")).alias("y")).collect()}
    models = []
    for m in range(folds + 1):
        n, y = (sum(v[i] for k, v in sizes.items() if k != m - 1) for i in (0, 1))
        share = float(np.clip(y / n if n else 0.5, 1e-3, 1 - 1e-3))
        models.append((Boosted(float(np.log(share / (1 - share))), rate, []), n >= 2 * least and 0 < y < n))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                margins = np.tile([model.base for model, _ in models], (len(batch), 1))
                columns = {k: batch[k].to_numpy(t) for k, t in COLUMNS.items()}
                yield pd.DataFrame([{k: v.tobytes() for k, v in columns.items()} | {"codes": b"".join(batch["codes"]), "margins": margins.tobytes()}])

    def opened(block) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
        """Codes, margins by all whole trees (rows x models), and the other columns."""
        codes = np.frombuffer(block["codes"], np.uint8).reshape(-1, features)
        margins = np.frombuffer(block["margins"]).reshape(-1, len(models)).copy()
        for m, (model, _) in enumerate(models):
            for tree in model.trees[kept:done]:
                margins[:, m] += rate * tree.predict(codes)
        return codes, margins, {k: np.frombuffer(block[k], t) for k, t in COLUMNS.items()}

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(margins=[opened(block)[1].tobytes() for _, block in batch.iterrows()])

    def summed(rows: Iterator[Row]) -> Iterator[np.ndarray]:
        out = np.zeros((3, len(growing), slots, features, width), np.int64)
        flat = out.reshape(3, -1)
        for block in rows:
            codes, margins, own = opened(block)
            for i, (m, tree, nodes) in enumerate(growing):
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[tree.place(codes)]
                use = np.flatnonzero((at >= 0) & (own["fold"] != m - 1))
                p = 1 / (1 + np.exp(-margins[use, m]))
                cell = ((((i * slots + at[use]) * features)[:, None] + np.arange(features)) * width + codes[use]).ravel()
                for k, v in enumerate((np.rint((p - own["y"][use]) / UNIT), np.rint(p * (1 - p) / UNIT), np.ones(len(use)))):
                    np.add.at(flat[k], cell, np.repeat(v.astype(np.int64) * own["n"][use], features))
        yield out

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, block in batch.iterrows():
                _, margins, own = opened(block)
                yield pd.DataFrame(own | {"p": 1 / (1 + np.exp(-margins[np.arange(len(margins)), own["fold"] + 1]))})

    layout = ", ".join(f"{k} binary" for k in (*COLUMNS, "codes", "margins"))
    table = cut(laid_out(table, seen["n"]).mapInPandas(blocks, layout))
    dealt = table.rdd
    kept = done = 0
    while done < rounds and any(going for _, going in models):
        trees = [Tree([], [], [], [], []) for _ in models]
        for tree in trees:
            tree.add(0.0, 1.0, 0.0)
        growing = [(m, trees[m], [0]) for m, (_, going) in enumerate(models) if going]
        for _ in range(depth):
            slots = max(len(nodes) for _, _, nodes in growing)
            sums = dealt.mapPartitions(summed).treeReduce(np.add) * np.array([UNIT, UNIT, 1]).reshape(3, 1, 1, 1, 1)
            growing = [(m, tree, _split(tree, nodes, sums[:, i], least, ridge)) for i, (m, tree, nodes) in enumerate(growing)]
            growing = [x for x in growing if x[2]]
            if not growing:
                break
        for tree, (model, going) in zip(trees, models, strict=True):
            if going:
                model.trees.append(tree)
        done += 1
        if done % KEPT == 0 and done < rounds:
            table, kept = cut(table.mapInPandas(moved, layout)), done
            dealt = table.rdd

    scored = cut(table.mapInPandas(judged, "fold int, part int, y double, n long, p double"))
    for model, _ in models:
        for tree in model.trees:  # from codes to values
            tree.threshold = [float(cuts[f][int(k)]) if f >= 0 else 0.0 for f, k in zip(tree.feature, tree.threshold, strict=True)]
    return [model for model, _ in models], scored


def _split(tree: Tree, nodes: list[int], sums: np.ndarray, least: int, ridge: float) -> list[int]:
    """Split leaves by sums (gradient, its slope and number; by leaf, feature and bin), and return the new leaves."""
    new = []
    for node, (gs, hs, ns) in zip(nodes, sums.swapaxes(0, 1), strict=False):
        g, h, n = gs[0].sum(), hs[0].sum(), ns[0].sum()
        if not node:
            tree.value[0] = float(-g / (h + ridge))
        gl, hl, nl = (v.cumsum(axis=1)[:, :-1] for v in (gs, hs, ns))
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
        gain[(nl < least) | (n - nl < least)] = -1
        if gain.size and gain.max() > 1e-6:
            f, k = np.unravel_index(gain.argmax(), gain.shape)
            tree.feature[node], tree.threshold[node] = int(f), float(k)
            tree.left[node] = tree.add(gl[f, k], hl[f, k], ridge)
            tree.right[node] = tree.add(g - gl[f, k], h - hl[f, k], ridge)
            new += [tree.left[node], tree.right[node]]
    return new


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights by accelerated proximal gradient steps."""
    n, k = x.shape
    x = np.concatenate([np.ones((n, 1)), x], axis=1)
    step = 4 * n / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ z)))
        new = z - step * (x.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (last - 1) / t * (new - w), new
    return float(w[0]), w[1:]
