"""The largest eigenvalues of symmetric networks, by joins of vectors with edges.

A block of vectors is a row per node. A product with the matrix is a join on an edge's end and a sum by its other
end, so a network of any size is spread over all tasks, and many networks are one plan. Rounds of filtered subspace
iteration find the eigenvalues of largest size, whatever their sign: a Chebyshev polynomial of the squared
matrix damps what lies below the block's last Ritz value; then sums of products of the
block with its images (180 numbers, the only ones of a network that meet in one task) give an orthonormal block, its Ritz
values and their residuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut

#: Vectors of a block; degrees of the filters of the first rounds, the last one for all further rounds; rounds at most.
WIDTH, DEGREES, ROUNDS = 8, (0, 2, 6, 12), 200
#: Residual, as a share of the largest size, at which an eigenvalue counts as found; change of both at which they do, too.
RESIDUAL, STILL = 1e-7, 1e-10
#: Networks up to so many nodes are taken apart whole, each in one task; networks whose products a task holds at once.
WHOLE, HELD = 256, 4096

X, Y, Z, W = ([f"{v}{k}" for k in range(WIDTH)] for v in "xyzw")
UPPER = np.triu_indices(WIDTH)


def image(looped: DataFrame, vectors: DataFrame, source: list[str], into: list[str], keep: list[str], scale: Column | None = None) -> DataFrame:
    """``net, node``, the columns to keep, and the matrix times each source column.

    ``looped`` holds the edges and a loop at each node, which carries what is kept to the same sum, so that a chain of
    products reads each step once.
    """
    met = looped.join(vectors.withColumnRenamed("node", "dst"), ["net", "dst"])
    loop = F.col("src") == F.col("dst")
    w = F.col("w") if scale is None else F.col("w") * scale
    kept = [F.sum(F.when(loop, F.col(c))).alias(c) for c in keep]
    return met.groupBy("net", F.col("src").alias("node")).agg(*kept, *[F.coalesce(F.sum(F.when(~loop, w * F.col(c))), F.lit(0.0)).alias(n) for c, n in zip(source, into, strict=True)])


#: Filter steps of one plan.
STEPS = 3


def _filtered(looped: DataFrame, block: DataFrame, degree: int) -> DataFrame:
    """``net, node, x..`` after the Chebyshev polynomial of that degree in 2 A^2 / c - 1; block: net, node, c, x.. ."""
    now = block.select("net", "node", "c", *X, *[F.lit(0.0).alias(y) for y in Y])
    for k in range(degree):
        once = image(looped, now, X, Z, ["c", *X, *Y], F.lit(4.0 if k else 2.0) / F.col("c"))
        twice = image(looped, once, Z, W, ["c", *X, *Y])
        now = twice.select("net", "node", "c", *[(F.col(w) - (2.0 if k else 1.0) * F.col(x) - F.col(y)).alias(x) for x, y, w in zip(X, Y, W, strict=True)], *[F.col(x).alias(y) for x, y in zip(X, Y, strict=True)])
        if k % STEPS == STEPS - 1:
            now = cut(now)
    return now.select("net", "node", *X)


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``net, p``: each task's share of X'X, X'Z, Z'Z, Z'W and W'W, upper halves one after another."""
    held: dict = {}

    def told() -> pd.DataFrame:
        out = pd.DataFrame({"net": list(held), "p": list(held.values())})
        held.clear()
        return out

    for pdf in batches:
        for net, own in pdf.groupby("net"):
            x, z, w = (own[c].to_numpy(float) for c in (X, Z, W))
            p = np.concatenate([(a.T @ b)[UPPER] for a, b in ((x, x), (x, z), (z, z), (z, w), (w, w))])
            held[net] = held[net] + p if net in held else p
        if len(held) >= HELD:
            yield told()
    if held:
        yield told()


def _gram(block: DataFrame) -> DataFrame:
    """``net, p`` of whole networks from ``net, x.., z.., w..``."""
    kind = block.schema["net"].dataType.simpleString()
    parts = block.select("net", *X, *Z, *W).mapInPandas(_products, f"net {kind}, p array<double>")
    sums = parts.select("net", F.posexplode("p").alias("at", "v")).groupBy("net", "at").agg(F.sum("v").alias("v"))
    return sums.groupBy("net").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("p"))


def _square(values: np.ndarray) -> np.ndarray:
    out = np.zeros((WIDTH, WIDTH))
    out[UPPER] = values
    return out + np.triu(out, 1).T


def ritz(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the products of X, Z = AX and W = AZ: the largest Ritz values of the space of X and Z, their residuals, and the
    columns that turn X and Z into Ritz vectors.

    With the image in it, the space holds both signs of a pair of eigenvalues that the squared matrix can't tell apart.
    """
    xx, xz, zz, zw, ww = (_square(v) for v in np.split(np.asarray(p, float), 5))
    g, h, k = np.block([[xx, xz], [xz, zz]]), np.block([[xz, zz], [zz, zw]]), np.block([[zz, zw], [zw, ww]])
    size = np.sqrt(np.maximum(np.diag(g), 0))
    inverse = np.divide(1.0, size, out=np.zeros(len(g)), where=size > 0)
    values, vectors = np.linalg.eigh(g * inverse[:, None] * inverse)
    some = values > 1e-11 * max(values.max(), 1e-300)
    base = inverse[:, None] * vectors[:, some] / np.sqrt(values[some])
    small = base.T @ h @ base
    theta, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(theta), kind="stable")[:WIDTH]
    theta, to = theta[order], base @ turn[:, order]
    left = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", to, k, to) - theta * theta, 0.0))
    pad = WIDTH - len(theta)
    return np.pad(theta, (0, pad)), np.pad(left, (0, pad)), np.pad(to, ((0, 0), (0, pad)))


def leading(edges: DataFrame, nodes: DataFrame, wanted: int = 2) -> DataFrame:
    """``net, first, second``: the two largest sizes of eigenvalues of each network's signed matrix.

    Edges are ``net, src, dst, w`` in both directions, nodes ``net, node``; a network without edges has zeros. Each is
    right to about 1e-7 of the first; with one ``wanted``, rounds end when the first is.
    """
    kind = nodes.schema["net"].dataType.simpleString()
    loops = nodes.select("net", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("w")).distinct()
    looped = cut(edges.filter("src <> dst").select("net", "src", "dst", "w").union(loops))
    # numbers drawn from the node by a hash
    drawn = [(F.xxhash64(F.lit(k), "net", "node") / float(1 << 63)).alias(x) for k, x in enumerate(X)]
    block = cut(nodes.select("net", "node").distinct().select("net", "node", F.lit(1.0).alias("c"), *drawn))
    last = block.select("net").distinct().select("net", F.lit(float("inf")).alias("old_first"), F.lit(float("inf")).alias("old_second"))

    def solved(steady: bool):
        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    theta, left, to = ritz(r.p)
                    first, second = abs(theta[0]), abs(theta[1])
                    found = left[:wanted].max() <= RESIDUAL * first or first == 0.0
                    still = steady and max(abs(first - r.old_first), abs(second - r.old_second)) <= STILL * first
                    spread = theta[np.abs(theta) > 0]
                    out.append((r.net, first, second, bool(found or still), max(float(spread[-1] ** 2) if len(spread) else 1.0, 1e-12 * first * first) or 1.0, to.ravel()))
                yield pd.DataFrame(out, columns=["net", "first", "second", "done", "c", "turn"])

        return solve

    done = None
    for n in range(ROUNDS):
        degree = DEGREES[min(n, len(DEGREES) - 1)]
        turned = _filtered(looped, block, degree)
        both = cut(image(looped, image(looped, turned, X, Z, X), Z, W, [*X, *Z]))
        seen = cut(_gram(both).join(last, "net").mapInPandas(solved(degree == DEGREES[-1]), f"net {kind}, first double, second double, done boolean, c double, turn array<double>"))
        new = seen.filter("done").select("net", "first", "second")
        done = new if done is None else done.union(new)
        if seen.filter("not done").isEmpty():
            return cut(done)
        model = seen.filter("not done").select("net", "c", "turn", F.col("first").alias("old_first"), F.col("second").alias("old_second"))
        last = model.select("net", "old_first", "old_second")
        whole = both.drop(*W).join(model, "net")
        combined = lambda k: sum((F.col(c) * F.get("turn", j * WIDTH + k) for j, c in enumerate([*X, *Z][1:], 1)), F.col(X[0]) * F.get("turn", k))
        block = cut(whole.select("net", "node", "c", *[combined(k).alias(Y[k]) for k in range(WIDTH)]).withColumnsRenamed(dict(zip(Y, X, strict=True))))
        looped = looped.join(model.select("net"), "net", "left_semi")
    raise RuntimeError(f"eigenvalues of a network weren't found in {ROUNDS} rounds")


def _apart(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``net, first, second`` of networks that are small enough for one task each."""

    def spectrum(key: tuple, own: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        place = pd.Index(members["node"].unique())
        m = np.zeros((len(place), len(place)))
        m[place.get_indexer(own["src"]), place.get_indexer(own["dst"])] = own["w"]
        first, second = [*np.sort(np.abs(np.linalg.eigvalsh(m)))[::-1][:2], 0.0, 0.0][:2]
        return pd.DataFrame({"net": [key[0]], "first": [first], "second": [second]})

    kind = nodes.schema["net"].dataType.simpleString()
    return edges.groupBy("net").cogroup(nodes.groupBy("net")).applyInPandas(spectrum, f"net {kind}, first double, second double")


def largest(edges: DataFrame, nodes: DataFrame, whole: int = WHOLE, wanted: int = 2) -> DataFrame:
    """``net, first, second`` of all networks: those of at most ``whole`` nodes in a task each, larger ones by joins."""
    nodes = cut(nodes.select("net", "node").distinct())  # written, as nodes may come from the edges themselves
    sizes = cut(nodes.groupBy("net").agg(F.count("*").alias("n")))
    small, large = (sizes.filter(c).select("net") for c in (F.col("n") <= whole, F.col("n") > whole))
    of = lambda df, nets: cut(df.join(nets, "net", "left_semi"))  # noqa: E731  written, as both come from the same rows
    out = _apart(of(edges.select("net", "src", "dst", "w"), small), of(nodes, small))
    return out if large.isEmpty() else out.union(leading(of(edges, large), of(nodes, large), wanted))


def second_share(edges: DataFrame, nodes: DataFrame, whole: int = WHOLE) -> DataFrame:
    """``net, lambda_ratio``: the second largest size of an eigenvalue over the largest, 0 where all are 0."""
    ratio = F.when(F.col("first") > 0, F.col("second") / F.col("first")).otherwise(0.0)
    return largest(edges, nodes, whole).select("net", ratio.alias("lambda_ratio"))


def radius(edges: DataFrame, nodes: DataFrame, whole: int = WHOLE) -> DataFrame:
    """``net, radius``: the spectral radius of each network's symmetric matrix."""
    return largest(edges, nodes, whole, 1).select("net", F.col("first").alias("radius"))


#: Nodes of a side whose vectors the driver holds; such vectors between restarts; edges that a task holds; products at most.
SIDE, BASIS, EDGES, PRODUCTS = 4_000_000, 12, 1 << 20, 400


def _dense(keys: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's edges with the left ends' places among all keys and the right ends' among its own."""

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "w")] for b in batches]
        if parts:
            left, right, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = np.unique(right, return_inverse=True)[1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(keys.value, left).astype(np.int32)), pa.array(at), pa.array(w)], ["left", "right", "w"])

    return dense


def _squared(vector: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's share of W W' times the vector: all edges of its right ends are its own."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in ("left", "right", "w")] for b in batches]
        if parts:
            left, right, w = (np.concatenate(x) for x in zip(*parts, strict=True))
            inner = np.bincount(right, w * vector.value[left])
            ends, place = np.unique(left, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(np.bincount(place, w * inner[right]))], ["left", "y"])

    return product


class TooWide(ValueError):
    """A side has more nodes than the driver holds numbers for; products by joins are the way then."""


def two_sided(edges: DataFrame) -> float | None:
    """The spectral radius of a network whose edges ``left, right, w`` go between two sides; weights of a pair add up.

    It is the root of the largest eigenvalue of W W' on the left side, which should be the smaller one. Edges are dealt
    to tasks by their right ends and written once; a product is one pass over them, and only the left side's vector, at most
    ``SIDE`` numbers, goes to and fro. Lanczos' steps start anew from the best vector after ``BASIS`` of them. Right to about
    1e-14 of itself over the gap to the next eigenvalue; None without edges.
    """
    spark = edges.sparkSession
    edges = edges.select("left", "right", F.col("w").cast("double").alias("w")).dropna()
    n, ends = edges.agg(F.count("*"), F.approx_count_distinct("left")).first()
    if not n:
        return None
    if ends > SIDE:
        raise TooWide(f"about {ends} nodes on the left side; the driver holds vectors of {SIDE}")
    sent = []

    def send(x: np.ndarray) -> Broadcast:
        sent.append(spark.sparkContext.broadcast(x))
        return sent[-1]

    names = np.sort(edges.select("left").distinct().toPandas()["left"].to_numpy())
    tasks = max(spark.sparkContext.defaultParallelism * 2, -(-n // EDGES))
    written = cut(edges.repartition(tasks, "right").mapInArrow(_dense(send(names)), "left int, right int, w double"))

    def times(x: np.ndarray) -> np.ndarray:
        parts = written.mapInArrow(_squared(send(x)), "left int, y double").groupBy("left").agg(F.sum("y").alias("y")).toPandas()
        sent.pop().destroy()
        out = np.zeros(len(names))
        out[parts["left"].to_numpy()] = parts["y"].to_numpy()
        return out

    x = np.random.default_rng(0).uniform(0.5, 1.5, len(names))
    basis, images = [x / np.linalg.norm(x)], []
    for _ in range(PRODUCTS):
        images.append(times(basis[-1]))
        small = np.array([[b @ i for i in images] for b in basis])
        values, turns = np.linalg.eigh((small + small.T) / 2)
        best, image = (sum(t * v for t, v in zip(turns[:, -1], vs, strict=True)) for vs in (basis, images))
        left = image - values[-1] * best
        if np.linalg.norm(left) <= RESIDUAL * abs(values[-1]) or not values[-1]:
            return float(np.sqrt(max(values[-1], 0.0)))
        if len(basis) == BASIS:
            basis, images = [best / np.linalg.norm(best)], [image / np.linalg.norm(best)]
        for _ in range(2):
            left = left - sum((b @ left) * b for b in basis)
        basis.append(left / np.linalg.norm(left))
    raise RuntimeError(f"the largest eigenvalue wasn't found in {PRODUCTS} products")
