"""Descriptor vectors: standardising, projecting, selecting, pairwise distances, trends, bins.

Vectors are ``array<double>`` columns. Whatever is fitted (means, covariances, loadings) is one row per
pool; rows themselves never come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from braidwork.session import cut

#: Groups up to which their means and picks are broadcast.
GROUPS = 10_000


def long(df: DataFrame, id_col: str, vec_col: str, *keep: str) -> DataFrame:
    """``id, dim, x`` with further columns that stay."""
    return df.select(id_col, *keep, F.posexplode(vec_col).alias("dim", "x"))


def pool_stats(df: DataFrame, vec_col: str = "v") -> DataFrame:
    """``dim, mean, sd`` (population; 1 where it is 0)."""
    out = df.select(F.posexplode(vec_col).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return out.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def standardised(df: DataFrame, stats: DataFrame, vec_col: str = "v") -> DataFrame:
    """Each vector by the pool's means and deviations; the pool may be larger than ``df``."""
    one = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sd"))).alias("_stats"))  # a row per dimension
    z = F.zip_with(vec_col, "_stats", lambda x, s: (x - s["mean"]) / s["sd"])
    return df.crossJoin(F.broadcast(one)).withColumn(vec_col, z).drop("_stats")


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: Numbers of a block at most; blocks at least, so that their cells go round; rows of a piece.
BLOCK_NUMBERS, BLOCKS, PIECE = 1 << 22, 8, 512

Side = dict[str, np.ndarray]


def all_pairs(df: DataFrame, id_col: str, columns: Sequence[str], met: Callable[[Side, Side, bool], Side], schema: str, rows: int | None = None) -> DataFrame:
    """What ``met`` gives for all pairs of rows, piece by piece.

    Rows are dealt to blocks by their id, and each pair of blocks is a cell and a task. A row is copied once for each block,
    so blocks are as large as memory allows, not in proportion to the table: a task holds one side of its cell, the other
    side passes in pieces of at most ``PIECE`` rows. ``met`` has both sides as arrays by column, ``id`` the first and vectors
    as matrices, and whether both come from one block (then pairs are to count once, those whose first id is the less).
    """
    own = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(c) for c in columns])
    wide = [f.name for f in own.schema if f.dataType.typeName() == "array"]
    seen = own.agg(F.count("*").alias("n"), *[F.max(F.size(c)).alias(c) for c in wide]).first()
    per = rows or max(1, BLOCK_NUMBERS // max(1, sum(seen[c] or 0 for c in wide)))
    blocks = max(2 if rows else BLOCKS, -(-seen["n"] // per))
    own = own.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    at = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    both = [own.withColumn("_held", F.lit(held)).withColumn("_c", at).filter("_b <= _c" if held else "_c <= _b") for held in (True, False)]
    # cells of the triangle are numbered row by row
    low, high = F.least("_b", "_c"), F.greatest("_b", "_c")
    cell = (low * blocks - (low * (low - 1) / 2).cast("int") + high - low).cast("int")
    both = both[0].unionByName(both[1]).withColumn("_same", F.col("_b") == F.col("_c")).withColumn("_cell", cell).drop("_b", "_c")
    dealt = both.repartitionById(blocks * (blocks + 1) // 2, "_cell").sortWithinPartitions(F.desc("_held"))
    names = ["id", *columns]
    out = spark_types(schema)

    def arrays(batch: pa.RecordBatch) -> Side:
        side = {}
        for name in names:
            c = batch.column(name)
            if pa.types.is_list(c.type):
                sizes = set(np.diff(c.offsets.to_numpy()).tolist())
                if len(sizes) > 1 or c.null_count:
                    raise ValueError(f"vectors of {sorted(sizes)} numbers and {c.null_count} missing ones can't be compared")
                side[name] = c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), *sizes)
            else:
                side[name] = c.to_numpy(zero_copy_only=False)
        return side

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, count = [], None, 0
        for batch in batches:
            is_held = np.asarray(batch.column("_held").to_numpy(zero_copy_only=False), bool)
            n = int(is_held.sum())
            if n:
                parts.append(arrays(batch.slice(0, n)))
            if n == len(is_held) or not parts:
                continue
            if held is None:
                held = {c: np.concatenate([x[c] for x in parts]) for c in names}
                count = len(held["id"])
            same = bool(batch.column("_same")[n].as_py())
            passing = arrays(batch.slice(n))
            for i in range(0, len(is_held) - n, PIECE):
                x = {c: a[i : i + PIECE] for c, a in passing.items()}
                for j in range(0, count, PIECE):
                    got = met(x, {c: a[j : j + PIECE] for c, a in held.items()}, same)
                    if len(next(iter(got.values()))):
                        yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)

    return dealt.mapInArrow(meet, schema)


def spark_types(schema: str) -> pa.Schema:
    """A schema's text as Arrow's."""
    return to_arrow_schema(StructType.fromDDL(schema))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a from all of b: one product, and sums of differences where most of its digits cancel."""
    aa, bb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    square = aa + bb - 2 * (a @ b.T)
    i, j = np.nonzero(~(square >= 0.01 * (aa + bb)))
    for k in range(0, len(i), 4096):
        at = i[k : k + 4096], j[k : k + 4096]
        square[at] = ((a[at[0]] - b[at[1]]) ** 2).sum(axis=1)
    return np.sqrt(square)


def counted(x: Side, y: Side, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that count."""
    return np.nonzero(x["id"][:, None] < y["id"][None, :]) if same else tuple(np.indices((len(x["id"]), len(y["id"]))).reshape(2, -1))


def ordered(x: Side, y: Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pairs, the less first."""
    p, q = x["id"][i], y["id"][j]
    return np.where(p < q, p, q), np.where(p < q, q, p)


def pairwise(df: DataFrame, id_col: str, vec_col: str = "v", rows: int | None = None) -> DataFrame:
    """``i, j, dist`` of all pairs i < j of vectors of one length: quadratic."""

    def met(x: Side, y: Side, same: bool) -> Side:
        i, j = counted(x, y, same)
        p, q = ordered(x, y, i, j)
        return {"i": p, "j": q, "dist": distances(x[vec_col], y[vec_col])[i, j]}

    kind = df.schema[id_col].dataType.simpleString()
    return all_pairs(df, id_col, [vec_col], met, f"i {kind}, j {kind}, dist double", rows)


def label_distances(df: DataFrame, id_col: str, top: str, vec_col: str = "v", rows: int | None = None) -> DataFrame:
    """``pair, n, mean_dist``: pairs of both ends in the top group, in the bottom group, or one in each, summed piece by piece."""
    names = np.array(["Bottom-Bottom", "Top-Bottom", "Top-Top"])

    def met(x: Side, y: Side, same: bool) -> Side:
        kind = x[top].astype(int)[:, None] + y[top].astype(int)[None, :]
        if same:
            kind = np.where(x["id"][:, None] < y["id"][None, :], kind, 3)
        d = distances(x[vec_col], y[vec_col])
        return {"pair": names, "n": np.bincount(kind.ravel(), minlength=4)[:3], "total": np.bincount(kind.ravel(), d.ravel(), 4)[:3]}

    sums = all_pairs(df, id_col, [vec_col, top], met, "pair string, n long, total double", rows)
    return sums.groupBy("pair").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_dist")).filter("n > 0")


def pair_label(a: Column, b: Column) -> Column:
    """Both ends in the top group, both in the bottom group, or one in each."""
    return F.when(a & b, "Top-Top").when(~a & ~b, "Bottom-Bottom").otherwise("Top-Bottom")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line: ``slope, intercept, n``."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count("*").alias("n"))


def grid_counts(df: DataFrame, x: str, y: str, size: int = 25) -> DataFrame:
    """``bx, by, n`` of rectangular bins over the data's range; empty bins are left out."""
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * size), F.lit(size - 1))).otherwise(0)
    return df.crossJoin(F.broadcast(ends)).groupBy(at(x, "x0", "x1").cast("int").alias("bx"), at(y, "y0", "y1").cast("int").alias("by")).agg(F.count("*").alias("n"))


def hex_counts(df: DataFrame, x: str, y: str, size: int = 15) -> DataFrame:
    """``lattice, hx, hy, n`` of hexagonal bins: the nearer of two shifted lattices over the data's range."""
    high = int(size / np.sqrt(3))
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    sx = lambda v, lo, hi, n: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * n).otherwise(0.0)
    at = df.crossJoin(F.broadcast(ends)).select(sx(x, "x0", "x1", size).alias("u"), sx(y, "y0", "y1", high).alias("v"))
    at = at.select("u", "v", F.floor(F.col("u") + 0.5).alias("i1"), F.floor(F.col("v") + 0.5).alias("j1"), F.floor("u").alias("i2"), F.floor("v").alias("j2"))
    d1 = F.pow(F.col("u") - F.col("i1"), 2) + 3 * F.pow(F.col("v") - F.col("j1"), 2)
    d2 = F.pow(F.col("u") - F.col("i2") - 0.5, 2) + 3 * F.pow(F.col("v") - F.col("j2") - 0.5, 2)
    first = d1 < d2
    return at.groupBy(
        F.when(first, 1).otherwise(2).alias("lattice"), F.when(first, F.col("i1")).otherwise(F.col("i2")).cast("int").alias("hx"), F.when(first, F.col("j1")).otherwise(F.col("j2")).cast("int").alias("hy")
    ).agg(F.count("*").alias("n"))


def moments(df: DataFrame, vec_col: str = "v") -> DataFrame:
    """``i, j, n, mean_i, mean_j, cov`` (population), i <= j, of vectors of one length.

    Each task sums its vectors' outer products, about their own mean, to one row; the rows are merged by place.
    """

    def summed(batches):
        n, mean, square = 0, None, None
        for pdf in batches:
            x = np.stack([np.asarray(v, float) for v in pdf["v"]]) if len(pdf) else None
            if x is None:
                continue
            m, own = len(x), x.mean(axis=0)
            c = (x - own).T @ (x - own)
            if n:
                step = own - mean
                square += c + np.outer(step, step) * n * m / (n + m)
                mean = mean + step * m / (n + m)
            else:
                mean, square = own, c
            n += m
        if n:
            i, j = np.triu_indices(len(mean))
            yield pd.DataFrame({"i": i, "j": j, "n": n, "a": mean[i], "b": mean[j], "c": square[i, j]})

    parts = df.select(F.col(vec_col).alias("v")).filter("v is not null").mapInPandas(summed, "i int, j int, n long, a double, b double, c double")
    total = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum("c").alias("c"), F.sum(F.col("n") * F.col("a") * F.col("b")).alias("ab"))
    between = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    return total.select("i", "j", "n", (F.col("a") / F.col("n")).alias("mean_i"), (F.col("b") / F.col("n")).alias("mean_j"), ((F.col("c") + between) / F.col("n")).alias("cov"))


def pca(df: DataFrame, vec_col: str = "v") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, loadings (rows) and shares of variance, from a covariance of dims x dims.

    Signs are fixed: the loading of largest size of each component is positive.
    """
    cells = moments(df, vec_col).collect()  # dims * (dims + 1) / 2 rows
    dims = 1 + max((r["j"] for r in cells), default=-1)
    c, means = np.zeros((dims, dims)), np.zeros(dims)
    for r in cells:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
        means[r["i"]] = r["mean_i"]
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(dims), np.abs(loadings).argmax(axis=1)])[:, None]
    values = np.maximum(values[order], 0)
    return means, loadings, values / max(values.sum(), 1e-300)


def projected(df: DataFrame, means: np.ndarray, loadings: np.ndarray, parts: int, vec_col: str = "v", into: str = "pc") -> DataFrame:
    """(v - means) times the first loadings, as column arithmetic."""
    literal = lambda x: F.array(*[F.lit(float(v)) for v in x])
    dot = lambda row: F.aggregate(F.zip_with(F.col(vec_col), literal(row), lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn(into, F.array(*[dot(loadings[k]) - F.lit(float(loadings[k] @ means)) for k in range(parts)]))


def maxmin(df: DataFrame, k: int, group: str, id_col: str, vec_col: str = "v") -> DataFrame:
    """``group, pick, id``: in each group k rows far from one another.

    The first is the farthest from the mean, each next the farthest from those picked; ties go to the smallest
    id. Rounds are aggregates over all rows against the k picks of their group, which stay in Spark, so groups may
    be of any size and number.
    """
    rows = cut(df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(vec_col).alias("v")))
    mean = rows.select("g", F.posexplode("v").alias("dim", "x")).groupBy("g", "dim").agg(F.avg("x").alias("m")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("c"))
    mean = cut(mean.select("g", F.transform("c", lambda s: s["m"]).alias("c")))
    near = F.broadcast if mean.limit(GROUPS + 1).count() <= GROUPS else lambda x: x
    far = lambda d: F.max_by(F.struct("id", "v"), F.struct(d, -F.col("id")))
    first = rows.join(near(mean), "g").withColumn("d", distance(F.col("v"), F.col("c"))).groupBy("g").agg(far("d").alias("p"))
    picks = cut(first.select("g", F.lit(0).alias("pick"), "p.id", "p.v"))
    for n in range(1, k):
        own = picks.groupBy("g").agg(F.collect_list("v").alias("vs"))  # at most k vectors a group
        d = rows.join(near(own), "g").withColumn("d", F.array_min(F.transform("vs", lambda c: distance(F.col("v"), c)))).filter("d > 0")
        new = cut(d.groupBy("g").agg(far("d").alias("p")).select("g", F.lit(n).alias("pick"), "p.id", "p.v"))
        if new.isEmpty():
            break
        picks = cut(picks.union(new))
    return picks.select(F.col("g").alias(group), "pick", F.col("id").alias(id_col))


def ridge(df: DataFrame, features: list[str], target: str, alpha: float = 1e-6, group: str | None = None) -> DataFrame:
    """``feature, weight`` rows (``intercept`` unpenalised) by group, from sufficient statistics.

    One aggregate gives means and covariances about them; the small systems are solved where the groups are.
    """
    names = [*features, target]
    keys = [group] if group else []
    sums = [F.count("*").cast("double").alias("n")] + [F.avg(c).alias(f"s_{i}") for i, c in enumerate(names)]
    sums += [F.covar_pop(a, b).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    stats = (df.groupBy(*keys) if keys else df).agg(*sums)
    d = len(features)

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                mean = np.array([r[f"s_{i}"] for i in range(d + 1)])
                c = r["n"] * np.array([[r[f"p_{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)])
                w = np.linalg.solve(c[:d, :d] + alpha * np.eye(d), c[:d, d])
                rows += [{**{k: r[k] for k in keys}, "feature": f, "weight": float(x)} for f, x in zip([*features, "intercept"], [*w, mean[d] - w @ mean[:d]], strict=True)]
            yield pd.DataFrame(rows)

    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["feature string", "weight double"])
    return stats.mapInPandas(solve, schema)
