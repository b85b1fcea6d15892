"""Whitening of embeddings by refined eigenvectors of their covariance.

Tasks sum whole-number vectors and then, about the exact means, their outer products; only sums by pair of
dimensions are shuffled. The covariance of a length of vectors is taken apart in one task, dims by dims: eigenvectors
of its float32 copy are the start, and refinement by matrix products in doubles (after Ogita and Aishima) corrects
them. With R = I - X'X and S = X'AX, an eigenvalue is S_ii / (1 - R_ii), and X goes to X + XE with
E_ij = (S_ij + l_j R_ij) / (l_j - l_i) = R_ij / 2 + (S_ij + (l_i + l_j) / 2 R_ij) / (l_j - l_i), which squares the error of
well separated vectors. Where eigenvalues are closer
than the error of S, the quotient means nothing: vectors of such a cluster are turned among themselves
by a sub-solve, the small eigenproblem of their own S and I - R less the cluster's mean value, and E only keeps them
orthogonal. The means of what is left over, dims by 32 numbers, go back to all rows.

Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped; vectors of each length are
whitened on their own; an entry's whole number is held within 2^62 either way, a deviation within a long; directions
without variance (at most ``FLAT`` of the largest eigenvalue, so all of a single or constant vector) have no scale
and give no rows, so there are at most as many components as directions; rows that repeat an id count each; rows
without an id count like others; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import common, cut, joined, read, small_batches

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
#: Directions of at most this share of the largest eigenvalue have no variance but rounding's.
FLAT = 1e-12
#: Rounds of refinement at most in either precision; it ends when a correction is small enough.
ROUNDS = 12
HELD = float(1 << 62)
LONG = np.iinfo(np.int64)


def whole(batch: pd.Series) -> np.ndarray:
    """Vectors of one length as whole numbers."""
    x = np.stack([np.asarray(v, np.float64) for v in batch])
    return np.clip(np.floor(SCALE * x), -HELD, HELD).astype(np.int64) + SHIFT


def _small(x: np.ndarray, factor: int) -> bool:
    """Whether products with the factor stay exact in a long."""
    return float(np.abs(x.astype(float)).max(initial=0.0)) * factor < 2.0**62


def by_length(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    for dims, own in pdf.groupby("dims"):
        yield int(dims), own


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``dims, i, n, s``: each task's exact sums."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for pdf in batches:
        for dims, own in by_length(pdf):
            x = whole(own["vec"])
            s = (x if _small(x, len(x)) else x.astype(object)).sum(axis=0).astype(object)
            n, before = totals.get(dims, (0, 0))
            totals[dims] = n + len(x), before + s
    for dims, (n, s) in totals.items():
        yield pd.DataFrame({"dims": dims, "i": np.arange(dims), "n": n, "s": [Decimal(int(v)) for v in s]})


def _about(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the exact means."""
    if _small(x, n) and max(map(abs, sums), default=0) < 1 << 62:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[float(Decimal(n * int(v) - s) / n) for v, s in zip(row, sums, strict=True)] for row in x])


def _scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``dims, i, j, n, a, b, c``: each task's means and centred products of the vectors ``v``, by pair of dimensions."""
    totals: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        for dims, own in by_length(pdf):
            v = np.stack([np.asarray(x, np.float64) for x in own["v"]])
            n, mean = len(v), v.mean(axis=0)
            c = (v - mean).T @ (v - mean)
            if dims in totals:
                m, was, square = totals[dims]
                step = mean - was
                c += square + np.outer(step, step) * n * m / (n + m)
                mean, n = was + step * n / (n + m), n + m
            totals[dims] = n, mean, c
    for dims, (n, mean, c) in totals.items():
        i, j = np.triu_indices(len(mean))
        yield pd.DataFrame({"dims": dims, "i": i, "j": j, "n": n, "a": mean[i], "b": mean[j], "c": c[i, j]})


def covariances(rows: DataFrame) -> DataFrame:
    """``dims, i, j, cov`` for i <= j of ``dims, v``, divisor n; tasks centre before they multiply."""
    parts = rows.mapInPandas(_scatter, "dims int, i int, j int, n long, a double, b double, c double")
    n = F.col("n")
    total = parts.groupBy("dims", "i", "j").agg(F.sum("n").alias("n"), F.sum(n * F.col("a")).alias("a"), F.sum(n * F.col("b")).alias("b"), F.sum("c").alias("c"), F.sum(n * F.col("a") * F.col("b")).alias("ab"))
    return total.select("dims", "i", "j", ((F.col("c") + F.col("ab") - F.col("a") * F.col("b") / n) / n).alias("cov"))


def _groups(values: np.ndarray, order: np.ndarray, gap: float) -> list[np.ndarray]:
    """Neighbours in ``order`` whose values lie within ``gap`` of one another."""
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return np.split(order, cuts)


def _turned(x: np.ndarray, s: np.ndarray, r: np.ndarray, values: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sub-solve: vectors of one cluster turned to the eigenvectors of their own part, less its mean value."""
    at, eye = np.ix_(own, own), np.eye(len(own))
    inverse = np.linalg.inv(np.linalg.cholesky((eye - r[at]).astype(np.float64)))
    part = inverse @ (s[at] - values[own].mean() * (eye - r[at])).astype(np.float64) @ inverse.T
    return x[:, own] @ (inverse.T @ np.linalg.eigh((part + part.T) / 2)[1]).astype(x.dtype)


def _corrected(a: np.ndarray, x: np.ndarray, size: float) -> tuple[np.ndarray, float]:
    """One refinement in the precision of ``a`` and ``x``, and how large it was."""
    eye = np.eye(len(a), dtype=a.dtype)

    def seen() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, s = eye - x.T @ x, x.T @ (a @ x)
        return r, s, np.diag(s) / (1 - np.diag(r))

    r, s, values = seen()
    norm = lambda m: float(np.linalg.norm(m.astype(np.float64), 2))
    gap = max(2 * (norm(s - np.diag(values)) + size * norm(r)), 4 * size * float(np.finfo(np.float64).eps))  # the matrix itself is known to doubles
    groups = [g for g in _groups(values, np.argsort(values), gap) if len(g) > 1]
    for own in groups:
        x[:, own] = _turned(x, s, r, values, own)
    if groups:
        r, s, values = seen()
    apart = values[None, :] - values[:, None]
    near = np.abs(apart) <= gap
    for own in groups:  # a chain of close values is one cluster, however far its ends are apart
        near[np.ix_(own, own)] = True
    # a symmetric part that makes vectors orthogonal, and a turn, so that rounding in one doesn't spoil the other
    turn = (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(near, 1.0, apart)
    e = r / 2 + np.where(near, 0.0, (turn - turn.T) / 2)
    return x + x @ e, float(np.abs(e).max(initial=0.0))


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, to double precision, the largest first.

    Doubles refine the float32 start as far as they can; the last rounds take extended doubles, so that what is
    rounded to doubles in the end is right to their last digits.
    """
    scale = float(np.abs(a).max(initial=0.0)) or 1.0
    a = a / scale
    x, size = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64), float(np.linalg.norm(a, 2))
    for kind, least in ((np.float64, 1e-8), (np.longdouble, 1e-15)):
        own, x, last = a.astype(kind), x.astype(kind), np.inf
        for _ in range(ROUNDS):
            x, change = _corrected(own, x, size)
            if change < least or change > last / 4:  # the next error is about its square, or rounding's
                break
            last = change
    for _ in range(2):  # a turn by k leaves k^2 of R
        x = x + x @ ((np.eye(len(a), dtype=x.dtype) - x.T @ x) / 2)
    values = ((x * (own @ x)).sum(axis=0) / (x * x).sum(axis=0)).astype(np.float64)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, (x / np.sqrt((x * x).sum(axis=0))).astype(np.float64)[:, order]


class Fit:
    """Numbers of each length of vectors: ``dims, n, sums, axes, scale, share``.

    ``axes`` holds the kept eigenvectors one after another, ``scale`` their standard deviations and ``share`` their
    shares of the trace.
    """

    def __init__(self, rows: DataFrame, components: int = COMPONENTS):
        """rows: dims, vec, whole and finite."""

        def solve(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
            dims = int(key[0])
            v = np.zeros((dims, dims))
            v[own["i"], own["j"]] = v[own["j"], own["i"]] = own["cov"]
            values, vectors = eigen(v)
            kept = int((values[:components] > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
            return pd.DataFrame({"dims": [dims], "axes": [vectors[:, :kept].T.ravel()], "scale": [np.sqrt(values[:kept])], "share": [values[:kept] / max(np.trace(v), 1e-300)]})

        sums = rows.mapInPandas(_sums, "dims int, i int, n long, s decimal(38,0)").groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
        sums = cut(sums.groupBy("dims").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"].cast("string")).alias("sums")))
        self.often = common(rows.select("dims"), ["dims"])
        centred = joined(rows, sums, ["dims"], "inner", self.often).mapInPandas(_centred, "dims int, v array<double>")
        axes = covariances(centred).groupBy("dims").applyInPandas(solve, "dims int, axes array<double>, scale array<double>, share array<double>")
        self.model = cut(sums.join(axes, "dims"))
        white = joined(rows, self.model, ["dims"], "inner", self.often).mapInPandas(_whitened, "dims int, v array<double>")
        off = F.abs(F.col("cov") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
        self.error = cut(covariances(white.filter(F.size("v") > 0)).groupBy("dims").agg(F.max(off).alias("identity_error")))  # a row for each length

    def applied(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, dims, vec) as ``id, n, deviation, white, share, identity_error``."""
        kind = rows.schema["id"].dataType.simpleString()

        def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, own in by_length(pdf):
                    r, x = own.iloc[0], whole(own["vec"])
                    n, sums = int(r["n"]), [int(s) for s in r["sums"]]
                    yield pd.DataFrame({"id": own["id"], "n": n, "deviation": _deviations(x, n, sums), "white": list(_white(x, r)), "share": own["share"], "identity_error": own["identity_error"]})

        model = self.model.join(self.error, "dims")
        return joined(rows, model, ["dims"], "inner", self.often).mapInPandas(told, f"id {kind}, n long, deviation long, white array<double>, share array<double>, identity_error double")


def _centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dims, own in by_length(pdf):
            r = own.iloc[0]
            yield pd.DataFrame({"dims": dims, "v": list(_about(whole(own["vec"]), int(r["n"]), [int(s) for s in r["sums"]]))})


def _white(x: np.ndarray, r: pd.Series) -> np.ndarray:
    axes = np.asarray(r["axes"], float).reshape(-1, x.shape[1])
    return _about(x, int(r["n"]), [int(s) for s in r["sums"]]) @ axes.T / np.asarray(r["scale"], float)


def _whitened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for dims, own in by_length(pdf):
            yield pd.DataFrame({"dims": dims, "v": list(_white(whole(own["vec"]), own.iloc[0]))})


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of (n x - S)^2, exact, held within a long."""
    if _small(x, n) and max(map(abs, sums), default=0) < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        if float(np.abs(d.astype(float)).max(initial=0.0)) ** 2 * x.shape[1] < 2.0**62:
            return (d * d).sum(axis=1)
    d = n * x.astype(object) - np.array(sums, object)
    return np.array([min(int(v), LONG.max) for v in (d * d).sum(axis=1)], np.int64)


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, dims, vec`` of the vectors that take part."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.coalesce((F.size("vec") > 0) & ~odd, F.lit(False))).select("id", F.size("vec").alias("dims"), "vec")


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id, n, deviation, white, share, identity_error`` of each vector that takes part."""
    small_batches(df.sparkSession)
    rows = usable(df, id_col, vec_col)
    return Fit(rows, components).applied(rows)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; odd vectors, repeated ids and flat directions as in the module's cases."""
    found = whitened(read(spark, sf_dir, "embeddings"))
    out = found.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("white", "share")).alias("k", "c"))
    return out.select(F.col("id").alias("vec_id"), (F.col("k") + 1).alias("component"), "n", "deviation", F.col("c.white").alias("whitened"), F.col("c.share").alias("explained"), "identity_error")
