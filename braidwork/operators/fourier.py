"""Discrete Fourier transforms of runs of any length, in four steps that no task holds a run for.

A length n1 * n2 is laid out as a matrix: place i stands in row i // n2 and column i % n2. Columns are transformed by
blocks (n1 points each), every cell is turned by its twiddle, and rows are transformed by blocks (n2 points); what
stands in row k1 and comes out at k2 is the transform's place k1 + n1 * k2. A length without two factors small enough
becomes a convolution with a chirp at a power of two beyond twice the length. Short runs are transformed whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.scans import Ranges
from braidwork.session import cut

#: Points up to which a run is transformed by one task; points of a block; the larger factor of a length at most.
SHORT, CELLS, FACTOR = 65_536, 65_536, 65_536
#: Long runs up to which their lengths are broadcast.
RUNS = 20_000


def factors(n: int, most: int = FACTOR) -> tuple[int, int] | None:
    """Two factors as alike as can be, None if the larger exceeds ``most``."""
    a = int(np.sqrt(n))
    while n % a:
        a -= 1
    return (a, n // a) if n // a <= most else None


def _phase(numerator: np.ndarray, denominator: int) -> np.ndarray:
    """exp(-2 pi i x / n) of whole numbers, reduced first."""
    return np.exp(-2j * np.pi * (numerator % denominator) / denominator)


def _kept(pdf: pd.DataFrame, i: np.ndarray, z: np.ndarray) -> pd.DataFrame:
    r = pdf.iloc[0]
    return pd.DataFrame({"run": r["run"], "n1": r["n1"], "n2": r["n2"], "i": i.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})


def _along(forward: bool, first: bool, cells: int):
    """The transform of a block of columns (first) or rows of runs' matrices."""

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0])
        i, z = pdf["i"].to_numpy(np.int64), pdf["re"].to_numpy(float) + 1j * pdf["im"].to_numpy(float)
        length = n1 if first else n2
        at, line = (i // n2, i % n2) if first else (i % n2, i // n2)
        start = int(line.min() // _lines(length, cells)) * _lines(length, cells)
        lines = np.arange(start, min(start + _lines(length, cells), n2 if first else n1))
        m = np.zeros((length, len(lines)), complex)  # cells without a row are 0
        m[at, line - start] = z
        m = np.fft.fft(m, axis=0) if forward else np.conj(np.fft.fft(np.conj(m), axis=0))
        k = np.arange(length)[:, None]
        if first:
            turn = _phase(k * lines, n1 * n2)
            return _kept(pdf, k * n2 + lines, m * (turn if forward else np.conj(turn)))
        return _kept(pdf, lines + n1 * k, m)

    return transform


def _lines(length: int, cells: int) -> int:
    return max(1, cells // length)


def transformed(points: DataFrame, forward: bool = True, cells: int = CELLS) -> DataFrame:
    """``run, n1, n2, i, re, im`` to the same after the transform of each run's n1 * n2 points; absent points are 0."""
    kind = points.schema["run"].dataType.simpleString()
    shape = f"run {kind}, n1 long, n2 long, i long, re double, im double"
    for first in (True, False):
        length, line = (F.col("n1"), F.col("i") % F.col("n2")) if first else (F.col("n2"), F.floor(F.col("i") / F.col("n2")))
        block = F.floor(line / F.greatest(F.lit(1), F.floor(F.lit(cells) / length)))
        points = points.withColumn("block", block).groupBy("run", "n1", "n2", "block").applyInPandas(_along(forward, first, cells), shape)
    return points


def _chirped(points: DataFrame, sign: float) -> DataFrame:
    """Each point times exp(sign pi i place^2 / n), the square reduced exactly."""
    angle = sign * np.pi * (F.col("i") * F.col("i") % (2 * F.col("n"))) / F.col("n")
    re, im = F.col("re"), F.col("im")
    return points.withColumns({"re": re * F.cos(angle) - im * F.sin(angle), "im": re * F.sin(angle) + im * F.cos(angle)})


def _by_chirp(points: DataFrame, lengths: DataFrame, cells: int) -> DataFrame:
    """``run, n, i, re, im`` of runs whose length can't be split; points: run, n, i, re, im; lengths: run, n."""
    half = F.ceil((F.floor(F.log2(F.col("n") * 2.0)) + 1) / 2)  # n1 * n2 is a power of two beyond 2 n
    n1, n2 = F.pow(F.lit(2), half).cast("long"), F.pow(F.lit(2), F.floor(F.log2(F.col("n") * 2.0)) + 1 - half).cast("long")
    sized = lambda df: df.withColumn("n1", n1).withColumn("n2", n2)
    a = transformed(sized(_chirped(points, -1.0)).select("run", "n1", "n2", "i", "re", "im"), True, cells)
    # the chirp itself, in blocks: place i and, from the end, its mirror image
    b = lengths.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / cells)))).repartition("run", "block")
    b = b.withColumn("i", F.explode(F.sequence(F.col("block") * cells, F.least(F.col("n"), (F.col("block") + 1) * cells) - 1)))
    b = sized(_chirped(b.withColumn("re", F.lit(1.0)).withColumn("im", F.lit(0.0)), 1.0))
    b = b.withColumn("i", F.explode(F.when(F.col("i") > 0, F.array("i", F.col("n1") * F.col("n2") - F.col("i"))).otherwise(F.array("i")))).select("run", "n1", "n2", "i", "re", "im")
    b = transformed(b, True, cells).select("run", "i", F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    both = a.join(b, ["run", "i"])
    product = both.select("run", "n1", "n2", "i", (F.col("re") * F.col("b_re") - F.col("im") * F.col("b_im")).alias("re"), (F.col("re") * F.col("b_im") + F.col("im") * F.col("b_re")).alias("im"))
    out = transformed(product, False, cells).join(_near(lengths), "run").filter(F.col("i") < F.col("n"))
    scale = F.col("n1") * F.col("n2")
    return _chirped(out.withColumn("re", F.col("re") / scale).withColumn("im", F.col("im") / scale), -1.0).select("run", "n", "i", "re", "im")


def _near(lengths: DataFrame) -> DataFrame:
    """Lengths of long runs, broadcast where they were counted to be few."""
    return F.broadcast(lengths) if lengths.limit(RUNS + 1).count() <= RUNS else lengths


def dft(series: DataFrame, short: int = SHORT, cells: int = CELLS, factor: int = FACTOR) -> DataFrame:
    """``run, k, re, im`` of each run's real transform, k from 0 to half its length; series: run, step, value."""
    kind = series.schema["run"].dataType.simpleString()
    placed = cut(Ranges(series.select("run", "step", "value"), ["run"], ["step"]).carried().select("run", F.col("pos").alias("i"), F.col("value").cast("double").alias("re")))
    sizes = cut(placed.groupBy("run").agg(F.count("*").alias("n")))

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.fft.rfft(pdf.sort_values("i")["re"].to_numpy(float))
        return pd.DataFrame({"run": key[0], "k": np.arange(len(z)), "re": z.real, "im": z.imag})

    long = cut(sizes.filter(F.col("n") > short))
    if long.isEmpty():
        return placed.groupBy("run").applyInPandas(whole, f"run {kind}, k long, re double, im double")
    out = placed.join(long.select("run"), "run", "left_anti").groupBy("run").applyInPandas(whole, f"run {kind}, k long, re double, im double")

    @F.pandas_udf("struct<n1:long,n2:long>")
    def split(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([factors(int(x), factor) or (0, 0) for x in n], columns=["n1", "n2"])

    shaped = cut(long.withColumn("f", split("n")).select("run", "n", "f.n1", "f.n2"))
    points = placed.withColumn("im", F.lit(0.0)).join(_near(shaped), "run")
    direct = transformed(points.filter("n1 > 0").select("run", "n1", "n2", "i", "re", "im"), True, cells).withColumn("n", F.col("n1") * F.col("n2"))
    found = direct.select("run", "n", "i", "re", "im")
    odd = shaped.filter("n1 = 0").select("run", "n")
    if not odd.isEmpty():
        found = found.union(_by_chirp(points.filter("n1 = 0").select("run", "n", "i", "re", "im"), odd, cells))
    return out.union(found.filter(F.col("i") <= F.floor(F.col("n") / 2)).select("run", F.col("i").alias("k"), "re", "im"))
