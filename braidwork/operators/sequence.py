"""Order-dependent operations on series ``run, step, value``, and leaky-integrator states over them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.fourier import dft
from braidwork.operators.scans import Ranges

def delay_embed(series: DataFrame, delays: int, value: str = "value") -> DataFrame:
    """``run, step, h0 .. h(d-1)``: each value with the next ones; rows without all of them are left out."""
    rows = Ranges(series.select("run", "step", F.col(value).alias("value")), ["run"], ["step"]).ahead(delays, ["value"])
    return rows.filter(F.size("next") == delays).select("run", "step", *[F.get("next", k)["value"].alias(f"h{k}") for k in range(delays)])


def energy_rank(values: DataFrame, energy: float = 0.99) -> DataFrame:
    """``run, rank``: how many of the largest values hold that share of the sum of squares."""
    square = F.col("value") * F.col("value")
    rows = values.select("run", "step", "value", (-F.col("value")).alias("falling"))
    cum = Ranges(rows, ["run"], ["falling", "step"]).carried(sums={"before": square}, place="k")
    totals = values.groupBy("run").agg(F.sum(square).alias("total"))
    return cum.join(totals, "run").filter(F.col("before") + square >= energy * F.col("total")).groupBy("run").agg((F.min("k") + 1).alias("rank"))


def delay_ranks(series: DataFrame, delays: int, energy: float = 0.99) -> DataFrame:
    """``run, rank`` of each run's centred delay matrix, from a delays x delays covariance by one aggregate.

    Runs that are shorter than the delays are left out; one without variance has rank 1.
    """
    cells = [(i, j) for i in range(delays) for j in range(i, delays)]
    stats = delay_embed(series, delays).groupBy("run").agg(*[F.covar_pop(f"h{i}", f"h{j}").alias(f"c{i}_{j}") for i, j in cells])
    kind = series.schema["run"].dataType.simpleString()

    def ranks(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(delays)] for i in range(delays)])
                s = np.sort(np.maximum(np.linalg.eigvalsh(c), 0))[::-1]
                cum = np.cumsum(s) / s.sum() if s.sum() > 0 else np.ones(delays)
                out.append((r["run"], int(np.searchsorted(cum, energy)) + 1))
            yield pd.DataFrame(out, columns=["run", "rank"])

    return stats.mapInPandas(ranks, f"run {kind}, rank int")


def choose_rank(series: DataFrame, delays: int, energy: float = 0.99, least: int = 1, most: int = 50) -> DataFrame:
    """``rank``: the smallest at which every run has its energy, within bounds; ``least`` if there is no run."""
    top = delay_ranks(series, delays, energy).agg(F.max("rank").alias("m"))
    return top.select(F.coalesce(F.least(F.greatest("m", F.lit(least)), F.lit(most)), F.lit(least)).alias("rank"))


#: Ranks under which an input excites too few modes to tell systems apart.
FEW_MODES = 5


def rank_notes(series: DataFrame, delays: int, energy: float = 0.99, least: int = 1, most: int = 50) -> DataFrame:
    """``rank, widest, few_modes, capped``: the chosen rank, the largest of a run, and what to beware of.

    ``few_modes`` says that the rank is too low to tell systems apart, ``capped`` that a run has more than was taken.
    """
    top = delay_ranks(series, delays, energy).agg(F.max("rank").alias("widest"))
    rank = F.coalesce(F.least(F.greatest("widest", F.lit(least)), F.lit(most)), F.lit(least))
    return top.select(rank.alias("rank"), "widest", (rank < FEW_MODES).alias("few_modes"), F.coalesce(F.col("widest") > rank, F.lit(False)).alias("capped"))


def whole_runs(series: DataFrame, delays: int) -> DataFrame:
    """``series``, if every run is long enough for the delays; else reading it is an error, where ``delay_ranks`` skips such runs."""
    short = series.groupBy("run").agg(F.count("*").alias("n")).filter(F.col("n") < delays).agg(F.count("*").alias("short"))  # one row
    ok = F.when(F.col("short") == 0, True).otherwise(F.raise_error(F.format_string(f"%d runs are shorter than {delays} delays", "short")).cast("boolean"))
    return series.crossJoin(F.broadcast(short)).filter(ok).drop("short")


def islands(series: DataFrame, label: str) -> DataFrame:
    """``run, label, start, end, centre`` of each stretch of equal labels; positions from 0, ends exclusive."""
    rows = series.select("run", "step", F.col(label).alias("label"))
    seen = Ranges(rows, ["run"], ["step"]).carried(last={"prev": F.col("label")})
    starts = Ranges(seen.withColumn("new", (~F.col("prev_known") | ~F.col("prev").eqNullSafe(F.col("label"))).cast("int")).select("run", "step", "label", "pos", "new"), ["run"], ["pos"])
    own = starts.carried(sums={"island": F.col("new")}, place="at").withColumn("island", F.col("island") + F.col("new"))
    out = own.groupBy("run", "island", "label").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    return out.select("run", "label", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("centre"))


def series_zscore(series: DataFrame) -> DataFrame:
    """Values by their run's mean and population deviation (1 where it is 0), from partial sums."""
    stats = series.groupBy("run").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    return series.join(stats, "run").select("run", "step", ((F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).alias("z"))


def dft_magnitude(series: DataFrame) -> DataFrame:
    """``run, k, magnitude`` of each run's real discrete Fourier transform, of runs of any length."""
    return dft(series).select("run", F.col("k").cast("int").alias("k"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))


def leaky_fold(series: DataFrame, leak: float, w_in: float, w: float) -> DataFrame:
    """``run, steps, state``: the last state of one unit, x <- (1 - a) x + a tanh(w_in u + w x) from 0.

    A run is folded in order by the task that its rows are dealt to, from batch to batch, so its length bounds no memory.
    """
    kind = series.schema["run"].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, n, x = None, 0, 0.0
        for pdf in batches:
            out = []
            for own, u in zip(pdf["run"].tolist(), pdf["value"].tolist(), strict=True):
                if own != run or not n:
                    if n:
                        out.append((run, n, x))
                    run, n, x = own, 0, 0.0
                n, x = n + 1, (1 - leak) * x + leak * math.tanh(w_in * u + w * x)
            yield pd.DataFrame(out, columns=["run", "steps", "state"])
        if n:
            yield pd.DataFrame({"run": [run], "steps": [n], "state": [x]})

    rows = series.select("run", "step", "value").repartition("run").sortWithinPartitions("run", "step").select("run", "value")
    return rows.mapInPandas(fold, f"run {kind}, steps int, state double")


class Leaky:
    """The state update of a reservoir; variants override ``update``, and ``initial`` for other weights."""

    def __init__(self, w: np.ndarray, w_in: np.ndarray, leak: float):
        self.w, self.w_in, self.leak = w, w_in, leak

    @staticmethod
    def initial(rng: np.random.Generator, units: int, inputs: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights between units and from inputs, before their radius is set: all normal, all there."""
        w_in = rng.standard_normal((units, inputs))
        return rng.standard_normal((units, units)) / np.sqrt(units), w_in

    def update(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        return (1 - self.leak) * x + self.leak * np.tanh(self.w_in @ u + self.w @ x)

    def fold(self, inputs: np.ndarray, x: np.ndarray | None = None) -> np.ndarray:
        """States after each input."""
        x = np.zeros(len(self.w)) if x is None else x
        out = np.empty((len(inputs), len(x)))
        for t, u in enumerate(inputs):
            x = out[t] = self.update(x, u)
        return out


def states(series: DataFrame, reservoir: Leaky, inputs: str = "u") -> DataFrame:
    """``run, step, id, state`` for inputs that are arrays; parallel over runs, sequential within one, no wash-out.

    Rows are taken by step, then id, from batch to batch, so a run's length bounds no memory. An input of another width
    than the reservoir's is an error.
    """
    kind, step = (series.schema[c].dataType.simpleString() for c in ("run", "step"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, x = None, None
        for pdf in batches:
            widths = set(map(len, pdf[inputs])) | {reservoir.w_in.shape[1]}
            if len(widths) > 1:
                raise ValueError(f"inputs of different widths: {sorted(widths)}")
            out = []
            for own, part in pdf.groupby("run", sort=False):
                found = reservoir.fold(np.stack([np.asarray(u, float) for u in part[inputs]]), x if own == run else None)
                run, x = own, found[-1]
                out.append(part[["run", "step", "id"]].assign(state=list(found)))
            yield pd.concat(out)

    rows = series.select("run", "step", "id", inputs).repartition("run").sortWithinPartitions("run", "step", "id")
    return rows.mapInPandas(fold, f"run {kind}, step {step}, id long, state array<double>")


def activations(state: DataFrame, steps: int = 100, units: int = 5) -> DataFrame:
    """``run, step, id, unit, activation``: sizes of the first units' states in the first steps."""
    first = state.withColumn("n", F.row_number().over(Window.partitionBy("run").orderBy("step", "id"))).filter(F.col("n") <= steps)
    return first.select("run", "step", "id", F.posexplode(F.slice("state", 1, units)).alias("unit", "x")).select("run", "step", "id", "unit", F.abs("x").alias("activation"))


def one_hot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def told(values: dict, key: Column, what: str) -> Column:
    """The value of a key; an unknown or missing key is an error."""
    out = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(key.cast("string"), F.lit("null"))))
    for k, v in reversed(values.items()):
        out = F.when(key == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def masked(vec: Column, drop: Column) -> Column:
    """The vector without the places in ``drop``."""
    return F.filter(vec, lambda x, i: ~F.array_contains(drop, i))


def fed(obs: Column, action: Column, reward: Column) -> Column:
    """What a reservoir is fed: observation, action and reward."""
    return F.concat(obs, action, F.array(reward))


def mean_of(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda s, x: s + x) / F.size(vec)
