"""Training-style logs ``run, step, value`` and the results that are ranked from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.scans import Ranges
from braidwork.operators.sequence import told


def weight(step: Column, last: Column, window: float, kind: str, only: Column) -> Column:
    """Recency weight of a step in the last ``window`` steps; other kinds than linear and exponential weigh alike."""
    if kind == "linear":
        return F.when(only, 1.0).otherwise(F.least(F.greatest((step - (last - window)) / window, F.lit(1e-6)), F.lit(1.0)))
    if kind == "exponential":
        return F.exp((step - last) / (window / 3.0))
    return F.lit(1.0)


def recency_score(log: DataFrame, window: float, kind: str = "linear", run: str = "run") -> DataFrame:
    """``run, score``: the weighted mean of each run's last ``window`` steps.

    Two aggregates with partial sums, so a run of any length is no single task's work.
    """
    last = log.groupBy(run).agg(F.max("step").alias("last"))
    tail = log.join(last, run).filter(F.col("step") >= F.col("last") - window)
    w = weight(F.col("step"), F.col("last"), window, kind, F.lit(False))
    sums = tail.groupBy(run).agg(F.sum(F.col("value") * w).alias("wv"), F.sum(w).alias("w"))
    return sums.select(run, (F.col("wv") / F.col("w")).alias("score"))


def positions(log: DataFrame, *keys: str, by: tuple[str, ...] = ("step",)) -> DataFrame:
    """``pos`` of each row in its run, from 0 (without keys, in all)."""
    return Ranges(log, keys, by).carried()


def shortest(log: DataFrame, group: str, run: str) -> DataFrame:
    """``log`` with positions, cut to the shortest run of each group."""
    counts = log.groupBy(group, run).agg(F.count("*").alias("n")).groupBy(group).agg(F.min("n").alias("n"))
    return positions(log, group, run).join(counts, group).filter("pos < n").drop("n")


def seed_band(log: DataFrame, group: str = "model", run: str = "seed") -> DataFrame:
    """``group, pos, mean, sd`` across runs, as far as the shortest goes."""
    return shortest(log, group, run).groupBy(group, "pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def seed_pivot(log: DataFrame, seeds: list, group: str = "model", run: str = "seed") -> DataFrame:
    """The same, a column per run."""
    wide = shortest(log, group, run).groupBy(group, "pos").pivot(run, seeds).agg(F.first("value"))
    return wide.select(group, "pos", *[F.col(str(s)).alias(f"seed_{s}") for s in seeds])


def top_bottom(scores: DataFrame, k: int, name: str) -> DataFrame:
    """``side, rank, name, score``: the k best by score, and the k worst in ascending order.

    A missing score ranks as minus infinity, ties go by name. A bottom row's rank is its place from the top of
    all.
    """
    scores = scores.withColumn("score", F.coalesce("score", F.lit(float("-inf"))))
    n = scores.agg(F.count("*").alias("n"))
    best = scores.orderBy(F.desc("score"), name).limit(k).withColumn("side", F.lit("top")).withColumn("at", F.row_number().over(Window.orderBy(F.desc("score"), name)))
    worst = scores.orderBy("score", F.desc(name)).limit(k).withColumn("side", F.lit("bottom")).withColumn("at", F.row_number().over(Window.orderBy("score", F.desc(name))))
    out = best.unionByName(worst).crossJoin(F.broadcast(n))
    return out.select("side", F.when(F.col("side") == "top", F.col("at")).otherwise(F.col("n") - F.col("at") + 1).alias("rank"), name, "score")


def run_key(task: Column, motif: Column, idx: Column, steps: int = 500_000) -> Column:
    """The name under which a run's results are kept."""
    return F.format_string(f"%s_RES_%s_idx%d_PPO_{steps}steps", task, motif, idx)


def first_values(df: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """The first value that isn't null of each column, by ``order``, in each group."""
    return df.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def episodes(log: DataFrame, run: str = "run", done: str = "done") -> DataFrame:
    """``episode`` of each step: the number of ends before it in its run."""
    return Ranges(log, [run], ["step"]).carried(sums={"episode": F.col(done).cast("long")}).drop("pos")


def episode_sums(log: DataFrame, run: str = "run", done: str = "done") -> DataFrame:
    """``run, episode, total, length, mean`` of finished episodes."""
    out = episodes(log, run, done).groupBy(run, "episode").agg(F.sum("value").alias("total"), F.count("*").alias("length"), F.avg("value").alias("mean"), F.bool_or(done).alias("ended"))
    return out.filter("ended").drop("ended")


def last_mean(sums: DataFrame, n: int, run: str = "run") -> DataFrame:
    """Mean total of each run's last n episodes; n = 0 takes all."""
    if n:
        sums = sums.withColumn("back", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("episode")))).filter(F.col("back") <= n)
    return sums.groupBy(run).agg(F.avg("total").alias("mean_reward"), F.count("*").alias("episodes"))


def first_files(files: DataFrame, *keys: str, path: str = "path") -> DataFrame:
    """The first file of each folder by name, whatever order a file system lists them in."""
    return files.groupBy(*keys).agg(F.min(path).alias(path))


def resolved_seed(seed: Column, array_id: Column) -> Column:
    """The seed itself; -1 stands for the id within an array of jobs, or 0 outside one."""
    return F.when(seed == -1, F.coalesce(array_id.cast("long"), F.lit(0))).otherwise(seed.cast("long"))


#: Models and learning rates that are compared, by whether observations are masked.
MODELS = {
    "True": (("PPO", 0.0003), ("RES_PPO_0.0003", 0.0003), ("RES_PPO_0.0001", 0.0001), ("RES_PPO_0.00005", 0.00005)),
    "False": (("PPO", 0.0003), ("RES_PPO_0.0003", 0.0003), ("RES_PPO_0.0001", 0.0001)),
}


def models_of(flag: Column) -> Column:
    """The models and learning rates under a flag, as structs; another flag is an error."""
    pairs = {k: F.array(*[F.struct(F.lit(m).alias("model"), F.lit(lr).alias("lr")) for m, lr in v]) for k, v in MODELS.items()}
    return told(pairs, flag, "kind of environments")


def missing(requested: DataFrame, made: DataFrame, *keys: str) -> DataFrame:
    """What is asked for and not there yet."""
    return requested.join(made, [*keys], "left_anti")
