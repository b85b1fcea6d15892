"""Where results go: Parquet for tables and distance bundles, text for reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.session import cut


def write_distances(dist: DataFrame, path: str, **run: object) -> None:
    """``i, j, component, dist`` in partitions by component, and one row of what the run was (rank, delays, ...)."""
    dist.write.mode("overwrite").partitionBy("component").parquet(f"{path}/distances")
    dist.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(run.items())], "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/run")


def write_trajectories(states: DataFrame, path: str) -> None:
    """Trajectories by task, so that a task's rows are read alone."""
    states.write.mode("overwrite").partitionBy("task").parquet(path)


def write_report(ranked: DataFrame, path: str) -> None:
    """Ranked results as lines of text: side, rank, name and score, in order of rank.

    A score is rounded from its exact value to four places, as C and SQL do; Java rounds the digits that it shows.
    """
    told = F.udf(lambda x: "null" if x is None else f"{x:.4f}", "string")
    line = F.format_string("%s %d. %s: %s", "side", "rank", "seed_name", told("score"))
    ranked.orderBy("rank", F.desc("side")).select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_new(df: DataFrame, path: str) -> None:
    """Written unless it is there already."""
    df.write.mode("ignore").parquet(path)


def write_missing(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """The keys of ``df`` that aren't under ``path`` yet are written, each as a partition, and returned; others stay as they are.

    Only the new keys' partitions are touched, so a run that failed may be repeated.
    """
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys).distinct()
        new = df.join(there, [*keys], "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        new = df
    asked = cut(new.select(*keys).distinct())
    df.join(asked, [*keys], "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return asked


def write_logs(log: DataFrame, path: str) -> None:
    """``model, seed`` and further columns in a folder for each model and seed."""
    folder = F.concat_ws("_", "model", F.col("seed").cast("string"))
    log.withColumn("folder", folder).drop("model", "seed").repartition("folder").write.partitionBy("folder").parquet(path)
