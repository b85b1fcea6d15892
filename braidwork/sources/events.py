"""Logs that the events table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.logs import positions
from braidwork.session import table


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, step, value, model, seed, done``: a user's events in order; a purchase ends an episode."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").select("user_id", "ts", "event_id", "value", "event_type")
    e = positions(e, "user_id", by=("ts", "event_id"))
    return e.select(
        F.col("user_id").alias("run"), (F.col("pos") + 1).alias("step"), F.col("value"), F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("seed"), (F.col("event_type") == "purchase").alias("done")
    )


def model_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, seed, step, value``: events of a type and a fifth of the users, in order of time."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return e.select(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("seed"), F.struct("ts", "event_id").alias("step"), "value")
