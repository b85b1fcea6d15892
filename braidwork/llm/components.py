"""Connected components by minimum labels, in rounds that each end in a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.common import common, counted, joined, laid_out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every id in ``links``; component is the smallest id reachable.

    In a round each id takes the smallest label next to it, hands it on to the id that its own label names, and
    follows that label one step further, so the rounds grow with the logarithm of a chain's length. Ids with many
    links and labels with many ids are looked up by a broadcast of the few such keys, so neither a hub nor a large
    component is one task's work. The driver sees only whether a round changed anything.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    ends, seen = counted(ends.union(ends.select("v", "u")).distinct())
    ends, hubs = laid_out(ends, seen["n"]), common(ends, ["v"], seen["n"])
    labels, seen = counted(ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("label")))
    n = seen["n"]
    labels = laid_out(labels, n)
    while True:
        near = joined(ends, labels.select(F.col("id").alias("v"), F.col("label").alias("near")), ["v"], "inner", hubs).groupBy(F.col("u").alias("id")).agg(F.min("near").alias("near"))
        met = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        own = met.select("id", F.col("label").alias("old"), "low").union(met.filter("low < label").select("label", F.lit(None).cast(labels.schema["label"].dataType), "low"))
        own = laid_out(counted(own.groupBy("id").agg(F.max("old").alias("old"), F.min("low").alias("label")))[0], n)
        jump = own.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = joined(own, jump, ["label"], "left", common(own, ["label"], n)).select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        labels, seen = counted(new, changed=F.count_if(F.col("label") < F.col("old")))
        labels = laid_out(labels.select("id", "label"), n)
        if not seen["changed"]:
            return labels.withColumnRenamed("label", "component")
