"""Scans over ordered runs of any length, by ranges and carries.

Rows are sorted by ranges of run and order, and a run may lie in many ranges. Of each run and range one row of
summary is kept: how many rows there are, their sums, the last row's values. A prefix over the summaries of a run is
what its range starts from; the rest is local. So a run that holds a third of all rows is as many tasks' work as
it fills ranges, and nothing but summaries meets by run. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.session import cut


class Ranges:
    """Rows sorted by ranges of ``keys`` and ``by``, which together should tell rows apart."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], by: Sequence[str]):
        self.keys, self.by = list(keys), list(by)
        # the number of a range follows its place in the order
        self.rows = cut(rows.repartitionByRange(*self.keys, *self.by).sortWithinPartitions(*self.keys, *self.by).withColumn("_range", F.spark_partition_id()))
        self.local = Window.partitionBy(*self.keys, "_range").orderBy(*self.by)
        self._over = (Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))).orderBy("_range")

    def carried(self, sums: dict[str, Column] | None = None, last: dict[str, Column] | None = None, place: str = "pos") -> DataFrame:
        """The rows with their ``place`` in the run from 0, and under the names given sums over all rows before, and
        values of the row before; ``<name>_known`` tells a null value from no row."""
        sums, last = sums or {}, last or {}
        rows = self.rows.withColumns({f"_s_{n}": c for n, c in sums.items()} | {f"_l_{n}": c for n, c in last.items()})
        ends = {f"_e_{n}": F.max_by(F.struct(F.col(f"_l_{n}").alias("v")), F.struct(*self.by)) for n in last}
        summary = rows.groupBy(*self.keys, "_range").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums], *[c.alias(n) for n, c in ends.items()])
        above = self._over.rowsBetween(Window.unboundedPreceding, -1)
        before = {"_b": F.coalesce(F.sum("_n").over(above), F.lit(0))}
        before |= {f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(above), F.lit(0)) for n in sums}
        before |= {f"_p_{n}": F.lag(f"_e_{n}").over(self._over) for n in last}
        carry = summary.withColumns(before).select(*self.keys, "_range", *before)
        within = self.local.rowsBetween(Window.unboundedPreceding, -1)
        own = {place: (F.row_number().over(self.local) - 1).cast("long")}
        own |= {n: F.coalesce(F.sum(f"_s_{n}").over(within), F.lit(0)) for n in sums}
        own |= {f"_p0_{n}": F.lag(F.struct(F.col(f"_l_{n}").alias("v"))).over(self.local) for n in last}
        out = rows.withColumns(own).join(carry, [*self.keys, "_range"])
        done = {place: F.col(place) + F.col("_b")} | {n: F.col(n) + F.col(f"_b_{n}") for n in sums}
        for n in last:
            prev = F.coalesce(f"_p0_{n}", f"_p_{n}")
            done |= {n: prev["v"], f"{n}_known": prev.isNotNull()}
        out = out.withColumns(done)
        return out.drop(*[c for c in out.columns if c.startswith(("_s_", "_l_", "_b", "_p_", "_p0_"))], "_range")

    def ahead(self, n: int, columns: Sequence[str], place: str = "_pos") -> DataFrame:
        """The rows with ``next``, an array of structs of the columns of each row and of the n - 1 after it, shorter at the end.

        The first n - 1 rows of a range are lent to those of the n - 1 ranges before it that end close enough.
        """
        numbered = self.rows.withColumn("_at", F.row_number().over(self.local))
        summary = self.rows.groupBy(*self.keys, "_range").agg(F.count("*").alias("_n"))
        summary = summary.withColumn("_nth", F.row_number().over(self._over)).withColumn("_first", F.coalesce(F.sum("_n").over(self._over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        summary = cut(summary)
        placed = numbered.join(summary, [*self.keys, "_range"]).withColumn(place, F.col("_first") + F.col("_at"))
        own = placed.select(*self.rows.columns, place, F.lit(True).alias("_own"))
        if n > 1:
            lent = placed.filter(F.col("_at") < n).withColumn("_nth", F.explode(F.sequence(F.col("_nth") - (n - 1), F.col("_nth") - 1))).drop("_range", "_first", "_n")
            ends = summary.select(*self.keys, "_nth", "_range", (F.col("_first") + F.col("_n")).alias("_end"))
            lent = lent.join(ends, [*self.keys, "_nth"]).filter(F.col(place) < F.col("_end") + n)
            own = own.unionByName(lent.select(*self.rows.columns, place, F.lit(False).alias("_own")))
        window = Window.partitionBy(*self.keys, "_range").orderBy(place).rowsBetween(0, n - 1)
        return own.withColumn("next", F.collect_list(F.struct(*columns)).over(window)).filter("_own").drop("_own", "_range", place)
