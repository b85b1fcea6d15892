"""What several corpus operators share."""

from __future__ import annotations

import uuid
from bisect import bisect, insort
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.session import cut, shared_folder

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc(id_col: str = "doc_id") -> Column:
    """crc32 of the id written as text; the splits into learned and held-out rows use it."""
    return F.crc32(F.col(id_col).cast("string"))


def n_words(text: Column) -> Column:
    """Number of words, 0 for a null text."""
    words = F.split(text, SPACE)
    return F.coalesce(F.size(F.filter(words, lambda w: w != "")), F.lit(0)).cast("long")


def counted(df: DataFrame, **also: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, with the number of rows, ``n``, and other aggregates seen while it was written.

    A part that is written twice, as after a lost executor, may be seen twice: the numbers serve for layouts and to
    tell nothing from something.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in also.items()]))
    return out, seen.get


def laid_out(df: DataFrame, n: int, rows: int = 100_000) -> DataFrame:
    """A written ``df`` in partitions of about so many rows, so that small tables don't shuffle from many tasks."""
    return df.coalesce(max(1, -(-n // rows)))


def settled(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` written and laid out."""
    out, seen = counted(df)
    return laid_out(out, seen["n"], rows)


def few(df: DataFrame, rows: int = 20_000) -> Callable[[DataFrame], DataFrame]:
    """What marks a table as long as ``df`` for a broadcast, if it was counted to be short; beyond, joins shuffle."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda x: x


#: A key is common if it has more rows than this and than a hundred-thousandth of all rows: there are 100,000 such keys at most.
COMMON, MOST_COMMON = 256, 100_000


def least_common(n: int) -> int:
    """The most rows of a key among n that isn't common."""
    return max(COMMON, n // MOST_COMMON)


def common(rows: DataFrame, keys: list[str], n: int | None = None) -> DataFrame | None:
    """The common keys of ``rows``, None if there is none; ``n`` is the number of rows, if it is known."""
    least = least_common(rows.count() if n is None else n)
    found, seen = counted(rows.groupBy(*keys).count().filter(F.col("count") > least).drop("count"))
    return laid_out(found, seen["n"]) if seen["n"] else None


def joined(rows: DataFrame, table: DataFrame, keys: list[str], how: str, shared: DataFrame | None) -> DataFrame:
    """``rows`` joined to a table of one row a key, where single keys (``shared``) hold many of the rows.

    These meet their few rows of the table by a broadcast, wherever they lie; the others are shuffled. Both frames
    are read twice, so they should be written or cut.
    """
    if shared is None:
        return rows.join(table, keys, how)
    met = rows.join(F.broadcast(shared.join(table, keys, how)), keys)
    return met.unionByName(rows.join(F.broadcast(shared), keys, "left_anti").join(table, keys, how))


def running(df: DataFrame, by: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each column in ``sums``, the sum of the rows before in the order of ``by``, under the name given.

    Rows are sorted by ranges; sums run within a range, and one row of totals for each range shifts them.
    """
    part, at = unused([*df.columns, *sums.values()], "part", "at")
    ranged = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    totals = ranged.groupBy(part).agg(*[F.sum(c).alias(name) for c, name in sums.items()]).orderBy(part).collect()  # a row for each range
    before = {name: list(accumulate((r[name] or 0 for r in totals), initial=0)) for name in sums.values()}
    parts = F.array(*[F.lit(r[part]) for r in totals]) if totals else F.array(F.lit(0))
    within = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    for c, name in sums.items():
        shift = F.element_at(F.array(*[F.lit(x) for x in before[name]]), F.array_position(parts, F.col(part)).cast("int"))
        ranged = ranged.withColumn(name, F.coalesce(F.sum(c).over(within), F.lit(0)) + shift)
    return ranged.drop(part, at)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``stored``, and the folder, which ``dropped`` removes when nothing reads it any more."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Remove a folder of ``written``, wherever it lies."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


#: What Arrow hands to a Python worker at once. Plans run when their rows are asked for, so all operators share one bound.
BATCH_ROWS, BATCH_BYTES = 4096, "2m"


def small_batches(spark: SparkSession) -> None:
    """Bound what Arrow hands to a Python worker at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until none of them is among ``columns`` (compared without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Put [a, b) among sorted, disjoint spans if it overlaps none of them."""
    i = bisect(taken, (a, b))
    if i and taken[i - 1][1] > a or i < len(taken) and taken[i][0] < b:
        return False
    insort(taken, (a, b))
    return True
