"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral is the source's share of the
token budget; inverting the cumulative demand gives every copy of a document its training position, and the
mix is range-sorted by that position.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its own, last in
order; a null id is ordered like an empty one; repeated rows count each on their own, and ``mixed`` repeats all rows
of one id and text alike; an empty table gives an empty mix; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.llm.common import cut, n_words, read, running, unused

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Tilts of the sources' schedules, repeating: 1 rises from 0, -1 falls to 0, 0 is level.
TILTS = (0.5, -0.5, 0.0)
#: All takes together, as a multiple of all sizes, and the most of one source.
BUDGET, MOST = 1.5, 2.0
#: Each source's token line is cut into ranges of a hash, so that no source is one task's work: hexadecimal digits at least, and rows of a range.
#: Rows that agree in all that counts are one row of a range.
DIGITS, SLICE_ROWS = 3, 100_000


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, tilts: tuple = TILTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source, source_size`` to ``source, source_size, target, tilt``.

    Targets share ``budget`` times all sizes by weight; none exceeds ``most`` times its source's size, and
    the excess is shared again by weight among the rest. The fixed point is closed: with sources ordered by
    cap / weight, the capped ones are a prefix. There is one row per source here, never one per document.
    """
    # ranks by code point and then sums in the order of cap / weight, by ranges of sources
    ranked = running(sizes.withColumn("one", F.lit(1)), [F.col("source").isNull(), F.col("source")], {"one": "rank"})
    levels = (
        ranked.select("source", "source_size", (F.col("rank") + 1).alias("rank"))
        .withColumn("weight", _cycle(weights, F.col("rank")))
        .withColumn("tilt", _cycle(tilts, F.col("rank")))
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    levels = running(levels, [F.col("level"), F.col("rank")], {"cap": "caps", "weight": "weights"})
    totals = levels.agg(F.sum("source_size").alias("everything"), F.sum("weight").alias("all_weights"))  # one row
    share = (budget * F.col("everything") - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    shares = levels.crossJoin(F.broadcast(totals)).withColumn("share", share)
    fair = shares.agg(F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "share"))).alias("fair"))  # one row
    target = F.coalesce(F.least(F.col("cap"), F.col("fair.share") * F.col("weight")), F.col("cap"))
    return levels.crossJoin(F.broadcast(fair)).select("source", "source_size", target.alias("target"), "tilt")


def when(part: Column, tilt: Column) -> Column:
    """The time by which ``part`` of a source's demand is met: the inverse of t + tilt * (t * t - t).

    That is the integral of the schedule 1 + tilt * (2 t - 1); the root is written so that it holds for a
    tilt of 0 as well.
    """
    b = 1 - tilt
    return 2 * part / (b + F.sqrt(b * b + 4 * tilt * part))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, **shares) -> DataFrame:
    """The rows of ``mix`` with a hash of the text, ``tag``."""
    digits = DIGITS
    while 16**digits * SLICE_ROWS < docs.count():
        digits += 1
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col).cast("string")).alias("tag"), F.md5(F.col(text_col).cast("string")).alias("text_md5"))
    # by id and text, so that rows without an id, or with the same, are dealt like others
    docs = docs.withColumn("digest", F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text_md5", F.lit("")))))
    docs = docs.withColumn("slice", F.conv(F.substring("digest", 1, digits), 16, 10).cast("long"))
    docs = docs.drop("text_md5")
    docs = cut(docs.groupBy(*docs.columns).agg(F.count("*").alias("copies")))  # narrow rows, so that words are counted once
    docs = docs.withColumn("all", F.col("size") * F.col("copies"))
    slices = docs.groupBy("source", "slice").agg(F.sum("all").alias("slice_size"))
    in_order = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(in_order), F.lit(0)))
    wanted = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), **shares)
    starts = starts.alias("a").join(wanted.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "slice", "start", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "slice").orderBy("digest", "doc_id", "tag").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("before", F.coalesce(F.sum("all").over(within), F.lit(0)))
    placed = docs.alias("d").join(starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.slice") == F.col("s.slice")))
    size, total = F.col("size"), F.col("source_size")
    whole = F.when(total > 0, F.floor(F.col("target") / total)).otherwise(0)
    extra = F.floor(F.col("target")) - whole * total
    return (
        placed.select("doc_id", "tag", "d.source", "size", "source_size", "target", "tilt", (F.col("start") + F.col("before")).alias("before"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth"))
        .withColumn("part_from", F.col("before") + F.col("nth") * F.col("size"))
        .drop("before", "nth")
        .withColumn("taken", (whole * size + F.greatest(F.lit(0), F.least(size, extra - F.col("part_from")))).cast("long"))
        .withColumn("position", F.when(F.col("taken") > 0, when(F.col("part_from") / F.col("target"), F.col("tilt"))))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """A row per document: its id and source, size, source_size, target, taken, part_from, position.

    A source's documents lie on a line in the order of a md5 of id and text, each as long as its words. With
    r = target / source size, every document is taken floor(r) times, and those on the first r - floor(r)
    of the line once more; the one across that end gives the words that are still missing. So the taken
    words are the target, rounded down. ``position`` is the training time of the first copy, null if the
    document isn't taken.
    """
    return _placed(docs, id_col, text_col, source_col, **shares).select("doc_id", "source", "size", "source_size", "target", "tilt", "part_from", "taken", "position")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The documents themselves as the curriculum orders them, each as often as it is taken.

    A document is repeated as a whole: a last copy of which less than half is taken is left out, one of which
    at least half is taken stays whole. The result is range-sorted by training position.
    """
    own, tag, copy, at = unused(docs.columns, "own", "tag", "copy", "at")
    plan = _placed(docs, id_col, text_col, source_col, **shares).filter("taken > 0")
    plan = plan.groupBy("doc_id", "tag").agg(F.min(F.struct("part_from", "size", "taken", "source_size", "target", "tilt")).alias("p")).select(F.col("doc_id").alias(own), F.col("tag").alias(tag), "p.*")
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    plan = plan.withColumn(copy, F.explode(F.sequence(F.lit(0), F.when(copies > 0, copies - 1))))
    when_at = F.least(F.lit(1.0), (F.col("part_from") + F.col(copy) * F.col("source_size")) / F.col("target"))
    plan = plan.select(own, tag, copy, when(when_at, F.col("tilt")).alias(at))
    columns = [docs[c] for c in docs.columns]
    met = docs.join(plan, docs[id_col].eqNullSafe(plan[own]) & (F.xxhash64(docs[text_col].cast("string")) == plan[tag]))
    return met.repartitionByRange(at, copy, own, tag).sortWithinPartitions(at, copy, own, tag).select(*columns)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents in the order of training; nulls, repeated rows and empty texts as in the module's cases."""
    out = mix(read(spark, sf_dir, "documents")).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS digest,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][(rank - 1) % 3 + 1]::DOUBLE AS weight, [0.5, -0.5, 0.0][(rank - 1) % 3 + 1]::DOUBLE AS tilt,
             2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, cap / weight AS level, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS everything FROM w),
h AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM l),
f AS (SELECT share AS fair FROM h WHERE share <= level ORDER BY level LIMIT 1),
t AS (SELECT source, source_size, tilt, coalesce(least(cap, (SELECT fair FROM f) * weight), cap) AS target FROM h),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.tilt,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part_from
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
q AS (SELECT *, CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - part_from)) AS BIGINT) AS taken FROM k)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(2 * (part_from / target) / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (part_from / target))), 9) END AS position
FROM q
"""
