"""Repeated line runs, found in a suffix array over line ids and deleted but for their first copy.

Every distinct line has an id, and a document is a sequence of ids. Distributed prefix doubling ranks all
suffixes by their first 1, 2, 4, ... lines: a step pairs the ranks of two neighbouring halves, sorts the
distinct pairs by range and takes their places as the new ranks, so a line that a third of all documents
share is still one row to sort. Suffixes that agree in their first m lines are an interval of the suffix
array whose longest common prefix is m or more; for m between powers of two, the ranks at both ends of the
m lines tell the interval. In each interval the first copy stays, and the m lines of all others go, but for those
that a copy shares with the first where the two overlap, as in a text that repeats one line over and over.

A run counts if it has ``min_words`` words or more. Of a maximal repeated run only the shortest such windows
are looked at, one from each of its lines and one to each: they lie inside the run, they repeat with it,
and together they cover it. So the doubling ends with the longest window, not with the longest document,
and lines that lie in no long enough stretch of repeated lines leave at once.

Defined cases: lines are cut at newlines and compared as they are; lines without a word are never part of a
run and stay where they are; a null text stays null; rows that repeat id and text count once and are all
treated alike; columns named like the results are replaced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.llm.common import common, counted, cut, joined, laid_out, least_common, n_words, read, settled, small_batches, unused

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """``id, tag, i, p, h, c, w`` of every line with a word: i counts these, p all lines; h, c identify the line."""
    line = F.transform(_lines(F.col("text")), lambda x, p: F.struct(p.alias("p"), F.xxhash64(x).alias("h"), F.crc32(x).alias("c"), n_words(x).cast("int").alias("w")))
    return docs.filter("text is not null").select("id", F.xxhash64("text").alias("tag"), F.posexplode(F.filter(line, lambda x: x["w"] > 0)).alias("i", "l")).select("id", "tag", "i", "l.*")


def _with_common(counts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Counts ``n`` by key, written, and the keys among them that are common."""
    counts, seen = counted(counts, rows=F.coalesce(F.sum("n"), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0)))
    counts, least = laid_out(counts, seen["n"]), least_common(seen["rows"])
    return counts, settled(counts.filter(F.col("n") > least).select(*keys)) if seen["most"] > least else None


def stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines that repeat, in stretches of enough words: ``id, tag, s, i, p, w, before`` and the line's rank."""
    repeated, often = _with_common(lines.groupBy("h", "c").agg(F.count("*").alias("n")).filter("n > 1"), ["h", "c"])
    ranks = settled(_in_order(repeated.select("h", "c"), ["h", "c"]))
    own = joined(lines, ranks, ["h", "c"], "inner", often).select("id", "tag", "i", "p", "w", "rank").dropDuplicates(["id", "tag", "i"])
    doc = Window.partitionBy("id", "tag").orderBy("i")
    own = own.withColumn("s", F.col("i") - F.row_number().over(doc))
    stretch = Window.partitionBy("id", "tag", "s")
    so_far = stretch.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("words", F.sum("w").over(stretch)).filter(F.col("words") >= min_words)
    return settled(own.withColumn("before", F.sum("w").over(so_far) - F.col("w")).drop("words"))


def _in_order(keys: DataFrame, by: list[str]) -> DataFrame:
    """``keys``, all distinct, with ranks in their order; partitions of a range sort follow one another."""
    return keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id())


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """``id, tag, i, m``: the shortest windows of enough words from each line and to each line."""
    stretch = Window.partitionBy("id", "tag", "s")
    ahead = stretch.orderBy("before").rangeBetween(0, min_words - 1)
    back = stretch.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    lines = lines.withColumn("upto", F.col("before") + F.col("w"))
    last, first = F.max(F.struct("i", "upto")).over(ahead), F.min(F.struct("i", "before")).over(back)
    ends = lines.withColumn("last", last).withColumn("first", first)
    forward = ends.filter(F.col("last.upto") - F.col("before") >= min_words).select("id", "tag", "i", (F.col("last.i") - F.col("i") + 1).alias("m"))
    backward = ends.filter(F.col("upto") - F.col("first.before") >= min_words).select("id", "tag", F.col("first.i").alias("i"), (F.col("i") - F.col("first.i") + 1).alias("m"))
    return forward.union(backward).distinct()


def copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id, tag, p`` of each line that lies in a later copy of a run; docs: id, text."""
    lines = cut(line_table(docs))
    own = stretches(lines, min_words)
    wins, seen = counted(windows(own, min_words), longest=F.coalesce(F.max("m"), F.lit(0)))
    wins, longest = laid_out(wins, seen["n"]), seen["longest"]
    ranks = own.select("id", "tag", "s", "i", "rank")
    levels = [ranks]
    while 2 << (len(levels) - 1) <= longest:
        ahead = F.lead("rank", 1 << (len(levels) - 1)).over(Window.partitionBy("id", "tag", "s").orderBy("i"))
        pairs, seen = counted(ranks.withColumn("next", F.coalesce(ahead, F.lit(-1))).withColumnRenamed("rank", "r"))
        pairs = laid_out(pairs, seen["n"])
        named = settled(_in_order(pairs.select("r", "next").distinct(), ["r", "next"]))
        ranks = settled(joined(pairs, named, ["r", "next"], "inner", common(pairs, ["r", "next"], seen["n"])).select("id", "tag", "s", "i", "rank"))
        levels.append(ranks)
    every = levels[0].withColumn("level", F.lit(0))
    for k, x in enumerate(levels[1:], 1):
        every = every.union(x.withColumn("level", F.lit(k)))
    every = every.select("level", "id", "tag", "i", "rank")
    wins = wins.withColumn("level", F.length(F.bin("m")) - 1).withColumn("j", F.expr("i + m - shiftleft(1, level)"))
    ends = wins.join(every.withColumnRenamed("rank", "a"), ["level", "id", "tag", "i"])
    ends = settled(ends.join(every.withColumnsRenamed({"rank": "b", "i": "j"}), ["level", "id", "tag", "j"]).select("id", "tag", "i", "m", "a", "b"))
    interval, often = _with_common(ends.groupBy("m", "a", "b").agg(F.min(F.struct("id", "tag", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1"), ["m", "a", "b"])
    later = joined(ends, interval.drop("n"), ["m", "a", "b"], "inner", often).filter(F.struct("id", "tag", "i") != F.col("first"))
    same = (F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.tag") == F.col("tag"))
    begin = F.when(same, F.greatest(F.col("i"), F.col("first.i") + F.col("m"))).otherwise(F.col("i"))  # past the first copy
    gone = later.select("id", "tag", F.explode(F.sequence(begin, F.col("i") + F.col("m") - 1)).alias("i")).distinct()
    return settled(gone.join(own.select("id", "tag", "i", "p"), ["id", "tag", "i"]).select("id", "tag", "p"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its text less later copies of line runs, and n_lines, n_deleted and emptied.

    ``emptied`` marks texts that had words and have none left.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.drop("n_lines", "n_deleted", "emptied")
    id_, tag, gone, left = unused([*docs.columns, "n_lines", "n_deleted", "emptied"], "id", "tag", "gone", "left")
    dropped = copies(own, min_words).groupBy(F.col("id").alias(id_), F.col("tag").alias(tag)).agg(F.collect_list("p").alias(gone))

    @F.pandas_udf("text string, emptied boolean")
    def cleared(texts: pd.Series, dropped: pd.Series) -> pd.DataFrame:
        rows = []
        for text, places in zip(texts, dropped, strict=True):
            if text is None:
                rows.append((None, False))
                continue
            gone = set(places)
            left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            rows.append((left, not left.encode().split()))
        return pd.DataFrame(rows, columns=["text", "emptied"])

    text = F.col(text_col)
    out = docs.join(dropped, (docs[id_col] == dropped[id_]) & (F.xxhash64(text.cast("string")) == dropped[tag]), "left")
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    out = out.withColumn("n_lines", F.coalesce(n, F.lit(0))).withColumn("n_deleted", F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)))
    # only texts that lose a line are sent to be cut; a filter on the result must not cut them a second time
    out = out.withColumn(left, cleared.asNondeterministic()(F.when(F.col("n_deleted") > 0, text), gone))
    out = out.withColumn("emptied", F.col(f"{left}.emptied")).withColumn(text_col, F.when(F.col("n_deleted") > 0, F.col(f"{left}.text")).otherwise(text))
    return out.drop(id_, tag, gone, left)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, those deleted, and a hash of what is left (a null text: of the empty one)."""
    out = deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_deleted").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(0, len(lines))) AS p, unnest(lines) AS line FROM t),
v AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w FROM u),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, sum(w) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM v WHERE w > 0),
f AS (SELECT x.doc_id, x.i, min(y.i) AS e FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.w >= 50 GROUP BY ALL),
b AS (SELECT y.doc_id, max(x.i) AS i, y.i AS e FROM a x JOIN a y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.w >= 50 GROUP BY y.doc_id, y.i),
g AS (SELECT * FROM f UNION SELECT * FROM b),
c AS (SELECT g.doc_id, g.i, g.e, string_agg(a.line, chr(10) ORDER BY a.i) AS content FROM g JOIN a ON a.doc_id = g.doc_id AND a.i BETWEEN g.i AND g.e GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS nth, first_value(doc_id) OVER w AS doc_1, first_value(e) OVER w AS e_1 FROM c WINDOW w AS (PARTITION BY content ORDER BY doc_id, i)),
d AS (SELECT DISTINCT a.doc_id, a.p FROM r JOIN a ON a.doc_id = r.doc_id AND a.i BETWEEN r.i AND r.e AND (r.doc_id <> doc_1 OR a.i > e_1) WHERE nth > 1),
k AS (SELECT u.doc_id, count(d.p) AS n_deleted, string_agg(CASE WHEN d.p IS NULL THEN u.line END, chr(10) ORDER BY u.p) AS text
      FROM u LEFT JOIN d ON d.doc_id = u.doc_id AND d.p = u.p GROUP BY u.doc_id)
SELECT documents.doc_id, coalesce(len(t.lines), 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)
"""
