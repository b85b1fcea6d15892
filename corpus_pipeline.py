"""From raw documents to training tokens, in five stages.

Every stage works on all that the one before kept, and all but the last return the columns of ``documents``; columns
beyond those stay, whatever their names. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import bpe, langid, lines, minhash, mixing
from braidwork.llm.common import dropped, read, unused, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or in a language that can't be told, go.

    Rows without an id or a language are told like others; repeated rows stay.
    """
    return langid.accepted(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; a document that loses all its words goes.

    Null and empty texts stay; rows that repeat id and text are treated alike; rows without an id lose nothing.
    """
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_deleted", "emptied")]
    aside = dict(zip(own, unused([*docs.columns, "n_lines", "n_deleted", "emptied"], *[f"own_{i}" for i in range(len(own))]), strict=True))
    out = lines.deduplicate(docs.withColumnsRenamed(aside)).filter(~F.col("emptied"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_lines", "n_deleted", "emptied").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8) stays.

    Texts without words stay; of rows without an id those stay that are no copy of another.
    """
    return minhash.representatives(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, each as often as its source's target asks.

    Texts without words take nothing and go; a null source is a source of its own; rows without an id take part.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to the text again; a null text counts as empty.

    Columns named ids, n_tokens or exact are replaced.
    """
    [decoded] = unused([*docs.columns, "ids", "n_tokens", "exact"], "decoded")
    out = bpe.encode(docs, decoded_col=decoded)
    out = out.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("exact", F.col(decoded) == F.coalesce("text", F.lit("")))
    return out.drop(decoded)


STAGES = [
    ("language ID", language),
    ("line dedup", repeated_lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", tokens),
]

#: The first and third stages learn and sketch in ways that SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            dropped(spark, before)  # nothing reads the last stage's rows any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
