"""Design tables: from files with an explicit schema, or derived from the parts table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.designs import COMMUNITIES, STRATA
from braidwork.session import table

DESIGN = "stratum string, K int, p0 double, centre_u double, sigma_ratio double, rho double, size_alpha double, f double, core_fraction double, seed bigint, contrast_u double"
MEASURES = "modularity double, participation double, clustering double, efficiency double, cv_strength double, cv_betweenness double, lambda_ratio double, frac_negative double"


def read_designs(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of ``paths`` that exists, with ``inf`` read as infinity and the text null as a stratum."""
    for path in paths:
        try:
            return spark.read.schema(f"{DESIGN}, {MEASURES}").option("header", True).option("positiveInf", "inf").option("negativeInf", "-inf").option("nullValue", "").csv(path).withColumn("stratum", F.coalesce("stratum", F.lit("null")))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def write_designs(df: DataFrame, path: str) -> None:
    """Designs as CSV with a header, in the schema that ``read_designs`` takes; infinity is written as it is read."""
    df = df.withColumn("size_alpha", F.when(F.col("size_alpha") == float("inf"), "inf").otherwise(F.col("size_alpha").cast("string")))
    df.write.mode("overwrite").option("header", True).csv(path)


def with_default(df: DataFrame, column: str, value: object) -> DataFrame:
    """``df`` with the column, of one value where it is missing."""
    return df if column in df.columns else df.withColumn(column, F.lit(value))


def read_scalars(spark: SparkSession, path: str, tag: str = "rollout/ep_rew_mean") -> DataFrame:
    """``run, step, value`` of one tag from Parquet logs ``run, step, tag, value``."""
    return spark.read.parquet(path).filter(F.col("tag") == tag).select("run", "step", "value")


def discovered(spark: SparkSession, path: str, pattern: str = r"/(?:[^/=]+=)?([^/=]+)_(\d+)/[^/]*$") -> DataFrame:
    """Logs under ``path``, however deep, with their file, and model and seed from its folder's name ``{model}_{seed}``.

    Folders of another name are left out.
    """
    file = F.col("_metadata.file_path")
    df = spark.read.option("recursiveFileLookup", True).parquet(path)
    seen = df.select("*", file.alias("path"), F.regexp_extract(file, pattern, 1).alias("model"), F.regexp_extract(file, pattern, 2).alias("seed"))
    return seen.filter("seed <> ''").withColumn("seed", F.col("seed").cast("int"))


def with_file_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """``df``, read from one Parquet file, with each row's place in the file from 0."""
    return df.select("*", F.col("_metadata.row_index").alias(name))


def part_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design for each part."""
    return _designs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")))


def supplier_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design for each supplier; a supplier's size is its nation's number."""
    return _designs(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (1 + F.col("s_nationkey")).alias("size"), F.abs("s_acctbal").alias("price")))


def _designs(p: DataFrame) -> DataFrame:
    """From ``id, size, price``: stratum, communities and contrasts from the key, densities from size and price."""
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    stratum = pick(STRATA, F.col("id"))
    null, core = stratum == "null", stratum == "core_periphery"
    contrast = 1 + F.col("id") % 7
    return p.select(
        "id",
        stratum.alias("stratum"),
        pick(COMMUNITIES, F.col("id")).alias("K"),
        (0.03 + 0.27 * F.col("size") / 50).alias("p0"),
        (2 + F.col("price") % 8).alias("centre_u"),
        F.when(null, 0.0).when(stratum == "disassortative", -contrast).otherwise(contrast).cast("double").alias("contrast_u"),
        F.when(null, 1.0).otherwise(F.col("size") / 10).alias("sigma_ratio"),
        F.when(null, 1.0).otherwise((1 + F.col("id") % 16) / 4).alias("rho"),
        F.when(null | (F.col("id") % 2 == 0), float("inf")).otherwise(30.0).alias("size_alpha"),
        F.when(core, 0.2 + F.col("size") / 100).otherwise(0.5).alias("f"),
        F.when(core, 0.05 + F.col("size") / 200).otherwise(0.0).alias("core_fraction"),
        (F.col("size") / 100).alias("frac_negative"),
        (F.col("id") * 7919 % 2147483647).alias("seed"),
    )
