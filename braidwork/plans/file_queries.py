"""Tables through files and back, and orders that files and designs need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import dynamics, logs
from braidwork.operators import vectors as v
from braidwork.operators.designs import STRATA
from braidwork.plans.design_queries import _D
from braidwork.plans.log_queries import _TB, top_bottom
from braidwork.plans.vector_queries import rows
from braidwork.session import shared_folder, table
from braidwork.sources import arrays, sinks
from braidwork.sources import designs as files
from braidwork.sources.events import model_log
from braidwork.sources.trade import nations


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def designs_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs of the parts written as CSV and read again, the first of two paths missing; by stratum."""
    path = _folder(spark)
    names = [c.split()[0] for c in (files.DESIGN + ", " + files.MEASURES).split(", ")]
    own = files.part_designs(spark, sf_dir)
    for name in names:
        own = files.with_default(own, name, 0.5)
    files.write_designs(own.select(*names), path)
    found = files.read_designs(spark, f"{path}-missing", path)
    inf = F.count_if(F.col("size_alpha") == float("inf"))
    return found.groupBy("stratum").agg(F.count("*").alias("n"), F.sum("seed").alias("seeds"), inf.alias("endless"), F.round(F.avg("p0"), 9).alias("p0"), F.avg("efficiency").alias("efficiency"))


def scalars_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scalars under the tag of their type, written and read for one tag; by run."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    e.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("event_type").alias("tag"), "value").write.parquet(path)
    return files.read_scalars(spark, path, "purchase").groupBy("run").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.round(F.sum("value"), 6).alias("total"))


def trajectories_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories written by task; one task's are read alone."""
    path = _folder(spark)
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    sinks.write_trajectories(e.select(F.col("event_type").alias("task"), F.col("user_id").alias("run"), F.col("event_id").alias("t"), F.array("value").alias("o")), path)
    own = spark.read.parquet(path).filter("task = 'click'")
    return own.groupBy("task", "run").agg(F.count("*").alias("steps"), F.round(F.sum(F.get("o", 0)), 6).alias("total"))


def distances_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the mean vectors of labels, written as a bundle and read again."""
    path = _folder(spark)
    mean = v.long(rows(spark, sf_dir), "label", "v").groupBy("label", "dim").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("v"))
    sinks.write_distances(v.pairwise(mean, "label").withColumn("component", F.lit("state")), path, rank=3)
    return spark.read.parquet(f"{path}/distances").select("i", "j", "component", F.round("dist", 6).alias("dist"))


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the best and worst runs, as lines of text."""
    path = _folder(spark)
    sinks.write_report(top_bottom(spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written first stays: the second table under the same name is left out."""
    path = _folder(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sinks.write_new(c, path)
    sinks.write_new(c.filter("c_custkey < 0"), path)
    return spark.read.parquet(path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def written_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run writes only the nations that the first left out; what the first wrote stays."""
    path = _folder(spark)
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    sinks.write_missing(c.filter("nation % 3 = 0").withColumn("run", F.lit(1)), path, "nation")
    new = sinks.write_missing(c.withColumn("run", F.lit(2)), path, "nation")
    kept = spark.read.parquet(path).groupBy("nation").agg(F.max("run").alias("run"), F.count("*").alias("n"))
    return kept.join(new.withColumn("new", F.lit(True)), "nation", "left").select("nation", "run", "n", F.coalesce("new", F.lit(False)).alias("new"))


def discovered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in folders of models and seeds, found again with the first file of each."""
    path = _folder(spark)
    sinks.write_logs(model_log(spark, sf_dir).select("model", "seed", F.col("step.event_id").alias("step"), "value"), f"{path}/deep/er")
    found = files.discovered(spark, path)
    first = logs.first_files(found.select("model", "seed", "path").distinct(), "model", "seed")
    return found.join(first, ["model", "seed", "path"]).groupBy("model", "seed").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.round(F.sum("value"), 6).alias("total"))


def one_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of one model and seed, by two equalities."""
    own = model_log(spark, sf_dir).filter((F.col("model") == "click") & (F.col("seed") == 2))
    return own.groupBy("model", "seed").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"))


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task, stratum, seed, t, x``: a user's events of a type, in order, as observations."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    stratum = F.element_at(F.array(*map(F.lit, STRATA)), (F.col("user_id") % len(STRATA) + 1).cast("int"))
    own = e.select(F.col("event_type").alias("task"), stratum.alias("stratum"), F.col("user_id").alias("seed"), "ts", "event_id", "value")
    own = logs.positions(own, "task", "stratum", "seed", by=("ts", "event_id"))
    return own.select("task", "stratum", "seed", F.col("pos").alias("t"), F.array("value", F.log1p("value")).alias("x"))


def array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories as array files; those of one task and stratum are read alone, through the data source."""
    path = _folder(spark)
    arrays.write_arrays(_trajectories(spark, sf_dir).withColumn("part", F.lit("Ot")), path)
    spark.dataSource.register(arrays.Trajectories)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    own = spark.read.format("trajectories").load(path).filter("task = 'click' and stratum = 'mixed'")
    return own.groupBy("task", "stratum", "seed").agg(F.count("*").alias("steps"), F.max("t").alias("last"), F.round(F.sum(F.get("x", 0)), 6).alias("total"))


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``task, stratum, seed, K``: every supplier's design under every task."""
    own = files.supplier_designs(spark, sf_dir).select("stratum", F.col("id").alias("seed"), "K")
    return own.crossJoin(table(spark, sf_dir, "events").select(F.col("event_type").alias("task")).distinct())


def guarded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs that have trajectories joined to them by task, stratum and seed, under a guard that none is missing."""
    made = _trajectories(spark, sf_dir)
    asked = _requested(spark, sf_dir).join(made.select("task", "stratum", "seed").distinct(), ["task", "stratum", "seed"], "left_semi")
    out = dynamics.guarded(asked, made, "task", "stratum", "seed", least=2)
    return out.groupBy("task", "stratum").agg(F.countDistinct("seed").alias("designs"), F.count("*").alias("steps"), F.sum("K").alias("communities"))


def whole_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for a fourth of the designs as requests, but for tasks that lack any of them."""
    made, asked = _trajectories(spark, sf_dir), _requested(spark, sf_dir).filter("seed % 4 = 1")
    out = dynamics.whole_tasks(asked, made, "task", "stratum", "seed")
    return out.groupBy("task").agg(F.countDistinct("seed").alias("designs"), F.count("*").alias("steps"))


def row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's place in a file that was written in the order of names, from the last."""
    path = _folder(spark)
    table(spark, sf_dir, "supplier").orderBy(F.desc("s_name")).coalesce(1).write.parquet(path)
    return files.with_file_index(spark.read.parquet(path)).select("idx", "s_suppkey")


def stratum_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designs stacked by stratum, then id."""
    return logs.positions(files.part_designs(spark, sf_dir).select("stratum", "id"), by=("stratum", "id")).select("pos", "stratum", "id")


def community_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The communities that nations belong to, in order."""
    return logs.positions(nations(spark, sf_dir).select("community").distinct(), by=("community",)).select("pos", "community")


QUERIES = {f.__name__: f for f in (designs_file, scalars_file, trajectories_file, distances_file, report_file, written_once, written_by_key, discovered_logs, one_run, array_files, guarded_join, whole_tasks, row_index, stratum_order, community_ids)}

_STRATA = f"[{', '.join(map(repr, STRATA))}]"
_TRAJ = f"tj AS (SELECT event_type AS task, {_STRATA}[user_id % 5 + 1] AS stratum, user_id AS seed, value FROM events WHERE user_id IS NOT NULL)"
_ASKED = f"rq AS (SELECT DISTINCT event_type AS task, {_STRATA}[s_suppkey % 5 + 1] AS stratum, s_suppkey AS seed, [2, 3, 4, 6, 8, 12, 16][s_suppkey % 7 + 1] AS K FROM supplier, events)"

ORACLES = {
    "designs_file": f"""WITH {_D} SELECT stratum, count(*) AS n, CAST(sum(seed) AS BIGINT) AS seeds, count(*) FILTER (stratum = 'null' OR id % 2 = 0) AS endless, round(avg(p0), 9) AS p0, 0.5::DOUBLE AS efficiency FROM ds GROUP BY stratum""",
    "scalars_file": "SELECT user_id AS run, count(*) AS n, max(event_id) AS last, round(sum(value), 6) AS total FROM events WHERE user_id IS NOT NULL AND event_type = 'purchase' GROUP BY user_id",
    "trajectories_file": "SELECT event_type AS task, user_id AS run, count(*) AS steps, round(sum(value), 6) AS total FROM events WHERE user_id IS NOT NULL AND event_type = 'click' GROUP BY ALL",
    "distances_file": """WITH l AS (SELECT label, unnest(range(0, len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM l GROUP BY ALL)
SELECT a.label AS i, b.label AS j, 'state' AS component, round(sqrt(sum(pow(a.x - b.x, 2))), 6) AS dist FROM m a JOIN m b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL""",
    "report_file": f"WITH {_TB} SELECT format('{{}} {{}}. {{}}: {{:.4f}}', side, rank, seed_name, score) AS line FROM tb",
    "written_once": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "row_index": "SELECT row_number() OVER (ORDER BY s_name DESC) - 1 AS idx, s_suppkey FROM supplier",
    "written_by_key": "SELECT c_nationkey AS nation, CASE WHEN c_nationkey % 3 = 0 THEN 1 ELSE 2 END AS run, count(*) AS n, c_nationkey % 3 <> 0 AS new FROM customer GROUP BY c_nationkey",
    "discovered_logs": "SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS seed, count(*) AS n, max(event_id) AS last, round(sum(value), 6) AS total FROM events WHERE user_id IS NOT NULL GROUP BY ALL",
    "one_run": "SELECT event_type AS model, CAST(user_id % 5 AS INTEGER) AS seed, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least FROM events WHERE event_type = 'click' AND user_id % 5 = 2 GROUP BY ALL",
    "array_files": f"WITH {_TRAJ} SELECT task, stratum, seed, count(*) AS steps, count(*) - 1 AS last, round(sum(value), 6) AS total FROM tj WHERE task = 'click' AND stratum = 'mixed' GROUP BY ALL",
    "guarded_join": f"WITH {_TRAJ}, {_ASKED} SELECT task, stratum, count(DISTINCT seed) AS designs, count(*) AS steps, CAST(sum(K) AS BIGINT) AS communities FROM rq JOIN tj USING (task, stratum, seed) GROUP BY ALL",
    "whole_tasks": f"""WITH {_TRAJ}, {_ASKED}, lack AS (SELECT DISTINCT task FROM rq WHERE seed % 4 = 1 AND NOT EXISTS (SELECT 1 FROM tj WHERE tj.task = rq.task AND tj.stratum = rq.stratum AND tj.seed = rq.seed))
SELECT task, count(DISTINCT seed) AS designs, count(*) AS steps FROM rq JOIN tj USING (task, stratum, seed) WHERE seed % 4 = 1 AND task NOT IN (SELECT task FROM lack) GROUP BY task""",
    "stratum_order": f"WITH {_D} SELECT CAST(row_number() OVER (ORDER BY stratum, id) - 1 AS BIGINT) AS pos, stratum, id FROM ds",
    "community_ids": "SELECT row_number() OVER (ORDER BY n_regionkey) - 1 AS pos, n_regionkey AS community FROM (SELECT DISTINCT n_regionkey FROM nation)",
}
