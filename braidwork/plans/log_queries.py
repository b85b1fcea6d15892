"""Queries over the events as training logs, and over customers as their designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import logs
from braidwork.session import table
from braidwork.sources.events import model_log, user_log

WINDOW = 20


def _scores(spark: SparkSession, sf_dir: str, kind: str = "linear") -> DataFrame:
    return logs.recency_score(user_log(spark, sf_dir), WINDOW, kind)


def _score_query(kind: str):
    return lambda spark, sf_dir: _scores(spark, sf_dir, kind).select("run", F.round("score", 6).alias("score"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under their runs' names."""
    name = logs.run_key(F.lit("events"), F.concat(F.lit("seed"), F.col("run") % 5), F.col("run"))
    return _scores(spark, sf_dir).select(name.alias("seed_name"), F.round("score", 6).alias("score"))


def _designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as designs with the names that their runs would have."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return c.withColumn("seed_name", logs.run_key(F.lit("events"), F.concat(F.lit("seed"), F.col("c_custkey") % 5), F.col("c_custkey")))


def seed_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.seed_band(model_log(spark, sf_dir)).select("model", "pos", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


def seed_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.seed_pivot(model_log(spark, sf_dir), list(range(5)))


def top_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.top_bottom(_named(spark, sf_dir), 10, "seed_name")


def rank_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_bottom(spark, sf_dir).join(_designs(spark, sf_dir), "seed_name").select("side", "rank", "seed_name", "c_custkey", "c_mktsegment", "score")


def left_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _designs(spark, sf_dir).join(_named(spark, sf_dir), "seed_name", "left").select("seed_name", "c_custkey", "score")


def semi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).join(_designs(spark, sf_dir).filter("c_mktsegment = 'BUILDING'"), "seed_name", "left_semi")


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.missing(_designs(spark, sf_dir), _named(spark, sf_dir), "seed_name").select("seed_name", "c_custkey")


def run_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _designs(spark, sf_dir).select("c_custkey", "seed_name")


def episode_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.episode_sums(user_log(spark, sf_dir)).select("run", "episode", F.round("total", 6).alias("total"), "length")


def mean_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.last_mean(logs.episode_sums(user_log(spark, sf_dir)), 5).select("run", F.round("mean_reward", 6).alias("mean_reward"), "episodes")


def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = logs.episode_sums(user_log(spark, sf_dir))
    return sums.groupBy("run").agg(F.round(F.avg("mean"), 6).alias("mean_of_means"), F.round(F.avg("total"), 6).alias("mean_of_sums"))


def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("rich", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")))
    return logs.first_values(c, "c_mktsegment", "c_custkey", "c_name", "rich")


def grid_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type with every market segment and seed, and how many events its cell has."""
    e = table(spark, sf_dir, "events").filter("user_id is not null").select(F.col("event_type").alias("task"), (F.col("user_id") % 5).cast("int").alias("seed"), F.col("user_id").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("model"))
    tasks, seeds, models = e.select("task").distinct(), e.select("seed").distinct(), c.select("model").distinct()
    cells = e.join(c, "c_custkey").groupBy("task", "model", "seed").agg(F.count("*").alias("n"))
    return tasks.crossJoin(models).crossJoin(seeds).join(cells, ["task", "model", "seed"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id is not null").groupBy(F.col("user_id").alias("run")).agg(F.count_if(F.col("event_type") == "error").alias("errors"))


def models_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models to train for each user, who counts as masked if any of their events is an error."""
    flag = F.when(F.col("errors") > 0, "True").otherwise("False")
    return _runs(spark, sf_dir).select("run", F.explode(logs.models_of(flag)).alias("m")).select("run", "m.model", "m.lr")


def resolved_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of runs: users without an error ask for the id in their array of jobs, one in three of them has none."""
    seed, array_id = F.when(F.col("errors") > 0, F.col("run") % 5).otherwise(-1), F.when(F.col("run") % 3 != 0, F.col("run"))
    return _runs(spark, sf_dir).select("run", logs.resolved_seed(seed, array_id).alias("seed"))


def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each user's first event by name, as of a folder's first file."""
    e = table(spark, sf_dir, "events").filter("user_id is not null")
    return logs.first_files(e.select(F.col("user_id").alias("run"), F.format_string("%s-%012d", "event_type", "event_id").alias("path")), "run")


QUERIES = {f"score_{kind}": _score_query(kind) for kind in ("linear", "exponential", "mean")} | {
    f.__name__: f
    for f in (seed_band, seed_pivot, top_bottom, rank_metadata, left_scores, semi_scores, anti_missing, run_key, episode_sums, mean_reward, mean_of_means, first_per_group, grid_cross, models_by_flag, resolved_seeds, first_event)
}

LOG = """lg AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value, event_type AS model, user_id % 5 AS seed,
  event_type = 'purchase' AS done FROM events WHERE user_id IS NOT NULL)"""
_W = {"linear": "least(greatest((step - (last - 20)) / 20.0::DOUBLE, 1e-6), 1.0)", "exponential": "exp((step - last) / (20 / 3.0::DOUBLE))", "mean": "1.0"}
_SCORE = lambda kind: f"{LOG}, tl AS (SELECT * FROM (SELECT *, max(step) OVER (PARTITION BY run) AS last FROM lg) WHERE step >= last - 20), sc AS (SELECT run, sum(value * {_W[kind]}) / sum({_W[kind]}) AS score FROM tl GROUP BY run)"
_NAMED = _SCORE("linear") + ", nm AS (SELECT format('events_RES_seed{}_idx{}_PPO_500000steps', run % 5, run) AS seed_name, round(score, 6) AS score FROM sc), ds AS (SELECT c_custkey, c_mktsegment, format('events_RES_seed{}_idx{}_PPO_500000steps', c_custkey % 5, c_custkey) AS seed_name FROM customer)"
_TB = f"""{_NAMED}, tb AS (SELECT * FROM (SELECT 'top' AS side, row_number() OVER (ORDER BY score DESC, seed_name) AS rank, seed_name, score FROM nm) WHERE rank <= 10
UNION ALL SELECT side, n - place + 1, seed_name, score FROM (SELECT 'bottom' AS side, row_number() OVER (ORDER BY score, seed_name DESC) AS place, count(*) OVER () AS n, seed_name, score FROM nm) WHERE place <= 10)"""
_EP = f"{LOG}, ep AS (SELECT *, coalesce(sum(CAST(done AS BIGINT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM lg), es AS (SELECT run, CAST(episode AS BIGINT) AS episode, sum(value) AS total, count(*) AS length, avg(value) AS mean FROM ep GROUP BY run, episode HAVING bool_or(done))"
_BAND = "m AS (SELECT event_type AS model, user_id % 5 AS seed, row_number() OVER (PARTITION BY event_type, user_id % 5 ORDER BY ts, event_id) - 1 AS pos, value FROM events WHERE user_id IS NOT NULL), sh AS (SELECT model, min(n) AS n FROM (SELECT model, seed, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY model), k AS (SELECT m.* FROM m JOIN sh USING (model) WHERE pos < n)"

ORACLES = {f"score_{kind}": f"WITH {_SCORE(kind)} SELECT run, round(score, 6) AS score FROM sc" for kind in _W} | {
    "seed_band": f"WITH {_BAND} SELECT model, CAST(pos AS BIGINT) AS pos, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd FROM k GROUP BY 1, 2",
    "seed_pivot": f"WITH {_BAND} SELECT model, CAST(pos AS BIGINT) AS pos, {', '.join(f'max(CASE WHEN seed = {s} THEN value END) AS seed_{s}' for s in range(5))} FROM k GROUP BY 1, 2",
    "top_bottom": f"WITH {_TB} SELECT side, rank, seed_name, score FROM tb",
    "rank_metadata": f"WITH {_TB} SELECT side, rank, seed_name, c_custkey, c_mktsegment, score FROM tb JOIN ds USING (seed_name)",
    "left_scores": f"WITH {_NAMED} SELECT seed_name, c_custkey, score FROM ds LEFT JOIN nm USING (seed_name)",
    "semi_scores": f"WITH {_NAMED} SELECT seed_name, score FROM nm WHERE seed_name IN (SELECT seed_name FROM ds WHERE c_mktsegment = 'BUILDING')",
    "anti_missing": f"WITH {_NAMED} SELECT seed_name, c_custkey FROM ds WHERE seed_name NOT IN (SELECT seed_name FROM nm)",
    "run_key": "SELECT c_custkey, 'events_RES_seed' || (c_custkey % 5) || '_idx' || c_custkey || '_PPO_500000steps' AS seed_name FROM customer",
    "episode_sums": f"WITH {_EP} SELECT run, episode, round(total, 6) AS total, length FROM es",
    "mean_reward": f"WITH {_EP} SELECT run, round(avg(total), 6) AS mean_reward, count(*) AS episodes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY episode DESC) AS back FROM es) WHERE back <= 5 GROUP BY run",
    "mean_of_means": f"WITH {_EP} SELECT run, round(avg(mean), 6) AS mean_of_means, round(avg(total), 6) AS mean_of_sums FROM es GROUP BY run",
    "first_per_group": "SELECT c_mktsegment, arg_min(c_name, c_custkey) AS c_name, arg_min(c_acctbal, c_custkey) FILTER (c_acctbal > 5000) AS rich FROM customer GROUP BY c_mktsegment",
    "models_by_flag": f"""WITH r AS (SELECT user_id AS run, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'True' ELSE 'False' END AS flag FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT run, model, CAST(lr AS DOUBLE) AS lr FROM r JOIN (VALUES {', '.join(f"('{k}', '{m}', {lr})" for k, own in logs.MODELS.items() for m, lr in own)}) v(flag, model, lr) USING (flag)""",
    "resolved_seeds": """SELECT user_id AS run, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN user_id % 5 WHEN user_id % 3 <> 0 THEN user_id ELSE 0 END AS seed FROM events WHERE user_id IS NOT NULL GROUP BY user_id""",
    "first_event": "SELECT user_id AS run, min(format('{}-{:012d}', event_type, event_id)) AS path FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "grid_cross": """WITH x AS (SELECT event_type AS task, CAST(user_id % 5 AS INTEGER) AS seed, user_id FROM events WHERE user_id IS NOT NULL),
c AS (SELECT task, c_mktsegment AS model, seed, count(*) AS n FROM x JOIN customer ON c_custkey = user_id GROUP BY ALL)
SELECT t.task, m.model, s.seed, coalesce(n, 0) AS n FROM (SELECT DISTINCT task FROM x) t CROSS JOIN (SELECT DISTINCT c_mktsegment AS model FROM customer) m CROSS JOIN (SELECT DISTINCT seed FROM x) s
LEFT JOIN c ON c.task = t.task AND c.model = m.model AND c.seed = s.seed""",
}
