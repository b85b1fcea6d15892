"""Queries over users' events as series and as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import logs
from braidwork.operators import sequence as q
from braidwork.operators import vectors
from braidwork.plans.log_queries import LOG
from braidwork.plans.spectra import spectrum
from braidwork.session import cut, shared_folder, table
from braidwork.sources.events import user_log
from braidwork.streaming import reservoirs as stream

#: Sets of environments by name, rewards to reach and rewards of random play.
ENV_SETS = {
    "Ant_Swimmer": ("Ant-v4", "Swimmer-v4"),
    "Ant_Cheetah": ("Ant-v4", "HalfCheetah-v4"),
    "Cheetah_Swimmer": ("HalfCheetah-v4", "Swimmer-v4"),
    "Ant_4_tr_envs": ("HalfCheetah-v4", "Hopper-v4", "Swimmer-v4", "Walker2d-v4"),
    "Cheetah_4_tr_envs": ("Ant-v4", "Hopper-v4", "Swimmer-v4", "Walker2d-v4"),
    "Swimmer_4_tr_envs": ("Ant-v4", "HalfCheetah-v4", "Hopper-v4", "Walker2d-v4"),
    "Hopper_4_tr_envs": ("Ant-v4", "HalfCheetah-v4", "Swimmer-v4", "Walker2d-v4"),
    "Walker_4_tr_envs": ("Ant-v4", "HalfCheetah-v4", "Swimmer-v4", "Hopper-v4"),
    "forward_mujoco": ("Ant-v4", "HalfCheetah-v4", "Hopper-v4", "Swimmer-v4", "Walker2d-v4"),
}
TARGET = {"Ant-v4": 125, "HalfCheetah-v4": 750, "Swimmer-v4": 60, "Hopper-v4": 1250, "Humanoid-v4": 375, "HumanoidStandup-v4": 7500, "Walker2d-v4": 800}
RANDOM = {
    "Ant-v4": -0.355, "HalfCheetah-v4": -0.292, "Hopper-v4": 0.751, "Humanoid-v4": 5.025, "HumanoidStandup-v4": 33.089, "InvertedDoublePendulum-v4": 9.088,
    "InvertedPendulum-v4": 1.0, "Pusher-v4": -1.493, "Reacher-v4": -0.849, "Swimmer-v4": 0.0, "Walker2d-v4": 0.075,
}
VELOCITIES = {"CartPole-v1": (1, 3), "MountainCar-v0": (1,), "MountainCarContinuous-v0": (1,), "Pendulum-v1": (2,), "LunarLander-v2": (2, 3, 5), "LunarLanderContinuous-v2": (2, 3, 5)}
ENVS = tuple(sorted(TARGET))
TYPES = ("click", "error", "purchase", "signup", "view")


def delay_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.delay_embed(user_log(spark, sf_dir), 3)


def delay_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.delay_ranks(user_log(spark, sf_dir), 4, 0.9)


def choose_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.choose_rank(user_log(spark, sf_dir), 4, 0.9)


def rank_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.rank_notes(q.whole_runs(user_log(spark, sf_dir), 2), 4, 0.9, 3, 3)


def energy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.energy_rank(user_log(spark, sf_dir))


def episode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.episodes(user_log(spark, sf_dir)).select("run", "step", "episode")


def episode_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = logs.episodes(user_log(spark, sf_dir)).filter("episode = 1")
    return logs.positions(own, "run", "episode").filter("pos < 4").select("run", "step", F.col("pos").cast("long").alias("pos"), "value")


def label_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.islands(user_log(spark, sf_dir), "model")


def series_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.series_zscore(user_log(spark, sf_dir)).select("run", "step", (F.round("z", 6) + F.lit(0.0)).alias("z"))


def dft_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.dft_magnitude(user_log(spark, sf_dir)).select("run", "k", F.round("magnitude", 5).alias("magnitude"))


def leaky_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = user_log(spark, sf_dir).withColumn("value", F.col("value") / 500)
    return q.leaky_fold(log, 0.3, 0.7, 0.5).select("run", "steps", F.round("state", 6).alias("state"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.array_position(F.array(*map(F.lit, TYPES)), F.col("model")) - 1
    log = user_log(spark, sf_dir)
    return log.select("run", "step", q.one_hot(index, len(TYPES)).alias("x")).select("run", "step", *[F.get("x", i).alias(f"x{i}") for i in range(len(TYPES))])


def mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector without the velocities of the environment that its label stands for."""
    names = sorted(VELOCITIES)
    drop = q.told({i: F.array(*map(F.lit, VELOCITIES[n])) for i, n in enumerate(names)}, F.col("label") % len(names), "environment")
    e = table(spark, sf_dir, "embeddings").select("vec_id", q.masked(F.col("embedding").cast("array<double>"), drop).alias("v"))
    return e.select("vec_id", F.size("v").alias("dims"), F.round(q.mean_of(F.col("v")), 6).alias("mean"))


def reward_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of users' events between random play (0) and target (1) of the environment of their key."""
    own = table(spark, sf_dir, "events").filter("user_id is not null").groupBy(F.element_at(F.array(*map(F.lit, ENVS)), (F.col("user_id") % len(ENVS) + 1).cast("int")).alias("env")).agg(F.avg("value").alias("reward"))
    value = lambda table: F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), F.col("env"))
    return own.select("env", F.round((F.col("reward") - value(RANDOM)) / (value(TARGET) - value(RANDOM)), 6).alias("share"))


def env_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean share of each named set of environments."""
    sets = F.explode(F.array(*[F.struct(F.lit(n).alias("env_set"), F.lit(e).alias("env")) for n, own in ENV_SETS.items() for e in own]))
    names = spark.range(1).select(sets.alias("s")).select("s.*")
    return names.join(reward_share(spark, sf_dir), "env").groupBy("env_set").agg(F.count("*").alias("envs"), F.round(F.avg("share"), 6).alias("mean_share"))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.inputs(table(spark, sf_dir, "events"))


def esn_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.activations(q.states(_inputs(spark, sf_dir), stream.reservoir(7, 8, 3))).withColumn("activation", F.round("activation", 6))


def esn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next value of each run from its reservoir state, by a ridge readout over all runs."""
    own = _inputs(spark, sf_dir)
    series = own.select("run", F.struct("step", "id").alias("step"), F.get("u", 0).alias("value"))
    target = q.delay_embed(series, 2).select("run", "step.step", "step.id", F.col("h1").alias("y"))
    x = [f"x{i}" for i in range(8)]
    rows = cut(q.states(own, stream.reservoir(7, 8, 3)).join(target, ["run", "step", "id"]).select("run", "step", "id", *[F.get("state", i).alias(c) for i, c in enumerate(x)], "y"))
    weights = {r["feature"]: r["weight"] for r in vectors.ridge(rows, x, "y").collect()}  # a weight per unit
    predicted = F.lit(weights["intercept"])
    for c in x:
        predicted = predicted + F.col(c) * weights[c]
    return rows.groupBy("run").agg(F.count("*").alias("n"), F.round(F.avg((F.col("y") - predicted) * (F.col("y") - predicted)), 5).alias("mse"))


#: Files, each a batch, into which a run's rows are dealt out of order.
BATCHES = 3


def _stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Users' events as a stream in batches that bring a run's rows in no order, and the stream's folder."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = stream.numbered(table(spark, sf_dir, "events")).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(BATCHES)))
    rows.repartition(BATCHES, "batch").drop("batch").write.parquet(f"{path}/in")
    read = spark.readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    return read, path


def _through(spark: SparkSession, sf_dir: str, own: list, **how) -> DataFrame:
    read, path = _stream(spark, sf_dir)
    out = stream.run_once(stream.contexts(read, own, **how), path)
    return out.select("run", "step", "id", F.size("context").alias("units"), F.round(q.mean_of(F.col("context")), 6).alias("mean"))


def stream_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of inputs, states and fresh starts of a reservoir that forgets at an episode's end."""
    read, path = _stream(spark, sf_dir)
    out = stream.tapped(stream.contexts(read, [stream.reservoir(7, 8, 3)], reset=True), path)
    return out.select("run", "nth", "fresh", *[F.round(F.get("u", i), 6).alias(f"u{i}") for i in range(3)], F.round(F.get("context", 0), 6).alias("x0"))


def reservoir_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, [stream.reservoir(7, 8, 3)])


def multi_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, [stream.reservoir(7 + i, 6, 3) for i in range(3)], skip=True)


def partly_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through(spark, sf_dir, [stream.reservoir(7, 8, 3)], observed=3, reset=True)


QUERIES = {
    f.__name__: f
    for f in (
        delay_embed, delay_rank, choose_rank, rank_notes, energy_rank, episode_ids, episode_slice, label_islands, series_zscore, dft_magnitude, leaky_fold, one_hot, mask_columns,
        reward_share, env_sets, esn_states, esn_predict, reservoir_stream, multi_reservoir, partly_observed, stream_tap,
    )
}

_EPS = f"{LOG}, ep AS (SELECT *, coalesce(sum(CAST(done AS BIGINT)) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS episode FROM lg)"
_NAMES = sorted(VELOCITIES)
_MASK = " ".join(f"WHEN {i} THEN [{', '.join(map(str, VELOCITIES[n]))}]" for i, n in enumerate(_NAMES))
_CASE = lambda t: "CASE env " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in t.items()) + " END"
_SHARE = f"ow AS (SELECT [{', '.join(repr(e) for e in ENVS)}][user_id % {len(ENVS)} + 1] AS env, avg(value) AS reward FROM events WHERE user_id IS NOT NULL GROUP BY 1), sr AS (SELECT env, round((reward - {_CASE(RANDOM)}) / ({_CASE(TARGET)} - {_CASE(RANDOM)}), 6) AS share FROM ow)"
_SETS = ", ".join(f"('{n}', '{e}')" for n, own in ENV_SETS.items() for e in own)

_ROW = lambda r: "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in r) + "]"
_ROWS = lambda m: "[" + ", ".join(map(_ROW, m)) + "]"
_NEXT = lambda r, x: f"list_transform(range(1, {len(r.w) + 1}), lambda j: {1 - r.leak!r}::DOUBLE * {x}[j] + {r.leak!r}::DOUBLE * tanh(list_inner_product({_ROWS(r.w_in)}[j], u) + list_inner_product({_ROWS(r.w)}[j], {x})))"
_INPUT = """inp AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, epoch_us(ts) AS step, event_id AS id,
  [ln(1 + value), 0::DOUBLE, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END::DOUBLE] AS u, event_type = 'purchase' AS done FROM events WHERE user_id IS NOT NULL)"""


def _folded(own: list, reset: bool = False) -> str:
    """Recursive CTEs: the state of each reservoir, x0, x1, ..., after each of a run's inputs."""
    zeros = [f"list_transform(range({len(r.w)}), lambda i: 0::DOUBLE)" for r in own]
    names = [f"x{i}" for i in range(len(own))]
    before = [f"CASE WHEN f.done THEN {z} ELSE f.{x} END" if reset else f"f.{x}" for x, z in zip(names, zeros, strict=True)]
    start = ", ".join(f"{z} AS {x}" for x, z in zip(names, zeros, strict=True))
    own_before = ", ".join(f"{b} AS {x}" for b, x in zip(before, names, strict=True))
    after = ", ".join(f"{_NEXT(r, x)} AS {x}" for r, x in zip(own, names, strict=True))
    return f"""{_INPUT}, f AS (SELECT run, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS id, [0::DOUBLE] AS u, false AS done, {start} FROM (SELECT DISTINCT run FROM inp)
UNION ALL SELECT run, nth, step, id, u, done, {after} FROM (SELECT inp.run, inp.nth, inp.step, inp.id, inp.u, inp.done, {own_before} FROM f JOIN inp ON inp.run = f.run AND inp.nth = f.nth + 1))"""


_EIGHT, _SIX = [stream.reservoir(7, 8, 3)], [stream.reservoir(7 + i, 6, 3) for i in range(3)]
_CONTEXT = lambda c: f"SELECT run, step, id, CAST(len({c}) AS INTEGER) AS units, round(list_sum({c}) / len({c}), 6) AS mean FROM f WHERE nth > 0"


def _readout(units: int) -> str:
    """CTEs that solve the ridge readout of h1 on the states by elimination; ``sol`` has a weight in each row."""
    n = units
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*)" for a, b in [(f"s[{i}]", f"s[{j}]") for i in range(1, n + 1) for j in [*range(1, n + 1)]])
    goal = ", ".join(f"covar_pop(s[{i}], y) * count(*)" for i in range(1, n + 1))
    out = [f"ro AS (SELECT [{sums}] AS c, [{goal}] AS d, {', '.join(f'avg(s[{i}]) AS m{i}' for i in range(1, n + 1))}, avg(y) AS my FROM tr)"]
    out.append(f"g0 AS MATERIALIZED (SELECT i, list_append(list_transform(range(1, {n + 1}), lambda j: c[(i - 1) * {n} + j] + CASE WHEN i = j THEN 1e-6 ELSE 0 END), d[i]) AS r FROM ro, (SELECT unnest(range(1, {n + 1})) AS i))")
    for k in range(1, n + 1):
        out.append(f"g{k} AS MATERIALIZED (SELECT a.i, CASE WHEN a.i = {k} THEN list_transform(a.r, lambda x: x / p.r[{k}]) ELSE list_transform(range(1, {n + 2}), lambda j: a.r[j] - a.r[{k}] * p.r[j] / p.r[{k}]) END AS r FROM g{k - 1} a, (SELECT r FROM g{k - 1} WHERE i = {k}) p)")
    out.append(f"sol AS (SELECT list(r[{n + 1}] ORDER BY i) AS w FROM g{n})")
    return ", ".join(out)


_RANKS = f"""WITH {LOG}, h AS (SELECT run, [h0, h1, h2, h3] AS h FROM (SELECT run, value AS h0, lead(value, 1) OVER w AS h1, lead(value, 2) OVER w AS h2, lead(value, 3) OVER w AS h3 FROM lg WINDOW w AS (PARTITION BY run ORDER BY step)) WHERE h3 IS NOT NULL),
hc AS MATERIALIZED (SELECT run, a.i, b.i AS j, covar_pop(h[a.i], h[b.i]) AS m FROM h, (SELECT unnest(range(1, 5)) AS i) a, (SELECT unnest(range(1, 5)) AS i) b GROUP BY ALL),
{spectrum('p', 'hc', 'run')}, {spectrum('q', 'p_d', 'run')}, {spectrum('v', 'q_d', 'run')},
dr AS (SELECT run, CAST(1 + CASE WHEN p_l.l < 0.9 * t THEN 1 ELSE 0 END + CASE WHEN p_l.l + q_l.l < 0.9 * t THEN 1 ELSE 0 END + CASE WHEN p_l.l + q_l.l + v_l.l < 0.9 * t THEN 1 ELSE 0 END AS INTEGER) AS rank
       FROM (SELECT run, sum(m) AS t FROM hc WHERE i = j GROUP BY run) JOIN p_l USING (run) JOIN q_l USING (run) JOIN v_l USING (run))"""

ORACLES = {
    "delay_rank": f"{_RANKS} SELECT run, rank FROM dr",
    "choose_rank": f"{_RANKS} SELECT least(greatest(max(rank), 1), 50) AS rank FROM dr",
    "rank_notes": f"{_RANKS} SELECT 3 AS rank, max(rank) AS widest, true AS few_modes, max(rank) > 3 AS capped FROM dr",
    "esn_states": f"WITH RECURSIVE {_folded(_EIGHT)} SELECT run, step, id, CAST(unit AS INTEGER) AS unit, round(abs(x0[unit + 1]), 6) AS activation FROM f, (SELECT unnest(range(0, 5)) AS unit) WHERE nth BETWEEN 1 AND 100",
    "reservoir_stream": f"WITH RECURSIVE {_folded(_EIGHT)} {_CONTEXT('x0')}",
    "multi_reservoir": f"WITH RECURSIVE {_folded(_SIX)} {_CONTEXT('list_concat(list_concat(list_concat(x0, x1), x2), u)')}",
    "partly_observed": f"WITH RECURSIVE {_folded(_EIGHT, True)} {_CONTEXT('x0[1:3]')}",
    "stream_tap": f"WITH RECURSIVE {_folded(_EIGHT, True)} SELECT run, nth - 1 AS nth, coalesce(lag(done) OVER (PARTITION BY run ORDER BY nth), true) AS fresh, round(u[1], 6) AS u0, round(u[2], 6) AS u1, round(u[3], 6) AS u2, round(x0[1], 6) AS x0 FROM f WHERE nth > 0",
    "esn_predict": f"""WITH RECURSIVE {_folded(_EIGHT)}, tr AS MATERIALIZED (SELECT * FROM (SELECT run, x0 AS s, lead(u[1]) OVER (PARTITION BY run ORDER BY nth) AS y FROM f WHERE nth > 0) WHERE y IS NOT NULL), {_readout(8)}
SELECT run, count(*) AS n, round(avg(pow(y - my - ({' + '.join(f'w[{i}] * (s[{i}] - m{i})' for i in range(1, 9))}), 2)), 5) AS mse FROM tr, sol, ro GROUP BY run""",
    "delay_embed": f"WITH {LOG} SELECT run, step, h0, h1, h2 FROM (SELECT run, step, value AS h0, lead(value, 1) OVER w AS h1, lead(value, 2) OVER w AS h2, lead(step, 2) OVER w AS z FROM lg WINDOW w AS (PARTITION BY run ORDER BY step)) WHERE z IS NOT NULL",
    "energy_rank": f"""WITH {LOG}, c AS (SELECT run, row_number() OVER w AS k, sum(value * value) OVER (PARTITION BY run ORDER BY value DESC, step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM lg WINDOW w AS (PARTITION BY run ORDER BY value DESC, step)),
t AS (SELECT run, sum(value * value) AS total FROM lg GROUP BY run) SELECT run, min(k) AS rank FROM c JOIN t USING (run) WHERE cum >= 0.99 * total GROUP BY run""",
    "episode_ids": f"WITH {_EPS} SELECT run, step, CAST(episode AS BIGINT) AS episode FROM ep",
    "episode_slice": f"WITH {_EPS} SELECT run, step, pos, value FROM (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS pos FROM ep WHERE episode = 1) WHERE pos < 4",
    "label_islands": f"""WITH {LOG}, n AS (SELECT run, model AS label, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS pos, row_number() OVER (PARTITION BY run, model ORDER BY step) AS m FROM lg)
SELECT run, label, min(pos) AS "start", max(pos) + 1 AS "end", (min(pos) + max(pos) + 1) / 2.0 AS centre FROM n GROUP BY run, label, pos - m""",
    "series_zscore": f"WITH {LOG} SELECT run, step, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 0 THEN stddev_pop(value) OVER w ELSE 1 END, 6) + 0.0 AS z FROM lg WINDOW w AS (PARTITION BY run)",
    "dft_magnitude": f"""WITH {LOG}, n AS (SELECT run, count(*) AS n FROM lg GROUP BY run), k AS (SELECT run, n, unnest(range(0, n // 2 + 1)) AS k FROM n)
SELECT run, CAST(k AS INTEGER) AS k, round(sqrt(pow(sum(value * cos(2 * pi() * k * (step - 1) / n)), 2) + pow(sum(value * sin(2 * pi() * k * (step - 1) / n)), 2)), 5) AS magnitude FROM k JOIN lg USING (run) GROUP BY run, k, n""",
    "leaky_fold": f"""WITH RECURSIVE {LOG}, f AS (SELECT run, CAST(0 AS BIGINT) AS step, 0.0::DOUBLE AS state FROM (SELECT DISTINCT run FROM lg)
UNION ALL SELECT f.run, lg.step, 0.7 * state + 0.3 * ((exp(2 * (0.7 * value / 500 + 0.5 * state)) - 1) / (exp(2 * (0.7 * value / 500 + 0.5 * state)) + 1)) FROM f JOIN lg ON lg.run = f.run AND lg.step = f.step + 1)
SELECT run, CAST(max(step) AS INTEGER) AS steps, round(arg_max(state, step), 6) AS state FROM f GROUP BY run""",
    "one_hot": f"WITH {LOG} SELECT run, step, {', '.join(f'''CASE WHEN model = '{t}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x{i}''' for i, t in enumerate(TYPES))} FROM lg",
    "mask_columns": f"WITH e AS (SELECT vec_id, CASE label % {len(_NAMES)} {_MASK} END AS gone, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), m AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x, gone FROM e) SELECT vec_id, CAST(count(*) AS INTEGER) AS dims, round(avg(x), 6) AS mean FROM m WHERE NOT list_contains(gone, i) GROUP BY vec_id",
    "reward_share": f"WITH {_SHARE} SELECT env, share FROM sr",
    "env_sets": f"WITH {_SHARE} SELECT s.env_set, count(*) AS envs, round(avg(share), 6) AS mean_share FROM (VALUES {_SETS}) s(env_set, env) JOIN sr USING (env) GROUP BY s.env_set",
}
