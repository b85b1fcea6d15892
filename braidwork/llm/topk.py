"""Exact top-k by inner product with a pivot-distance index.

Vectors are lifted onto a sphere, x' = (x, sqrt(R^2 - |x|^2)) and q' = (q, 0), so that
|q' - x'|^2 = |q|^2 + R^2 - 2 q.x: the largest inner products are the nearest points. Every row is keyed by its
nearest pivot and its distance to it; the rows of one pivot within a range of distances are an annulus, of which
there are a bounded number. A query at distance d of a pivot is at least max(d - outer, inner - d) away from all
of an annulus, and an annulus also keeps its least and greatest distance to every other pivot, so the largest of
these gaps bounds its inner products from above.

Blocks of alike queries take the annuli in rounds, the best bounds first and four times as many rows in each
round as in the one before. After a round each query knows its k-th best score so far, and an annulus is passed
over where no query of the block can gain by it; the search stops when none is left. All rows are indexed, and
the result is exact.

Defined cases: rows without an id and vectors that are null, empty, or hold null or non-finite components take
no part; queries meet rows of their own length only; components and scores beyond a long saturate; equal scores go
to the smaller id; a query never finds rows of its own id; rows that repeat an id are candidates of their own, and
share one list as queries; with fewer than k candidates all are returned; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.llm.common import cut, few, read, small_batches

#: Rows and numbers from which pivots are taken at most; pivots of a length; annuli of a pivot.
SAMPLE, NUMBERS, PIVOTS, RINGS = 2048, 1 << 21, 32, 64
#: Queries of a block, rows that a task compares with a block (a share of a small table), rows of a block's first round.
BLOCK, PART, SHARE, START = 8192, 8192, 16, 16_384
LONG = np.iinfo(np.int64)


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows with an id whose vector is whole and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.filter(F.col("id").isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0) & ~F.exists(vec, bad))


def _farthest(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n points, each the farthest from those before it."""
    at = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(at) < min(n, len(points)) and near.max() > 0:
        at.append(int(near.argmax()))
        near = np.minimum(near, ((points - points[at[-1]]) ** 2).sum(axis=1))
    return points[at]


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def _matrix(s: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, kind) for v in s])


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers: by doubles where these are exact, else by unbounded integers."""
    if len(x) and len(y) and np.abs(x.astype(float)).max() * np.abs(y.astype(float)).max() * x.shape[1] >= 2.0**53:
        return np.clip(x.astype(object) @ y.astype(object).T, LONG.min, LONG.max).astype(np.int64)
    return (x.astype(float) @ y.astype(float).T).astype(np.int64)


class Pivots:
    """Pivots for each length of vectors; a length without a sampled row has the one above the origin."""

    def __init__(self, sample: list[np.ndarray], square: float):
        self.square, self.by_length = square, {}
        for n in {len(v) for v in sample}:
            self.by_length[n] = _farthest(_lift(np.stack([v for v in sample if len(v) == n]), square), PIVOTS)

    def of(self, n: int) -> np.ndarray:
        return self.by_length[n] if n in self.by_length else np.append(np.zeros(n), np.sqrt(self.square))[None]

    def away(self, vec: pd.Series, lifted: bool) -> list[np.ndarray]:
        """Each vector's distances to the pivots of its length; queries aren't lifted."""
        out, lengths = [np.zeros(0)] * len(vec), np.array([len(v) for v in vec], np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = _matrix(vec.iloc[at])
            d = _distances(_lift(x, self.square) if lifted else np.column_stack([x, np.zeros(len(x))]), self.of(int(n)))
            for i, row in zip(at, d, strict=True):
                out[i] = row
        return out


def _bounds(away: np.ndarray, sizes: np.ndarray, square: float, nearest: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """Queries x annuli: what inner products can't exceed, with room for rounding.

    ``nearest`` and ``farthest`` are annuli x pivots.
    """
    gap = np.zeros((len(away), len(nearest)))
    for p in range(away.shape[1]):
        np.maximum(gap, away[:, p : p + 1] - farthest[:, p], out=gap)
        np.maximum(gap, nearest[:, p] - away[:, p : p + 1], out=gap)
    total = sizes[:, None] + square
    return np.maximum((total - gap * gap) / 2 + 0.5 + 1e-6 * total, float(LONG.min))  # scores saturate there, too


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of each query's k best scores, and those that tie with the k-th, from ``least`` on."""
    allowed = own[:, None] != ids[None, :]
    floor = least
    if scores.shape[1] > k:
        floor = np.maximum(least, np.partition(np.where(allowed, scores, LONG.min), -k, axis=1)[:, -k])
    return np.nonzero((scores >= floor[:, None]) & allowed)


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, in order."""
    order = np.lexsort((ids, ~score, query))
    q = query[order]
    start = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - start < k]


def searched(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec") -> tuple[DataFrame, dict]:
    """``query_id, rank, id, score`` of the k rows of largest inner product with each query, and figures.

    Both frames hold vectors of whole numbers. The figures are the rounds, the pairs of a query and a row of its
    length, and those among them that the bounds left to be scored.
    """
    small_batches(rows.sparkSession)
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<long>").alias("vec")).withColumn("dims", F.size("vec"))
    queries = queries.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<long>").alias("vec")).withColumn("dims", F.size("vec"))
    id_type = rows.schema["id"].dataType.simpleString()
    result = f"query_id {id_type}, rank int, id {id_type}, score long"
    size = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    seen = rows.agg(F.max(size).alias("square"), F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    figures = {"rounds": 0, "pairs": 0, "scored": 0}
    if not seen["n"]:
        return spark.createDataFrame([], result), figures
    square, most = float(seen["square"]), max(1, min(SAMPLE, NUMBERS // seen["dims"]))
    draw = F.xxhash64(F.lit("pivots"), "id")
    drawn = rows.filter(F.pmod(draw, F.lit(1_000_000)) < 2_000_000 * most / seen["n"]).orderBy(draw, "id", "vec").limit(most).select("vec").toPandas()
    pivots = Pivots([np.asarray(v, float) for v in drawn["vec"]], square)
    part = int(min(PART, max(PART // SHARE, seen["n"] // SHARE)))
    width = max(1.0, np.sqrt(square) * 2 / RINGS)

    @F.pandas_udf("pivot int, ring int, away array<double>")
    def key(vec: pd.Series) -> pd.DataFrame:
        away = pivots.away(vec, True)
        return pd.DataFrame({"pivot": [a.argmin() for a in away], "ring": [int(a.min() / width) for a in away], "away": away})

    @F.pandas_udf("array<double>")
    def ask(vec: pd.Series) -> pd.Series:
        return pd.Series(pivots.away(vec, False), dtype=object)

    ring = ["dims", "pivot", "ring"]
    keyed = cut(rows.withColumn("k", key("vec")).select("dims", "id", "vec", "k.*"))
    # least and greatest distances to each pivot: an annulus has as many as its length has pivots
    ends = keyed.select(*ring, F.posexplode("away").alias("p", "d")).groupBy(*ring, "p").agg(F.min("d").alias("inner"), F.max("d").alias("outer"), F.count("*").alias("n"))
    ends = ends.groupBy(*ring).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "inner", "outer"))).alias("ends"))
    rings = cut(ends.select(*ring, "n", F.ceil(F.col("n") / part).alias("parts"), F.transform("ends", lambda e: e["inner"]).alias("nearest"), F.transform("ends", lambda e: e["outer"]).alias("farthest")))
    small = few(rings)
    dealt = keyed.drop("away").join(small(rings.select(*ring, "parts")), ring).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts")

    # alike queries share a block: they are laid out by their nearest pivot, at a place drawn within it
    asked = cut(queries.withColumn("away", ask("vec")).withColumn("home", F.array_position("away", F.array_min("away"))).withColumn("size", size))
    homes = asked.groupBy("dims", "home").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("dims").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    homes = cut(homes.withColumn("before", before))
    asked = asked.join(few(homes)(homes), ["dims", "home"])
    asked = cut(asked.withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("id"), "count")) / BLOCK)).select("dims", "block", "id", "vec", "size", "away"))
    blocks = asked.groupBy("dims", "block").agg(F.count("*").alias("queries"))
    figures["pairs"] = (blocks.groupBy("dims").agg(F.sum("queries").alias("q")).join(rings.groupBy("dims").agg(F.sum("n").alias("n")), "dims").agg(F.sum(F.col("q") * F.col("n"))).first()[0]) or 0
    told = cut(blocks.select("dims", F.col("block").alias("r_block")).join(rings, "dims").withColumnRenamed("dims", "r_dims"))

    def plan(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """The annuli in the order of their best bounds, and how many queries each may still serve."""
        if not len(q) or not len(r):
            return pd.DataFrame({c: [] for c in ("dims", "block", "pivot", "ring", "n", "asking", "upto", "nth")})
        r = r.sort_values(["pivot", "ring"], ignore_index=True)
        nearest, farthest, away, least = _matrix(r["nearest"]), _matrix(r["farthest"]), _matrix(q["away"]), q["least"].to_numpy(float)
        best, asking = np.full(len(r), -np.inf), np.zeros(len(r), np.int64)
        for a in range(0, len(q), 1024):
            bound = _bounds(away[a : a + 1024], q["size"].to_numpy()[a : a + 1024], square, nearest, farthest)
            best, asking = np.maximum(best, bound.max(axis=0)), asking + (bound >= least[a : a + 1024, None]).sum(axis=0)
        order = np.argsort(-best, kind="stable")
        n = r["n"].to_numpy()
        upto = np.empty(len(r), np.int64)
        upto[order] = np.cumsum(n[order]) - n[order]
        nth = np.empty(len(r), np.int64)
        nth[order] = np.arange(len(r))
        return pd.DataFrame({"dims": q["dims"].iloc[0], "block": q["block"].iloc[0], "pivot": r["pivot"], "ring": r["ring"], "n": n, "asking": asking, "upto": upto, "nth": nth})

    def expand(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        """The k best rows of each query among those of the task, annulus by annulus while its bound allows."""
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        x, ids, away, sizes = _matrix(q["vec"], np.int64), q["id"].to_numpy(), _matrix(q["away"]), q["size"].to_numpy(float)
        floor = q["least"].to_numpy(np.int64).copy()
        asked, found, scores = np.zeros(0, np.int64), np.zeros(0, ids.dtype), np.zeros(0, np.int64)
        step = max(1, 2_000_000 // len(q))
        for _, own in r.sort_values(["nth", "id"]).groupby("nth"):
            bound = _bounds(away, sizes, square, _matrix(own["nearest"].iloc[:1]), _matrix(own["farthest"].iloc[:1]))[:, 0]
            y, rid = _matrix(own["vec"], np.int64), own["id"].to_numpy()
            for a in range(0, len(y), step):
                at = np.flatnonzero(bound >= floor)
                if not len(at):
                    break
                s = products(x[at], y[a : a + step])
                i, j = _best(s, rid[a : a + step], ids[at], floor[at], k)
                asked, found, scores = np.append(asked, at[i]), np.append(found, rid[a : a + step][j]), np.append(scores, s[i, j])
                keep = _first(asked, scores, found, k)
                asked, found, scores = asked[keep], found[keep], scores[keep]
                last = np.searchsorted(asked, np.arange(len(q)), "right")
                full = np.bincount(asked, minlength=len(q)) == k
                floor[full] = np.maximum(floor[full], scores[last[full] - 1])
        return pd.DataFrame({"query_id": ids[asked], "id": found, "score": scores})

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    none = spark.createDataFrame([], f"query_id {id_type}, id {id_type}, score long")
    best, low, high = none, 0, START
    while True:
        least = best.groupBy("query_id").agg(F.count("*").alias("c"), F.min("score").alias("least")).filter(F.col("c") == k).select(F.col("query_id").alias("id"), "least")
        now = asked.join(least, "id", "left") if figures["rounds"] else asked.withColumn("least", F.lit(None).cast("long"))
        planned = now.select("dims", "block", "size", "away", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"))
        planned = planned.groupBy("dims", "block").cogroup(told.groupBy("r_dims", "r_block")).applyInPandas(plan, "dims int, block long, pivot int, ring int, n long, asking long, upto long, nth long")
        left = cut(planned.filter((F.col("upto") >= low) & (F.col("asking") > 0)))
        ahead = left.agg(F.min("upto").alias("next"), F.sum(F.when(F.col("upto") < high, F.col("n") * F.col("asking"))).alias("scored")).first()
        if ahead["next"] is None:
            break
        if ahead["next"] < high:
            figures["rounds"] += 1
            figures["scored"] += ahead["scored"]
            wanted = left.filter(F.col("upto") < high).join(small(rings.drop("n")), ring)
            wanted = wanted.withColumn("run", F.floor((F.col("upto") - low) / part)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            wanted = cut(wanted.select(*ring, "part", "block", "run", "nth", "nearest", "farthest"))
            task = ["dims", "block", "run", "part"]
            tasks = wanted.select(*task).distinct()
            mine = now.join(few(tasks)(tasks), ["dims", "block"]).select(*[F.col(c).alias(f"q_{c}") for c in task], "id", "vec", "size", "away", F.coalesce("least", F.lit(int(LONG.min))).alias("least"))
            theirs = dealt.join(few(wanted)(wanted), [*ring, "part"]).select(*task, "nth", "nearest", "farthest", "id", "vec")
            found = mine.groupBy(*[f"q_{c}" for c in task]).cogroup(theirs.groupBy(*task)).applyInPandas(expand, none.schema)
            best = cut(best.union(found).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
        low, high = high, high * 4
    return best.withColumn("rank", rank).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"), figures


def search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """``query_id, rank, id, score`` of the k rows of largest inner product with each query."""
    return searched(rows, queries, k, id_col, vec_col)[0]


def whole_numbers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, vec`` with each component x as floor(64 x), for the vectors that take part."""
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")), "vec")
    return rows.select("id", F.transform("vec", lambda x: F.floor(64 * x.cast("double"))).alias("vec"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every query whose id is divisible by 20; ties, nulls, repeated ids and odd vectors as in the module's cases."""
    rows = whole_numbers(read(spark, sf_dir, "embeddings"))
    found = search(rows, rows.filter(F.col("id") % 20 == 0), 20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
