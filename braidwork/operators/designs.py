"""Network designs: parameters, block matrices, node assignments and sampled networks.

A design row has ``id, stratum, K, p0, centre_u, contrast_u, sigma_ratio, rho, size_alpha, f, core_fraction,
frac_negative, seed``. Randomness is drawn per design from its own seed, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators import graph
from braidwork.session import cut

#: Fixed values of the design space.
STRATA = ("assortative", "disassortative", "core_periphery", "mixed", "null")
COMMUNITIES = (2, 3, 4, 6, 8, 12, 16)
ALPHAS = (float("inf"), 100.0, 30.0, 10.0, 3.0)
SIGMA = 0.1
#: Block means of the four canonical architectures (hi, lo, mid).
PRESETS = {"assortative": (0.9, 0.1, 0.5), "disassortative": (0.9, 0.1, 0.5), "core_periphery": (0.9, 0.1, 0.5), "mixed": (0.9, 0.1, 0.5)}
#: Their nodes, communities and the core's share of nodes.
PRESET_SIZES = {"assortative": (68, 4, 0.0), "disassortative": (68, 4, 0.0), "core_periphery": (68, 2, 0.2), "mixed": (68, 4, 0.0)}


def params_driven(designs: DataFrame) -> DataFrame:
    """Parameters of driven networks: hi and lo half a contrast above and below the centre."""
    c, d = F.col("centre_u"), F.col("contrast_u")
    return designs.select(
        "id", F.coalesce("stratum", F.lit("null")).alias("motif"), F.col("K").alias("n_communities"), (c + d / 2).alias("hi"), (c - d / 2).alias("lo"), c.alias("mid"), (F.col("sigma_ratio") * c).alias("sigma"), F.col("p0").alias("connectivity"), F.col("frac_negative").alias("p_negative"), "seed"
    )


def params_described(designs: DataFrame, n: int = 200) -> DataFrame:
    """Parameters of described networks: scaled by SIGMA, deviations by block, cores by fraction."""
    core = F.col("stratum") == "core_periphery"
    hi, lo = (F.col("centre_u") + F.col("contrast_u")) * SIGMA, (F.col("centre_u") - F.col("contrast_u")) * SIGMA
    s_b = SIGMA * F.col("K") / (F.col("sigma_ratio") + F.col("K") - 1)
    out = designs.withColumn("hi", hi).withColumn("lo", lo).withColumn("s_between", s_b).withColumn("s_within", F.col("sigma_ratio") * s_b)
    motif = F.when(core, "core_periphery").when(F.col("stratum") == "mixed", "mixed").otherwise("assortative")
    return out.select("id", motif.alias("motif"), "K", "hi", "lo", F.when(core, F.col("lo") + F.col("f") * (F.col("hi") - F.col("lo"))).alias("mid"), "s_between", "s_within", F.when(core, n_core(F.lit(n), F.col("core_fraction"))).alias("n_core"), F.when(~core & (F.col("size_alpha") < float("inf")), F.col("size_alpha")).alias("size_alpha"), "seed")


def grid(designs: DataFrame, k: str = "K") -> DataFrame:
    """All pairs r, s of each design's communities."""
    each = F.sequence(F.lit(0), F.col(k).cast("int") - 1)
    return designs.withColumn("r", F.explode(each)).withColumn("s", F.explode(each))


def draw(*parts: Column) -> Column:
    """A uniform number in [0, 1) from a digest of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def omega(motif: Column, r: Column, s: Column, hi: Column, lo: Column, mid: Column, key: Column) -> Column:
    """Block mean of communities r and s; a mixed block is the mean of two draws between lo and hi."""
    mixed = lo + (hi - lo) * (draw(key, r, s) + draw(key, s, r)) / 2
    return (
        F.when(motif.isin("assortative", "null"), F.when(r == s, hi).otherwise(lo))
        .when(motif == "disassortative", F.when(r == s, lo).otherwise(hi))
        .when(motif == "core_periphery", F.when((r == 0) & (s == 0), hi).when((r == 0) | (s == 0), mid).otherwise(lo))
        .when(motif == "mixed", mixed)
        .otherwise(F.raise_error(F.concat(F.lit("unknown motif: "), motif)).cast("double"))
    )


def preset_omega(kind: Column, r: Column, s: Column, key: Column) -> Column:
    """Block means of a canonical architecture with its own defaults."""
    value = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[i])]), kind)
    return omega(kind, r, s, value(0), value(1), value(2), key)


def preset_nodes(kinds: DataFrame) -> DataFrame:
    """``kind, node, community`` of the canonical architectures, from ``kind``."""
    value = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PRESET_SIZES.items() for x in (k, v[i])]), F.col("kind"))
    own = kinds.select("kind", value(0).alias("n"), value(1).alias("k"), value(2).alias("core_fraction")).withColumn("node", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    node, n, k = F.col("node"), F.col("n"), F.col("k")
    core = F.greatest(F.lit(1), F.rint(n * F.col("core_fraction")).cast("int"))
    community = F.when(F.col("core_fraction") > 0, core_community(node, n, k, core)).otherwise(equal_community(node, n, k))
    return own.select("kind", "node", community.cast("int").alias("community"))


def density(rho: Column, k: Column, p0: Column, core: Column, f: Column, r: Column, s: Column) -> Column:
    """Edge probability of a block; the mean over blocks stays p0 before clipping to [0, 1]."""
    p_b = p0 * k / (rho + k - 1)
    p_w = rho * p_b
    block = F.when(k == 1, p0).when(core, F.when((r == 0) & (s == 0), p_w).when((r == 0) | (s == 0), p_b + f * (p_w - p_b)).otherwise(p_b)).otherwise(F.when(r == s, p_w).otherwise(p_b))
    return F.least(F.greatest(block, F.lit(0.0)), F.lit(1.0))


def equal_community(node: Column, n: Column, k: Column) -> Column:
    """Community of a node where k communities of n nodes are as equal as possible, in whole numbers."""
    return F.floor(((node + 1) * k - 1) / n)


def n_core(n: Column, fraction: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(n * fraction)).cast("int")


def core_community(node: Column, n: Column, k: Column, core: Column) -> Column:
    """0 for the core's nodes, else 1 + the equal community among the others."""
    return F.when(node < core, 0).otherwise(1 + equal_community(node - core, n - core, F.greatest(k - 1, F.lit(1))))


def apportion(shares: DataFrame, total: str, group: str, key: str, share: str = "share") -> DataFrame:
    """``group, key, n``: one of each group's ``total`` for every key, the spare by share and largest remainders.

    Equal remainders go in the order of keys.
    """
    all_keys = Window.partitionBy(group)
    out = shares.withColumn("spare", F.col(total) - F.count("*").over(all_keys))
    out = out.withColumn("exact", F.col(share) / F.sum(share).over(all_keys) * F.col("spare")).withColumn("whole", F.floor("exact"))
    out = out.withColumn("short", F.col("spare") - F.sum("whole").over(all_keys)).withColumn("at", F.row_number().over(all_keys.orderBy(F.desc(F.round(F.col("exact") - F.col("whole"), 9)), key)))
    return out.select(group, key, (1 + F.col("whole") + F.when(F.col("at") <= F.col("short"), 1).otherwise(0)).cast("long").alias("n"))


def drawn_sizes(designs: DataFrame, nodes: int) -> DataFrame:
    """``id, community, n``: sizes by a symmetric Dirichlet draw, at least one node a community; size_alpha is a finite whole number.

    A gamma number of a whole shape is a sum of exponential ones, each drawn from a digest of design, community and place.
    """
    own = designs.select("id", "size_alpha", F.explode(F.sequence(F.lit(0), F.col("K") - 1)).alias("community"))
    parts = F.transform(F.sequence(F.lit(1), F.col("size_alpha").cast("int")), lambda i: -F.log(1 - draw(F.col("id"), F.col("community"), i)))
    shares = own.select("id", "community", F.lit(nodes).alias("total"), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x).alias("share"))
    return apportion(shares, "total", "id", "community")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for small rows that each take long."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, "id")


def sampled(keys: DataFrame, per: str = "stratum") -> DataFrame:
    """A random design for each row of ``id, stratum``, from a generator seeded by the id."""
    schema = "id long, stratum string, K int, p0 double, centre_u double, sigma_ratio double, rho double, size_alpha double, f double, core_fraction double, contrast_u double, seed long"

    def draw_rows(batches):
        for pdf in batches:
            rows = []
            for i, stratum in zip(pdf["id"], pdf[per], strict=True):
                g = np.random.default_rng([17, int(i)])
                log_uniform = lambda a, b: float(np.exp(g.uniform(np.log(a), np.log(b))))  # noqa: B023, E731
                row = {"id": i, "stratum": stratum, "K": int(g.choice(COMMUNITIES)), "p0": log_uniform(0.03, 0.30), "centre_u": g.uniform(0, 10), "sigma_ratio": log_uniform(1 / 8, 8), "rho": log_uniform(1 / 16, 16), "size_alpha": float(g.choice(ALPHAS)), "f": 0.5, "core_fraction": 0.0, "contrast_u": g.uniform(1, 8), "seed": int(g.integers(0, 2**31 - 1))}
                if stratum == "null":
                    row |= {"contrast_u": 0.0, "rho": 1.0, "sigma_ratio": 1.0, "centre_u": g.uniform(2, 10), "size_alpha": float("inf")}
                elif stratum in ("assortative", "disassortative"):
                    row["contrast_u"] = g.uniform(0.5, 8) * (1 if stratum == "assortative" else -1)
                elif stratum == "core_periphery":
                    row |= {"f": g.uniform(0.2, 0.8), "core_fraction": g.uniform(0.05, 0.40)}
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return keys.select("id", per).mapInPandas(draw_rows, schema)


def search_space(keys: DataFrame, reservoirs: int, ranges: dict[str, tuple[float, float]], units: int) -> DataFrame:
    """``id, res_id, hp, value``: log-uniform values of each hyper-parameter of each reservoir, and fixed units."""
    names = list(ranges)
    each = keys.select("id", F.explode(F.sequence(F.lit(1), F.lit(reservoirs))).alias("res_id"))
    lo, hi = (F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(np.log(ranges[n][k])))]), F.col("hp")) for k in (0, 1))
    drawn = each.select("id", "res_id", F.explode(F.array(*map(F.lit, names))).alias("hp"))
    drawn = drawn.select("id", "res_id", "hp", F.exp(lo + (hi - lo) * draw(F.col("id"), F.col("res_id"), F.col("hp"))).alias("value"))
    return drawn.union(each.select("id", "res_id", F.lit("units"), F.lit(float(units))))


def spectral_scaled(w: np.ndarray, radius: float) -> np.ndarray:
    """``w`` with its largest absolute eigenvalue at ``radius``; a zero matrix stays."""
    now = np.abs(np.linalg.eigvalsh(w) if np.array_equal(w, w.T) else np.linalg.eigvals(w)).max(initial=0.0)
    return w * (radius / now) if now > 0 else w


def block_sample(rng: np.random.Generator, z: np.ndarray, mean: np.ndarray, sd: np.ndarray, p: np.ndarray, p_negative: float, radius: float) -> np.ndarray:
    """One symmetric weighted network: an edge of each pair is drawn once, sign flips after, then the radius is set."""
    n, at = len(z), np.ix_(z, z)
    upper = np.triu(np.ones((n, n), bool), 1)
    weights, there = rng.normal(mean[at], sd[at]), rng.random((n, n)) < p[at]
    w = np.where(upper & there, weights, 0.0)
    if p_negative > 0:
        w = np.where(np.triu(rng.random((n, n)) < p_negative, 1), -np.abs(w), w)
    return spectral_scaled(w + w.T, radius)


def dirichlet_sizes(rng: np.random.Generator, n: int, k: int, alpha: float) -> np.ndarray:
    """Sizes of k communities of n nodes, one each reserved, the spare by a Dirichlet draw and largest remainders."""
    if k > n:
        raise ValueError(f"{n} nodes can't fill {k} communities")
    exact = rng.dirichlet(np.full(k, alpha)) * (n - k)
    whole = np.floor(exact).astype(int)
    rest = np.argsort(-(exact - whole), kind="stable")[: n - k - whole.sum()]
    whole[rest] += 1
    return whole + 1


def _assigned(d: dict, n: int, rng: np.random.Generator) -> np.ndarray:
    """The communities of a design's n nodes."""
    k, nodes = int(d["K"]), np.arange(n)
    if d["stratum"] == "core_periphery":
        core = max(1, round(n * d["core_fraction"]))
        return np.where(nodes < core, 0, 1 + ((nodes - core + 1) * max(k - 1, 1) - 1) // (n - core))
    if np.isfinite(d["size_alpha"]):
        return np.repeat(np.arange(k), dirichlet_sizes(rng, n, k, d["size_alpha"]))
    return ((nodes + 1) * k - 1) // n


def _block_values(d: dict, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and densities of a design's blocks."""
    k, core = int(d["K"]), d["stratum"] == "core_periphery"
    hi, lo = (d["centre_u"] + d["contrast_u"]) * SIGMA, (d["centre_u"] - d["contrast_u"]) * SIGMA
    s_b = SIGMA * k / (d["sigma_ratio"] + k - 1)
    p_b = d["p0"] * k / (d["rho"] + k - 1)
    parts = []
    for within, between in ((hi, lo), (d["sigma_ratio"] * s_b, s_b), (d["rho"] * p_b, p_b)):
        m = np.where(np.eye(k, dtype=bool), within, between)
        parts.append(m)
    if core:
        for m, (within, between) in zip((parts[0], parts[2]), ((hi, lo), (d["rho"] * p_b, p_b)), strict=True):
            m[:] = between
            m[0, :] = m[:, 0] = between + d["f"] * (within - between)
            m[0, 0] = within
    if d["stratum"] == "mixed":
        u = rng.uniform(min(lo, hi), max(lo, hi), (k, k))
        parts[0] = (u + u.T) / 2
    return parts[0], parts[1], np.clip(parts[2], 0, 1)


#: Numbers of the matrices that a task samples at once.
MATRICES = 1 << 20


def drawn_networks(rows: list[dict], n: int, radius: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """A symmetric matrix and the nodes' communities for each design, each drawn from its own seed; as ``block_sample``, all at once."""
    m, k = len(rows), max((int(d["K"]) for d in rows), default=0)
    w, chance, flips, z = np.empty((m, n, n)), np.empty((m, n, n)), np.ones((m, n, n)), np.empty((m, n), int)
    values = np.zeros((3, m, k, k))
    for i, d in enumerate(rows):
        rng = np.random.default_rng(int(d["seed"]))
        z[i] = _assigned(d, n, rng)
        for v, own in zip(values, _block_values(d, rng), strict=True):
            v[i, : len(own), : len(own)] = own
        rng.standard_normal(out=w[i])
        rng.random(out=chance[i])
        if float(d.get("frac_negative") or 0) > 0:
            rng.random(out=flips[i])
    at = np.arange(m)[:, None, None], z[:, :, None], z[:, None, :]
    w *= values[1][at]
    w += values[0][at]
    negative = np.array([float(d.get("frac_negative") or 0) for d in rows])[:, None, None]
    w = np.where(flips < negative, -np.abs(w), w)
    w = np.where((chance < values[2][at]) & np.tri(n, k=-1, dtype=bool).T, w, 0.0)
    w += w.transpose(0, 2, 1)
    now = np.abs(np.linalg.eigvalsh(w)).max(axis=1, initial=0.0)
    return w * np.divide(radius, now, out=np.ones(m), where=now > 0)[:, None, None], z


def _sampled(designs: DataFrame, n: int, radius: float, told: Callable[[np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, numbers: int) -> DataFrame:
    """What ``told`` makes of the ids, matrices and communities of a task's networks, some at a time; a network takes so many numbers."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            for k in range(0, len(rows), at := max(1, MATRICES // numbers)):
                yield told(pdf["id"].to_numpy()[k : k + at], *drawn_networks(rows[k : k + at], n, radius))

    return spread(designs).mapInPandas(build, schema)


def networks(designs: DataFrame, n: int = 60, radius: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """``net, src, dst, w`` and ``net, node, community`` of a network for each design (described parameters)."""

    def told(ids: np.ndarray, w: np.ndarray, z: np.ndarray) -> pd.DataFrame:
        at, src, dst = np.nonzero(w)
        edges = pd.DataFrame({"net": ids[at], "src": src, "dst": dst, "w": w[at, src, dst]})
        return pd.concat([edges, pd.DataFrame({"net": np.repeat(ids, n), "src": np.tile(np.arange(n), len(ids)), "dst": -1 - z.ravel(), "w": 0.0})])  # nodes' communities, as -1 - z

    rows = cut(_sampled(designs, n, radius, told, "net long, src int, dst int, w double", 8 * n * n))  # sampled once for all measures
    return rows.filter("dst >= 0"), rows.filter("dst < 0").select("net", F.col("src").alias("node"), (-1 - F.col("dst")).alias("community"))


def network_sizes(designs: DataFrame, n: int = 60, radius: float = 0.9) -> DataFrame:
    """``net, edges, top, negative, communities`` of a network for each design: edges in both directions, largest weight, share
    of negative ones, communities found. A network stays in the task that draws it; one without edges gives no row."""

    def told(ids: np.ndarray, w: np.ndarray, z: np.ndarray) -> pd.DataFrame:
        edges = np.count_nonzero(w, axis=(1, 2))
        ordered = np.sort(z, axis=1)
        out = pd.DataFrame({"net": ids, "edges": edges, "top": np.abs(w).max(axis=(1, 2)), "negative": (w < 0).sum(axis=(1, 2)) / np.maximum(edges, 1), "communities": 1 + (np.diff(ordered, axis=1) > 0).sum(axis=1)})
        return out[edges > 0]

    return _sampled(designs, n, radius, told, "net long, edges long, top double, negative double, communities long", 8 * n * n)


def described(designs: DataFrame, n: int, radius: float = 0.9) -> DataFrame:
    """``net`` and the eight measures of a network of n nodes for each design; rows with a value that isn't finite are left out.

    Networks are small, so each is measured whole in the task that draws it: nothing is shuffled but the designs.
    """

    def told(ids: np.ndarray, w: np.ndarray, z: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"net": ids, **graph.measured(w, z)})

    rows = _sampled(designs, n, radius, told, f"net long, {', '.join(f'{m} double' for m in MEASURES)}", n * n * n)
    return rows.filter(graph.is_finite(*MEASURES))


#: The eight measures of a network.
MEASURES = ("modularity", "participation", "clustering", "efficiency", "cv_strength", "cv_betweenness", "lambda_ratio", "frac_negative")


def ornstein_uhlenbeck(keys: DataFrame, steps: int, dims: int = 10, theta: float = 0.15) -> DataFrame:
    """``id, t, u``: x <- x (1 - theta) + sqrt(2 theta) noise, each component standardised over its series."""

    def walk(batches):
        for pdf in batches:
            for i in pdf["id"]:
                noise, x = np.random.default_rng(int(i)).standard_normal((steps, dims)), np.zeros((steps, dims))
                for t in range(steps):
                    x[t] = (x[t - 1] if t else 0) * (1 - theta) + np.sqrt(2 * theta) * noise[t]
                z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
                yield pd.DataFrame({"id": i, "t": np.arange(steps, dtype=np.int32), "u": list(z)})

    return spread(keys.select("id")).mapInPandas(walk, "id long, t int, u array<double>")


def mackey_glass(keys: DataFrame, steps: int, tau: int = 17, a: float = 0.2, b: float = 0.1, n: int = 10, h: float = 1.0) -> DataFrame:
    """``id, t, x`` of the delay equation x' = a x(t - tau) / (1 + x(t - tau)^n) - b x by fourth-order steps.

    The delayed value is held during a step; histories start from the id's own constant in [1.1, 1.3).
    """

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                lag = max(1, round(tau / h))
                x = np.empty(steps + lag + 1)
                x[: lag + 1] = 1.1 + 0.2 * np.random.default_rng(int(i)).random()
                for t in range(lag, steps + lag):
                    push = a * x[t - lag] / (1 + x[t - lag] ** n)
                    k1 = push - b * x[t]
                    k2 = push - b * (x[t] + h * k1 / 2)
                    k3 = push - b * (x[t] + h * k2 / 2)
                    x[t + 1] = x[t] + h * (k1 + 2 * k2 + 2 * k3 + push - b * (x[t] + h * k3)) / 6
                yield pd.DataFrame({"id": i, "t": np.arange(steps, dtype=np.int32), "x": x[lag + 1 :]})

    return spread(keys.select("id")).mapInPandas(run, "id long, t int, x double")
