"""Structural measures of weighted block networks, on edge lists.

Edges are ``net, src, dst, w`` in both directions without self-loops; nodes are ``net, node, community``. A
missing edge is a zero. All measures are grouped by network, so one plan describes any number of networks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators import spectra
from braidwork.session import cut


def symmetrised(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, weights of a pair added, self-loops left out."""
    edges = edges.filter("src <> dst")
    back = edges.select("net", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("net", "src", "dst", "w").union(back).groupBy("net", "src", "dst").agg(F.sum("w").alias("w"))


def scaled(edges: DataFrame) -> DataFrame:
    """Weights as shares of the network's largest absolute weight."""
    top = edges.groupBy("net").agg(F.max(F.abs("w")).alias("top"))
    return edges.join(top, "net").select("net", "src", "dst", (F.col("w") / F.col("top")).alias("w"))


def above_mean(edges: DataFrame) -> DataFrame:
    """The edges that are heavier than their network's mean edge."""
    return _with_mean(edges).filter(F.col("w") > F.col("mean")).select("net", "src", "dst", "w")


def centred(edges: DataFrame) -> DataFrame:
    """Signed weights: each less its network's mean edge; exact zeros go."""
    return _with_mean(edges).select("net", "src", "dst", (F.col("w") - F.col("mean")).alias("w")).filter("w <> 0")


def _with_mean(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("net").agg(F.avg("w").alias("mean")), "net")


def strengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``net, node, community, strength`` with 0 for isolated nodes."""
    s = edges.groupBy("net", F.col("src").alias("node")).agg(F.sum(F.abs("w")).alias("strength"))
    return nodes.join(s, ["net", "node"], "left").withColumn("strength", F.coalesce("strength", F.lit(0.0)))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the communities r and s of their ends."""
    r = nodes.select("net", F.col("node").alias("src"), F.col("community").alias("r"))
    s = nodes.select("net", F.col("node").alias("dst"), F.col("community").alias("s"))
    return edges.join(r, ["net", "src"]).join(s, ["net", "dst"])


def cv(value: str) -> Column:
    """Population standard deviation over mean; 0 unless the mean is positive."""
    return F.when(F.avg(value) > 0, F.stddev_pop(value) / F.avg(value)).otherwise(0.0)


def modularity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the planted partition on |w|: the sum over communities of inside / total - (strength / total)^2."""
    inside = labelled(edges, nodes).filter("r = s").groupBy("net", F.col("r").alias("community")).agg(F.sum(F.abs("w")).alias("inside"))
    parts = strengths(edges, nodes).groupBy("net", "community").agg(F.sum("strength").alias("strength"))
    totals = parts.groupBy("net").agg(F.sum("strength").alias("total"))
    share = F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.pow(F.col("strength") / F.col("total"), 2)
    joined = parts.join(inside, ["net", "community"], "left").join(totals, "net")
    return joined.groupBy("net").agg(F.sum(F.when(F.col("total") > 0, share).otherwise(0.0)).alias("modularity"))


def participation(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean over nodes of 1 - sum over communities of (strength into it / strength)^2; an isolated node gives 1."""
    into = labelled(edges, nodes).groupBy("net", F.col("src").alias("node"), "s").agg(F.sum(F.abs("w")).alias("k"))
    into = into.groupBy("net", "node").agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    joined = strengths(edges, nodes).join(into, ["net", "node"], "left")
    own = F.when(F.col("strength") > 0, 1 - F.col("squares") / (F.col("strength") * F.col("strength"))).otherwise(1.0)
    return joined.groupBy("net").agg(F.avg(own).alias("participation"))


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean unweighted local transitivity; a node of degree under 2 gives 0.

    Edges are turned to their end of the higher degree, so the wedges that are joined with edges are few at
    hubs: the heaviest node starts no wedge of its many neighbours.
    """
    degree = edges.groupBy("net", "src").agg(F.count("*").alias("degree"))
    ends = edges.select("net", "src", "dst").join(degree, ["net", "src"]).join(degree.select("net", F.col("src").alias("dst"), F.col("degree").alias("other")), ["net", "dst"])
    up = ends.filter(F.struct("degree", "src") < F.struct("other", "dst")).select("net", F.col("src").alias("a"), F.col("dst").alias("b"))
    wedge = up.alias("x").join(up.alias("y"), (F.col("x.net") == F.col("y.net")) & (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b")))
    wedge = wedge.select(F.col("x.net").alias("net"), F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    close = edges.select("net", F.col("src").alias("b"), F.col("dst").alias("c"))
    corner = wedge.join(close, ["net", "b", "c"]).select("net", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("net", "node").agg(F.count("*").alias("triangles"))
    joined = nodes.select("net", "node").join(degree.withColumnRenamed("src", "node"), ["net", "node"], "left").join(corner, ["net", "node"], "left")
    local = F.when(F.col("degree") > 1, 2 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return joined.groupBy("net").agg(F.avg(local).alias("clustering"))


def strength_cv(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return strengths(edges, nodes).groupBy("net").agg(cv("strength").alias("cv_strength"))


def frac_negative(edges: DataFrame) -> DataFrame:
    """Share of the edges with a negative weight."""
    return edges.filter("w <> 0").groupBy("net").agg(F.avg((F.col("w") < 0).cast("double")).alias("frac_negative"))


def _lengths(edges: DataFrame) -> DataFrame:
    """``net, src, dst, d``: a path is as long as the sum of 1 / |w| of its edges."""
    return edges.filter("w <> 0").select("net", "src", "dst", (1 / F.abs("w")).alias("d"))


def geodesics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``net, src, dst, d``: the shortest distance of every pair of nodes with a path, and 0 from a node to itself.

    Frontiers are relaxed: only distances that the last round made shorter meet the edges at their end, and what they
    bring is held against what is known. So a pair's work is about the edges of its end, not the nodes of its network; the
    rounds are the edges on the longest of the shortest paths. A pair is a row, and no network is one task's work.
    """
    lengths = cut(_lengths(edges).groupBy("net", "src", "dst").agg(F.min("d").alias("step")).select("net", F.col("src").alias("dst"), F.col("dst").alias("far"), "step"))
    known = cut(nodes.select("net", F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("d")).distinct())
    front = known
    while True:
        reached = front.join(lengths, ["net", "dst"]).groupBy("net", "src", F.col("far").alias("dst")).agg(F.min(F.col("d") + F.col("step")).alias("new"))
        met = cut(known.join(reached, ["net", "src", "dst"], "full"))
        shorter = F.col("new").isNotNull() & (F.col("d").isNull() | (F.col("new") < F.col("d")))
        front = met.filter(shorter).select("net", "src", "dst", F.col("new").alias("d"))
        if front.isEmpty():
            return known
        known = met.select("net", "src", "dst", F.least("d", "new").alias("d"))


def efficiency(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``net, efficiency``: the mean of 1 / distance over all ordered pairs of nodes, 0 for pairs without a path."""
    inverse = paths.filter("src <> dst").groupBy("net").agg(F.sum(1 / F.col("d")).alias("inverse"))
    n = nodes.groupBy("net").agg(F.count("*").alias("n"))
    mean = F.coalesce("inverse", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))
    return n.join(inverse, "net", "left").select("net", F.when(F.col("n") > 1, mean).otherwise(0.0).alias("efficiency"))


#: Paths whose lengths differ by less than this share are equally short.
SAME = 1e-12


def tight_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``net, src, mid, dst``: the edges from mid to dst that end a shortest path from src."""
    last = _lengths(edges).select("net", F.col("src").alias("mid"), "dst", F.col("d").alias("step"))
    start = paths.select("net", "src", F.col("dst").alias("mid"), F.col("d").alias("upto"))
    met = start.join(last, ["net", "mid"]).join(paths, ["net", "src", "dst"])
    return cut(met.filter(F.col("upto") + F.col("step") <= F.col("d") * (1 + SAME)).select("net", "src", "mid", "dst"))


def path_counts(tight: DataFrame, paths: DataFrame) -> DataFrame:
    """``net, src, dst, n``: how many shortest paths a pair of nodes has.

    Paths are counted by their number of edges, until no shortest path has one more.
    """
    some = cut(paths.filter("src = dst").select("net", "src", "dst", F.lit(1.0).alias("n")))
    every = some
    while not some.isEmpty():
        some = cut(some.withColumnRenamed("dst", "mid").join(tight, ["net", "src", "mid"]).groupBy("net", "src", "dst").agg(F.sum("n").alias("n")))
        every = every.union(some)
    return cut(every.groupBy("net", "src", "dst").agg(F.sum("n").alias("n")))


def dependencies(tight: DataFrame, counts: DataFrame) -> DataFrame:
    """``net, src, node, passed``: how many pairs from src send their shortest paths through a node, by shares of paths.

    Brandes' backward accumulation, for all sources at once: each end of a path hands what it holds to the nodes
    before it, in proportion to their counts of paths; a round takes one edge, until only sources are left.
    """
    of = lambda name, n: counts.select("net", "src", F.col("dst").alias(name), F.col("n").alias(n))
    shares = cut(tight.filter("mid <> src").join(of("mid", "near"), ["net", "src", "mid"]).join(of("dst", "all"), ["net", "src", "dst"]).select("net", "src", "mid", "dst", (F.col("near") / F.col("all")).alias("share")))
    held = counts.filter("src <> dst").select("net", "src", "dst", F.lit(1.0).alias("held"))
    every = held.limit(0)
    while not held.isEmpty():
        held = cut(held.join(shares, ["net", "src", "dst"]).groupBy("net", "src", F.col("mid").alias("dst")).agg(F.sum(F.col("held") * F.col("share")).alias("held")))
        every = every.union(held)
    return every.groupBy("net", "src", F.col("dst").alias("node")).agg(F.sum("held").alias("passed"))


def betweenness(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``net, node, betweenness``: of every unordered pair of others, the share of its shortest paths that pass the node."""
    tight = tight_edges(edges, paths)
    share = dependencies(tight, path_counts(tight, paths)).groupBy("net", "node").agg((F.sum("passed") / 2).alias("betweenness"))
    return nodes.select("net", "node").join(share, ["net", "node"], "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))


def betweenness_cv(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    return betweenness(edges, nodes, paths).groupBy("net").agg(cv("betweenness").alias("cv_betweenness"))


def lambda_ratio(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``net, lambda_ratio``: the second largest size of an eigenvalue of the signed matrix over the largest."""
    return spectra.second_share(edges, nodes)


def all_descriptors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All eight measures, a row per network."""
    paths = geodesics(edges, nodes)
    out = modularity(edges, nodes)
    for part in (participation(edges, nodes), clustering(edges, nodes), efficiency(paths, nodes), strength_cv(edges, nodes), betweenness_cv(edges, nodes, paths), lambda_ratio(edges, nodes), frac_negative(edges)):
        out = out.join(part, "net", "left")
    return out.withColumn("frac_negative", F.coalesce("frac_negative", F.lit(0.0)))


def measured(w: np.ndarray, community: np.ndarray) -> dict[str, np.ndarray]:
    """The eight measures of small networks of equally many nodes: symmetric matrices ``w`` (network, node, node) and the
    nodes' communities. The same as ``all_descriptors``, whole networks at once in a task; a row of paths is n x n numbers.
    """
    n = w.shape[1]
    size = np.abs(w)
    there = size > 0
    strength = size.sum(axis=2)
    total = strength.sum(axis=1)
    member = (community[:, :, None] == np.arange(community.max(initial=0) + 1)).astype(float)
    into = size @ member
    share = lambda x, y: np.divide(x, y, out=np.zeros(np.broadcast_shapes(x.shape, y.shape)), where=y > 0)
    out = {"modularity": (share((member * into).sum(axis=1), total[:, None]) - share((member * strength[:, :, None]).sum(axis=1), total[:, None]) ** 2).sum(axis=1)}
    out["participation"] = (1 - share((into * into).sum(axis=2), strength * strength)).mean(axis=1)
    degree = there.sum(axis=2)
    links = there.astype(float)
    out["clustering"] = share(((links @ links) * links).sum(axis=2), (degree * (degree - 1)).astype(float)).mean(axis=1)
    step = np.divide(1.0, size, out=np.full(w.shape, np.inf), where=there)
    far = _relaxed(step)
    inverse = np.divide(1.0, far, out=np.zeros(w.shape), where=np.isfinite(far) & (far > 0))
    out["efficiency"] = inverse.sum(axis=(1, 2)) / max(n * (n - 1), 1)
    out["cv_strength"] = _cv(strength)
    out["cv_betweenness"] = _cv(_between(step, far))
    sizes = np.sort(np.abs(np.linalg.eigvalsh(w)), axis=1)
    out["lambda_ratio"] = share(sizes[:, -2], sizes[:, -1]) if n > 1 else np.zeros(len(w))
    out["frac_negative"] = share((w < 0).sum(axis=(1, 2)).astype(float), there.sum(axis=(1, 2)).astype(float))
    return out


def _cv(x: np.ndarray) -> np.ndarray:
    mean = x.mean(axis=1)
    return np.divide(x.std(axis=1), mean, out=np.zeros(len(x)), where=mean > 0)


def _relaxed(step: np.ndarray) -> np.ndarray:
    """Shortest distances of all pairs of nodes, from the lengths of edges: relaxed until nothing gets shorter."""
    far = np.full(step.shape, np.inf)
    far[:, np.arange(step.shape[1]), np.arange(step.shape[1])] = 0.0
    while True:
        new = far.copy()
        for mid in range(step.shape[1]):
            np.minimum(new, far[:, :, mid, None] + step[:, None, mid, :], out=new)
        if np.array_equal(new, far):
            return far
        far = new


def _between(step: np.ndarray, far: np.ndarray) -> np.ndarray:
    """``network, node``: of every unordered pair of others, the share of its shortest paths that pass the node (Brandes)."""
    n = step.shape[1]
    tight = (np.isfinite(step)[:, None] & np.isfinite(far)[..., None] & (far[..., None] + step[:, None] <= far[:, :, None, :] * (1 + SAME))).astype(float)  # network, source, before the end, end
    some = np.broadcast_to(np.eye(n), step.shape)
    ways = some.copy()
    while some.any():
        some = (some[:, :, None, :] @ tight)[:, :, 0, :]
        ways += some
    shares = tight * np.divide(ways[..., None], ways[:, :, None, :], out=np.zeros(tight.shape), where=ways[:, :, None, :] > 0)
    shares[:, np.arange(n), np.arange(n)] = 0.0  # a source isn't passed
    held = ((ways > 0) & ~np.eye(n, dtype=bool)).astype(float)
    passed = np.zeros(step.shape)
    while held.any():
        held = (shares @ held[..., None])[..., 0]
        passed += held
    return passed.sum(axis=1) / 2


def is_finite(*columns: str) -> Column:
    """Whether all columns hold finite numbers."""
    return _all([F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in columns])


def descriptors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All eight measures; rows with a value that isn't finite are left out."""
    out = all_descriptors(edges, nodes)
    return out.filter(is_finite(*[c for c in out.columns if c != "net"]))


def rejects(rows: DataFrame, *columns: str) -> DataFrame:
    """``kept, rejected``: how many rows have finite numbers in all columns, and how many haven't."""
    kept = F.count_if(is_finite(*columns))
    return rows.agg(kept.alias("kept"), (F.count("*") - kept).alias("rejected"))


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def block_sizes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("net", "community").agg(F.count("*").alias("n"))


def block_grid(nodes: DataFrame) -> DataFrame:
    """All pairs of communities r, s of a network with their sizes."""
    n = block_sizes(nodes)
    r, s = (n.select("net", F.col("community").alias(x), F.col("n").alias(f"n_{x}")) for x in "rs")
    return r.join(s, "net")


def block_values(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``net, r, s, mean, sd, density`` over the edges that exist; 0 where there are none (sd: fewer than two).

    The density's denominator counts all cells of a block, its diagonal too.
    """
    found = labelled(edges.filter("w <> 0"), nodes).groupBy("net", "r", "s").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"), F.count("*").alias("edges"))
    out = block_grid(nodes).join(found, ["net", "r", "s"], "left")
    return out.select(
        "net",
        "r",
        "s",
        F.coalesce("mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("edges") > 1, F.col("sd")).otherwise(0.0).alias("sd"),
        (F.coalesce("edges", F.lit(0)) / (F.col("n_r") * F.col("n_s"))).alias("density"),
    )


def motif(rr: Column, ss: Column, rs: Column, tol: float = 1e-12) -> Column:
    """Class of a pair of communities from its three block values."""
    return (
        F.when((F.abs(rr - rs) <= tol) & (F.abs(ss - rs) <= tol), "degenerate")
        .when(F.least(rr, ss) > rs, "assortative")
        .when(rs > F.greatest(rr, ss), "disassortative")
        .otherwise("core_periphery")
    )


def motifs(blocks: DataFrame, value: str) -> DataFrame:
    """``net, r, s, motif`` of every pair r < s of ``blocks`` (net, r, s, value)."""
    inner = blocks.filter("r = s")
    rr = inner.select("net", "r", F.col(value).alias("rr"))
    ss = inner.select("net", "s", F.col(value).alias("ss"))
    return blocks.filter("r < s").join(rr, ["net", "r"]).join(ss, ["net", "s"]).select("net", "r", "s", motif(F.col("rr"), F.col("ss"), F.col(value)).alias("motif"))


def cores(blocks: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """``net, node, community, is_core``: the core is the community of the largest inner value, the first on ties."""
    core = blocks.filter("r = s").groupBy("net").agg(F.max_by("r", F.struct(F.col(value), -F.col("r"))).alias("core"))
    return nodes.join(core, "net").select("net", "node", "community", (F.col("community") == F.col("core")).alias("is_core"))


def with_inputs(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges and those from input nodes -1, -2, ... (``net, input, dst, w``), for display."""
    return edges.select("net", "src", "dst", "w").union(weights.select("net", (-1 - F.col("input")).alias("src"), "dst", "w"))


def display_edges(edges: DataFrame, least: float = 0.01) -> DataFrame:
    """Edges above a display threshold once each, with |w| scaled from the network's least to its greatest."""
    shown = edges.filter((F.abs("w") > least) & (F.col("src") < F.col("dst"))).withColumn("a", F.abs("w"))
    ends = shown.groupBy("net").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    alpha = F.when(F.col("hi") > F.col("lo"), (F.col("a") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return shown.join(ends, "net").select("net", "src", "dst", "w", F.least(F.greatest(alpha, F.lit(0.0)), F.lit(1.0)).alias("alpha"))
