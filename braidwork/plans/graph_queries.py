"""Queries over the nation trade graph: its structure against regions as the planted partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import graph as g
from braidwork.operators import spectra
from braidwork.plans.spectra import spectrum
from braidwork.sources.trade import nations, supply_edges, supply_lines, trade_edges


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns if c != "net"])


def graph_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.modularity(trade_edges(spark, sf_dir), nations(spark, sf_dir)), "modularity")


def graph_participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.participation(g.above_mean(trade_edges(spark, sf_dir)), nations(spark, sf_dir)), "participation")


def graph_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.clustering(g.above_mean(trade_edges(spark, sf_dir)), nations(spark, sf_dir)), "clustering")


def graph_strength_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.strength_cv(trade_edges(spark, sf_dir), nations(spark, sf_dir)), "cv_strength")


def graph_frac_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.frac_negative(g.centred(trade_edges(spark, sf_dir))), "frac_negative")


def graph_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = trade_edges(spark, sf_dir), nations(spark, sf_dir)
    return _round(g.efficiency(g.geodesics(edges, nodes), nodes), "efficiency")


def graph_betweenness_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, nodes = trade_edges(spark, sf_dir), nations(spark, sf_dir)
    return _round(g.betweenness_cv(edges, nodes, g.geodesics(edges, nodes)), "cv_betweenness")


def graph_lambda_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.lambda_ratio(g.centred(trade_edges(spark, sf_dir)), nations(spark, sf_dir)), "lambda_ratio")


def display_with_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade edges for display together with those from the regions as input nodes -1, -2, ..., one to each of their nations."""
    inputs = nations(spark, sf_dir).select("net", F.col("community").alias("input"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    return _round(g.with_inputs(g.above_mean(trade_edges(spark, sf_dir)).filter("src < dst"), inputs), "w")


def supply_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectral radius of the network of suppliers and parts, whose edges are the quantities between them."""
    try:
        found = spectra.two_sided(supply_lines(spark, sf_dir))
    except spectra.TooWide:
        edges = supply_edges(spark, sf_dir)
        return spectra.radius(edges, edges.select("net", F.col("src").alias("node")).distinct()).select(F.round("radius", 4).alias("radius"))
    return spark.createDataFrame([(found,)], "radius double").select(F.round("radius", 4).alias("radius"))


def graph_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = g.descriptors(g.centred(trade_edges(spark, sf_dir)), nations(spark, sf_dir))
    return _round(out, *[c for c in out.columns if c != "net"])


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.block_values(g.above_mean(trade_edges(spark, sf_dir)), nations(spark, sf_dir))


def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_blocks(spark, sf_dir).select("net", "r", "s", "mean"), "mean")


def block_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_blocks(spark, sf_dir).select("net", "r", "s", "sd"), "sd")


def block_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_blocks(spark, sf_dir).select("net", "r", "s", "density"), "density")


def block_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.motifs(_blocks(spark, sf_dir), "mean").drop("net")


def density_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.motifs(_blocks(spark, sf_dir), "density").drop("net")


def core_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cores(_blocks(spark, sf_dir), nations(spark, sf_dir), "mean").drop("net")


def display_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(g.display_edges(trade_edges(spark, sf_dir), 0.2), "w", "alpha")


QUERIES = {
    f.__name__: f
    for f in (
        graph_modularity, graph_participation, graph_clustering, graph_strength_cv, graph_frac_negative, graph_efficiency,
        graph_betweenness_cv, graph_lambda_ratio, display_with_inputs, supply_radius, graph_descriptors, block_mean, block_sd, block_density, block_motifs, density_motifs, core_nodes, display_edges,
    )
}

GRAPH = """
rev AS (SELECT s_nationkey AS a, c_nationkey AS b, sum(l_extendedprice * (1 - l_discount)) AS r
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
sym AS (SELECT a, b, sum(r) AS w FROM (SELECT a, b, r FROM rev UNION ALL SELECT b, a, r FROM rev) GROUP BY 1, 2),
e AS (SELECT a AS src, b AS dst, w / (SELECT max(w) FROM sym) AS w FROM sym),
heavy AS (SELECT * FROM e WHERE w > (SELECT avg(w) FROM e)),
signed AS (SELECT src, dst, w - (SELECT avg(w) FROM e) AS w FROM e WHERE w <> (SELECT avg(w) FROM e)),
node AS (SELECT n_nationkey AS node, n_regionkey AS z FROM nation)"""

_BLOCKS = """,
lab AS (SELECT x.z AS r, y.z AS s, w FROM heavy JOIN node x ON x.node = src JOIN node y ON y.node = dst),
size AS (SELECT z, count(*) AS n FROM node GROUP BY z),
blk AS (SELECT a.z AS r, b.z AS s, coalesce(avg(w), 0) AS mean, CASE WHEN count(w) > 1 THEN stddev_pop(w) ELSE 0 END AS sd,
               count(w) / CAST(a.n * b.n AS DOUBLE) AS density
        FROM size a CROSS JOIN size b LEFT JOIN lab ON lab.r = a.z AND lab.s = b.z GROUP BY a.z, b.z, a.n, b.n)"""

_MOTIF = """SELECT x.r, x.s, CASE WHEN abs(rr.{v} - x.{v}) <= 1e-12 AND abs(ss.{v} - x.{v}) <= 1e-12 THEN 'degenerate'
  WHEN least(rr.{v}, ss.{v}) > x.{v} THEN 'assortative' WHEN x.{v} > greatest(rr.{v}, ss.{v}) THEN 'disassortative' ELSE 'core_periphery' END AS motif
FROM blk x JOIN blk rr ON rr.r = x.r AND rr.s = x.r JOIN blk ss ON ss.r = x.s AND ss.s = x.s WHERE x.r < x.s"""

_PATHS = """,
d0 AS (SELECT src, dst, 1 / abs(w) AS d FROM e UNION ALL SELECT node, node, 0 FROM node),
d1 AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM d0 a JOIN d0 b ON a.dst = b.src GROUP BY 1, 2),
d2 AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM d1 a JOIN d1 b ON a.dst = b.src GROUP BY 1, 2),
d3 AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM d2 a JOIN d2 b ON a.dst = b.src GROUP BY 1, 2),
d4 AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM d3 a JOIN d3 b ON a.dst = b.src GROUP BY 1, 2),
d5 AS (SELECT a.src, b.dst, min(a.d + b.d) AS d FROM d4 a JOIN d4 b ON a.dst = b.src GROUP BY 1, 2)"""

_LAMBDA = f""",
sq AS MATERIALIZED (SELECT a.src AS i, b.dst AS j, sum(a.w * b.w) AS m FROM signed a JOIN signed b ON a.dst = b.src GROUP BY 1, 2),
{spectrum('one', 'sq')},
{spectrum('two', 'one_d')},
lam AS (SELECT sqrt((SELECT l FROM two_l) / (SELECT l FROM one_l)) AS lambda_ratio)"""

_SIGNED_PATHS = _PATHS.replace("FROM e UNION", "FROM signed UNION")

_ALL = f"""WITH {GRAPH}{_SIGNED_PATHS}{_LAMBDA},
tot AS (SELECT sum(abs(w)) AS m2 FROM signed),
st AS (SELECT node, z, coalesce(sum(abs(w)), 0) AS s FROM node LEFT JOIN signed ON src = node GROUP BY node, z),
sz AS (SELECT z, sum(s) AS s FROM st GROUP BY z),
ins AS (SELECT x.z, sum(abs(w)) AS i FROM signed JOIN node x ON x.node = src JOIN node y ON y.node = dst WHERE x.z = y.z GROUP BY x.z),
mo AS (SELECT sum(coalesce(i, 0) / m2 - (s / m2) * (s / m2)) AS modularity FROM sz LEFT JOIN ins USING (z), tot),
k AS (SELECT src AS node, z, sum(abs(w)) AS k FROM signed JOIN node y ON y.node = dst GROUP BY 1, 2),
p AS (SELECT node, 1 - sum(k * k) / (sum(k) * sum(k)) AS p FROM k GROUP BY node),
pa AS (SELECT avg(coalesce(p, 1)) AS participation FROM node LEFT JOIN p USING (node)),
deg AS (SELECT src AS node, count(*) AS k FROM signed GROUP BY src),
tri AS (SELECT a.src AS node, count(*) / 2 AS t FROM signed a JOIN signed b ON a.dst = b.src JOIN signed c ON c.src = b.dst AND c.dst = a.src GROUP BY a.src),
cl AS (SELECT avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END) AS clustering FROM node LEFT JOIN deg USING (node) LEFT JOIN tri USING (node)),
n AS (SELECT count(*) AS n FROM node),
ef AS (SELECT sum(1 / d) / (max(n) * (max(n) - 1)) AS efficiency FROM d5, n WHERE src <> dst),
cs AS (SELECT CASE WHEN avg(s) > 0 THEN stddev_pop(s) / avg(s) ELSE 0 END AS cv_strength FROM st),
b AS (SELECT v.node, count(*) AS b FROM node v JOIN d5 st ON st.src < st.dst AND v.node <> st.src AND v.node <> st.dst
      JOIN d5 sv ON sv.src = st.src AND sv.dst = v.node JOIN d5 vt ON vt.src = v.node AND vt.dst = st.dst WHERE abs(sv.d + vt.d - st.d) <= 1e-9 * st.d GROUP BY v.node),
c AS (SELECT coalesce(b, 0) AS b FROM node LEFT JOIN b USING (node)),
cb AS (SELECT CASE WHEN avg(b) > 0 THEN stddev_pop(b) / avg(b) ELSE 0 END AS cv_betweenness FROM c),
fn AS (SELECT avg(CASE WHEN w < 0 THEN 1.0 ELSE 0.0 END) AS frac_negative FROM signed)
SELECT round(modularity, 6) + 0.0 AS modularity, round(participation, 6) AS participation, round(clustering, 6) AS clustering, round(efficiency, 6) AS efficiency,
       round(cv_strength, 6) AS cv_strength, round(cv_betweenness, 6) AS cv_betweenness, round(lambda_ratio, 6) AS lambda_ratio, round(frac_negative, 6) AS frac_negative
FROM mo, pa, cl, ef, cs, cb, lam, fn"""

ORACLES = {
    "display_with_inputs": f"WITH {GRAPH} SELECT src, dst, round(w, 6) + 0.0 AS w FROM heavy WHERE src < dst UNION ALL SELECT -1 - z, node, 1.0 FROM node",
    "supply_radius": """WITH RECURSIVE e AS MATERIALIZED (SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
v AS (SELECT 0 AS k, p, 1.0::DOUBLE AS x FROM (SELECT DISTINCT p FROM e)
UNION ALL SELECT any_value(y.k) + 1, e.p, sum(e.w * y.y) / 1e6 FROM e JOIN (SELECT any_value(v.k) AS k, e.s, sum(e.w * v.x) AS y FROM v JOIN e USING (p) WHERE v.k < 40 GROUP BY e.s) y USING (s) GROUP BY e.p)
SELECT round(sqrt(sum(a.x * b.x) / sum(a.x * a.x) * 1e6), 4) AS radius FROM v a JOIN v b ON a.p = b.p AND a.k = 39 AND b.k = 40""",
    "graph_lambda_ratio": f"WITH {GRAPH}{_LAMBDA} SELECT round(lambda_ratio, 6) AS lambda_ratio FROM lam",
    "graph_descriptors": _ALL,
    "graph_modularity": f"""WITH {GRAPH},
tot AS (SELECT sum(w) AS m2 FROM e),
st AS (SELECT z, sum(w) AS s FROM e JOIN node ON node = src GROUP BY z),
ins AS (SELECT x.z, sum(w) AS i FROM e JOIN node x ON x.node = src JOIN node y ON y.node = dst WHERE x.z = y.z GROUP BY x.z)
SELECT round(sum(coalesce(i, 0) / m2 - (s / m2) * (s / m2)), 6) + 0.0 AS modularity FROM st LEFT JOIN ins USING (z), tot""",
    "graph_participation": f"""WITH {GRAPH},
k AS (SELECT src AS node, z, sum(w) AS k FROM heavy JOIN node y ON y.node = dst GROUP BY 1, 2),
p AS (SELECT node, 1 - sum(k * k) / (sum(k) * sum(k)) AS p FROM k GROUP BY node)
SELECT round(avg(coalesce(p, 1)), 6) AS participation FROM node LEFT JOIN p USING (node)""",
    "graph_clustering": f"""WITH {GRAPH},
deg AS (SELECT src AS node, count(*) AS k FROM heavy GROUP BY src),
tri AS (SELECT a.src AS node, count(*) / 2 AS t FROM heavy a JOIN heavy b ON a.dst = b.src JOIN heavy c ON c.src = b.dst AND c.dst = a.src GROUP BY a.src)
SELECT round(avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 6) AS clustering FROM node LEFT JOIN deg USING (node) LEFT JOIN tri USING (node)""",
    "graph_strength_cv": f"""WITH {GRAPH}, s AS (SELECT node, coalesce(sum(w), 0) AS s FROM node LEFT JOIN e ON src = node GROUP BY node)
SELECT round(CASE WHEN avg(s) > 0 THEN stddev_pop(s) / avg(s) ELSE 0 END, 6) AS cv_strength FROM s""",
    "graph_frac_negative": f"WITH {GRAPH} SELECT round(avg(CASE WHEN w < 0 THEN 1.0 ELSE 0.0 END), 6) AS frac_negative FROM signed",
    "graph_efficiency": f"""WITH {GRAPH}{_PATHS}, n AS (SELECT count(*) AS n FROM node)
SELECT round(sum(1 / d) / (max(n) * (max(n) - 1)), 6) AS efficiency FROM d5, n WHERE src <> dst""",
    "graph_betweenness_cv": f"""WITH {GRAPH}{_PATHS},
b AS (SELECT v.node, count(*) AS b FROM node v JOIN d5 st ON st.src < st.dst AND v.node <> st.src AND v.node <> st.dst
      JOIN d5 sv ON sv.src = st.src AND sv.dst = v.node JOIN d5 vt ON vt.src = v.node AND vt.dst = st.dst
      WHERE abs(sv.d + vt.d - st.d) <= 1e-9 * st.d GROUP BY v.node),
c AS (SELECT coalesce(b, 0) AS b FROM node LEFT JOIN b USING (node))
SELECT round(CASE WHEN avg(b) > 0 THEN stddev_pop(b) / avg(b) ELSE 0 END, 6) AS cv_betweenness FROM c""",
    "block_mean": f"WITH {GRAPH}{_BLOCKS} SELECT r, s, round(mean, 6) AS mean FROM blk",
    "block_sd": f"WITH {GRAPH}{_BLOCKS} SELECT r, s, round(sd, 6) AS sd FROM blk",
    "block_density": f"WITH {GRAPH}{_BLOCKS} SELECT r, s, round(density, 6) AS density FROM blk",
    "block_motifs": f"WITH {GRAPH}{_BLOCKS} {_MOTIF.format(v='mean')}",
    "density_motifs": f"WITH {GRAPH}{_BLOCKS} {_MOTIF.format(v='density')}",
    "core_nodes": f"""WITH {GRAPH}{_BLOCKS}, core AS (SELECT r FROM blk WHERE r = s ORDER BY mean DESC, r LIMIT 1)
SELECT node, z AS community, z = (SELECT r FROM core) AS is_core FROM node""",
    "display_edges": f"""WITH {GRAPH}, shown AS (SELECT * FROM e WHERE abs(w) > 0.2 AND src < dst)
SELECT src, dst, round(w, 6) AS w, round((abs(w) - (SELECT min(abs(w)) FROM shown)) / (SELECT max(abs(w)) - min(abs(w)) FROM shown), 6) AS alpha FROM shown""",
}
