"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Equal vectors are one node. Nodes are dealt into shards of bounded size, and each shard gets a graph of layers
of decreasing size, built by inserting nodes in batches: a batch descends the layers, searches each with a
beam, and links to diverse neighbours; nodes that thinning cut off are bridged again, so that a beam as wide as
the shard sees all of it. Then the beam is widened until an audit passes: nodes turned away to a cosine at the
very threshold must find all that is within it, which tests the graph however rare duplicates are.

Every shard is then queried with all nodes, which stream past it. A node's beam is doubled for as long as all
that it holds is similar enough; and a batch's beams are doubled until a second audit, in which a sample of the
batch is compared with the whole shard, misses nothing. Links come from the graph alone at every size; the audits'
recall at the first width is a result of its own (``linked``).

What a beam brings is verified by cosine in double precision. A batch gives each of its nodes' number of links
and one partner, and a shard the forest of its own linked nodes, so a group of n alike nodes costs n rows for
each shard and not n * n.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths never link; a row without an id links with nothing and is kept; rows that repeat an
id are vectors of their own for n_links and share a component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import common, cut, few, joined, read, small_batches
from braidwork.llm.components import components

#: Nodes for which a table gets one more shard, up to so many shards; most numbers of a shard (rows times dimensions); queries that share a copy of a shard; fewest tasks.
SHARD_LEAST, SHARDS, SHARD_NUMBERS, QUERIES, TASKS = 8192, 12, 12_800_000, 262_144, 12
#: Links of a node in upper layers (twice as many in the lowest), beam while building, first beam while querying.
LINKS, BUILD_BEAM, BEAM = 12, 32, 24
#: Nodes of a shard turned away for its audit and the share of links they must find; nodes audited in a batch.
TURNED, RECALL, AUDIT = 256, 0.99, 48


class Graph:
    """Unit vectors with neighbour lists by layer; -1 fills a list."""

    def __init__(self, x: np.ndarray, seed: int = 0):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        n = len(x)
        level = np.minimum(np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 6)
        order = np.arange(n)
        self.entry = int(level.argmax()) if n else 0
        order[[0, self.entry]] = order[[self.entry, 0]]  # the highest node comes first
        self.layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(level.max(initial=0) + 1)]
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(done, 512))]
            self._insert(batch, level)
            done += len(batch)
        self._bridge()

    def _bridge(self) -> None:
        """One more link for some nodes of the lowest layer, so that all nodes are reached from the entry."""
        n, lists = len(self.x), self.layers[0]
        bridge, seen = np.full(n, -1, np.int32), np.zeros(n, bool)

        def reach(front: np.ndarray) -> None:
            while len(front):
                seen[front] = True
                front = np.unique(lists[front])
                front = front[(front >= 0) & ~seen[front]]

        reach(np.array([self.entry][:n]))
        for u in range(n):
            if not seen[u]:
                near = [r for r in lists[u] if r >= 0 and seen[r]]
                r = next((r for r in near if bridge[r] < 0), self.entry)
                while bridge[r] >= 0:
                    r = bridge[r]
                bridge[r] = u
                reach(np.array([u]))
        if (bridge >= 0).any():
            self.layers[0] = np.column_stack([lists, bridge])

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        start = np.full((len(batch), 1), self.entry, np.int64)
        alike = self.x[batch] @ self.x[batch].T
        np.fill_diagonal(alike, -np.inf)
        for k in range(len(self.layers) - 1, -1, -1):
            deep = level[batch] >= k
            ids, sims = self.beam(self.x[batch], k, start, np.where(deep.any(), BUILD_BEAM, 1))
            start = ids[:, :1].copy()
            rows = np.flatnonzero(deep)
            if not len(rows):
                continue
            # the others of the batch in this layer are candidates too
            peers = np.argsort(-alike[np.ix_(rows, rows)], axis=1)[:, : LINKS * 2]
            peer_sims = np.take_along_axis(alike[np.ix_(rows, rows)], peers, 1)
            both = np.concatenate([ids[rows], np.where(np.isfinite(peer_sims), batch[rows][peers], -1)], axis=1)
            both_sims = np.concatenate([sims[rows], peer_sims], axis=1)
            chosen = self.diverse(both, both_sims, LINKS)
            self.layers[k][batch[rows], : chosen.shape[1]] = chosen
            self._back(k, np.repeat(batch[rows], chosen.shape[1]), chosen.ravel())

    def _back(self, k: int, new: np.ndarray, at: np.ndarray) -> None:
        """Links from the chosen neighbours back to the new nodes, thinned where a list is full."""
        new, at = new[at >= 0], at[at >= 0]
        order = np.argsort(at, kind="stable")
        new, at = new[order], at[order]
        nodes, first, count = np.unique(at, return_index=True, return_counts=True)
        lists = self.layers[k]
        most = lists.shape[1]
        wide = np.full((len(nodes), most + int(count.max(initial=0))), -1, np.int64)
        wide[:, :most] = lists[nodes]
        wide[np.repeat(np.arange(len(nodes)), count), most + np.arange(len(at)) - np.repeat(first, count)] = new
        used = (wide >= 0).sum(axis=1)
        roomy = used <= most
        packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)[:, :most]
        lists[nodes[roomy]] = packed[roomy]
        full = np.flatnonzero(~roomy)
        for part in np.array_split(full, max(1, len(full) // 256)):
            if len(part):
                ids = wide[part]
                sims = np.where(ids >= 0, np.einsum("nd,ncd->nc", self.x[nodes[part]], self.x[ids]), -np.inf)
                kept = self.diverse(ids, sims, most)
                lists[nodes[part]] = -1
                lists[nodes[part], : kept.shape[1]] = kept

    def diverse(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates the nearest that are no nearer to one chosen before; then the nearest of the rest."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids = np.where(np.isfinite(sims), ids, -1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        v = self.x[ids]
        near = np.einsum("nad,nbd->nab", v, v)
        n, c = ids.shape
        chosen, count = np.zeros((n, c), bool), np.zeros(n, int)
        for j in range(c):
            ok = (ids[:, j] >= 0) & (count < most) & ~(chosen[:, :j] & (near[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
            chosen[:, j] = ok
            count += ok
        score = np.where(chosen, 2, np.where(ids >= 0, 1, 0))
        # a third of the places at least goes to the nearest, so that clusters stay whole
        score[:, : most // 3] = np.where(ids[:, : most // 3] >= 0, 3, 0)
        pick = np.argsort(-score, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(np.where(score > 0, ids, -1), pick, 1)

    def beam(self, q: np.ndarray, layer: int, start: np.ndarray, width: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nodes found nearest to each query, nearest first, and their similarities."""
        width, rows, lists = int(width), np.arange(len(q)), self.layers[layer]
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        seen[:, -1] = True
        ids = np.full((len(q), max(width, start.shape[1])), -1, np.int64)
        sims = np.full(ids.shape, -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.einsum("nd,ncd->nc", q, self.x[start])
        sims[:, : start.shape[1]][start < 0] = -np.inf
        seen[rows[:, None], start] = True
        done = ~np.isfinite(sims)
        while len(rows):
            open_sims = np.where(done[rows], -np.inf, sims[rows])
            some = min(steps, open_sims.shape[1])
            at = np.argpartition(-open_sims, some - 1, axis=1)[:, :some]
            live = np.isfinite(np.take_along_axis(open_sims, at, 1))
            go = live.any(axis=1)
            rows, at, live = rows[go], at[go], live[go]
            if not len(rows):
                break
            done[rows[:, None], at] = True
            near = np.where(live[:, :, None], lists[np.take_along_axis(ids[rows], at, 1)], -1).reshape(len(rows), -1)
            fresh = ~seen[rows[:, None], near]
            seen[rows[:, None], near] = True
            near = np.where(fresh, near, -1)
            # one node may be next to several that are opened together
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            new = np.where(near >= 0, np.einsum("nd,ncd->nc", q[rows], self.x[near]), -np.inf).astype(np.float32)
            all_ids, all_sims = np.concatenate([ids[rows], near], axis=1), np.concatenate([sims[rows], new], axis=1)
            all_done = np.concatenate([done[rows], near < 0], axis=1)
            top = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[rows], sims[rows], done[rows] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_done))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def query(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full((len(q), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self.beam(q, layer, start, 4)[0]
        return self.beam(q, 0, start, width)

    def tuned(self, least: float, seed: int = 1) -> int:
        """The first width at which nodes turned away to the threshold find what lies within it."""
        rng, n = np.random.default_rng(seed), len(self.x)
        own = self.x[rng.permutation(n)[:TURNED]].astype(np.float64)
        away = rng.normal(size=own.shape)
        away -= (away * own).sum(axis=1, keepdims=True) * own
        size = np.linalg.norm(away, axis=1, keepdims=True)
        q = (least * own + np.sqrt(1 - least * least) * away / np.where(size > 0, size, 1)).astype(np.float32)
        near = least - 1e-4
        true = (q @ self.x.T >= near).sum(axis=1)
        width = BEAM
        while width < n:
            got = np.bincount(self._beams(q, near, width)[0], minlength=len(q))
            if np.mean(np.minimum(got / np.maximum(true, 1), 1)) >= RECALL:
                break
            width *= 2
        return min(width, max(n, 1))

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Query and node numbers of all pairs found with similarity ``least``, links audited, and of these those found at once.

        The beams widen until a sample of the queries misses nothing.
        """
        n = len(self.x)
        audit = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
        truth = self.x @ q[audit].T >= least + 1e-6  # what rounding puts at the very edge doesn't count
        place = np.full(len(q), -1)
        place[audit] = np.arange(len(audit))
        first = None
        while True:
            a, b = self._beams(q, least, width)
            got = np.zeros(truth.shape, bool)
            mine = place[a] >= 0
            got[b[mine], place[a[mine]]] = True
            hits = int((truth & got).sum())
            first = hits if first is None else first
            if hits == truth.sum() or width >= n:
                return a, b, int(truth.sum()), first
            width *= 2

    def _beams(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = int(np.clip(20_000_000 // max(1, len(self.x)), 16, 1024))
        todo = [(np.arange(k, min(k + step, len(q))), width) for k in range(0, len(q), step)]
        while todo:
            at, w = todo.pop()
            w = min(w, len(self.x))
            ids, sims = self.query(q[at], w)
            full = (sims[:, -1] >= least) & (w < len(self.x))
            i, j = np.nonzero((sims >= least) & ~full[:, None])
            a.append(at[i])
            b.append(ids[i, j])
            if full.any():
                todo.append((at[full], 2 * w))
        return np.concatenate(a), np.concatenate(b)


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class _Shard:
    """A shard's graph in a task, and the forest of its own nodes that queries have linked."""

    def __init__(self, rows: pd.DataFrame):
        self.graph = Graph.__new__(Graph)
        self.x = _unit(_matrix(rows["vec"]))
        self.graph.x, self.graph.entry = self.x.astype(np.float32), int(rows["entry"].iloc[0])
        self.graph.layers = [np.stack([np.asarray(v[k], np.int32) for v in rows["layers"]]) for k in range(len(rows["layers"].iloc[0]))]
        self.ids, self.copies, self.width = rows["node"].to_numpy(), rows["copies"].to_numpy(float), int(rows["width"].iloc[0])
        self.label, self.linked = np.arange(len(rows)), np.zeros(len(rows), bool)

    def answer(self, q: pd.DataFrame, least: float) -> pd.DataFrame:
        """A row per linked query: its links here and one of its partners; and one with the audit's counts."""
        y, q_ids = _unit(_matrix(q["vec"])), q["node"].to_numpy()
        a, b, true, found = self.graph.within(y.astype(np.float32), least - 1e-4, self.width)
        sure = np.concatenate([(y[a[k : k + 65536]] * self.x[b[k : k + 65536]]).sum(axis=1) for k in range(0, len(a), 65536)] or [np.zeros(0)]) >= least
        sure &= q_ids[a] != self.ids[b]
        a, b = a[sure], b[sure]
        first = np.full(len(q), len(self.ids))
        np.minimum.at(first, a, b)
        self.linked[b] = True
        while True:  # the partners of a query are one group
            new = self.label.copy()
            np.minimum.at(new, b, self.label[first[a]])
            np.minimum.at(new, first[a], self.label[b])
            new = new[new]
            if (new == self.label).all():
                break
            self.label = new
        at = np.unique(a)
        count = np.bincount(a, self.copies[b], len(q)).astype(np.int64)[at]
        out = pd.DataFrame({"node": q_ids[at], "links": count, "root": self.ids[first[at]], "true": 0, "found": 0}).astype({"node": object, "root": object})
        return pd.concat([out, pd.DataFrame([[None, 0, None, true, found]], columns=out.columns, dtype=object)], ignore_index=True)

    def forest(self) -> pd.DataFrame:
        at = np.flatnonzero(self.linked)
        return pd.DataFrame({"node": self.ids[at], "links": 0, "root": self.ids[self.label[at]], "true": 0, "found": 0})


def _visiting(least: float):
    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams of shards, each with its nodes in order and then its queries."""
        unit, shard, nodes = None, None, []
        for batch in batches:
            keys = ["dims", "shard", "part", "query"]
            cuts = np.flatnonzero((batch[keys] != batch[keys].shift()).any(axis=1).to_numpy())
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                own = batch.iloc[a:b]
                if tuple(own[keys[:3]].iloc[0]) != unit:
                    if shard is not None:
                        yield shard.forest()
                    unit, shard, nodes = tuple(own[keys[:3]].iloc[0]), None, []
                if not own["query"].iloc[0]:
                    nodes.append(own)
                    continue
                if shard is None and nodes:
                    shard = _Shard(pd.concat(nodes, ignore_index=True))
                    nodes = []
                if shard is not None:
                    yield shard.answer(own, least)
        if shard is not None:
            yield shard.forest()

    return visit


def linked(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A row per vector, ``id, n_links, component_id, kept``; and the audit, one row of ``true, found`` links.

    ``true`` counts the links of sampled nodes by comparison with whole shards, ``found`` those of them that the
    beams' first width brought; where it missed one the batch was asked again with wider beams. ``shards`` is the
    least number of shards of each length of vectors; without it the table's size decides.
    """
    small_batches(df.sparkSession)
    df = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    whole = F.coalesce(F.col("id").isNotNull() & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = df.filter(whole)
    nodes = cut(rows.groupBy("vec").agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("dims", F.size("vec")))
    sizes = nodes.groupBy("dims").count()
    wanted = F.lit(shards).cast("long") if shards else F.least(F.lit(SHARDS), F.ceil(F.col("count") / SHARD_LEAST))
    sizes = sizes.withColumn("shards", F.greatest(wanted, F.ceil(F.col("count") * F.col("dims") / SHARD_NUMBERS)))
    spread = F.least(F.ceil(TASKS / F.col("shards")), F.ceil(F.col("count") / 1024))  # a small table's few shards serve several tasks
    dealing = cut(sizes.select("dims", "shards", F.greatest(spread, F.ceil(F.col("count") / QUERIES)).alias("parts")))
    units = int(dealing.agg(F.sum(F.col("shards") * F.col("parts"))).first()[0] or 1)
    dealt = nodes.join(few(dealing)(dealing), "dims").withColumn("shard", F.pmod(F.xxhash64("node"), "shards")).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), "parts"))
    dealt = cut(dealt)
    id_type = nodes.schema["node"].dataType.simpleString()

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("node", ignore_index=True)
        graph = Graph(_unit(_matrix(own["vec"])))
        return own[["dims", "shard", "node", "copies", "vec", "parts"]].assign(
            place=np.arange(len(own)), entry=graph.entry, width=graph.tuned(least), layers=[[layer[i] for layer in graph.layers] for i in range(len(own))]
        )

    shape = f"dims int, shard long, node {id_type}, copies long, vec array<double>, parts long, place long, entry long, width long, layers array<array<int>>"
    graphs = cut(dealt.groupBy("dims", "shard").applyInPandas(build, shape))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    graphs = graphs.withColumn("part", each("parts")).drop("parts").withColumn("query", F.lit(False))
    queries = dealt.withColumn("shard", each("shards")).withColumn("query", F.lit(True)).select("dims", "shard", "part", "query", "node", "vec")
    stream = graphs.unionByName(queries, allowMissingColumns=True).repartition(4 * units, "dims", "shard", "part").sortWithinPartitions("dims", "shard", "part", "query", "place")
    found = cut(stream.mapInPandas(_visiting(least), f"node {id_type}, links long, root {id_type}, true long, found long"))
    audit = found.agg(F.coalesce(F.sum("true"), F.lit(0)).alias("true"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    links = found.filter("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.filter("node is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    told = nodes.join(links, "node", "left").join(groups.withColumnRenamed("id", "node"), "node", "left")
    told = cut(told.select("vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    met = joined(rows, told, ["vec"], "left", common(rows, ["vec"])).select("id", "n_links", "component_id")
    out = met.union(df.filter(~whole).select("id", F.lit(0).cast("long"), "id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), audit


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """A row per vector: ``id, n_links, component_id, kept``."""
    return linked(df, id_col, vec_col, least)[0]


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors; nulls, zeros, repeated ids and odd lengths as in the module's cases."""
    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_inner_product(a.v, b.v) >= 0.95 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))),
r AS (SELECT a AS vec_id, b AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT vec_id, least(vec_id, min(other)) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
