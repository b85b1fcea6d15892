"""Merkle manifest of a dataset, kept as an append log in postorder.

A document's leaf is the digest of its columns. Leaves of a source ascend by id; every 16 neighbouring nodes of a
level (the last run of a level may have fewer) have a parent, until one node is left, the source's subroot. The
subroots, in the order of their sources, form a tree of the same kind, whose root stands for the dataset.

A tree is written as a log in which a node follows when its last leaf has come, so that nothing is ever moved
when leaves are appended. All places in it are known without looking: before leaf i stand i leaves and the inner
nodes that were complete by then, i // 16 + i // 256 + ..., and a node of level l whose last leaf is i stands l
places after it. Builders are aligned: each takes 4096 neighbouring nodes and builds three levels, so its part of the log
needs no other builder, whatever source holds most documents; the tops of the parts are the leaves of the next
round of builders. A proof is read from the same parts: the siblings of a node of any level are at places computed
from the sizes of the subtrees, and what is above a part's top was read in the round before.

Defined cases: a null column is written as ``-``, other than an empty one; a null source is a source of its own and
comes first; rows without an id come first in their source; rows that repeat an id are leaves of their own, in
the order of their digests; a lone leaf is its source's subroot, a lone subroot the root; an empty table has
no rows and no root; other columns, whatever their names, are no part of a leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.llm.common import crc, cut, few, read

#: Nodes under a parent, and levels of a builder.
FAN, LEVELS = 16, 3
#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def before(leaf: int) -> int:
    """Nodes in the log before a leaf."""
    n = leaf
    while leaf := leaf // FAN:
        n += leaf
    return n


def place(level: int, k: int, n: int) -> int:
    """Where the k-th node of a level stands in the log of n leaves."""
    last = min((k + 1) * FAN**level, n) - 1
    return before(last) + level


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _written(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**columns: Column) -> Column:
    """The digest of a row's columns; those that are given stand in for the row's own."""
    return F.sha2(F.concat(*[_written(columns.get(c, F.col(c))) for c in COLUMNS]), 256)


def tampered() -> Column:
    """The leaf after tampering, which lower-cases the text's A-Z where 5 divides the id's checksum; else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(crc() % 5 == 0, leaf(text=F.translate("text", upper, upper.lower())))


def _ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """A written ``rows`` with ``k``, each row's place in its ``tree`` from 0.

    Rows are sorted by ranges, of which a tree may fill many; the counts of those before shift the places.
    """
    ranged = cut(rows.repartitionByRange("tree", *by).sortWithinPartitions("tree", *by).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    seen = ranged.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each range and tree in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(seen.select("tree", "part", (before - F.col("first")).alias("shift")))
    return ranged.join(few(starts)(starts), ["tree", "part"]).withColumn("k", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _logged(digests: list[str], levels: int) -> list[str]:
    """The log of a block: its leaves and the nodes above them in the order of completion."""
    n, rows = len(digests), [digests]
    for _ in range(levels):
        below = rows[-1]
        rows.append([sha256("".join(below[i : i + FAN]).encode()).hexdigest() for i in range(0, len(below), FAN)])
    log = [""] * sum(map(len, rows))
    for level, row in enumerate(rows):
        for k, digest in enumerate(row):
            log[place(level, k, n)] = digest
    return log


def _depth(block: int, n: int, levels: int) -> int:
    """Levels that a builder adds: a first block that isn't full is a whole tree, others rise to the next round."""
    return height(n) if block == 0 and n < FAN**levels else levels


def _in_blocks(units: DataFrame, levels: int) -> DataFrame:
    return units.withColumn("block", F.floor(F.col("k") / FAN**levels))


def built(leaves: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Rounds of ``tree, block, n, log, top`` from ``tree, k, digest``; each round's leaves are the tops before it."""

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("k")
        log = _logged(own["digest"].tolist(), _depth(key[1], len(own), levels))
        return pd.DataFrame({"tree": [key[0]], "block": [key[1]], "n": [len(own)], "log": [log], "top": [log[-1]]})

    rounds, units = [], leaves
    while True:
        made = cut(_in_blocks(units, levels).groupBy("tree", "block").applyInPandas(build, "tree string, block long, n long, log array<string>, top string"))
        rounds.append(made)
        open_trees = made.filter("block = 1").select("tree")  # at most a row for each tree
        if open_trees.isEmpty():
            return rounds
        units = made.join(open_trees, "tree", "left_semi").select("tree", F.col("block").alias("k"), F.col("top").alias("digest"))


def tops(rounds: list[DataFrame]) -> DataFrame:
    """``tree, top`` of the finished trees, and ``round``, the one in which each was finished."""
    out = None
    for r, made in enumerate(rounds):
        lone = made.filter("block = 0").join(made.filter("block = 1").select("tree"), "tree", "left_anti").select("tree", "top", F.lit(r).alias("round"))
        out = lone if out is None else out.union(lone)
    return out


def _runs(log: list[str], depth: int, n: int) -> list[list[str]]:
    """The nodes of each level under a block's top, found by their places."""
    out, width = [], n
    for level in range(depth):
        out.append([log[place(level, k, n)] for k in range(width)])
        width = -(-width // FAN)
    return out


_PATH = "array<struct<left:string,right:string>>"


def _extractor(levels: int):
    def extract(own: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        """The siblings on the way up of each node of a block, in order; ``path`` is what is above the block's top."""
        if not len(own) or not len(part):
            return own.drop(columns="block").assign(path=None, subroot=None, root=None).head(0)
        p = part.iloc[0]
        runs = _runs(list(p["log"]), _depth(int(p["block"]), int(p["n"]), levels), int(p["n"]))
        above = [{"left": s["left"], "right": s["right"]} for s in p["path"]]
        paths = []
        for k in own["k"] % FAN**levels:
            path = []
            for row in runs:
                first = k - k % FAN
                path.append({"left": "".join(row[first:k]), "right": "".join(row[k + 1 : first + FAN])})
                k //= FAN
            paths.append(path + above)
        return own.drop(columns="block").assign(path=paths, subroot=p["subroot"], root=p["root"])

    return extract


def extracted(units: list[DataFrame], rounds: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``units[0]`` with ``path, subroot, root``, read from the last round down; above: ``tree, path, subroot, root``.

    ``units`` are each round's nodes, with ``tree, k`` and, in the first, whatever else a leaf has.
    """
    ended = tops(rounds).join(few(above)(above), "tree").select("tree", "round", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    ended = cut(ended)
    higher = None
    for r in reversed(range(len(rounds))):
        known = ended.filter(F.col("round") == r).drop("round")
        if higher is not None:
            known = known.unionByName(higher.withColumnRenamed("k", "block"))
        part = rounds[r].join(known, ["tree", "block"]).select("tree", "block", "n", "log", "path", "subroot", "root")
        shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units[r].schema) + f", path {_PATH}, subroot string, root string"
        higher = _in_blocks(units[r], levels).groupBy("tree", "block").cogroup(part.groupBy("tree", "block")).applyInPandas(_extractor(levels), shape)
        if r:
            higher = cut(higher.select("tree", "k", "path", "subroot", "root"))
    return higher


def _nodes(leaves: DataFrame, rounds: list[DataFrame]) -> list[DataFrame]:
    """Each round's nodes: the leaves, then the tops of the parts of trees that go on."""
    out = [leaves]
    for made in rounds[:-1]:
        out.append(made.join(made.filter("block = 1").select("tree"), "tree", "left_semi").select("tree", F.col("block").alias("k")))
    return out


class Manifest:
    """The trees of a dataset's documents: ``leaves``, the rounds of each source's tree, and those of the tree above."""

    def __init__(self, docs: DataFrame, levels: int = LEVELS):
        self.levels = levels
        # the order of trees is that of sources, the null one first; rows are narrow from here on
        tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
        row = docs.select(*COLUMNS).select(tree.alias("tree"), F.col("doc_id").alias("id"), leaf().alias("digest"), tampered().alias("tampered"))
        self.leaves = cut(_ranked(cut(row), ["id", "digest"]))
        self.rounds = built(self.leaves.select("tree", "k", "digest"), levels)
        subroots = cut(tops(self.rounds).select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("top").alias("digest")))
        self.subroots = cut(_ranked(subroots, ["source"]))
        self.upper = built(self.subroots.select("tree", "k", "digest"), levels)

    def log(self) -> DataFrame:
        """``tree, position, level, digest``: each source's log; the tree of subroots has the empty name.

        Documents' trees are named by their source after ``=``, the null source's is ``-``.
        """
        levels = self.levels
        sizes = self.leaves.groupBy("tree").agg(F.count("*").alias("leaves")).union(self.subroots.groupBy("tree").agg(F.count("*").alias("leaves")))

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples():
                    width, out = r.n, []
                    for level in range(_depth(r.block, r.n, levels) + 1):
                        if level or not r.round:  # a later round's leaves stand in the log already
                            for i in range(width):
                                at = levels * r.round + level
                                out.append((r.tree, place(at, r.block * FAN ** (levels - level) + i, r.leaves), at, r.log[place(level, i, r.n)]))
                        width = -(-width // FAN)
                    yield pd.DataFrame(out, columns=["tree", "position", "level", "digest"])

        parts = None
        for rounds in (self.rounds, self.upper):
            for r, made in enumerate(rounds):
                part = made.withColumn("round", F.lit(r))
                parts = part if parts is None else parts.union(part)
        small = few(sizes)
        return parts.join(small(sizes), "tree").mapInPandas(placed, "tree string, position long, level int, digest string")

    def proofs(self) -> DataFrame:
        """``id, digest, tampered, subroot, root, path``: a path's steps hold the siblings left and right, from the leaf up."""
        root = tops(self.upper).select("tree", F.array().cast(_PATH).alias("path"), F.col("top").alias("subroot"), F.col("top").alias("root"))
        above = extracted(_nodes(self.subroots.select("tree", "k", "source", "digest"), self.upper), self.upper, root, self.levels)
        above = cut(above.select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root"))
        return extracted(_nodes(self.leaves, self.rounds), self.rounds, above, self.levels)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its verification of every document; nulls, repeated and lone rows as in the module's cases."""
    found = Manifest(read(spark, sf_dir, "documents")).proofs()
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({c} AS VARCHAR)), ':', {c}) END"
_LEAF = lambda text: "sha256(concat(" + ", ".join(_FIELD(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
_UP = "SELECT tree, level + 1 AS level, k // 16 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h, (n + 15) // 16 AS n"

ORACLE = f"""
WITH RECURSIVE ct AS (SELECT CAST(range AS BIGINT) AS i, 0 AS j, CAST(range AS BIGINT) AS v FROM range(256)
  UNION ALL SELECT i, j + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM ct WHERE j < 8),
cc AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d, 0 AS p, CAST(4294967295 AS BIGINT) AS v FROM documents
  UNION ALL SELECT doc_id, d, p + 1, xor(cc.v // 256, ct.v) FROM cc JOIN ct ON ct.j = 8 AND ct.i = xor(cc.v, CAST(ascii(d[p + 1]) AS BIGINT)) % 256 WHERE p < len(d)),
lf AS (SELECT doc_id, concat('s', source) AS tree, source, {_LEAF("text")} AS leaf,
         CASE WHEN xor(v, 4294967295) % 5 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_LEAF("text")} END AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n
       FROM documents JOIN (SELECT doc_id AS crc_id, v FROM cc WHERE p = len(d)) ON crc_id = doc_id),
tr AS (SELECT tree, 0 AS level, k, leaf AS h, n FROM lf UNION ALL {_UP} FROM tr WHERE n > 1 GROUP BY tree, level, k // 16, n),
sr AS (SELECT s.tree, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k, count(*) OVER () AS n
       FROM (SELECT DISTINCT tree, source FROM lf) s JOIN tr ON tr.tree = s.tree AND tr.n = 1),
up AS (SELECT '' AS tree, 0 AS level, k, subroot AS h, n FROM sr UNION ALL {_UP} FROM up WHERE n > 1 GROUP BY tree, level, k // 16, n),
nd AS (SELECT tree, level, k, h FROM tr WHERE n > 1 UNION ALL SELECT tree, 1000 + level, k, h FROM up WHERE n > 1),
ps AS (SELECT doc_id, nd.level, lf.k // CAST(pow(16, nd.level) AS BIGINT) AS own, nd.k, nd.h FROM lf JOIN nd ON nd.tree = lf.tree AND nd.k // 16 = lf.k // CAST(pow(16, nd.level + 1) AS BIGINT)
       UNION ALL SELECT doc_id, nd.level, sr.k // CAST(pow(16, nd.level - 1000) AS BIGINT), nd.k, nd.h FROM lf JOIN sr USING (tree) JOIN nd ON nd.tree = '' AND nd.k // 16 = sr.k // CAST(pow(16, nd.level - 999) AS BIGINT)),
st AS MATERIALIZED (SELECT doc_id, level, coalesce(string_agg(h, '' ORDER BY k) FILTER (k < own), '') AS l, coalesce(string_agg(h, '' ORDER BY k) FILTER (k > own), '') AS r,
         row_number() OVER (PARTITION BY doc_id ORDER BY level) AS step FROM ps GROUP BY doc_id, level),
fo AS (SELECT doc_id, CAST(0 AS BIGINT) AS step, tampered AS h FROM lf UNION ALL SELECT fo.doc_id, fo.step + 1, sha256(concat(l, h, r)) FROM fo JOIN st ON st.doc_id = fo.doc_id AND st.step = fo.step + 1),
pr AS (SELECT doc_id, sha256(string_agg(concat(l, r), '' ORDER BY step)) AS proof FROM st GROUP BY doc_id),
rt AS (SELECT h AS root FROM up WHERE n = 1),
fr AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM fo GROUP BY doc_id)
SELECT lf.doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM lf JOIN sr USING (tree) CROSS JOIN rt LEFT JOIN pr ON pr.doc_id = lf.doc_id JOIN fr ON fr.doc_id = lf.doc_id
"""
