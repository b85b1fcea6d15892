"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles is sketched in 128 buckets. A bucket keeps its smallest hash in the
compressed form of a leading-zero count and ten mantissa bits; an empty bucket takes the register of another
one, in an order that all documents share. Four registers make a band, and documents that share a band are
candidates. Candidates pass a size bound and an estimate of Jaccard similarity, corrected for registers that
agree by chance, and are confirmed on the full sets.

No bucket of a band is expanded into all its pairs:

1. documents of equal sets are one class, with the smallest id; equality is that of a 128-bit digest of the whole
   sorted set;
2. in every band each class meets one hub, the class of the bucket that shares most bands with others, as
   the original of many altered copies does; confirmed links join into components;
3. what is left is exact: in each band's bucket that still holds several components, classes outside the
   bucket's largest component meet all others of the bucket that are of other components: as pairs where there are
   few, else in blocks of bounded size, first by registers, which leaves those that have a likely partner, then
   by full sets. A pair is looked at in the first band that it shares.

A pair of similarity 0.8 shares none of the 32 bands with a probability of 5e-8. The estimate rests on the buckets
that the larger set fills, so its standard error, and with it the room below the threshold, grows for small sets;
with few shingles the room is all there is, and only the size bound and full sets decide.

Defined cases: words are split by ASCII white space after lowering A-Z; a text of fewer words than a shingle
is one shingle; a null, empty or blank text has no shingle and links with nothing; rows that repeat an id
count as copies; a row without an id makes no link, takes the component of the copies of its text, and is kept
only if there is none; columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import common, counted, joined, laid_out, least_common, read, settled, small_batches, unused
from braidwork.llm.components import components

BUCKETS, BITS, MANTISSA, ROWS = 128, 7, 10, 4
BANDS = BUCKETS // ROWS
#: Ids up to which the rows to confirm are picked by a broadcast (8 bytes each); beyond, by a shuffle.
BROADCAST_IDS = 200_000
#: Standard errors below the threshold at which the estimate drops a pair; what borrowed registers add to the variance.
MARGIN, BORROWED = 6.0, 1.3
#: Pairs of a bucket up to which they are compared one by one; classes in a block of outer and of all classes.
FEW, X_BLOCK, Y_BLOCK = 64, 128, 512
#: Shingles of a block of full sets.
SHINGLES = 1_000_000
#: Rows of a partition of sketches.
SKETCHES = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of k words."""
    words = [(t or "").encode().lower().split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    flat = np.empty(int(counts.sum()), dtype=object)
    flat[:] = [x for w in words for x in w]
    single = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    joint = single
    for j in range(1, k):
        joint = _mix(joint[: len(joint) - 1] * np.uint64(3) + np.uint64(j)) ^ single[j:] if len(joint) else joint
    out = []
    for i, n in enumerate(counts):
        a = starts[i]
        if n >= k:
            out.append(np.unique(joint[a : a + n - k + 1]))
        elif n:
            x = np.uint64(n)
            for w in single[a : a + n]:
                x = _mix(np.array([x], np.uint64))[0] ^ w
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_ORDER = np.stack([np.random.default_rng([7, j]).permutation(BUCKETS) for j in range(BUCKETS)])
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BITS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 numbers of 16 bits: leading zeros of the bucket's smallest hash, then its next ten bits."""
    hashes = _mix(hashes)
    hashes.sort()
    at = np.searchsorted(hashes, _EDGES)
    filled = np.diff(np.append(at, len(hashes))) > 0
    low = (hashes[np.minimum(at, len(hashes) - 1)] & np.uint64((1 << (64 - BITS)) - 1)) | np.uint64(1)
    part, power = np.frexp(low.astype(np.float64))
    out = ((64 - BITS - power) << MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    if not filled.all():
        out = out[np.where(filled, np.arange(BUCKETS), _ORDER[np.arange(BUCKETS), filled[_ORDER].argmax(axis=1)])]
    return out.astype(np.uint16)


def _sketch(k: int):
    @F.pandas_udf("n long, digest binary, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for i in range(0, len(texts), 500):
                for h in shingle_sets(texts.iloc[i : i + 500].tolist(), k):
                    bands = registers(h).view(np.int64) if len(h) else None
                    rows.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), bands))
            yield pd.DataFrame(rows, columns=["n", "digest", "bands"])

    return sketch


def _sets(k: int):
    @F.pandas_udf("array<long>")
    def sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([h.view(np.int64) for i in range(0, len(texts), 500) for h in shingle_sets(texts.iloc[i : i + 500].tolist(), k)], dtype=object)

    return sets.asNondeterministic()  # else a filter on the sets is pushed below the join that picks their texts


def by_chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that registers of unrelated sets of n and m shingles agree."""
    total = np.zeros(len(n))
    for z in range(1, 64 - BITS):
        p = [(1 - 2.0**-z) ** (x / BUCKETS) - (1 - 2.0 ** -(z - 1)) ** (x / BUCKETS) for x in (n, m)]
        total += p[0] * p[1]
    return total * 2.0**-MANTISSA


def corrected(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarities from pairs x buckets of registers, corrected for registers that agree by chance."""
    chance = by_chance(n, m)
    return ((x == y).mean(axis=1) - chance) / (1 - chance)


def passes(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs may be similar enough by their estimates; x may be one row for all pairs."""
    least = room(np.maximum(n, m), percent)
    out = (x == y).mean(axis=1) >= least  # the correction only lowers an estimate
    at = np.flatnonzero(out)
    out[at] = corrected(x[at] if len(x) == len(y) else x, y[at], n[at], m[at]) >= least[at]
    return out


def room(n: np.ndarray, percent: int) -> np.ndarray:
    """The least estimate of a pair at the threshold, less the margin; n shingles are in the larger set."""
    j, filled = percent / 100, BUCKETS * -np.expm1(-n / BUCKETS)
    return j - MARGIN * np.sqrt(j * (1 - j) * BORROWED / filled)


def _registers(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in s]).view(np.uint16)


def _estimated(percent: int):
    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        n, m = n.to_numpy(float), m.to_numpy(float)
        return pd.Series(passes(_registers(a), _registers(b), n, m, percent))

    return likely


def _overlap(pairs: DataFrame) -> DataFrame:
    """``pairs`` of sets x and y with the size of what they share."""

    @F.pandas_udf("long")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.asarray(a), np.asarray(b), assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype="int64")

    return pairs.withColumn("both", shared("set_a", "set_b"))


def _picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``; few ids are broadcast, many shuffled."""
    return docs.join(F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids, "id", "left_semi")


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the written ``pairs`` (a, b) whose full sets are similar enough, written out.

    One b may be in many pairs, so its set is given to several tasks.
    """
    ids = settled(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = _picked(texts, ids).withColumn("set", _sets(k)("text")).drop("text")
    least = least_common(pairs.count())
    parts = F.broadcast(pairs.groupBy("b").count().filter(F.col("count") > least).select("b", F.ceil(F.col("count") / least).alias("parts")))
    salted = lambda df: df.join(parts, "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"), F.size("set").alias("n_a"))
    b = salted(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"), F.size("set").alias("n_b")))
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    dealt = salted(pairs.select("a", "b")).withColumn("part", F.pmod(F.xxhash64("a"), "parts")).drop("parts")
    # merge joins, so that sets are made in one stage and compared in another, each with one Python worker a task
    met = _overlap(dealt.join(a.hint("merge"), "a").join(b.hint("merge"), ["b", "part"]))
    return settled(met.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b").distinct())


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The written ``pairs`` (a, b) without those that the estimate rules out; one b may be in many."""
    a, b = (classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}")) for x in "ab")
    met = joined(pairs, b, ["b"], "inner", common(pairs, ["b"])).join(a, "a")
    return settled(met.filter(_estimated(percent)("bands_a", "bands_b", "n_a", "n_b")).select("a", "b"))


def _fits(n, m, percent: int):
    """The size bound."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _rest(spots: DataFrame, groups: DataFrame, percent: int, shared: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What has to be compared in the buckets that still hold several components.

    Classes outside a bucket's largest component meet all its others; pairs inside a component need no look.
    Buckets of at most ``FEW`` such pairs give the pairs; of the others come their classes, ``band, key, rep, n,
    component, outer``.
    """
    spots = spots.select("band", "key", "rep", "n").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    spots = settled(spots.withColumn("component", F.coalesce("component", "rep")))
    parts = spots.groupBy("band", "key", "component").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("band", "key").agg(F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = settled(mixed.select("band", "key", F.col("most.component").alias("main"), ((F.col("m") - F.col("most.c")) * F.col("m") <= FEW).alias("few")))
    spots = settled(joined(spots, mixed, ["band", "key"], "inner", shared).withColumn("outer", F.col("component") != F.col("main")))
    x, y = spots.filter("few and outer").alias("x"), spots.filter("few").alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
    met = x.join(y, same & (F.col("x.component") != F.col("y.component")) & _fits(F.col("x.n"), F.col("y.n"), percent))
    pairs = met.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b")).distinct()
    return pairs, spots.filter("not few").select("band", "key", "rep", "n", "component", "outer")


def _dealt(rows: DataFrame, shared: DataFrame | None, weight: int | None = None) -> DataFrame:
    """``rows`` of buckets in blocks ``x, y``: on the left outer classes, on the right all, each side in every block of the other."""
    of = lambda side, block: F.ceil(F.greatest(F.sum(side) / block, F.sum(side * F.col("n")) / weight if weight else F.lit(1)))
    sides = settled(rows.groupBy("band", "key").agg(of(F.lit(1), Y_BLOCK).alias("ys"), of(F.col("outer").cast("int"), X_BLOCK).alias("xs")))
    both = joined(rows, sides, ["band", "key"], "inner", shared).withColumn("h", F.xxhash64("rep"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = both.filter("outer").withColumn("x", F.pmod("h", "xs")).withColumn("y", each("ys")).withColumn("left", F.lit(True))
    y = both.withColumn("y", F.pmod("h", "ys")).withColumn("x", each("xs")).withColumn("left", F.lit(False))
    pick = ["band", "key", "x", "y", "left", "rep", "n", "component"]
    return x.select(*pick).union(y.select(*pick))


def _in_blocks(rows: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int, shared: DataFrame | None) -> DataFrame:
    """Links of outer classes with the others of their buckets, by registers and then by full sets.

    Each task compares one block of a bucket with another. Of a class's links with one component one is given.
    """
    rows, seen = counted(rows)
    rows = laid_out(rows, seen["n"])
    id_type = rows.schema["rep"].dataType.simpleString()
    if not seen["n"]:
        return rows.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    blocks = _dealt(rows, shared).join(classes.select("rep", "bands"), "rep")

    def likely(block: pd.DataFrame) -> pd.DataFrame:
        """Classes of the block that have a likely partner in it which no earlier band brought them."""
        left, right = block[block["left"]], block[~block["left"]]
        if not len(left) or not len(right):
            return block.iloc[:0][["band", "key", "rep"]]
        x, y = _registers(left["bands"]), _registers(right["bands"])
        bx, by, band = x.view(np.int64), y.view(np.int64), int(block["band"].iloc[0])
        nx, ny, px, py = left["n"].to_numpy(float), right["n"].to_numpy(float), left["component"].to_numpy(), right["component"].to_numpy()
        hit_x, hit_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for i in range(len(x)):
            at = np.flatnonzero((py != px[i]) & (100 * np.minimum(ny, nx[i]) >= percent * np.maximum(ny, nx[i])) & ~(by[:, :band] == bx[i, :band]).any(axis=1))
            at = at[passes(x[i : i + 1], y[at], np.full(len(at), nx[i]), ny[at], percent)]
            hit_x[i] = len(at) > 0
            hit_y[at] = True
        return pd.concat([left[hit_x], right[hit_y]])[["band", "key", "rep"]].drop_duplicates()

    spot = ["band", "key", "rep"]
    left = blocks.groupBy("band", "key", "x", "y").applyInPandas(likely, f"band int, key long, rep {id_type}").distinct()
    rows = settled(rows.join(left, spot))
    sets = _picked(texts, rows.select(F.col("rep").alias("id")).distinct()).select(F.col("id").alias("rep"), _sets(k)("text").alias("set"))
    blocks = _dealt(rows, shared, SHINGLES).join(sets, "rep")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["left"]], block[~block["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        own = [np.asarray(s) for s in right["set"]]
        sizes = np.array([len(s) for s in own])
        flat, at = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, at = flat[order], at[order]
        ids, parts, out = right["rep"].to_numpy(), right["component"].to_numpy(), []
        for i, part, s in zip(left["rep"], left["component"], left["set"], strict=True):
            s = np.asarray(s)
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            both = np.bincount(at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(own))
            close = np.flatnonzero((100 * both >= percent * (len(s) + sizes - both)) & (parts != part))
            _, first = np.unique(parts[close], return_index=True)
            out += [(max(i, j), min(i, j)) for j in ids[close[first]]]
        return pd.DataFrame(out, columns=["a", "b"])

    return settled(blocks.groupBy("band", "key", "x", "y").applyInPandas(compare, f"a {id_type}, b {id_type}").distinct())


def _told(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """A row per document: ``id, tag, n, digest, component``; the tag is a hash of the text."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched, seen = counted(docs.withColumn("s", _sketch(k)("text")).select("id", F.xxhash64("text").alias("tag"), "s.*"))
    sketched, n_docs = laid_out(sketched, seen["n"], SKETCHES), seen["n"]
    classes, seen = counted(sketched.filter("n > 0 and id is not null").groupBy("n", "digest").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")))
    classes, n_classes = laid_out(classes, seen["n"], SKETCHES), seen["n"]
    # sets of J >= percent that differ hold at least percent / (100 - percent) shingles
    wide = classes.filter(F.col("n") * (100 - percent) >= percent).select("rep", "n", F.posexplode("bands").alias("band", "key"))
    often = F.col("members") > least_common(n_classes * BANDS)
    counts, seen = counted(wide.groupBy("band", "key").agg(F.count("*").alias("members")).filter("members > 1"), often=F.count_if(often))
    counts = laid_out(counts, seen["n"])
    shared = laid_out(counts.filter(often).select("band", "key"), seen["often"]) if seen["often"] else None
    spots = settled(joined(wide, counts, ["band", "key"], "inner", shared))
    central = spots.groupBy("rep").agg(F.sum("members").alias("weight"))
    hubs = settled(spots.join(central, "rep").groupBy("band", "key").agg(F.max(F.struct("weight", F.xxhash64("rep").alias("h"), "rep", "n")).alias("hub")))
    met = joined(spots, hubs.select("band", "key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("n_hub")), ["band", "key"], "inner", shared)
    pairs = settled(met.filter((F.col("rep") != F.col("hub")) & _fits(F.col("n"), F.col("n_hub"), percent)).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    likely = _likely(pairs, classes, percent)
    links = _confirm(likely, docs, k, percent)
    groups = components(links)
    met, rows = _rest(spots, groups, percent, shared)
    seen = likely.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = _likely(settled(met.join(seen, ["a", "b"], "left_anti")), classes, percent)
    more = _confirm(pairs, docs, k, percent).union(_in_blocks(rows, classes, docs, k, percent, shared))
    if not more.isEmpty():
        groups = components(links.union(more))
    of_class = settled(classes.select("n", "digest", "rep").join(groups.withColumnRenamed("id", "rep"), "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("component")))
    same = ["n", "digest"]
    return joined(sketched.drop("bands"), of_class, same, "left", common(sketched, same, n_docs)).select("id", "tag", "n", "digest", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: ``id, n_shingles, component_id, kept``.

    Documents with 100 * shared >= percent * union of their shingles are linked; component_id is the smallest
    id reachable, and the document that has it is kept.
    """
    out = _told(docs, id_col, text_col, k, percent).select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by shingles of two words; nulls, short texts and repeated ids as in the module's cases."""
    out = near_duplicates(read(spark, sf_dir, "documents"), k=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates one with the smallest id.

    Texts without words all stay. Of rows that repeat an id in one group, and of rows without an id that are copies
    of each other only, one stays; a row without an id goes if a copy of it has one. Columns stay as they were.
    """
    told = settled(_told(docs, id_col, text_col, k, percent).filter("n = 0 or component is null or id = component"))
    group = F.struct("component", F.when(F.col("component").isNull(), F.col("digest")).alias("digest"))
    of_words = told.filter("n > 0").groupBy(group.alias("of")).agg(F.min(F.struct("id", "tag")).alias("row"), F.count("*").alias("rows"))
    own, tag = unused(docs.columns, "own", "tag")
    stay = settled(of_words.select("row.id", "row.tag", "rows").union(told.filter("n = 0").select("id", "tag", F.lit(1)).distinct()))
    stay = stay.withColumnsRenamed({"id": own, "tag": tag})
    same = lambda some: docs[id_col].eqNullSafe(some[own]) & (F.xxhash64(docs[text_col].cast("string")) == some[tag])
    single, several = stay.filter("rows = 1"), stay.filter("rows > 1")
    out = docs.join(single.select(own, tag), same(single), "left_semi")
    if several.isEmpty():
        return out
    several = several.select(own, tag)
    one = docs.join(several, same(several)).dropDuplicates([own, tag]).select(*docs.columns)
    return out.union(one)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                                        WHEN len(words) = 1 THEN words ELSE [] END) AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.other),
m AS (SELECT doc_id, least(doc_id, min(other)) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN m USING (doc_id)
"""
