import random
import re
from hashlib import sha256

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import fmindex as m

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def brute(docs, items):
    """{row: (n_words, n_hit, items)} of (id, text) rows."""
    wanted = {}
    for name, text in items:
        w = words(text)
        for a in range(max(1, len(w) - 9) if w else 0):
            wanted.setdefault(tuple(w[a : a + 10]), set()).add("" if name is None else str(name))
    lengths = {len(x) for x in wanted}
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if own := wanted.get(tuple(w[a : a + n])):
                    hit.update(range(a, a + n))
                    found |= own
        out.append((str(doc_id), len(w), len(hit), sorted(found)))
    return sorted(out)


def told(found):
    return sorted((str(r["id"]), r["n_words"], r["n_hit"], r["items"]) for r in found.collect())


def test_suffix_array_and_counts():
    rng = np.random.default_rng(1)
    for top, n in ((1, 40), (2, 300), (5, 2000), (70, 3000)):
        codes = np.concatenate([x for _ in range(n // 20) for x in (rng.integers(1, top + 1, rng.integers(1, 40)), [0])])
        order = m.suffix_array(codes)
        ends = np.cumsum(codes == 0) - (codes == 0)
        keys = [[(1, c) if c else (0, ends[i]) for i, c in enumerate(codes[a:], a)][:60] for a in range(len(codes))]
        assert order.tolist() == sorted(range(len(codes)), key=keys.__getitem__)
        index = m.Index(codes, top)
        text = codes.tolist()
        for size in (1, 2, 3, 7):
            for _ in range(20):
                a = int(rng.integers(0, len(text) - size))
                phrase = text[a : a + size] if rng.random() < 0.7 else rng.integers(1, top + 1, size).tolist()
                if 0 in phrase:
                    continue
                places = [i for i in range(len(text) - size + 1) if text[i : i + size] == phrase]
                found, low, high = index.search(np.array([[0] * (9 - size) + phrase]), np.array([size]))
                assert (int(high[0] - low[0]) if len(found) else 0) == len(places)
                if places:
                    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == places


@pytest.mark.parametrize(("size", "part"), [(1 << 20, 2_000_000), (64, 300)])
def test_hits_against_all_windows(spark, size, part):
    rng = random.Random(7)
    vocabulary = ["Ab", "b1", "c", "dé", "E", "ff", "漢字", "g", "h2", "i"]
    some = lambda n, k=10: " ".join(rng.choices(vocabulary[:k], k=n))
    items = [(i, some(rng.choice([1, 3, 9, 10, 11, 25, 60]), rng.choice([2, 4, 10]))) for i in range(120) if i % 40] + [(0, some(70, 3)), (None, some(12)), (5, some(30)), (40, None), (80, " .,; ")]
    items += [(200, "solo"), (201, items[3][1])]
    docs = [(i, some(rng.randint(0, 60)) + " zz, " + some(rng.randint(0, 15))) for i in range(150)]
    docs += [(i, f"{some(8)}\nyy! {rng.choice(items)[1]}; yy {some(rng.randint(0, 30), 3)}") for i in range(100, 250)]
    docs += [(300, some(4000, 3)), (301, "c " * 700), (302, "SOLO"), (303, ""), (304, None), (305, "no, such; words")]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, n_words int, hit string").repartition(5)
    found = m.scan(frame, spark.createDataFrame(items, "item_id long, text string"), size=size, part=part)
    assert told(found) == brute(docs, items)
    # spans are whole hit words, and the rest is what is left
    for r in frame.join(found.withColumnRenamed("id", "doc_id").select("doc_id", F.col("n_hit"), "spans"), "doc_id").filter("doc_id >= 250").withColumn("rest", m.without(F.col("text"), F.col("spans"))).collect():
        text = r["text"] or ""
        assert sum(len(words(text[s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
        rest = text
        for s in reversed(r["spans"]):
            rest = rest[: s["start"]] + rest[s["end"] :]
        assert (r["rest"] or "") == rest


def test_odd_rows(spark):
    items = [(1, "a plain sentence of the usual kind, and here is another one"), (2, "Satz"), (3, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")]
    docs = [(r[0], r[1]) for r in cases.rows()]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert told(m.scan(cases.docs(spark), benchmark)) == brute(docs, items)
    assert m.scan(cases.none(spark), benchmark).collect() == []
    assert told(m.scan(cases.docs(spark), benchmark.limit(0))) == brute(docs, [])


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (12, "x y"), (2, "two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "One, two; three x"), (2, "x y two"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in m.op12_fmindex(spark, str(tmp_path)).collect()}
    sha = lambda s: sha256(s.encode()).hexdigest()
    assert got == {1: (4, 2, 2, sha("1,2"), True), 2: (3, 3, 2, sha("12,2"), True), 3: (0, 0, 0, sha(""), False)}
