from hashlib import sha256
from zlib import crc32

import cases
import pytest
from pyspark.sql import functions as F

from braidwork.llm import merkle


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def lifted(row):
    return [digest(*row[i : i + 16]) for i in range(0, len(row), 16)]


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append(lifted(out[-1]))
    return out


def siblings(levels, k):
    """(left, right) of each level."""
    out = []
    for row in levels[:-1]:
        first = k - k % 16
        out.append((row[first:k], row[k + 1 : first + 16]))
        k //= 16
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of every row, from (doc_id, text, lang, source, n_chars)."""
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text), doc_id))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(own)]) for s, own in sources.items()}
    upper = levels_of([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for k, (_, _, leaf, doc_id) in enumerate(sorted(sources[s])):
            out.append((doc_id, leaf, trees[s][-1][0], upper[-1][0], siblings(trees[s], k) + siblings(upper, j)))
    return out


def same_as_brute(spark, rows, extra="x string", levels=3):
    df = spark.createDataFrame([(*r, None) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    got = merkle.Manifest(df, levels).proofs().collect()
    told = lambda path: [("".join(a), "".join(b)) for a, b in path]
    want = sorted((str(i), leaf, sub, root, told(path)) for i, leaf, sub, root, path in brute(rows))
    assert sorted((str(r["id"]), r["digest"], r["subroot"], r["root"], [(s["left"], s["right"]) for s in r["path"]]) for r in got) == want


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_proofs_against_plain_trees(spark, levels):
    sizes = {None: 1, "": 16, "a": 17, "b": 256, "c": 257, "A": 33, "ä": 1, "hot": 1100, **{f"s{i}": 2 for i in range(30)}}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((n * 7919 % 100003, None if n % 11 == 0 else f"Text {n}\n", None if n % 5 else "de", source, None if n % 3 else n))
            n += 1
    same_as_brute(spark, rows, "tree string", levels)


def test_odd_rows(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in cases.rows()]
    same_as_brute(spark, rows, "digest string")
    same_as_brute(spark, rows[:1])
    same_as_brute(spark, [(5, "x", "en", "s", 1)] * 20 + [(None, "x", None, "s", None), (None, "y", None, "s", None)], "k int")
    assert merkle.Manifest(cases.none(spark)).proofs().collect() == []


def test_query_columns(spark, tmp_path):
    rows = [(i, f"{'Abc' if i % 2 else 'abc'} {i}", "en", f"s{i % 3}", i) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in merkle.op11_merkle(spark, str(tmp_path)).collect()}
    fooled = 0
    for (doc_id, leaf, sub, root, path), row in ((b, next(r for r in rows if r[0] == b[0])) for b in brute(rows)):
        h = leaf
        if crc32(str(doc_id).encode()) % 5 == 0:
            h = leaf_of(doc_id, row[3], row[2], row[4], row[1].lower())
            fooled += h != leaf
        for a, b in path:
            h = digest(*a, h, *b)
        r = got[doc_id]
        assert (r["leaf"], r["subroot"], r["root"], r["folded_root"], r["verified"]) == (leaf, sub, root, h, h == root)
        assert r["proof_sha256"] == digest(*[x for a, b in path for x in (*a, *b)])
    assert fooled and sum(not r["verified"] for r in got.values()) == fooled


@pytest.mark.parametrize("n", [1, 17, 700])
def test_log_is_postorder(spark, n):
    df = spark.createDataFrame([(i, str(i), "en", "s", i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    levels = levels_of([leaf_of(i, "s", "en", i, str(i)) for i in range(n)])

    def walked(level, k):
        below = [x for c in range(16 * k, min(16 * k + 16, len(levels[level - 1]))) for x in walked(level - 1, c)] if level else []
        return [*below, (level, levels[level][k])]

    log = merkle.Manifest(df, 1).log().filter(F.col("tree") == "=s").orderBy("position").collect()
    assert [r["position"] for r in log] == list(range(len(log)))
    assert [(r["level"], r["digest"]) for r in log] == walked(len(levels) - 1, 0)
    for r in log:
        k = levels[r["level"]].index(r["digest"])
        assert merkle.place(r["level"], k, n) == r["position"]
