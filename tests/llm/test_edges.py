"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator on documents."""

import pytest
from cases import docs, none, rows
from pyspark.sql import functions as F

from braidwork.llm import bpe, hnsw, langid, licences, lines, minhash, mixing, pii, quality, topk


def _langid(df):
    return langid.predict(df, df)


def _pii(df):
    return pii.redact(pii.find(df, *pii.fit(df)))


def _quality(df):
    return quality.score(df, *quality.fit(df, df.select("doc_id", F.lit(1).alias("quality"))))


OPERATORS = {"langid": _langid, "pii": _pii, "quality": _quality, "minhash": minhash.near_duplicates, "licences": licences.scan, "lines": lines.deduplicate, "mix": mixing.mix, "bpe": bpe.encode}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_stays(spark, name):
    assert OPERATORS[name](docs(spark)).count() == len(rows())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](none(spark)).count() == 0


FILTERS = {"accepted": langid.accepted, "representatives": minhash.representatives, "mixed": mixing.mixed}
#: Names that operators use inside, and those of their results.
CLASHES = ("_id", "_kept", "_bpe", "_text", "_words", "_lines", "_stats", "_lang", "_copy", "_at", "own", "tag", "gone", "left", "copy", "at", "told", "bpe", "stats", "words", "lines", "id", "digest", "component", "slice", "position", "n", "text_", "LANG")
RESULTS = ("lang_pred", "score", "predicted", "spans", "redacted", "licences", "n_lines", "n_deleted", "emptied", "ids", "decoded", "n_shingles", "component_id", "kept", "size", "target", "taken")


def clashing(spark):
    own = [c for c in (*CLASHES, *RESULTS) if c.lower() not in {x.lower() for x in docs(spark).columns}]
    return docs(spark).select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in own if c != "LANG"])


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    """Results are as without the other columns, and an operator that adds columns keeps all it doesn't name a result."""
    plain, got = OPERATORS[name](docs(spark)), OPERATORS[name](clashing(spark))
    new = [c for c in plain.columns if c not in docs(spark).columns or c in ("score", "kept")]
    told = lambda df: sorted(map(str, df.select(*new).collect()))
    assert told(plain) == told(got) and len(new) > 0
    if "source" in got.columns and name != "mix":
        for c in CLASHES:
            if c in got.columns and c not in new:
                assert all(r[0] in (f"{c}:{r[1]}", f"{c}:none") for r in got.select(c, "doc_id").collect())


@pytest.mark.parametrize("name", FILTERS)
def test_filters_return_the_columns(spark, name):
    keep = FILTERS[name]
    for df in (docs(spark), clashing(spark), none(spark)):
        assert keep(df).dtypes == df.dtypes
    some = lambda df: sorted(map(str, keep(df).select("doc_id", F.md5(F.coalesce("text", F.lit("")))).collect()))
    assert some(docs(spark)) == some(clashing(spark)) != []
    assert keep(none(spark)).count() == 0


def test_accepted_rows(spark):
    assert sorted(r["doc_id"] or 0 for r in langid.accepted(docs(spark)).collect() if r["doc_id"] != 8) == [0, 1, 2, 7, 7, 9, 10]


def test_representatives_keep_one_of_each(spark):
    """Copies under one id or none leave one; texts without words and rows without an id that have no copy stay."""
    got = [r["doc_id"] for r in minhash.representatives(docs(spark)).collect()]
    assert sorted(i or 0 for i in got) == [0, 1, 3, 4, 5, 6, 7, 8, 9, 10]
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, text), (None, text), (5, "q r s t u v"), (5, "other words of the same id again"), (6, "q r s t u v"), (None, "q r s t u v"), (None, None), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in minhash.representatives(df).collect())
    assert [g for g in got if g[0] == "None"] == [("None", "None"), ("None", "None"), ("None", text)]
    assert [g[0] for g in got if g[0] != "None"] == ["5"]


def test_mixed_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "one two three", "a"), (1, "one two three four", "a"), (None, "five", "b"), (2, "", "b"), (3, None, None)], "doc_id long, text string, source string")
    got = mixing.mixed(df, budget=2.0).collect()
    assert sorted(str(r["text"]) for r in got) == sorted(2 * ["one two three", "one two three four", "five"])


def test_values_of_odd_texts(spark):
    """What null, empty and blank texts give."""
    odd = docs(spark).filter("doc_id in (3, 4, 5)")
    found = {r["doc_id"]: r for r in _pii(docs(spark)).filter("doc_id in (3, 4, 5)").collect()}
    assert all(found[i]["spans"] == [] for i in found) and found[3]["redacted"] is None and found[4]["redacted"] == ""
    assert all(r["licences"] == [] for r in licences.scan(odd).collect())
    assert {r["doc_id"]: (list(r["ids"]), r["decoded"]) for r in bpe.encode(odd).collect() if r["doc_id"] != 5} == {3: ([], ""), 4: ([], "")}
    scores = {r["doc_id"]: r["score"] for r in _quality(docs(spark)).collect()}
    assert scores[3] == scores[4] and all(0 <= s <= 1 for s in scores.values())
    mix = {r["doc_id"]: r for r in mixing.mix(docs(spark)).collect() if r["doc_id"] in (3, 4, 5)}
    assert all((r["size"], r["taken"], r["position"]) == (0, 0, None) for r in mix.values())


def test_langid_without_letters(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in _langid(docs(spark)).collect()}
    assert all(got[i] == ("und", 0.0) for i in (3, 4, 5, 6))
    assert got[9][0] == "de" and 0 < got[9][1] <= 1


def test_minhash_cases(spark):
    got = {(r["id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(spark)).collect()}
    assert got[3, 0] == (3, True) and got[4, 0] == (4, True) and got[5, 0] == (5, True)
    assert got[1, 13] == (1, True) and got[2, 13] == (1, False)
    assert got[8, 1] == (8, True)
    assert [v for (i, _), v in got.items() if i is None] == [(None, True)]


def test_lines_cases(spark):
    line = "word " * 30
    text = f"{line}\n{line.upper()}\nshort tail"
    df = spark.createDataFrame([(1, text), (2, f"head\n{text}"), (3, None), (4, ""), (5, f"{line}\nother")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.deduplicate(df).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "head" and got[5]["text"] == f"{line}\nother"
    assert got[3]["text"] is None and got[4]["text"] == "" and not got[4]["emptied"]
    assert got[2]["n_deleted"] == 3 and got[2]["n_lines"] == 4


@pytest.mark.parametrize(("period", "lines_kept"), [(1, 5), (2, 5), (3, 5), (4, 5), (7, 7)])
def test_overlapping_copies_of_lines(spark, period, lines_kept):
    """The first copy of a run stays whole, also where later ones begin within it."""
    own = [f"{'abcdefg'[i % period]} is the first of ten words in this own line" for i in range(30)]
    df = spark.createDataFrame([(1, "\n".join(own)), (2, "\n".join(own[:12]))], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(df).collect()}
    assert got[1].split("\n") == own[:lines_kept] and got[2] == ""


def test_mixed_rows_without_an_id_are_dealt(spark):
    """Rows that share an id, or have none, lie in many ranges of their source, and rows that agree in all are one of a range."""
    rows = [(None, f"text {i}", "a") for i in range(500)] + [(7, f"other {i}", "a") for i in range(500)] + [(None, "the very same", "a")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing._placed(df, "doc_id", "text", "source")
    out = plan.agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.max("source_size").alias("size"), F.countDistinct("part_from").alias("places")).first()
    assert (out["n"], out["taken"], out["size"], out["places"]) == (1300, 1.5 * out["size"], 2900, 1300)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(20, [1.0, 0.0]), (40, [1.0, 0.0]), (3, [0.99, 0.01]), (4, [0.0, 1.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [0.0, 0.0]), (60, []), (10, [1.0]), (None, [1.0, 0.0]), (3, [0.99, 0.01])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.near_duplicates(df).collect():
        got.setdefault(r["id"], (r["n_links"], r["component_id"], r["kept"]))
    assert got[20] == (3, 3, False) and got[3] == (3, 3, True) and got[4] == (0, 4, True)
    assert all(got[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 60, 10)) and got[None] == (0, None, True)
    rows = topk.usable(df.select(F.col("vec_id").alias("id"), "embedding"), "embedding").select("id", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))).alias("vec"))
    best = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in topk.search(rows, rows.filter("id % 20 = 0"), 20).collect())
    assert [b[1:] for b in best if b[0] == 20] == [(1, 40, 4096), (2, 3, 4032), (3, 3, 4032), (4, 4, 0), (5, 9, 0)]
    empty = df.limit(0)
    assert hnsw.near_duplicates(empty).count() == 0
    assert topk.search(rows.limit(0), rows.limit(0), 20).count() == 0
