"""The pipeline stage by stage against plain Python on the smallest tables."""

import hashlib
import itertools
import math
import re

import corpus_pipeline
import numpy as np
import pytest
from cases import docs as odd_docs
from cases import none
from conftest import SMALL
from pyspark.sql import functions as F

from braidwork.llm import langid
from braidwork.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def likelihoods(word, number, p):
    """Logs of the sums over all segmentations of a word, by language."""
    text, longest = langid.START + word, max(map(len, number))
    total = [np.ones(p.shape[1], np.longdouble)]
    for end in range(1, len(text) + 1):
        own = [(n, number.get(text[end - n : end], langid.UNKNOWN if n == 1 else None)) for n in range(1, min(end, longest) + 1)]
        total.append(sum(total[end - n] * p[k] for n, k in own if k is not None))
    return np.log(total[-1]).astype(float)


def accepted(rows, spark, docs):
    """Stage 1: the learned probabilities are the operator's, the scores are plain sums over segmentations."""
    path = langid.default_path()
    langs, p = langid.learn(langid.sample(docs, "doc_id", "text", "lang"), path)
    number, known, out = langid.pieces(path), {}, []
    for r in rows:
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        for w in set(words) - set(known):
            known[w] = likelihoods(w, number, p)
        if words:
            logs = np.sum([known[w] for w in words], axis=0)
            if 1 / np.exp(logs - logs.max()).sum() >= 0.5:
                out.append(r)
    return out


def without_repeats(rows):
    """Stage 2: of equal shortest windows of 50 words all but the first lose their lines."""
    windows, lines = {}, {}
    for r in rows:
        own = lines[r["doc_id"]] = r["text"].split("\n")
        at = [(p, len(WORD.findall(x))) for p, x in enumerate(own) if WORD.search(x)]
        spans = set()
        for i in range(len(at)):
            for end in range(i, len(at)):
                if sum(w for _, w in at[i : end + 1]) >= 50:
                    spans.add((i, end))
                    break
            for start in range(i, -1, -1):
                if sum(w for _, w in at[start : i + 1]) >= 50:
                    spans.add((start, i))
                    break
        for i, end in spans:
            windows.setdefault(tuple(own[p] for p, _ in at[i : end + 1]), []).append((r["doc_id"], i, [p for p, _ in at[i : end + 1]]))
    gone = {}
    for same in windows.values():
        first, _, stay = min(same)
        for doc, _, places in sorted(same)[1:]:
            gone.setdefault(doc, set()).update(set(places) - set(stay if doc == first else ()))
    out = []
    for r in rows:
        cut = gone.get(r["doc_id"], set())
        text = "\n".join(x for p, x in enumerate(lines[r["doc_id"]]) if p not in cut)
        if not cut or WORD.search(text):
            out.append({**r, "text": text, "n_chars": len(text) if cut else r["n_chars"]})
    return out


def representatives(rows):
    """Stage 3: all pairs of sets of five words."""
    sets = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return [r for r in rows if root(r["doc_id"]) == r["doc_id"]]


def mixture(rows):
    """Stage 4: targets by pouring, and each source's line of documents, once and then again."""
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    tilt = {s: (0.5, -0.5, 0.0)[i % 3] for i, s in enumerate(sources)}
    left, free, target = 1.5 * sum(total.values()), list(sources), {}
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > 2 * total[s]]
        for s in full or free:
            target[s] = 2.0 * total[s] if full else share * weight[s]
            left -= target[s]
        free = [s for s in free if full and s not in full]
    out = []
    for s in sources:
        own = sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(f"{r['doc_id']}|{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest(), r["doc_id"]))
        rounds, before = int(target[s] // total[s]), 0
        for r in own:
            n = size[r["doc_id"]]
            taken = rounds * n + max(0, min(n, math.floor(target[s]) - rounds * total[s] - before))
            for copy in range(int(taken / n + 0.5) if n else 0):
                part, b = min(1.0, (before + copy * total[s]) / target[s]), 1 - tilt[s]
                out.append((2 * part / (b + math.sqrt(b * b + 4 * tilt[s] * part)), r["doc_id"]))
            before += n
    return sorted(out)


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.orderBy("doc_id").collect()]
    plain = (lambda rows: accepted(rows, spark, docs), without_repeats, representatives)
    for (name, stage), own in zip(corpus_pipeline.STAGES, plain, strict=False):
        docs, before = stored(stage(spark, docs, SMALL)), len(rows)
        rows = own(rows)
        assert [r.asDict() for r in docs.orderBy("doc_id").collect()] == sorted(rows, key=lambda r: r["doc_id"]), name
        assert len(rows) < before or name == "language ID"
    want = mixture(rows)
    mixed = stored(corpus_pipeline.STAGES[3][1](spark, docs, SMALL))
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(i for _, i in want)
    from tokenizers import Tokenizer

    from braidwork.llm import bpe

    coder = Tokenizer.from_file(bpe.default_path())
    coder.no_truncation()
    coder.no_padding()
    for r in corpus_pipeline.STAGES[4][1](spark, mixed, SMALL).dropDuplicates(["doc_id"]).collect():
        assert list(r["ids"]) == coder.encode(r["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) and r["exact"]


def test_order_of_training(spark):
    """Copies lie in the order of their training positions, over all partitions."""
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").filter("text is not null").collect()]
    got = [r["doc_id"] for r in corpus_pipeline.mixture(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()]
    want = mixture(rows)
    place = {}
    for at, i in want:
        place.setdefault(i, []).append(at)
    at = [place[i].pop(0) for i in got]
    assert all(a <= b + 1e-9 for a, b in itertools.pairwise(at)) and not any(place.values())


@pytest.mark.parametrize("empty", [False, True])
def test_stages_bear_odd_tables(spark, empty):
    docs = (none if empty else odd_docs)(spark).select("*", F.lit(1).alias("_id"), F.lit(2).alias("own_0"), F.lit("x").alias("n_lines"), F.lit("y").alias("decoded"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, SMALL))
        assert out.dtypes == docs.dtypes and {tuple(r) for r in out.select("_id", "own_0", "n_lines", "decoded").distinct().collect()} <= {(1, 2, "x", "y")}
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert (last.count() == 0) == empty and all(r["exact"] for r in last.collect())
