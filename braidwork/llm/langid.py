"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has its own piece probabilities, learned by
expectation maximisation over all segmentations of its words. A word's likelihood sums the products of piece
probabilities over all its segmentations (forward algorithm); a text's is the product over its words, since
no piece crosses a word's end. The prediction is the language of the highest likelihood, the score its
posterior under equal priors.

Defined cases: a null text or one without letters is ``und`` with score 0, as is every text if there is
nothing to learn from; rows without a language or an id teach nothing, nor do values of the language
column that fewer than one in 2,000 labelled rows have; equal likelihoods go to the first language in
order; a run of letters of any length is one word and costs its length; columns named like the results are replaced.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import crc, read, settled, small_batches, unused

#: Rows of each language from which the pieces' probabilities are learned; all their words count.
SAMPLE_DOCS = 500
#: The least share of the labelled rows that makes a value of the language column a language; so there are 2,000 at most.
LEAST_SHARE = 1 / 2000
#: Groups into which a language's words are dealt for learning; units of an expected count, whose sums are exact.
DEALT, UNIT = 16, 2.0**-20
#: Letters after which sums are scaled; words that a worker remembers, and their longest; rounds of learning.
SCALED, MEMORY, REMEMBERED, ROUNDS = 8, 200_000, 64, 3
START = "▁"
ABSENT, UNKNOWN = 0, 1
LETTERS = re.compile(r"[^\W\d_]+")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> dict[str, int]:
    """All lower-case pieces of letters with their numbers from 2 on; 0 is no piece, 1 an unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = (model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {p: k for k, p in enumerate((p for p in names if p == p.lower() and (p == START or p.removeprefix(START).isalpha())), 2)}


class Trie:
    """The pieces as a table of steps from prefix to prefix; letters that no longer piece has share a column."""

    def __init__(self, number: dict[str, int]):
        longer = [p for p in number if len(p) > 1]
        prefixes = {"": 0} | {x: i for i, x in enumerate(sorted({p[:n] for p in longer for n in range(1, len(p) + 1)}), 1)}
        letters = sorted({c for p in longer for c in p})
        self.column, self.single = np.zeros(0x110000, np.uint16), np.full(0x110000, UNKNOWN, np.int32)
        self.column[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        for p, k in number.items():
            if len(p) == 1:
                self.single[ord(p)] = k
        self.step, self.piece = np.zeros((len(prefixes), len(letters) + 1), np.int32), np.zeros(len(prefixes), np.int32)
        for x, i in prefixes.items():
            if x:
                self.step[prefixes[x[:-1]], self.column[ord(x[-1])]] = i
                self.piece[i] = number.get(x, ABSENT) if len(x) > 1 else ABSENT
        self.longest = max(map(len, longer), default=1)


@functools.lru_cache(maxsize=2)
def trie(path: str) -> Trie:
    return Trie(pieces(path))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


Edges = list[list[tuple[int, np.ndarray, np.ndarray]]]


def lattice(words: list[str], path: str) -> Edges:
    """For words of equal length: at each end the lengths of pieces that end there, with their words and numbers."""
    table, everyone = trie(path), np.arange(len(words))
    points = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    out = [[(1, everyone, ids)] for ids in table.single[points.T]]
    columns = table.column[points]
    word, start = (x.ravel() for x in np.indices(points.shape))
    at = table.step[0][columns[word, start]]
    for n in range(2, table.longest + 1):
        go = (at > 0) & (start + n <= points.shape[1])
        word, start = word[go], start[go]
        at = table.step[at[go], columns[word, start + n - 1]]
        ids = table.piece[at]
        hit = np.flatnonzero(ids)
        hit = hit[np.argsort(start[hit], kind="stable")]
        ends, first = np.unique(start[hit], return_index=True)
        for e, part in zip(ends, np.split(hit, first[1:]), strict=True) if len(hit) else ():
            out[e + n - 1].append((n, word[part], ids[part]))
    return out


def forward(edges: Edges, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all segmentations up to each place, scaled, and the logs of the scales: places x words x languages.

    p: pieces x languages. After some letters the sums are divided by the last of them, so that words of any length
    can be summed; a place's sum is alpha * exp(scale).
    """
    alpha = np.zeros((len(edges) + 1, len(edges[0][0][1]), p.shape[1]))
    scale = np.zeros_like(alpha)
    alpha[0] = 1
    for end, here in enumerate(edges, 1):
        now, base = alpha[end], scale[end - 1]
        for n, at, ids in here:
            before = alpha[end - n] if len(at) == len(now) else alpha[end - n][at]
            if end > SCALED and n > 1:
                before = before * np.exp(scale[end - n][at] - base[at])
            if len(at) == len(now):
                now += before * p[ids]
            else:
                now[at] += before * p[ids]
        scale[end] = base
        if end % SCALED == 0:
            scale[end] += np.log(now)
            now[:] = 1
    return alpha, scale


def by_length(words: list[str], letters: int = 100_000) -> Iterator[np.ndarray]:
    """Places of words of equal length, in blocks of so many letters."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at, block = np.flatnonzero(lengths == n), max(1, letters // (int(n) + 1))
        yield from (at[k : k + block] for k in range(0, len(at), block))


def log_likelihoods(words: list[str], path: str, p: np.ndarray) -> np.ndarray:
    """words x languages."""
    out = np.empty((len(words), p.shape[1]))
    for at in by_length(words):
        alpha, scale = forward(lattice([words[i] for i in at], path), p)
        out[at] = np.log(alpha[-1]) + scale[-1]
    return out


def expected(words: list[str], n: np.ndarray, path: str, q: np.ndarray | None) -> np.ndarray:
    """How often each piece is expected to occur under the probabilities ``q``; without, every piece that fits counts."""
    new = np.zeros(len(pieces(path)) + 2)
    for place in by_length(words):
        edges, count = lattice([words[i] for i in place], path), n[place]
        if q is None:
            for here in edges:
                for _, at, ids in here:
                    np.add.at(new, ids, count[at])
            continue
        alpha, scale = (x[:, :, 0] for x in forward(edges, q[:, None]))
        beta = np.zeros_like(alpha)  # in units of exp(-scale)
        beta[-1] = count / alpha[-1]
        for end in range(len(edges), 0, -1):
            for size, at, ids in edges[end - 1]:
                flow = q[ids] * beta[end][at] * np.exp(scale[end - size][at] - scale[end][at])
                np.add.at(new, ids, flow * alpha[end - size][at])
                beta[end - size][at] += flow
    return new


def _counting(langs: list[str], p: np.ndarray | None, path: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def counted(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("word")
        lang = own["lang"].iloc[0]
        q = expected(own["word"].tolist(), own["n"].to_numpy(float), path, None if p is None else p[:, langs.index(lang)])
        units = np.rint(q / UNIT).astype(np.int64)
        units[ABSENT] = 0
        at = np.flatnonzero(units)
        return pd.DataFrame({"lang": lang, "piece": at.astype(np.int32), "units": units[at]})

    return counted


def learn(words: DataFrame, path: str) -> tuple[list[str], np.ndarray]:
    """From ``lang, word, n`` the languages in order and pieces x languages of probabilities; words stay in Spark."""
    langs, p = [], None
    dealt = words.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(DEALT))).groupBy("lang", "part")
    for _ in range(ROUNDS + 1):
        counted = dealt.applyInPandas(_counting(langs, p, path), "lang string, piece int, units long")
        found = counted.groupBy("lang", "piece").agg(F.sum("units").alias("units")).toPandas()
        langs = sorted(found["lang"].unique())
        p = np.zeros((len(pieces(path)) + 2, len(langs)))
        p[found["piece"].to_numpy(int), found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int)] = found["units"].to_numpy(float) * UNIT
        p[1:] += 0.1
        p /= p.sum(axis=0)
    return langs, p


class _Words(dict):
    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


class Scorer:
    """Log likelihoods of texts; words that it has met are remembered within a bound."""

    def __init__(self, langs: list[str], p: np.ndarray, path: str):
        self.langs, self.p, self.path = langs, p, path
        self.words, self.logs = _Words(), np.zeros((0, len(langs)))

    def score(self, texts: list[str]) -> np.ndarray:
        """texts x languages; a row of nan where there is no letter."""
        if len(self.words) > MEMORY:
            self.words, self.logs = _Words(), np.zeros((0, len(self.langs)))
        place, docs, long = self.words.__getitem__, [], []
        for text in texts:
            words = LETTERS.findall(text.lower())
            if words and max(map(len, words)) > REMEMBERED:
                long.append((len(docs), [w for w in words if len(w) > REMEMBERED]))
                docs.append(np.fromiter((place(w) for w in words if len(w) <= REMEMBERED), np.int64))
            else:
                docs.append(np.fromiter(map(place, words), np.int64, len(words)) if any(c.isalpha() for w in words for c in w) else None)
        if len(self.words) > len(self.logs):
            new = [*self.words][len(self.logs) :]
            self.logs = np.concatenate([self.logs, log_likelihoods(new, self.path, self.p)])
        out = np.array([np.full(len(self.langs), np.nan) if at is None else self.logs[at].sum(axis=0) for at in docs]).reshape(len(texts), len(self.langs))
        for i, words in long:
            out[i] += log_likelihoods(words, self.path, self.p).sum(axis=0)
        return out


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = SAMPLE_DOCS) -> DataFrame | None:
    """``lang, word, n`` of about ``most`` rows of each language, chosen by a hash of the id; None without a labelled row."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = docs.groupBy("lang").count()
    everything = counts.agg(F.sum("count")).first()[0]
    if not everything:
        return None
    found = counts.filter(F.col("count") >= LEAST_SHARE * everything).collect()  # at most 1 / LEAST_SHARE rows
    share = F.create_map(*[F.lit(x) for r in sorted(found) for x in (r["lang"], most / r["count"])])
    drawn = docs.filter(F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    @F.pandas_udf("array<string>")
    def words_of(texts: pd.Series) -> pd.Series:
        return pd.Series([LETTERS.findall(t.lower()) for t in texts], dtype=object)

    words = drawn.select("lang", F.explode(words_of("text")).alias("word"))
    return settled(words.groupBy("lang", "word").agg(F.count("*").alias("n")))


def predict(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score; only ``learn_from`` gives languages."""
    path = path or default_path()
    small_batches(docs.sparkSession)
    words = sample(learn_from, id_col, text_col, lang_col)
    langs, p = learn(words, path) if words is not None else ([], None)
    if not langs:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    @F.pandas_udf("lang_pred string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(langs, p, path)
        for texts in batches:
            logs = np.concatenate([scorer.score([t or "" for t in texts.iloc[k : k + 2000]]) for k in range(0, len(texts), 2000)] or [np.zeros((0, len(langs)))])
            none = np.isnan(logs).any(axis=1)
            logs[none] = 0
            odds = np.exp(logs - logs.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": np.where(none, "und", np.array(langs, dtype=object)[best]), "score": np.where(none, 0.0, 1 / odds.sum(axis=1))})

    [own] = unused([*docs.columns, "lang_pred", "score"], "told")
    out = docs.withColumn(own, of.asNondeterministic()(F.col(text_col).cast("string")))  # a filter must not run it twice
    return out.withColumn("lang_pred", F.col(f"{own}.lang_pred")).withColumn("score", F.col(f"{own}.score")).drop(own)


def accepted(docs: DataFrame, least: float = 0.5, **columns) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``, columns as they were.

    It learns from the same rows; without a single labelled row nothing can be told, and nothing is kept.
    """
    keep = docs.columns
    names = unused([*keep, "lang_pred", "score"], *[f"own_{i}" for i in range(len(keep))])
    aside = {c: n for c, n in zip(keep, names, strict=True) if c.lower() in ("lang_pred", "score")}
    told = predict(docs.withColumnsRenamed(aside), docs, **columns).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return told.withColumnsRenamed({n: c for c, n in aside.items()}).select(*keep)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language from its text alone; texts that are null or without a letter are ``und``."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.drop("lang"), docs.filter(crc() % 3 != 1))
    return out.select("doc_id", F.coalesce(crc() % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
