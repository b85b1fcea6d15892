"""Quality scores from a sparse ensemble of rules over text statistics.

Boosted trees are fitted on a bounded sample of labelled rows; every path from a root to a node is a rule, a
conjunction of comparisons. A logistic model with a lasso penalty keeps few rules, and these are compiled
into one Spark column, so scoring stays inside whole-stage code.

Defined cases: a null text counts as empty, and an empty text has a score like any other; rows without a
label or an id teach nothing; without both labels the score is the share of label 1 (0.5 without any label); columns
named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import SPACE, crc, few, read, unused
from braidwork.llm.trees import boost, lasso_logistic

#: Labelled rows from which rules are learned, chosen by a hash of the id.
SAMPLE_ROWS = 6000
ROUNDS, DEPTH, PENALTY = 24, 3, 0.002
STATISTICS = ("chars", "words", "word_length", "distinct_words", "upper", "digits", "symbols", "marks", "lines", "line_words", "distinct_lines", "bars")


def with_statistics(df: DataFrame, text_col: str = "text", into: str = "_stats") -> DataFrame:
    """``df`` with a struct of the statistics of the whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own, own_words, own_lines = unused([*df.columns, into], "own", "words", "lines")
    df = df.withColumn(own, text).withColumn(own_words, F.filter(F.split(text, SPACE), lambda w: w != "")).withColumn(own_lines, F.split(text, "\n", -1))
    chars, words, lines = F.length(own), F.size(own_words), F.size(own_lines)
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    without = lambda pattern: chars - F.length(F.regexp_replace(own, pattern, ""))
    single = lambda c: chars - F.length(F.replace(F.col(own), F.lit(c), F.lit("")))
    values = {
        "chars": F.log1p(chars),
        "words": F.log1p(words),
        "word_length": share(chars - words + 1, words),
        "distinct_words": share(F.size(F.array_distinct(own_words)), words),
        "upper": share(without(r"\p{Lu}+"), chars),
        "digits": share(without("[0-9]+"), chars),
        "symbols": share(without(r"[^\p{L}\p{N}\s]+"), chars),
        "marks": share(single("!"), chars),
        "lines": F.log1p(lines),
        "line_words": share(words, lines),
        "distinct_lines": share(F.size(F.array_distinct(own_lines)), lines),
        "bars": share(single("|"), chars),
    }
    return df.withColumn(into, F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])).drop(own, own_words, own_lines)


Rule = tuple[tuple[int, str, float], ...]


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.all([x[:, f] <= v if op == "<=" else x[:, f] > v for f, op, v in rule], axis=0)


def learn(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules."""
    if len(y) < 20 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return float(np.log(share / (1 - share))), []
    rules = list(dict.fromkeys(tuple(path) for tree in boost(x, y, ROUNDS, DEPTH).trees for path in tree.paths()))
    fires = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    intercept, weights = lasso_logistic(fires, y, PENALTY)
    return intercept, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6]


def compiled(intercept: float, rules: list[tuple[float, Rule]], stats: str = "_stats") -> Column:
    """The score as one column over the statistics."""
    total = F.lit(intercept)
    for weight, rule in rules:
        test = F.lit(True)
        for f, op, v in rule:
            stat = F.col(f"{stats}.{STATISTICS[f]}")
            test = test & ((stat <= v) if op == "<=" else (stat > v))
        total = total + F.when(test, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE_ROWS) -> tuple[float, list[tuple[float, Rule]]]:
    """Rules from about ``most`` rows of ``labels`` (id, label) and their texts in ``docs``."""
    labels = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    n = labels.count()
    drawn = labels.filter(F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1_000_000)) < 1_000_000 * most / max(n, 1))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(few(drawn)(drawn), "id")
    # an id that repeats may bring more rows than were drawn; the order by hash cuts these off
    found = with_statistics(rows).select("_stats.*", "y", "id").orderBy(F.xxhash64("id", "y", *STATISTICS), "id", "y", *STATISTICS).limit(2 * most).toPandas()
    return learn(found[[*STATISTICS]].to_numpy(float), found["y"].to_numpy(float))


def score(docs: DataFrame, intercept: float, rules: list[tuple[float, Rule]], text_col: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted."""
    [stats] = unused([*docs.columns, "score", "predicted"], "stats")
    out = with_statistics(docs, text_col, stats).withColumn("score", compiled(intercept, rules, stats)).drop(stats)
    return out.withColumn("predicted", F.when(F.col("score") >= least, 1).otherwise(0))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by rules learned from the labels that aren't held out; a null text as the empty one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").filter(crc() % 5 != 0))
    return score(docs, *model).select("doc_id", F.coalesce(crc() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
