"""Personal data by candidate gradient boosting.

Exact patterns give the base spans of each kind. High-recall generators propose further, overlapping spans:
parts of long digit runs, windows of dotted numbers, numbers without a leading plus, addresses written
with spaces or words. Boosted trees judge a candidate by its format and context. They are fitted on
the candidates of all documents. Right are the base spans, and their loose forms put in their own places: plus or country code left
out, other separators, @ and dots spelled out. Wrong is what its kind's content rules out (octets, check digit,
a number that is part of another kind's span or of a word), other bounds of a loose form, and dates, decimals and
prose put in the same places. What is neither is left for the model to judge. The threshold of a kind is the lowest one that keeps the precision
asked for over all candidates, each judged by trees that have seen no candidate of its text. Base spans always stay; of the others, the likeliest that their content
doesn't rule out and that overlap no span of their kind are added.

Defined cases: a null text counts as empty; offsets are code points, ends exclusive; repeated rows are
treated alike; without enough to learn from nothing is added; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import cut, free, read, running, settled, small_batches
from braidwork.llm.trees import Boosted, boost_table

KINDS = ("email", "ip", "card", "phone")
#: Fewer examples teach nothing; folds of texts; distinct examples that a task counts before it passes them on.
LEAST_EXAMPLES, FOLDS, COUNTED = 40, 3, 20_000
PRECISION = 0.98

SEED = re.compile("[0-9@]")
#: What every text with a candidate holds, for Spark and for Python alike.
HINT = "[0-9@]|[^A-Za-z0-9]at[^A-Za-z0-9]"
HINTED = re.compile(HINT)
#: The base patterns. Starts are pinned to a digit run's beginning, where the leftmost match always starts.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
DIGITS = re.compile(r"[0-9]+")
LOOSE_NUMBER = re.compile(r"[+(]?[0-9](?:[ ().-]{0,3}[0-9])+")
#: A loose address is up to LONGEST_LOCAL characters of LOCAL and, from its sign on, this.
SIGN = re.compile(r"@|(?<=[\s(\[])at(?=[)\]\s])")
LOOSE_DOMAIN = re.compile(r"(?:\s?@\s?|\s?[(\[]at[)\]]\s?|\sat\s)[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[A-Za-z0-9-]{1,63})+")
LONGEST_LOCAL = 64
FEATURES = 25
DATE = re.compile(r"(?<![0-9])(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2})(?![0-9])")
LAST_LABEL = re.compile(r"[A-Za-z0-9-]+\Z")
ANY_WORD = re.compile(r"[A-Za-z]{2,}")
#: Common ends of domains, ways to write @ and dots, characters around a rewritten span.
ENDINGS = frozenset("com org net edu gov mil int info biz io ai app dev name eu uk us ca au nz ie de at ch fr be nl lu es pt it pl cz sk hu ro bg gr dk se no fi ee lv lt ru ua tr il in cn jp kr tw hk sg id my th vn ph za ng ke eg br mx ar cl co pe test example invalid".split())
LOOSE_SIGNS = ((" at ", " dot "), (" at ", "."), (" [at] ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" @ ", "."), (" @ ", " dot "))
AROUND = 40

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def digits_of(text: str) -> str:
    return "".join(DIGITS.findall(text))


def emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: each @ takes the characters before it down to the last match's end."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if SEED.search(text):
        found["email"] = emails(text)
        found["ip"] = [m.span() for m in IP.finditer(text) if octets(m[0])]
        found["card"] = [m.span() for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def _groups(run: re.Match, least: int, most: int) -> Iterator[Span]:
    """Runs of neighbouring digit groups with a number of digits in range."""
    groups = [(m.start() + run.start(), m.end() + run.start()) for m in DIGITS.finditer(run[0])]
    for i in range(len(groups)):
        n = 0
        for a, b in groups[i:]:
            n += b - a
            if n > most:
                break
            if n >= least:
                yield groups[i][0], b


def loose_emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping: from each sign back over the characters of LOCAL, down to the last match's end."""
    end = 0
    for m in SIGN.finditer(text):
        at = m.start() - (m[0] != "@")
        if not text[at].isspace() and at and text[at - 1].isspace():
            at -= 1
        if at > end and text[at - 1] in LOCAL and (rest := LOOSE_DOMAIN.match(text, at)):
            start = at - 1
            while start > max(end, at - LONGEST_LOCAL) and text[start - 1] in LOCAL:
                start -= 1
            end = rest.end()
            yield start, end


def candidates(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """``kind, start, end`` and the bounds of the run around it, which give the context."""
    if not HINTED.search(text):
        return
    for a, b in loose_emails(text):
        yield "email", a, b, a, b
    for m in DOTTED.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start()) for p in DIGITS.finditer(m[0])]
        for i in range(len(parts) - 3):
            yield "ip", parts[i][0], parts[i + 3][1], *m.span()
    for m in CARD.finditer(text):
        for a, b in _groups(m, 13, 19):
            yield "card", a, b, *m.span()
    for m in LOOSE_NUMBER.finditer(text):
        for a, b in _groups(m, 9, 15):
            while a > m.start() and text[a - 1] in "+(":
                a -= 1
            yield "phone", a, b, *m.span()


def wrong(kind: str, span: str, left: str, right: str) -> bool:
    """Whether the content of a span, or a letter next to its run, rules its kind out."""
    if kind == "email":
        return not LAST_LABEL.search(span)[0].isalpha()
    if kind == "ip":
        return not octets(span)
    if kind == "card":
        return not luhn(digits_of(span))
    return left.isalpha() or right.isalpha() or DATE.search(span) is not None


def _ruled_out(text: str, kind: str, start: int, end: int, left: int, right: int) -> bool:
    return wrong(kind, text[start:end], text[left - 1 : left], text[right : right + 1])


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, kind: str, start: int, end: int, left: int, right: int) -> list[float]:
    span = text[start:end]
    d, before = digits_of(span), text[max(0, left - 24) : left].lower()
    groups = [len(x) for x in DIGITS.findall(span)]
    if kind == "email":  # its length, digits and signs only tell the learned addresses from others
        span, d, groups = LAST_LABEL.search(span)[0], "", []
    return [
        *(float(kind == k) for k in KINDS),
        len(span) * (kind != "email"), len(d), len(groups), max(groups, default=0), min(groups, default=0),
        float(kind == "card" and luhn(d)), float(kind == "ip" and octets(span)),
        float(span.startswith("+")), float("(" in span), float("@" in span), span.count(" "), span.count("-"), span.count("."),
        float(len({c for c in span if not c.isdigit()}) * (kind != "email")), float(d.startswith("0")),
        _class(text[left - 1 : left]), _class(text[right : right + 1]),
        len(digits_of(text[left:start])) + len(digits_of(text[end:right])), float(kind == "phone" and DATE.search(span) is not None),
        float(kind == "email" and span.lower() in ENDINGS),
        float(any(w in before for w in ("mail", "phone", "tel", "call", "card", "visa", "ip ", "host", "addr", "contact"))),
    ]


def loose_forms(kind: str, span: str) -> list[str]:
    """An email or phone of the base patterns as people write it otherwise."""
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        return [local + at + domain.replace(".", dot) for at, dot in LOOSE_SIGNS]
    if kind != "phone":
        return []
    first, *own = DIGITS.findall(span)
    out = [span[1:]]
    if len(own) > 1:
        tail, area, rest = span[1 + len(first) :].lstrip(" ).-"), own[0], own[1:]
        out += [tail, f"({area}) {'-'.join(rest)}", "-".join(own), ".".join(own), " ".join(own), f"{area} {''.join(rest)}", f"0{area} {''.join(rest)}", f"00{first} {' '.join(own)}"]
    return list(dict.fromkeys(f for f in out if 9 <= len(digits_of(f)) <= 15))


def false_forms(kind: str, span: str, before: str, after: str) -> list[str]:
    """What looks like a loose email or phone but is none, from a span's digits and the words around it."""
    if kind == "email":
        words = [w for w in ANY_WORD.findall(f"{before} {after}") if w.lower() not in ENDINGS]
        x, y, z = [*words, "look", "the", "house"][:3]
        return [f"{x} at {y}.{z}", f"{x} at {y} dot {z}", f"{y} at 10.30", f"{z} @ 3.50"]
    if kind != "phone":
        return []
    d = digits_of(span)
    return [f"20{d[1:3]}-0{d[3]}-1{d[4]} 1{d[5]}", f"1{d[1]}.0{d[2]}.20{d[3:5]} 1{d[5]}.{d[6:8]}", f"{d[0]}.{d[1:4]} {d[4]}.{d[5:8]} {d[8]}.{d[1:4]}"]


def _examples(texts: pd.Series) -> Iterator[tuple[float, list[float]]]:
    for text in texts:
        text = text or ""
        spans = base_spans(text)
        base = {(k, *s) for k, own in spans.items() for s in own}
        others = sorted((a, b) for k in ("email", "ip", "card") for a, b in spans[k])
        ends = list(accumulate((b for _, b in others), max))
        inside = lambda a, b: (i := bisect_left(others, (b,))) > 0 and ends[i - 1] > a
        for kind, a, b, left, right in candidates(text):
            if (kind, a, b) in base:
                yield 1.0, features(text, kind, a, b, left, right)
            elif _ruled_out(text, kind, a, b, left, right) or kind == "phone" and inside(a, b):
                yield 0.0, features(text, kind, a, b, left, right)
        for kind in ("email", "phone"):
            for a, b in spans[kind]:
                if kind == "phone" and inside(a, b):
                    continue
                before, after = text[max(0, a - AROUND) : a], text[b : b + AROUND]
                for right_form, forms in ((True, loose_forms(kind, text[a:b])), (False, false_forms(kind, text[a:b], before, after))):
                    for form in forms:
                        new, start, end = before + form + after, len(before), len(before) + len(form)
                        for k, x, y, *run in candidates(new):
                            if k == kind and x < end and y > start:
                                yield float(right_form and (x, y) == (start, end)), features(new, k, x, y, *run)


def examples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``fold, part, y, x, n``: how often the documents give an example; part is its kind, fold comes from the text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").rlike(HINT))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def counted() -> pd.DataFrame:
            keys = [*seen]
            x = pd.Series([np.array(k[2], float) for k in keys], dtype=object)
            return pd.DataFrame({"fold": [k[0] for k in keys], "part": [k[2].index(1.0) for k in keys], "y": [k[1] for k in keys], "n": [*seen.values()]}).assign(x=x)

        for batch in batches:
            for fold, text in zip(batch["fold"], batch["text"], strict=True):
                seen.update((fold, y, tuple(x)) for y, x in _examples([text]))
                if len(seen) > COUNTED:
                    yield counted()
                    seen.clear()
        if seen:
            yield counted()

    found = texts.select(F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(FOLDS)).cast("int").alias("fold"), "text").mapInPandas(rows, "fold int, part int, y double, n long, x array<double>")
    return found.groupBy("fold", "part", "y", "x").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold, from all documents; above 1, nothing is added."""
    rows = settled(examples(docs, text_col))
    none = {k: 2.0 for k in KINDS}
    if (rows.agg(F.sum("n")).first()[0] or 0) < LEAST_EXAMPLES:
        return Boosted(-9.0, 0.0, []), none
    models, scored = boost_table(rows, FOLDS)
    return models[0], none | {KINDS[k]: p for k, p in _thresholds(scored).items()}


def _thresholds(scored: DataFrame) -> dict[int, float]:
    """By part the lowest probability from which on the precision holds over all rows, if there is one; at least one half."""
    steps = cut(scored.groupBy("part", "p").agg(F.sum(F.col("n") * F.col("y").cast("long")).alias("good"), F.sum("n").alias("n")))
    first, before = {}, (0, 0)
    for r in steps.groupBy("part").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).orderBy("part").collect():  # a row for each kind
        first[r["part"]], before = before, (before[0] + r["good"], before[1] + r["n"])
    own = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in first.items() for x in (k, v[i])]), F.col("part"))
    precision = (F.col("good_before") + F.col("good") - own(0)) / (F.col("n_before") + F.col("n") - own(1))
    held = running(steps, [F.col("part"), F.col("p").desc()], {"good": "good_before", "n": "n_before"}).filter(precision >= PRECISION)
    return {r["part"]: max(0.5, r["p"]) for r in held.groupBy("part").agg(F.min("p").alias("p")).collect()}


def spans_of(text: str, model: Boosted, thresholds: dict[str, float]) -> list[tuple[str, int, int, bool, float]]:
    """``kind, start, end, base, score`` by kind, then start."""
    base = base_spans(text)
    out = [(k, a, b, True, 1.0) for k in KINDS for a, b in base[k]]
    found = [c for c in dict.fromkeys(candidates(text)) if not _ruled_out(text, *c)] if min(thresholds.values()) <= 1 else []
    if found:
        # positions of base spans by kind, to see overlaps by search
        taken = {k: sorted(base[k]) for k in KINDS}
        scores = model.predict(np.array([features(text, *c) for c in found], float))
        for p, (kind, a, b, *_) in sorted(zip(scores, found, strict=True), key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
            if p >= thresholds[kind] and free(taken[kind], a, b):
                out.append((kind, a, b, False, float(p)))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def find(docs: DataFrame, model: Boosted, thresholds: dict[str, float], text_col: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of ``kind, start, end, base, score``."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<kind string, start int, end int, base boolean, score double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "score")
        for texts in batches:
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in spans_of(t or "", model, thresholds)] for t in texts], dtype=object)

    text = F.col(text_col).cast("string")
    return docs.withColumn(into, spans(F.when(text.rlike(HINT), text)))  # texts without a hint aren't sent


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans", into: str = "redacted") -> DataFrame:
    """``found`` with every span of the text replaced by its kind in brackets; overlapping spans go together."""

    @F.udf("string", useArrow=True)
    def redacted(text, spans):
        out, end = [], 0
        for kind, a, b in sorted(((s["kind"], s["start"], s["end"]) for s in spans or []), key=lambda s: s[1:]):
            if a >= end:
                out += [text[end:a], f"[{kind}]"]
            end = max(end, b)
        return None if text is None else "".join(out) + text[end:]

    return found.withColumn(into, redacted(text_col, spans_col))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; a null text counts as empty, repeated rows are treated alike."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, *fit(docs)).withColumn("_base", F.filter("spans", lambda s: s["base"]))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("_base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
