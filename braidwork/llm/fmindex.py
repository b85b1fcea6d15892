"""Benchmark decontamination by FM-indexes over training shards.

A phrase is a window of 10 words of a benchmark item, or the whole of a shorter one. A task reads documents and cuts
them into shards of about a million symbols. A symbol is a word that some phrase has; all other words are one
separator, and what stands between two separators is a stretch. A stretch that is shorter than every
phrase can't hold any, so it is left out; nothing else is, and a stretch longer than a shard goes on in the next one with
an overlap. Of each shard the suffix array is sorted by prefix doubling, and its Burrows-Wheeler transform is
kept as a wavelet matrix, with the places of every eighth suffix and of each stretch's first. All phrases are
searched at once, from their last words backward, by two ranks for a word; the rows that are left walk to a sampled
place, and the places become spans of words that are merged for each document.

A shard lives and ends in its task: nothing is shuffled, and a lost task is done again alone. Benchmarks of more than
``PHRASE_WORDS`` words are dealt into parts by a hash; documents pass through the parts one after another.

Defined cases: null and empty texts have no words and no hits; an item without words is no phrase; rows that repeat an id
are documents (or, with other texts, parts of one item) of their own; an item without an id takes part and is listed
as an empty string; an empty benchmark hits nothing; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import read, small_batches

WINDOW = 10
#: Symbols of a shard, bytes of texts that wait for it, and words of a benchmark's part.
SHARD, WAITING, PHRASE_WORDS = 1 << 20, 1 << 26, 2_000_000
#: Every so many places of a suffix are kept.
SAMPLE = 8
#: Bytes to lower-case letters, digits and bytes beyond ASCII; all others to blanks.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling over what is still tied; separators (0) differ by place, the last symbol is one."""
    n, ends = len(codes), np.flatnonzero(codes == 0)
    first = codes.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    tied, one, two, shift = np.arange(n), np.zeros(n, np.int64), first, 0
    rank = np.empty(n, np.int64)
    while len(tied):
        order = np.lexsort((two, one))
        tied, one, two = tied[order], one[order], two[order]
        at = np.arange(len(tied))
        new_one = np.r_[True, one[1:] != one[:-1]]
        new = new_one | np.r_[True, two[1:] != two[:-1]]
        # a suffix ranks by the first place of its group
        group, pair = np.maximum.accumulate(np.where(new_one, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[tied] = one + pair - group
        tied = tied[~(new & np.r_[new[1:], True])]
        shift = 2 * shift or 1
        one, two = rank[tied], rank[tied + shift]
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with counts of the ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & low)


class Wavelet:
    """A wavelet matrix: one bit vector for each bit of the symbols, the highest first, each sorted stably by the one before."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for shift in reversed(range(max(1, top.bit_length()))):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.start = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> shift & 1, bits.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands before i."""
        return self._down(c, i) - self.start[c]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and how often each stands before."""
        c = np.zeros(len(i), np.int64)
        for _, bits in self.levels:
            one, ones = bits[i], bits.rank(i)
            c, i = c << 1 | one, np.where(one, bits.zeros + ones, i - ones)
        return c, i - self.start[c]


class Index:
    """FM-index of a shard: symbols from 1, stretches each ended by a 0."""

    def __init__(self, codes: np.ndarray, top: int):
        places = suffix_array(codes)
        last = codes[places - 1].astype(np.int64)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=top + 1))])
        self.wavelet = Wavelet(last, top)
        sampled = (places % SAMPLE == 0) | (last == 0)  # walks end at a stretch's first word at the latest
        self.sampled, self.places = Bits(sampled), places[sampled]
        self.n = len(codes)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows, their words at the right end) that occur, and the rows of suffixes that begin with each."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(1, phrases.shape[1] + 1):
            on = alive[lengths[alive] >= k]
            c = phrases[on, -k]
            low[on], high[on] = self.less[c] + self.wavelet.rank(c, low[on]), self.less[c] + self.wavelet.rank(c, high[on])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return alive, low[alive], high[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffixes, by steps back to a sampled one."""
        out, steps, left = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            hit = self.sampled[rows]
            out[left[hit]] = self.places[self.sampled.rank(rows[hit])] + steps
            left, rows, steps = left[~hit], rows[~hit], steps + 1
            c, before = self.wavelet.at(rows)
            rows = self.less[c] + before
        return out


class Phrases:
    """The windows of items by their words' numbers, and which items have each."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.window, self.number = window, {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for a in range(max(1, len(codes) - window + 1) if codes else 0):
                owners.setdefault(tuple(codes[a : a + window]), set()).add(name)
        self.items = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(x) for x in owners], np.int64)
        self.codes = np.zeros((len(owners), window), np.int64)
        for i, x in enumerate(owners):
            self.codes[i, window - len(x) :] = x
        self.shortest = int(self.lengths.min()) if len(owners) else 0

    def numbered(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words))

    def occurrences(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and the places where they occur in a shard."""
        index = Index(codes, len(self.number))
        found, low, high = index.search(self.codes, self.lengths)
        count = high - low
        rows = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.repeat(found, count), index.locate(rows)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class _Shard:
    """Documents that wait, and the stretches of their words that are still to be searched."""

    def __init__(self, phrases: Phrases, size: int):
        self.phrases, self.size = phrases, size
        self.waiting: list[dict] = []
        self.pieces: list[tuple[dict, int, np.ndarray]] = []
        self.symbols = self.bytes = 0

    def add(self, doc: dict) -> None:
        p = self.phrases
        words = words_of(doc["text"])
        doc["n_words"] = len(words)
        self.waiting.append(doc)
        self.bytes += len(doc["text"] or b"")
        if not p.shortest or len(words) < p.shortest:
            return
        codes = p.numbered(words)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], codes > 0, [0]]).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        for k in np.flatnonzero(stops - starts >= p.shortest):
            a, stop = int(starts[k]), int(stops[k])
            while True:
                b = min(stop, a + self.size)
                self.pieces.append((doc, a, codes[a:b]))
                self.symbols += b - a + 1
                if self.symbols >= self.size:
                    self.search()
                if b == stop:
                    break
                a = b - p.window + 1

    def search(self) -> None:
        """What the pieces hold goes to their documents."""
        if not self.pieces:
            return
        codes = np.concatenate([x for _, _, c in self.pieces for x in (c, [0])])
        starts = np.cumsum([0, *[len(c) + 1 for _, _, c in self.pieces[:-1]]])
        found, places = self.phrases.occurrences(codes)
        piece = np.searchsorted(starts, places, "right") - 1
        order = np.lexsort((places, piece))
        for k, at, x in zip(piece[order].tolist(), places[order].tolist(), found[order].tolist(), strict=True):
            doc, offset, _ = self.pieces[k]
            a = at - int(starts[k]) + offset
            doc["items"].update(self.phrases.items[x])
            b = a + int(self.phrases.lengths[x])
            if doc["hit"] and doc["hit"][-1][0] <= a <= doc["hit"][-1][1]:
                doc["hit"][-1] = (doc["hit"][-1][0], max(b, doc["hit"][-1][1]))
            else:
                doc["hit"].append((a, b))
        self.pieces, self.symbols = [], 0

    def done(self) -> list[dict]:
        self.search()
        out, self.waiting, self.bytes = self.waiting, [], 0
        for doc in out:
            doc["hit"] = merged(doc["hit"])
        return out


def _letters(text: bytes, hit: list[tuple[int, int]]) -> list[dict]:
    """Spans of words as spans of code points."""
    if not hit:
        return []
    at = [m.span() for m in WORD.finditer(text.decode())]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in hit]


def _pass(phrases, size: int, last: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def told(docs: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame({"id": [d["id"] for d in docs], "n_words": [d["n_words"] for d in docs], "items": [sorted(d["items"]) for d in docs]})
            if last:
                return out.assign(n_hit=[sum(b - a for a, b in d["hit"]) for d in docs], spans=[_letters(d["text"], d["hit"]) for d in docs])
            return out.assign(text=[d["text"] for d in docs], hit=[[x for span in d["hit"] for x in span] for d in docs])

        shard = _Shard(phrases.value, size)
        for pdf in batches:
            for doc_id, text, hit, items in zip(pdf["id"], pdf["text"], pdf["hit"], pdf["items"], strict=True):
                flat = list(hit)
                shard.add({"id": doc_id, "text": text, "hit": list(zip(flat[::2], flat[1::2], strict=True)), "items": set(items)})
                if shard.bytes >= WAITING or len(shard.waiting) >= 20_000:
                    yield told(shard.done())
        if docs := shard.done():
            yield told(docs)

    return scan


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, size: int = SHARD, part: int = PHRASE_WORDS) -> DataFrame:
    """A row per document: its id, ``n_words, n_hit, items, spans``.

    ``n_hit`` counts words inside a phrase, ``items`` are the ids, as strings, of items with a phrase that occurs, and
    ``spans`` are where (``start, end`` in code points, ends exclusive).
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text).cast("string").cast("binary").alias("text"))
    length = F.coalesce(F.sum(F.octet_length("text")), F.lit(0))  # no text has more words than half its bytes
    parts = max(1, -(-items.agg(length.alias("n")).first()["n"] // (2 * part)))
    kind = docs.schema[id_col].dataType.simpleString()
    none = F.array().cast("array<long>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"), none.alias("hit"), F.array().cast("array<string>").alias("items"))
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k).collect()  # of bounded size
        phrases = spark.sparkContext.broadcast(Phrases([(r["name"], bytes(r["text"]) if r["text"] is not None else None) for r in own], window))
        last = k == parts - 1
        shape = f"id {kind}, n_words long, items array<string>, " + ("n_hit long, spans array<struct<start:int,end:int>>" if last else "text binary, hit array<long>")
        rows = rows.mapInPandas(_pass(phrases, size, last), shape)
    return rows


def without(text: Column, spans: Column) -> Column:
    """The text less its spans, which are in order."""
    stops = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    return F.array_join(F.zip_with(stops, starts, lambda a, b: F.substr(text, a + 1, b - a)), "")


def op12_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document; nulls, short items and repeated rows as in the module's cases."""
    found = scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("items", ","), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[a : a + 9], ' ') AS phrase FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
s AS (SELECT doc_id, a, m, array_to_string(w[a : a + m - 1], ' ') AS phrase FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM d, m)),
o AS MATERIALIZED (SELECT doc_id, a, s.m, item FROM s JOIN p ON p.m = s.m AND p.phrase = s.phrase),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + m)) AS x FROM (SELECT DISTINCT doc_id, a, m FROM o)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
