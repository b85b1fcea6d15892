"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's pairs are the leaves of a segment tree of minima; a leaf holds rank * width + place, so the root
is the leftmost pair of the lowest rank. A merge updates three leaves (the merged pair, its right neighbour,
which goes, and its left neighbour) in logarithmic time, until the root holds no pair. Short words go
through the trees of a whole block at once, one numpy step per merge; long words through a tree of their
own, so a word of n bytes costs n log n.

Words recur, so each Python worker keeps the ids of the words it has met, within a bound.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to an empty text; a
special token's string in a text becomes its id, as in the public library; columns named like the results
are replaced.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import read, small_batches, unused

#: How words are cut; \p{L} and \p{N} as in the public tokenizer's own pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers within a task and from task to task, words in one block, and bytes up to which a word joins a block.
MEMORY, KEPT, BLOCK, SHORT = 150_000, 30_000, 10_000, 32
NONE = np.int64(1) << 62


def _byte_chars() -> dict[str, int]:
    """The characters by which vocabulary files write bytes: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """The merges as a sorted table of pairs, and what each id stands for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars, vocab = _byte_chars(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left, right = (np.array([vocab[x[k]] for x in merges], np.int64) for k in (0, 1))
        order = np.argsort(left << 20 | right, kind="stable")
        self.pairs, self.ranks = (left << 20 | right)[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def encode_block(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words of equal length, all trees in step."""
        length = len(words[0])
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)]
        if length == 1:
            return ids.tolist()
        width = 1 << (length - 1).bit_length()
        places = np.arange(length - 1)
        tree = np.full((len(words), 2 * width), NONE)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        tree[:, width : width + length - 1] = np.where(ranks == NONE, NONE, ranks * width + places)
        for low in (width >> k for k in range(1, width.bit_length())):
            tree[:, low : 2 * low] = np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2])
        after = np.tile(np.arange(1, length + 1), (len(words), 1))
        before = np.tile(np.arange(-1, length - 1), (len(words), 1))
        rows = np.flatnonzero(tree[:, 1] < NONE)

        def put(rows: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = place + width
            tree[rows, node] = value
            while node[0] > 1:  # all leaves are equally deep
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        while len(rows):
            root = tree[rows, 1]
            place, rank = root % width, root // width
            right = after[rows, place]
            beyond = after[rows, right]
            ids[rows, place] = self.made[rank]
            ids[rows, right] = -1
            after[rows, place] = beyond
            put(rows, np.minimum(right, width - 1), np.full(len(rows), NONE))
            has = beyond < length
            value = np.full(len(rows), NONE)
            before[rows[has], beyond[has]] = place[has]
            new = self.rank(ids[rows[has], place[has]], ids[rows[has], beyond[has]])
            value[has] = np.where(new == NONE, NONE, new * width + place[has])
            put(rows, place, value)
            left = before[rows, place]
            has = left >= 0
            if has.any():
                at, left = rows[has], left[has]
                new = self.rank(ids[at, left], ids[at, place[has]])
                put(at, left, np.where(new == NONE, NONE, new * width + left))
            rows = rows[tree[rows, 1] < NONE]
        keep = ids >= 0
        ends = np.cumsum(keep.sum(axis=1))[:-1]
        return [x.tolist() for x in np.split(ids[keep], ends)]

    def encode_long(self, word: bytes) -> list[int]:
        """The ids of one word by a tree of its own."""
        ids, n = self.of_byte[np.frombuffer(word, np.uint8)].tolist(), len(word)
        width, get, none = 1 << max(1, (n - 1).bit_length()), self.rank_of.get, int(NONE)
        leaf = lambda a, b, place: none if (r := get(a << 20 | b)) is None else r * width + place
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = [leaf(ids[i], ids[i + 1], i) for i in range(n - 1)]
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(place: int, value: int) -> None:
            node = place + width
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, place = divmod(tree[1], width)
            right = after[place]
            beyond = after[place] = after[right]
            ids[place], ids[right] = int(self.made[rank]), -1
            if right < n - 1 or right < width:
                put(right, none)
            put(place, none if beyond >= n else leaf(ids[place], ids[beyond], place))
            if beyond < n:
                before[beyond] = place
            if (left := before[place]) >= 0:
                put(left, leaf(ids[left], ids[place], left))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; a special token's string is one id."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        raw = [w.encode() for w in words]
        for i, w in enumerate(raw):
            if words[i] in self.special:
                out[i] = [self.special[words[i]]]
            elif len(w) > SHORT:
                out[i] = self.encode_long(w)
            elif w:
                by_length.setdefault(len(w), []).append(i)
        for at in by_length.values():
            for k in range(0, len(at), BLOCK):
                part = at[k : k + BLOCK]
                for i, ids in zip(part, self.encode_block([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out


class _Words(dict):
    """Words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


class Encoder:
    """A vocabulary, the way to cut texts, and the words met so far."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        special = "|".join(regex.escape(x) for x in sorted(self.vocabulary.special, key=len, reverse=True))
        self.special = regex.compile(f"({special})") if special else None
        letter = regex.compile(r"[\p{L}\p{N}]")
        odd = [c for c in map(chr, range(0x370, 0x110000)) if unicodedata.category(c) == "Cn" and letter.match(c)]
        self.odd, self.far = set(odd), re.compile("[\u0370-\U0010ffff]").search
        self.words, self.offsets, self.flat = _Words(), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        """All words but the first ones met, which are the commonest."""
        if len(self.words) > KEPT:
            self.words = _Words(zip(itertools.islice(self.words, KEPT), range(KEPT), strict=True))
            self.offsets = self.offsets[: KEPT + 1].copy()
            self.flat = self.flat[: self.offsets[-1]].copy()

    @functools.cached_property
    def library_cut(self):
        """The public library's own cutting, for characters on which Unicode versions differ."""
        from tokenizers import pre_tokenizers

        cutter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        return lambda text: [text[a:b] for _, (a, b) in cutter.pre_tokenize_str(text)]

    def cut(self, text: str) -> list[str]:
        if self.special and any(x in text for x in self.vocabulary.special):
            return [w for i, part in enumerate(self.special.split(text)) for w in ([part] if i % 2 else self._cut(part))]
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if not text.isascii() and self.far(text) and not self.odd.isdisjoint(text):
            return self.library_cut(text)
        return self.find(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.words) > MEMORY:
            self.forget()
        known, place = len(self.words), self.words.__getitem__
        docs = []
        for text in texts:
            words = self.cut(text)
            docs.append(np.fromiter(map(place, words), np.int64, len(words)))
        if len(self.words) > known:
            new = self.vocabulary.encode_words([*self.words][known:])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in new])])
            self.flat = np.concatenate([self.flat, np.array([i for x in new for i in x], np.int32)])
        out = []
        for at in docs:
            start, n = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
            ends = np.cumsum(n)
            steps = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            out.append(self.flat[np.repeat(start, n) + steps])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _rows(texts: pd.Series, most_chars: int = 4_000_000) -> Iterator[list[str]]:
    """Texts in lists of bounded size."""
    part, chars = [], 0
    for t in texts:
        t = t or ""
        if part and chars + len(t) > most_chars:
            yield part
            part, chars = [], 0
        part.append(t)
        chars += len(t)
    yield part


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """``docs`` with the ids of each whole text and, if a name is given, the text that these ids decode to."""
    path = path or default_path()
    schema = f"ids array<int>{', decoded string' * bool(decoded_col)}"

    @F.pandas_udf(schema)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for texts in batches:
            ids = [x for part in _rows(texts) for x in coder.encode(part)]
            out = pd.DataFrame({"ids": pd.Series(ids, dtype=object)})
            yield out.assign(decoded=pd.Series([coder.decode(x) for x in ids], dtype=object)) if decoded_col else out
        coder.forget()

    small_batches(docs.sparkSession)
    [own] = unused([*docs.columns, ids_col, decoded_col or ids_col], "bpe")
    out = docs.withColumn(own, both(F.col(text_col).cast("string"))).withColumn(ids_col, F.col(f"{own}.ids"))
    return (out.withColumn(decoded_col, F.col(f"{own}.decoded")) if decoded_col else out).drop(own)


def decode(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of each list of ids; a null list gives an empty text, an unknown id is an error."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = encoder(path)
        for ids in batches:
            yield pd.Series(["" if x is None else coder.decode(np.asarray(x)) for x in ids], dtype=object)

    small_batches(df.sparkSession)
    return df.withColumn(decoded_col, text(F.col(ids_col)))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, a null text as the empty one; repeated rows are treated alike."""
    out = encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
