import hashlib
import random

import tokenizers
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from braidwork.llm import bpe

PATH = bpe.default_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    coder = bpe.encoder(PATH)
    ids = coder.encode([text])[0]
    assert ids.tolist() == ids_of(text)
    assert coder.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_long_and_odd_words():
    rnd = random.Random(1)
    texts = ["a" * 5000, "ab" * 3000 + " " + "é" * 700, "\n" * 300, "don't we'll '", "x<|endoftext|>y", "՘a࢏b", "\x1c\x85  z"]
    texts += ["".join(rnd.choice("abcdef  \n'stre.!09é漢🙂") for _ in range(80)) for _ in range(300)]
    coder = bpe.encoder(PATH)
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == ids_of(text) and coder.decode(ids) == text


def test_query_columns(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op10_bpe(spark, SMALL).collect()}
    assert got == {i: (len(x), sha(",".join(map(str, x))), sha(LIBRARY.decode(x, skip_special_tokens=False))) for i, t in texts.items() for x in [ids_of(t)]}


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for r in bpe.decode(bpe.encode(docs, decoded_col=None), decoded_col="back").select("text", "ids", "back").collect():
        assert r["ids"] == ids_of(r["text"]) and r["back"] == r["text"]
