"""Byte-level BPE against the tokenizer library."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from codonlake.llm import bpe

WORDS = "The quick, brown fox's tail don't 12345 éèêaiment ouéaieuxlepa 今日は world Straße \U0001f600 naïve (x==y) &amp; <|endoftext|>  ab".split()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})


def sample():
    rng = random.Random(12)
    some = lambda letters, n: "".join(rng.choices(letters, k=n))
    out = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 60))) for _ in range(60)]
    out += ["".join(rng.choice([" ", "  ", "\n", "\t", "\r\n", " ", "　", "​", "\x1c", "\x85", *WORDS]) for _ in range(40)) for _ in range(60)]
    out += [some("aab", 30) for _ in range(40)] + [some("theionrs ", 80) for _ in range(40)] + [some("=-*_ ", 50) for _ in range(40)]
    out += ["", None, " ", "\n\n\n", "   \n  ", "\0\0a\0", out[0], out[0], some("etaoin", 3_000), " ".join(WORDS * 500), "'s 't'S I'LL"]
    return out


@pytest.mark.parametrize("head", [1 << 18, 8])
def test_equal_to_the_library(spark, library, head):
    texts = sample()
    df = spark.createDataFrame([(None if k == 3 else k // 2, t, 1, "w") for k, t in enumerate(texts)], "doc_id long, text string, ids int, word string")
    got = sorted(map(repr, (tuple(r) for r in bpe.digests(df, head=head).collect())))
    want = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want.append((None if k == 3 else k // 2, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(map(repr, want))


def test_numbers_and_round_trip(spark, library):
    texts = [t for t in sample() if t]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = bpe.encode(df, head=20).select("text", bpe.numbers(F.col("ids")).alias("n"), bpe.decode(F.col("ids")).alias("back")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n"] == library.encode_ordinary(r["text"]) and bytes(r["back"]) == r["text"].encode()


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
