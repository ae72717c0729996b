"""Token counts against a plain loop over the texts with another library's encoder of the same vocabulary."""

from __future__ import annotations

import math
import time
from itertools import groupby

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanline.functions import tokenizing
from gleanline.plans import tokenized

SF = "/root/testdata/sf0.001"
SPACES = {*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}


def plain(encoder, text):
    if not text:
        return 0
    total, short = 0, ""
    for space, run in ((s, "".join(r)) for s, r in groupby(text, lambda c: ord(c) in SPACES)):
        if len(run) >= 256:
            total += len(encoder.encode(short, add_special_tokens=False).ids) + math.ceil(len(run) / (8 if space else 3))
            short = ""
        else:
            short += run
    return math.ceil((total + len(encoder.encode(short, add_special_tokens=False).ids)) * 1.15)


def encoder():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_hard_texts(spark):
    texts = [None, "", " ", "a", "x" * 255, "x" * 256, "x" * 1000, " " * 255, "a" + " " * 256 + "b", "word " * 300, "a b" + "　" * 300 + "é" * 300 + "end", "<|endoftext|> is text", "名前は" * 40, "x" * 300 + " " * 300 + "y" * 300, "\x1c" * 300, "🙂 " * 50, "base64" * 200000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    cost = tokenizing.estimate(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = {r.k: r.tokens for r in rows.select("k", cost.alias("tokens")).collect()}
    assert got == {k: plain(encoder(), t) for k, t in enumerate(texts)}


def test_all_documents(spark):
    known = encoder()
    want = {r.doc_id: plain(known, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.tokens for r in tokenized.document_tokens(spark, SF).collect()} == want


def test_runs_just_short_of_long_ones_are_looked_at_once(spark):
    text = ("x" * 250 + " " * 250) * 8000
    rows = spark.createDataFrame([(0, text), (1, text + "x" * 6 + "y" * 256)], "k int, text string")
    cost = tokenizing.estimate(F.col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    began = time.time()
    got = {r.k: r.tokens for r in rows.select("k", cost.alias("tokens")).collect()}
    assert time.time() - began < 30
    assert got == {k: plain(encoder(), t) for k, t in rows.collect()}
