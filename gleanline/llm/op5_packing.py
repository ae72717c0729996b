"""Harmonic packing of token pieces into sequences of a fixed capacity C.

A piece of length L belongs to the class k = floor(C / L): k of them always fit into one sequence,
and each class fills its own sequences with k pieces apiece, on any number of workers at once, for
the place of a piece follows from its number within its class. Padding is kept small by the cuts:
a document's whole sequences go first, the rest is cut greedily at C/2, C/4 ... C/32, which fill
their sequences exactly, and only a tail shorter than C/32 joins the class of its own length.

What a class has beyond its last full sequence is at most k - 1 pieces, whatever the input's size;
these leftovers of all classes (some ten thousand at most) are packed together, longest first.

Edge cases: a null or empty text is the end token alone; texts of any length are cut; repeated rows
are packed each for itself; an empty table gives no pieces; further columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanline.llm import textbatch
from gleanline.llm.common import cut, documents, numbered

CAPACITY = 2048
END = 1
#: Words that a task's vocabulary cache holds before it starts anew, and ids in it.
CACHE_WORDS, CACHE_IDS = 200_000, 1_000_000
ROWS_PER_BLOCK = 20_000


def vocabulary() -> str:
    """The place of the tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of texts by way of their words.

    The tokenizer splits at white space before anything else, so a text's ids are those of its words
    in turn, and each distinct word is encoded once and then looked up by its hash. For plain Latin
    words with or without closing punctuation the tokenizer's normalizers only lower the case and its
    splitter parts letters from punctuation, so these go straight to its model; others take all its steps.
    """

    #: Latin letters whose composed, lower-case form str.lower() gives, then punctuation.
    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([.,;:!?|%$&*#()-]*)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the byte alphabet of the model: printable Latin-1 stands for itself, other bytes follow from 256 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}
        self.reset()

    def reset(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _room(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            setattr(self, name, np.concatenate([old, np.zeros(max(n - len(old), len(old)), old.dtype)]))

    def encode(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        hard = []
        for k, word in enumerate(words):
            if m := self.PLAIN.fullmatch(word):
                ids: list[int] = []
                for part in m.groups():
                    if part:
                        part = part.lower()
                        ids += [x.id for x in self.model.tokenize(part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode())))]
                out[k] = ids
            else:
                hard.append(k)
        for k, found in zip(hard, self.tokenizer.encode_batch([words[k] for k in hard], add_special_tokens=False), strict=True):
            out[k] = found.ids
        return out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        t = textbatch.segment(texts, lower=False)
        if not len(t.start):
            return [np.zeros(0, np.int32)] * len(texts)
        if len(self.known) > CACHE_WORDS or self.used > CACHE_IDS:
            self.reset()
        hashes, first, which = np.unique(t.hashes, return_index=True, return_inverse=True)
        get = self.known.get
        slot = np.array([get(h, -1) for h in hashes.tolist()], dtype=np.int64)
        new = np.nonzero(slot < 0)[0]
        if len(new):
            raw, lo, hi = t.data.tobytes(), t.start[first[new]].tolist(), t.end[first[new]].tolist()
            found = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(lo, hi, strict=True)])
            base, sizes = len(self.known), np.array([len(x) for x in found], dtype=np.int64)
            total = int(sizes.sum())
            self._room("start", base + len(new))
            self._room("size", base + len(new))
            self._room("flat", self.used + total)
            self.start[base : base + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.size[base : base + len(new)] = sizes
            self.flat[self.used : self.used + total] = np.fromiter((i for x in found for i in x), np.int32, total)
            self.used += total
            slot[new] = np.arange(base, base + len(new))
            self.known.update(zip(hashes[new].tolist(), slot[new].tolist(), strict=True))
        word = slot[which]
        size = self.size[word]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[word] - (ends - size), size) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[t.words]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest, part = n % capacity, capacity // 2
    while part >= max(1, capacity // 32):
        if rest >= part:
            out.append(part)
            rest -= part
        part //= 2
    return out + [rest] if rest else out


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        tokens, end = WordTokens(vocab), np.array([END], dtype="<u4")
        for batch in (s for b in batches for s in textbatch.slices(b)):
            row, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(tokens(batch.column("text"))):
                raw, at = np.concatenate([ids.astype("<u4"), end]).tobytes(), 0
                for n in cuts(len(ids) + 1, capacity):
                    row.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(ids) + 1)
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(found: DataFrame, capacity: int = CAPACITY, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """found (with length) with sequence_id and offset. It is read several times: cut its lineage first."""
    classed = found.withColumn("k", F.expr(f"CAST({capacity} DIV length AS INT)"))
    ranked = numbered(classed, ["k"], [F.col(c) for c in found.columns], rows_per_block, "_r")
    counts = classed.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))  # at most `capacity` rows
    earlier = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("_full", F.expr("_n DIV k")).withColumn("_base", F.coalesce(F.sum("_full").over(earlier), F.lit(0)))
    placed = ranked.join(F.broadcast(bases), "k").withColumn("_bin", F.expr("_r DIV k"))
    full = placed.filter("_bin < _full").withColumn("sequence_id", F.col("_base") + F.col("_bin"))
    inside = Window.partitionBy("sequence_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    columns, first = found.columns, bases.agg(F.coalesce(F.sum("_full"), F.lit(0))).first()[0]
    rest = placed.filter("_bin >= _full").select(*columns)

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *(c for c in columns if c != "length")], ascending=False, kind="stable")
        used: list[int] = []
        at, offset, open_from = [], [], 0
        for n in rows.length.to_numpy():
            k = next((j for j in range(open_from, len(used)) if used[j] + n <= capacity), len(used))
            if k == len(used):
                used.append(0)
            at.append(k)
            offset.append(used[k])
            used[k] += int(n)
            while open_from < len(used) and used[open_from] == capacity:
                open_from += 1
        return rows.assign(sequence_id=first + np.array(at, dtype=np.int64), offset=np.array(offset, dtype=np.int64))[[*columns, "sequence_id", "offset"]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields), "sequence_id long, offset long"])
    # fewer than k pieces of each class k: one group of bounded size
    last = rest.groupBy(F.lit(0).alias("g")).applyInPandas(together, schema)
    return full.select(*columns, F.col("sequence_id").cast("long"), "offset").unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(cut(pieces(documents(spark, sf_dir), vocabulary())))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the packed pieces of all documents that are left."""
    return pack(cut(pieces(docs, vocabulary())))
