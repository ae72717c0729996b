"""Multiple-instance learning of toxicity: sentences are scored, documents are labelled.

A sentence's probability is the logistic function of a bias and the weights of the hashed words in
it; a document is toxic if any sentence is (noisy-or): P = 1 - prod(1 - p_s). The weights are those
that make the document labels likeliest, so the words that carry a label are found without any
sentence label, and afterwards the sentence probabilities say where the offence stands.

Training reads at most MAX_TRAINING labelled documents, those with the smallest hash of their id
among the rows that are not held out; one task fits them. Scoring goes over all documents in whole.

Edge cases: a null or empty text has no sentence and score 0; repeated rows and ids get equal
scores; without labels of both classes every score is 0; with an empty table the result is empty;
labels without a document and null labels are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanline.llm import textbatch
from gleanline.llm.common import cut, documents

#: Documents that the fit reads at most.
MAX_TRAINING = 20_000
#: Buckets that words and their beginnings are hashed into.
BITS = 22
#: Lengths in bytes of the beginnings of words that are features, besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Sentence ends.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True
#: A feature carries weight if so many training documents have it and if its share of toxic and clean
#: documents differs by so many standard errors: chance alone takes hardly any of 4 million beyond it.
MIN_DOCUMENTS, MIN_Z = 4, 5.5


def sentences(t: textbatch.TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each word, and the text of each sentence; those without words aren't numbered."""
    doc = t.doc_of_word().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(_ENDS[t.data], dtype=np.int64)])[t.start]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (ends[1:] != ends[:-1])
    return np.cumsum(fresh) - 1, doc[fresh]


def features(t: textbatch.TextBatch) -> list[np.ndarray]:
    """For each kind of feature the bucket of each word, -1 where the word has none of that kind."""
    shift = np.uint64(64 - BITS)
    size = t.end - t.start
    first = textbatch.eights(t.data)[t.start]
    out = [(t.hashes >> shift).astype(np.int64)]
    for k in PREFIXES:
        found = (textbatch.mix((first & textbatch.MASKS[k]) + np.uint64(k * 0x9E3779B1)) >> shift).astype(np.int64)
        out.append(np.where(size >= k, found, -1))
    return out


def once(t: textbatch.TextBatch, sentence: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The positions in kept (of words) at which a word stands in its sentence for the first time."""
    key = textbatch.mix(t.hashes[kept] ^ textbatch.mix(sentence[kept].astype(np.uint64)))
    return kept[np.sort(np.unique(key, return_index=True)[1])]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def noisy_or(p: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """1 - prod(1 - p) over each document's sentences."""
    return -np.expm1(np.bincount(doc, weights=np.log1p(-np.clip(p, 0, 1 - 1e-12)), minlength=n_docs)[:n_docs])


def fit(bucket: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, epochs: int = 300, rate: float = 0.1, decay: float = 3e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, the buckets, and their weights: Adam on the whole sample's log loss, classes weighing alike."""
    used, col = np.unique(bucket, return_inverse=True)
    balance = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    theta = np.zeros(len(used) + 1)
    theta[-1] = -6.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, epochs + 1):
        p = _logistic(theta[-1] + np.bincount(sentence, weights=theta[:-1][col], minlength=len(doc)))
        whole = np.clip(noisy_or(p, doc, len(label)), 1e-9, 1 - 1e-9)
        # d loss / d z_s of sentence s: p_s for a clean document, -p_s (1 - P) / P for a toxic one
        dz = p * (np.where(label > 0, -(1 - whole) / whole, 1.0) * balance)[doc]
        grads = np.append(np.bincount(col, weights=dz[sentence], minlength=len(used)), dz.sum())
        grads[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * grads, 0.999 * v + 0.001 * grads**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return float(theta[-1]), used, theta[:-1]


def counts(t: textbatch.TextBatch, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per bucket how many toxic texts and how many texts have it."""
    doc = t.doc_of_word().astype(np.int64)
    found = []
    for bucket in features(t):
        has = np.nonzero(bucket >= 0)[0]
        found.append(np.unique(doc[has] << BITS | bucket[has]))
    pair = np.concatenate(found)
    used, column, n = np.unique(pair & ((1 << BITS) - 1), return_inverse=True, return_counts=True)
    return used, np.bincount(column, weights=label[pair >> BITS], minlength=len(used)).astype(np.int64), n


def told(t: textbatch.TextBatch, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chosen buckets in the texts: bucket and sentence of each, a word of a sentence once; sentences of words, texts of sentences."""
    sentence, doc = sentences(t)
    table = np.zeros(1 << BITS, dtype=bool)
    table[chosen] = True
    kinds = features(t)
    hit = [np.where(b >= 0, table[b], False) for b in kinds]
    some = once(t, sentence, np.nonzero(np.any(hit, axis=0))[0]) if len(t.start) else np.zeros(0, np.int64)
    picked = [some[h[some]] for h in hit]
    return np.concatenate([b[k] for b, k in zip(kinds, picked, strict=True)]), np.concatenate([sentence[k] for k in picked]), sentence, doc


def train(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> tuple[float, np.ndarray, np.ndarray]:
    """The model (bias, buckets, weights) from labelled documents that are not held out; equal texts count once."""
    chosen = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_training rows of two numbers
    sample = cut(sample.filter("text is not null").groupBy("text").agg(F.max("toxic").alias("toxic")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in textbatch.slices(b)):
            found = counts(textbatch.segment(batch.column("text"), textbatch.ALNUM), batch.column("toxic").to_numpy() > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["bucket", "n_toxic", "n"])

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("toxic")).first()
    if not size.n or not 0 < size.toxic < size.n:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    per_bucket = sample.mapInArrow(counted, "bucket long, n_toxic long, n long").groupBy("bucket").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n"))
    share = size.toxic / size.n
    # few of the 2**BITS buckets are left
    apart = per_bucket.filter((F.col("n") >= MIN_DOCUMENTS) & (F.col("n_toxic") > F.col("n") * share)).filter((F.col("n_toxic") - F.col("n") * share) >= MIN_Z * F.sqrt(F.col("n") * share * (1 - share)))
    buckets = np.sort(np.array([r.bucket for r in apart.select("bucket").collect()], dtype=np.int64))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in textbatch.slices(b)):
            bucket, sentence, _, doc = told(textbatch.segment(batch.column("text"), textbatch.ALNUM), buckets)
            order = np.argsort(sentence, kind="stable")
            bucket, sentence = bucket[order], sentence[order]
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            words = np.searchsorted(sentence, edges)
            parts = [np.stack([sentence[a:b] - lo, bucket[a:b]]).astype("<i4").tobytes() for a, b, lo in zip(words[:-1], words[1:], edges[:-1], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(np.diff(edges), pa.int32()), pa.array(parts, pa.binary())], ["toxic", "n", "packed"])

    def fitted(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "toxic", "packed"])
        parts = [np.frombuffer(x, "<i4").reshape(2, -1).astype(np.int64) for x in rows.packed]
        n = rows.n.to_numpy().astype(np.int64)
        start = np.cumsum(n) - n
        bias, used, weights = fit(np.concatenate([x[1] for x in parts]), np.concatenate([x[0] + s for x, s in zip(parts, start, strict=True)]), np.repeat(np.arange(len(n)), n), (rows.toxic.to_numpy() > 0).astype(float))
        return pd.DataFrame({"bias": [bias], "buckets": [used.astype("<i8").tobytes()], "weights": [weights.astype("<f8").tobytes()]})

    # one group: at most max_training rows of the chosen features
    got = sample.mapInArrow(packed, "toxic int, n int, packed binary").groupBy(F.lit(0).alias("k")).applyInPandas(fitted, "bias double, buckets binary, weights binary").first()
    return got.bias, np.frombuffer(got.buckets, "<i8"), np.frombuffer(got.weights, "<f8")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], names: tuple[str, str, str, str] = ("score", "worst_start", "worst_end", "worst_score")) -> DataFrame:
    """docs (with a column text) with score, and the code-point range and score of the worst sentence (null if none).

    A column of docs that has one of these names is replaced; give other names to keep it.
    """
    docs = docs.drop(*names)
    bias, used, weights = model
    kinds = [T.DoubleType(), T.LongType(), T.LongType(), T.DoubleType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(name, kind) for name, kind in zip(names, kinds, strict=True))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[used] = weights
        for batch in (s for b in batches for s in textbatch.slices(b)):
            t, n = textbatch.segment(batch.column("text"), textbatch.ALNUM), batch.num_rows
            bucket, sentence, of_word, doc = told(t, used)
            p = _logistic(bias + np.bincount(sentence, weights=table[bucket], minlength=len(doc))) if len(used) else np.zeros(len(doc))
            whole = np.clip(noisy_or(p, doc, n), 0, 1)
            spans, top = np.full((n, 2), -1, dtype=np.int64), np.zeros(n)
            if len(doc):
                order = np.lexsort((-p, doc))
                lead = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
                first, last = np.searchsorted(of_word, lead), np.searchsorted(of_word, lead, side="right") - 1
                points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80, dtype=np.int64)])
                at, base = doc[lead], points[t.docs[doc[lead]]]
                spans[at, 0], spans[at, 1], top[at] = points[t.start[first]] - base, points[t.end[last]] - base, p[lead]
            none = spans[:, 0] < 0
            extra = [pa.array(whole), pa.array(spans[:, 0], mask=none), pa.array(spans[:, 1], mask=none), pa.array(top, mask=none)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *names])

    return docs.mapInArrow(scored, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that score below THRESHOLD, with their columns as they were."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = ("_tox_score", "_tox_start", "_tox_end", "_tox_worst")
    return score(docs, model, names).filter(F.col("_tox_score") < THRESHOLD).select(*docs.columns)
