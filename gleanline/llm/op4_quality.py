"""Rule bitmask ledger: each quality rule is evaluated once per document, its failure stored as a bit.

The ledger holds a document's measurements and a long whose bit r says that rule r failed. Policies
are versioned masks over the ledger: a document passes policy v if it fails none of the rules in
mask v. New policies and ablations (what would rule r alone drop, what would go if r were left out)
read the ledger only, by bitwise aggregation; no text is read again.

Edge cases: a null or empty text has no word and fails the base rule; repeated rows are judged each
for itself; an empty table gives an empty ledger; further columns of the input are kept by ledger(), but
for those named like a measurement or failed_bits, which the ledger's own replace, and left out of
the query's result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm import textbatch
from gleanline.llm.common import documents

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_lines", "n_short_lines", "max_word_chars", "n_distinct_words"]

#: The rules in bit order: a name and when a document fails. Ratios are compared in whole numbers.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 25 * n_words"),
    ("capitals", "n_words >= 10 AND 100 * n_caps_words > 40 * n_words"),
    ("short_words", "n_words >= 10 AND word_chars < 2 * n_words"),
    ("long_words", "n_words >= 10 AND word_chars > 16 * n_words"),
    ("repeated_lines", "n_lines >= 6 AND 100 * n_dup_lines > 50 * n_lines"),
    ("few_distinct_words", "n_words >= 50 AND n_distinct_words * n_distinct_words < 4 * n_words"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document. The newest is in force.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": ["too_few_words", "repeated_windows", "symbols", "short_words", "long_words"],
    "v2": ["too_few_words", "repeated_windows", "symbols", "capitals", "short_words", "long_words", "repeated_lines"],
    "v3": ["too_few_words", "repeated_windows", "symbols", "capitals", "short_words", "long_words", "repeated_lines", "few_distinct_words"],
}
IN_FORCE = "v2"

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: First bytes of characters inside words.
_POINT = (textbatch.NOT_SPACE & ((np.arange(256) & 0xC0) != 0x80)).astype(np.int64)
_UPPER, _LOWER = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
_UPPER[65:91], _LOWER[97:123] = 1, 1
_SPACE = " \t\n\x0b\x0c\r"


def mask(rules: list[str]) -> int:
    return sum(BIT[r] for r in rules)


def measure(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text."""
    t = textbatch.segment(texts, lower=False)
    n, words = t.n_words, len(t.start)
    points = np.concatenate([[0], np.cumsum(_POINT[t.data])])
    capitals = np.concatenate([[0], np.cumsum(_UPPER[t.data])])
    lowers = np.concatenate([[0], np.cumsum(_LOWER[t.data])])
    doc = t.doc_of_word()
    long = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(long, doc, points[t.end] - points[t.start])
    caps = (capitals[t.end] - capitals[t.start] >= 2) & (lowers[t.end] == lowers[t.start])
    hashes, whole = t.windows(5)
    at = np.nonzero(whole)[0]
    key = hashes[at] ^ textbatch.mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.bincount(at[twice], minlength=words + 6)[: words + 6] - np.bincount(at[twice] + 5, minlength=words + 6)[: words + 6]
    covered = np.cumsum(cover)[:words] > 0
    distinct = np.unique(t.hashes ^ textbatch.mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    lines = np.array([_lines(x) for x in texts.fill_null("").to_pylist()], dtype=np.int64).reshape(-1, 3)
    symbols = t.per_doc(_SYMBOL[t.data], t.docs)
    return [n, t.per_doc(_POINT[t.data], t.docs), symbols, lines[:, 1], t.per_doc(covered, t.words), t.per_doc(caps, t.words), lines[:, 0], lines[:, 2], long, np.bincount(doc[distinct], minlength=len(n))]


def _lines(text: str) -> tuple[int, int, int]:
    """Lines with a word, those of them that equal an earlier one, those of under 30 characters."""
    found = [x for x in text.split("\n") if x.strip(_SPACE)]
    return len(found), len(found) - len(set(found)), sum(len(x) < 30 for x in found)


def ledger(docs: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """docs with MEASURES and failed_bits."""

    kept = [c for c in docs.columns if c not in ("text", "failed_bits", *MEASURES)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in textbatch.slices(b)):
            found = measure(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x.astype(np.int64)) for x in found)], [*kept, *MEASURES])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    out = docs.select("text", *(f"`{c}`" for c in kept)).mapInArrow(measured, ", ".join([*fields, *(f"{m} long" for m in MEASURES)]))
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(rules)), F.lit(0)).cast("long")
    return out.withColumn("failed_bits", bits)


def apply_policy(rows: DataFrame, version: str, name: str = "kept") -> DataFrame:
    return rows.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablation(rows: DataFrame, version: str, group: list[str] | None = None) -> DataFrame:
    """Per rule of a policy: documents that fail it, those that fail it alone, and those kept if it were left out; one pass over the ledger."""
    whole = mask(POLICIES[version])
    held = F.col("failed_bits").bitwiseAND(F.lit(whole).cast("long"))
    counts = rows.groupBy(*(group or []), held.alias("bits")).agg(F.count(F.lit(1)).alias("n"))  # at most 2**rules rows a group
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in POLICIES[version]))).alias("r")
    flat = counts.select(*(group or []), "bits", "n", each).select(*(group or []), "bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.lit(whole).cast("long") - F.col("bit"))
    return flat.groupBy(*(group or []), "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit & (rest == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(documents(spark, sf_dir).select("doc_id", "text"))
    judged = apply_policy(apply_policy(rows, IN_FORCE), "base", "_base")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("_base")).alias("base_failed"), "kept", "failed_bits")


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy in force drops, by source: the ledger's ablation over all documents."""
    return ablation(ledger(documents(spark, sf_dir).select("source", "text")), IN_FORCE, ["source"])
