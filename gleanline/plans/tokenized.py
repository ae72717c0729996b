"""Queries over token counts by a vocabulary: no SQL can express them, so tests/test_tokenizing.py holds them against a plain loop."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.functions import tokenizing
from gleanline.plans.facts import table
from gleanline.plans.registry import query

#: The vocabulary, by its name among the public ones.
VOCABULARY = "byte_bpe_50k.tiktoken"


@query("document_tokens")
def document_tokens(spark, sf_dir):
    """The cost in tokens of every document's whole text."""
    import public_tokenizers

    cost = tokenizing.estimate(F.col("text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return table(spark, sf_dir, "documents").select("doc_id", cost.alias("tokens"))
