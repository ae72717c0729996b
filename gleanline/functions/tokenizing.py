"""Token counts by a byte-level BPE vocabulary, with long runs counted by their length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The length from which a run counts by its length, characters a token in runs of spaces and in others, and the margin.
LONG_RUN, SPACE_EACH, OTHER_EACH, MARGIN = 256, 8, 3, 1.15
# What counts as a space.
_SPACE = r"\x20\x09-\x0D\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Runs are taken whole and never given back, so each character is looked at a few times however long its run is.
_SHORT = re.compile(f"(?:[^{_SPACE}]{{1,{LONG_RUN - 1}}}+(?![^{_SPACE}])|[{_SPACE}]{{1,{LONG_RUN - 1}}}+(?![{_SPACE}]))*+")
_RUN = re.compile(f"[^{_SPACE}]++|([{_SPACE}]++)")


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str):
    """The encoder of a file of ranks, once a worker process."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def exact(text: Column, path: str, pattern: str) -> Column:
    """The tokens of a text, as long; those of the pieces of an array text by text, summed. Null counts 0; special tokens' strings are plain text.

    path: a file of base64 tokens and ranks that every worker can read; pattern: how texts are cut before merging.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = vocabulary(path, pattern)
        for batch in batches:
            yield pd.Series([0 if pieces is None else sum(len(encoder.encode_ordinary(p)) for p in pieces) for pieces in batch], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def _pieces(text: str) -> tuple[list[str], int]:
    """What lies between the long runs of a text, and what those runs cost."""
    pieces, cost, at = [], 0, 0
    while (end := _SHORT.match(text, at).end()) < len(text):
        run = _RUN.match(text, end)
        pieces.append(text[at:end])
        cost, at = cost - -(run.end() - end) // (SPACE_EACH if run[1] else OTHER_EACH), run.end()
    return [p for p in (*pieces, text[at:]) if p], cost


def estimate(text: Column, path: str, pattern: str) -> Column:
    """What a text costs: its tokens and a margin of 15 %. Runs of spaces or of anything else of 256 characters or more (code points) count by their length, so no text is slow to merge.

    A null or empty text costs 0. Runs are found and the rest is counted in one pass over Arrow batches.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = vocabulary(path, pattern)
        for batch in batches:
            found = [_pieces(t or "") for t in batch]
            yield pd.Series([n + sum(len(encoder.encode_ordinary(p)) for p in pieces) for pieces, n in found], dtype="int64")

    return F.ceil(F.pandas_udf(count, "long")(text) * F.lit(MARGIN)).cast("long")
