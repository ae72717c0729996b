"""Vectorised word segmentation and hashing of Arrow string batches, for use inside Spark tasks.

A task hands over one Arrow string array; numpy finds the words of all its texts at once and gives
each word a 64-bit hash, so that no Python statement runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; numpy needs some 30 bytes for each of them.
SLICE_BYTES = 1_000_000
#: Words longer than this are hashed one by one.
LONG_WORD = 128

_U = np.uint64
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words between white space: bytes other than 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, a-z and everything beyond ASCII (after lower-casing).
ALNUM = np.ones(256, dtype=bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (in a new array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class TextBatch:
    """data: bytes of all texts; docs: offsets of the texts in data; start, end: of each word;
    words: offsets of each text's words; hashes: of the words."""

    data: np.ndarray
    docs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    words: np.ndarray
    hashes: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words)

    def per_doc(self, flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sums of flags between each text's bounds."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[bounds[1:]] - total[bounds[:-1]]

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, whichever texts they touch, and whether each lies in one text."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=_U), np.zeros(0, dtype=bool)
        acc = self.hashes[:n].copy()
        for j in range(1, k):
            acc *= _U(0x9E3779B97F4A7C15)
            acc += self.hashes[j : n + j]
        doc = self.doc_of_word()
        return mix(acc), doc[:n] == doc[k - 1 :]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1, dtype=np.int32), self.n_words)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = (end - start).astype(np.int64)
    eight = eights(data)
    out = mix(size.astype(_U) + _U(0x632BE59BD9B4E019))
    live, at = np.nonzero(size <= LONG_WORD)[0], 0
    while len(live):
        chunk = eight[start[live] + at] & MASKS[np.minimum(size[live] - at, 8)]
        out[live] = mix((out[live] ^ chunk) * _U(0xD6E8FEB86659FD93))
        at += 8
        live = live[size[live] > at]
    for k in np.nonzero(size > LONG_WORD)[0]:
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


def segment(texts: pa.Array, word: np.ndarray = NOT_SPACE, lower: bool = True, hashed: bool = True) -> TextBatch:
    """The words of a string array; a null is an empty text."""
    texts = texts.fill_null("")
    _, offsets, raw = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    off = off - off[0]
    if lower:
        data = LOWER[data]
    inside = word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    return TextBatch(data, off, start, end, np.searchsorted(start, off), _hash_words(data, start, end) if hashed else np.zeros(0, dtype=_U))


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most SLICE_BYTES of text, or one longer text."""
    texts = batch.column(column)
    sizes = texts.fill_null("").cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]) if len(texts) else np.zeros(0, np.int64)
    begin, total = 0, 0
    for k, size in enumerate(lengths):
        if k > begin and total + size > SLICE_BYTES:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += size
    if begin < len(texts):
        yield batch.slice(begin)
