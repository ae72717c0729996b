"""Plain versions of the corpus operators, one document or pair at a time."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, span=13):
    """doc_id -> (n_words, n_hit, n_items, items_sha256, contaminated)."""
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - span + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + span]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def dedup_lines(docs):
    """doc_id -> (text, removed) of documents in order of their ids."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        if text is None:
            out[doc] = (None, 0)
            continue
        lines = text.split("\n")
        content = [k for k, x in enumerate(lines) if TOKEN.search(x)]
        cut = set()
        for at in zip(content, content[1:], content[2:], strict=False):
            key = tuple(lines[k] for k in at)
            cut |= set(at) if key in seen else set()
            seen.add(key)
        out[doc] = ("\n".join(x for k, x in enumerate(lines) if k not in cut), len(cut))
    return out


def components(docs, percent=80):
    """doc_id -> least doc_id reachable by links."""
    sets = {}
    for doc, text in docs:
        w = TOKEN.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: find(d) for d in ids}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = TOKEN.findall(text)
    lines = [x for x in text.split("\n") if TOKEN.search(x)]
    places = {}
    for k in range(len(w) - 4):
        places.setdefault(tuple(w[k : k + 5]), []).append(k)
    repeated = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def check_packing(pieces, ids_of, capacity=2048):
    """The contract's rules for pieces (doc_id, start, length, crc, doc_tokens, sequence, offset) of documents' ids."""
    import zlib

    import numpy as np

    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(ids_of)
    for doc, parts in by_doc.items():
        ids, at = np.array([*ids_of[doc], 1], "<u4"), 0
        for _, start, length, crc, total, _, _ in sorted(parts, key=lambda p: p[1]):
            assert start == at and total == len(ids) and length > 0
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= capacity
    return sum(len(i) + 1 for i in ids_of.values()) / (capacity * len(by_sequence))
