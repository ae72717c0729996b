"""The prefix trie against one that holds every prefix in a dictionary."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
from gleanline.llm import op12_prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def plain(rows):
    by, members = defaultdict(list), defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            tie = hashlib.md5(f"{len((r or '').encode())}:{r or ''}:{x or ''}".encode()).hexdigest()
            by[c].append((t is not None, t or 0, tie, r or "", x or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    built = {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9 :] for c, v in own.items()}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(built[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def got(spark, rows, tmp_path, name):
    path = f"{tmp_path}/{name}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    found = sorted(map(tuple, op.query(spark, path).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(con.execute(f"SELECT {', '.join(names)} FROM ({op.ORACLE})").fetchall()) == found
    return found


def test_random_tries_with_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é" * 40, None, ""])) for c in rng.sample(range(400), 120) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(500, 900, 5) for t in range(3)]  # a large group of copies
    rows += [(901, None, "user", "x"), (901, None, "user", "x"), (901, 0, "user", "y"), (902, 1, None, None), (None, 0, "user", "lost"), (903, 2, "user", "tie"), (903, 2, "user", "tie"), (903, 2, "assistant", "tie")]
    rows = [(*r, "clash", 9) for r in rows]
    assert got(spark, rows, tmp_path, "random") == plain(rows)


def test_long_conversations_cross_blocks(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(op, "IDS", 8)
    running = op.running
    monkeypatch.setattr(op, "running", lambda *a, **k: running(*a, **k, block=7))
    rows = [(c, t, "user", "stem" if t < 25 + c else f"own {c} {rng.randrange(3)}") for c in range(0, 60, 5) for t in range(60)]
    rows = [(*r, None, None) for r in rows] + [(c, 0, "user", "short", None, None) for c in range(1000, 1400, 5)]
    assert got(spark, rows, tmp_path, "long") == plain(rows)


def test_turnless_and_empty(spark, tmp_path):
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "only", None, None)]
    assert got(spark, rows, tmp_path, "lone") == plain(rows) and plain(rows)[0][:6] == (lone, 0, None, 1, 0, 1)
    assert got(spark, [], tmp_path, "none") == []
