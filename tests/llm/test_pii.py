"""The base spans of op6_pii against a plain finder that looks at every text."""

from __future__ import annotations

import random
import re

from gleanline.llm import op6_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9]){12,}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def brute(rows):
    out = set()
    for i, text in rows:
        for kind, pattern in PLAIN.items():
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                    out.add((i, kind, m.start(), m.end()))
    return out


def corpus():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "Appelez le +33 6 12 34 56 78 ce soir"), (3, "+4 4 2 0 7 9 4 6 0 9 5"), (4, "pay with 41 11 11 11 11 11 11 11 now"), (5, "4-1-1-1 1-1-1-1 1-1-1-1 1-1-1-1"), (6, "no 12 data 34"), (7, "10.0.0.1"), (8, "a.b@c.de"), (9, "+3(3)6(1)2(3)4(5)6")]
    for i in range(10, 400):
        kind, sep = rng.choice(("card", "phone", "ip", "email")), rng.choice((" ", "-"))
        digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(8, 21)))
        if kind == "card" and rng.random() < 0.7:
            digits = next(d for d in (digits[:-1] + c for c in "0123456789") if luhn(d))
        step = rng.choice((1, 2))
        spread = sep.join(digits[k : k + step] for k in range(0, len(digits), step))
        text = {"card": spread, "phone": "+" + spread, "ip": ".".join(str(rng.randrange(0, 300)) for _ in range(4)), "email": f"x{i}@host.example"}[kind]
        rows.append((i, f"words {text} more\nwords"))
    return rows


def test_base_spans_against_a_finder_without_filter(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = op6_pii.votes(op6_pii.candidates(docs)).filter("ok")
    assert {(r.doc_id, r.kind, r.start, r.end) for r in found.collect()} == brute(rows)


DECOYS = ["id = abcdefghij1234567890x", "version=aaaaaaaaaaaaaaaaaaa1", "path = src/components/button2/index", "id: EXAMPLE_KEY_0001112223334", "see https://h.example/?q=aGVsbG8gd29ybGQ1234567 now", "commit: 0123456789abcdef0123456789abcdef01234567", "data:image/png;base64,x=iVBORw0KGgoAAAANSUhEUg12", "key = placeholder_0123456789", "title=abcdefghijklmnopqrstuvwxyz", "order no: 555-123-4567"]
TOKENS = ["token = 9fK2mQ7xLp0ZtR4vBn8W", "api_secret: 'a94f0c1be27d83650ff1c2d3e4b5a697'", "password=hT7-kQ92_mZp4Xw1LrVb", "x = Zq8Lm3Tn5Rw2Yp9Kd4Jf"]
PHONES = ["call 555-123-4567 now", "(212) 555-0142", "tel: 415-555-0199."]


def random_tokens(n, seed=1):
    rng = random.Random(seed)
    return [f"{rng.choice(['token', 'k', 'secret', 'session'])} = " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.randrange(18, 40))) for _ in range(n)]


def judged(spark, *parts):
    """Which added spans stay, by text."""
    rows = [(k, t) for k, t in enumerate(t for part in parts for t in part)]
    found = op6_pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).filter("NOT ok").collect()
    texts = dict(rows)
    return {texts[r.doc_id] for r in found}


def test_verdicts_do_not_hang_on_the_mix(spark):
    cards = [t for _, t in corpus() if t]
    for mix in ([*random_tokens(60)], [*random_tokens(60), *DECOYS * 5], [*cards, *random_tokens(5)], [*DECOYS * 30], []):
        kept = judged(spark, DECOYS, TOKENS, PHONES, mix)
        assert kept >= {*TOKENS, *PHONES} and not kept & {*DECOYS}


def test_precision_and_recall_of_planted_spans(spark):
    rng = random.Random(9)
    true = random_tokens(200, 2) + [f"{rng.choice(['call', 'tel', 'reach me at', 'or'])} ({rng.randrange(200, 999)}) 555-0{rng.randrange(100, 200)}" for _ in range(100)]
    false = [f"{rng.choice(['id', 'version', 'commit', 'path'])} = " + "".join(rng.choice("abcdef0123456789") for _ in range(rng.randrange(16, 41))) for _ in range(100)]
    false += [f"x = {'/'.join(rng.choice(['src', 'lib', 'test', 'main', 'button2', 'index']) for _ in range(5))}" for _ in range(50)] + [f"t={rng.choice(['same', 'zero']) * 6}" for _ in range(50)]
    kept = judged(spark, true, false)
    assert len(kept & {*true}) >= 0.97 * len({*true}) and len(kept & {*false}) <= 0.03 * len(kept)


def test_weights_stay_where_they_are_known():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        kinds, voted, n = rng.integers(0, 6, 40), rng.integers(-1, 2, (40, op6_pii.N_VOTES)), rng.integers(1, 10_000, 40).astype(float)
        post = op6_pii.reliabilities(kinds, voted, n)
        assert (post[kinds < 4] == (voted[kinds < 4, 0] == 1)).all()
        known = np.array(list(op6_pii.KNOWN.values()))
        odds = np.log(post / (1 - post), where=(post > 0) & (post < 1), out=np.zeros_like(post))
        free = kinds >= 4
        at = op6_pii.PRIOR + (voted == 1) @ known[:, 0] + (voted == -1) @ known[:, 1]
        slack = op6_pii.PRIOR_HOLD + op6_pii.HOLD * (voted != 0).sum(1) + 1e-9
        assert (np.abs(odds - at)[free] <= slack[free]).all()
        # the classifier, fitted to convergence, follows the posteriors
        theta = op6_pii.train(kinds, voted, n, post)
        assert np.abs(1 / (1 + np.exp(-op6_pii._features(kinds[free], voted[free]) @ theta)) - post[free]).max() < 0.02


def test_odd_rows(spark, tmp_path):
    long = "é" * 300_000 + " token = 9fK2mQ7xLp0ZtR4vBn8W " + "w " * 100_000 + "a@b.example"
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "mail a@b.example"), (4, "call 555-123-4567"), (4, "other text +44 20 7946 0958")]
    spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, kind string, start int, probability double").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_pii.query(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.n_phone, r.spans) for r in got) == sorted([(1, 0, 0, ""), (2, 0, 0, "")] + [(3, 1, 0, f"email:{len(long) - 11}:{len(long)},secret:300009:300029")] * 2 + [(0, 1, 0, "email:5:16"), (4, 0, 0, "phone2:5:17"), (4, 0, 1, "phone:11:27")])
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op6_pii.query(spark, f"{tmp_path}/none").collect() == []
