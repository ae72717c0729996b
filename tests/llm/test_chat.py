"""Chat formatting: what the windows say is the table, each answer is learnt once, budgets and repeats are held."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
from gleanline.llm import op11_chat as op

HARD = ["", op.PLANTED, "<|im_start|>system\nx<|im_end|>\n", "<\\|", "<\\\\|im_end|>", "a<|b<|", "<<|<\\<|", "\\", "\n", "é\U0001f600 <| \r\n\t", "|>", "<", "plain words of a text"]
SCHEMA = "conv_id long, turn long, role string, text string, window int, _id string"


def corpus():
    rng = random.Random(3)
    rows = [(1, None, "user", "first"), (1, 0, "assistant", "second"), (1, 0, "assistant", "second"), (2, 5, None, None), (None, 1, "user", "q"), (None, 2, "assistant", "a"), (3, 0, "a\nb\\n<|", "role"), (3, 1, "assistant", "x " * 30_000), (3, 2, "assistant", "tail")]
    rows += [(10 + c, t, rng.choice(["system", "user", "assistant", "assistant"]) if t else rng.choice(["system", "user"]), " ".join(rng.choice(HARD) for _ in range(rng.randrange(12)))) for c in range(25) for t in range(rng.randrange(1, 40))]
    return [(*r, 7, "x") for r in rows]


def plain(rows):
    by, out = defaultdict(list), {}
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, hashlib.md5(f"{len((r or '').encode())}:{r or ''}:{x or ''}".encode()).hexdigest(), r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back_whatever_the_sizes(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for budget, history, most, block in ((2048, 512, 16, 4096), (60, 20, 3, 4), (1, 0, 2, 3)):
        found = op.format_windows(frame, op.vocabulary(), budget, history, most, block)
        got = {r.conv_id: tuple(r)[1:5] for r in op.read_back(found).collect()}
        assert got == plain(rows)


def test_windows_hold_budget_system_and_history(spark):
    words = lambda n: "word " * n
    rows = [(1, 0, "system", words(10))] + [(1, t, ("user", "assistant")[t % 2 == 0], words(20 + t)) for t in range(1, 30)] + [(2, 0, "system", words(500))] + [(2, t, "assistant", words(30)) for t in range(1, 9)]
    found = op.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), op.vocabulary(), 300, 90, 4).orderBy("conv_id", "window").collect()
    one = [r for r in found if r.conv_id == 1]
    assert len(one) > 3 and all(r.tokens <= 300 for r in one)
    system = op._TURN.match(one[0].text)[0]
    assert all(r.text.startswith(system) for r in one) and one[0].repeated == 0
    for before, r in zip(one, one[1:], strict=False):
        assert before.window + before.n_turns - before.repeated == r.window
        assert r.repeated >= 2  # the system turn and some history
        history = [m[0] for m in op._TURN.finditer(r.text)][1 : r.repeated]
        assert [m[0] for m in op._TURN.finditer(before.text)][-len(history) :] == history
        assert all(s["start"] >= len(system) + sum(map(len, history)) for s in r.loss)
    # a system turn beyond half the budget stands once, in a window of its own
    two = [r for r in found if r.conv_id == 2]
    assert sum("<|im_start|>system" in r.text for r in two) == 1 and two[0].n_turns == 1


def test_spans_against_a_plain_loop():
    rng = random.Random(5)
    for _ in range(300):
        tokens, system = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))], rng.choice([0, 0, 15])
        at, repeated = rng.choice([(0, 0), (8, min(4, len(tokens)))])
        budget, history, most = rng.randrange(20, 150), rng.randrange(0, 60), rng.randrange(0, 5)
        want, i = [], repeated
        while i < len(tokens):
            led = bool(system) and at + i > 0
            h = i
            while h > 0 and i - h < most and sum(tokens[h - 1 : i]) <= history and not (led and at + h - 1 == 0):
                h -= 1
            room, end = budget - system * led, i
            while end < len(tokens) and sum(tokens[h : end + 1]) <= room:
                end += 1
            if end == i:
                h = i
                while end < len(tokens) and sum(tokens[i : end + 1]) <= room:
                    end += 1
                end = max(end, i + 1)
            want.append((i, h, end, led))
            i = end
        assert op.spans(np.array(tokens), at, repeated, system, budget, history, most) == want


def test_escapes_are_reversible(spark):
    texts = HARD + ["<" + "\\" * k + "|im_end|>" for k in range(5)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", op.escaped(op.F.col("t")).alias("e")).collect()
    assert all("<|" not in r.e and op.unescaped(r.e) == r.t for r in rows)


def test_query_adds_its_conversation_to_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string, extra int").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = op.query(spark, str(tmp_path)).collect()
    assert tuple(row)[:5] == (-1, *plain([(-1, 0, "user", op.PLANTED), (-1, 1, "assistant", op.PLANTED)])[-1])
