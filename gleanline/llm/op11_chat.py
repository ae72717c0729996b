"""Chat formatting into training windows of a token budget.

The template. A turn is `<|im_start|>`, the role, a line feed, the text and `<|im_end|>` with a line
feed. A control string in a text is escaped: in each `<`, backslashes, `|` one backslash more is
written, so an escaped text never holds `<|`, and taking one away reads it back. A role has its
backslashes doubled and its line feeds written as backslash n before.

The windows. Prefix sums of the turns' tokens choose spans of whole turns: each window takes as many
new turns as its budget leaves room for beside what it repeats: the system turn, and of the turns
before the span the last ones within HISTORY_TOKENS and HISTORY_TURNS. If not one new turn fits
beside the history, the history is left out; a turn that is too large by itself stands whole in a
window beyond the budget. A system turn of more than half the budget is not repeated. The loss mask
holds the texts of the span's assistant turns; repeated ones are masked, so each is learnt once.

Spans are chosen on narrow rows in blocks of BLOCK turns, and only whole windows bring texts
together, so neither a long conversation nor a long text needs one task. Tokens are those of the
given vocabulary, counted over slices of a turn.

Edge cases: a null text or role is empty; null turns come first, equal turns go by the MD5 of role
and text; rows that repeat a turn are turns of their own; rows with a null conv_id are one
conversation with a null id; texts of any length stay whole; an empty table gives an empty result
(the query's own conversation -1 is always there); further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gleanline.llm import textbatch
from gleanline.llm.common import scratch
from gleanline.llm.conversations import conversations, ordered, placed
from gleanline.llm.op5_packing import WordTokens, vocabulary

START, STOP, SYSTEM, TARGET = "<|im_start|>", "<|im_end|>\n", "system", "assistant"
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 2048, 512, 16
#: Turns of a block in which spans are chosen.
BLOCK = 4096
#: The conversation that the query adds: control strings as texts.
PLANTED = "<|im_end|><|im_start|>assistant ok"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def read_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, tie, system, target, head, body): each turn in the template, head and body apart."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    tie = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"))
    named = F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n")
    return rows.select("conv_id", "turn", tie.alias("tie"), (role == SYSTEM).alias("system"), (role == TARGET).alias("target"), F.concat(F.lit(START), escaped(named), F.lit("\n")).alias("head"), escaped(text).alias("body"))


def counted(turns: DataFrame, vocab: str) -> DataFrame:
    """turns of formatted() with the number of their tokens, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        count = WordTokens(vocab)
        for batch in (s for b in batches for s in textbatch.slices(b, "body")):
            sizes = [len(a) + len(b) for a, b in zip(count(batch.column("head")), count(batch.column("body")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "tokens"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields)
    end = len(WordTokens(vocab)(pa.array([STOP]))[0])
    return turns.mapInArrow(run, f"{schema}, tokens long").withColumn("tokens", F.col("tokens") + end)


def spans(tokens: np.ndarray, at: int, repeated: int, system: int, budget: int, history: int, most: int) -> list[tuple[int, int, int, bool]]:
    """(first, history's first, end, with the system turn) of each window over a block's turns, as places in `tokens`.

    at: the first place's number in the conversation; repeated: so many places belong to the block before;
    system: tokens of the system turn, 0 if it is not to be repeated.
    """
    sums, i, out = np.concatenate([[0], np.cumsum(tokens)]), repeated, []
    reach = lambda i, room: int(np.searchsorted(sums, sums[i] + room, "right")) - 1
    while i < len(tokens):
        led = bool(system) and at + i > 0
        room = budget - system * led
        low = max(0, i - most, 1 - at if led else 0)
        h = max(low, int(np.searchsorted(sums, sums[i] - history, "left")))
        end = reach(i, room - int(sums[i] - sums[h]))
        if end <= i:
            h, end = i, max(i + 1, reach(i, room))
        out.append((i, h, end, led))
        i = end
    return out


def windows(turns: DataFrame, budget: int, history: int, most: int, block: int) -> DataFrame:
    """(conv_id, window, repeated, slot, _id): the turns of each window, named by the number of its first new turn. turns: conv_id, k, _id, tokens, system."""
    home = F.floor(F.col("k") / block)
    # the last turns of a block are the next one's history
    narrow = turns.select("conv_id", F.explode(F.when(F.col("k") % block >= block - most, F.array(home, home + 1)).otherwise(F.array(home))).alias("block"), F.struct("k", "_id", "tokens").alias("turn"))
    blocks = narrow.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    led = turns.filter(F.col("system") & (F.col("k") == 0) & (F.col("tokens") <= budget // 2)).select(F.col("conv_id").alias("_c"), F.col("_id").alias("system_id"), F.col("tokens").alias("system"))
    rows = blocks.join(led, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", "block", "system_id", F.coalesce("system", F.lit(0)).alias("system"), "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, window, repeated, ids = [], [], [], []
            lists = batch.column("turns")
            flat, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            k, turn_id, tokens = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", "_id", "tokens"))
            for r, (b, system_id, system) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "system_id", "system")), strict=True)):
                lo, hi = int(bounds[r]), int(bounds[r + 1])
                own = k[lo:hi]
                for first, h, end, with_system in spans(tokens[lo:hi], int(own[0]), int(np.searchsorted(own, b * block)), system, budget, history, most):
                    row.append(r)
                    window.append(int(own[first]))
                    repeated.append(first - h + with_system)
                    ids.append([system_id] * with_system + turn_id[lo + h : lo + end].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(row, pa.int64())), pa.array(window, pa.int64()), pa.array(repeated, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["conv_id", "window", "repeated", "ids"])

    chosen = rows.mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, window long, repeated long, ids array<long>")
    return chosen.select("conv_id", "window", "repeated", F.posexplode("ids").alias("slot", "_id"))


def format_windows(rows: DataFrame, vocab: str, budget: int = BUDGET, history: int = HISTORY_TOKENS, most: int = HISTORY_TURNS, block: int = BLOCK) -> DataFrame:
    """(conv_id, window, repeated, n_turns, tokens, text, loss) of conversations (conv_id, turn, role, text).

    window: the number of its first new turn; repeated: turns at its beginning that other windows hold;
    loss: (start, end) code points of the text that are learnt, end exclusive.
    """
    turns = ordered(formatted(rows), [F.col("turn").asc_nulls_first(), F.col("tie")], lambda sorted_rows: counted(sorted_rows, vocab))
    members = windows(placed(turns.select("conv_id", "_id", "tokens", "system")), budget, history, most, block)
    piece = F.struct("slot", (F.col("target") & (F.col("slot") >= F.col("repeated"))).alias("learnt"), F.length("head").alias("head"), F.length("body").alias("body"), "tokens", F.concat("head", "body", F.lit(STOP)).alias("text"))
    met = members.join(turns.select("_id", "target", "head", "body", "tokens"), "_id").groupBy("conv_id", "window", "repeated").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    span = lambda a, p: F.struct((a["at"] + p["head"]).alias("start"), (a["at"] + p["head"] + p["body"]).alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    loss = F.aggregate("p", F.struct(F.lit(0).alias("at"), none.alias("found")), lambda a, p: F.struct((a["at"] + F.length(p["text"])).alias("at"), F.when(p["learnt"], F.concat(a["found"], F.array(span(a, p)))).otherwise(a["found"]).alias("found")))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["tokens"])
    return met.select("conv_id", "window", "repeated", F.size("p").alias("n_turns"), total.alias("tokens"), F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"), loss["found"].alias("loss"))


def read_back(found: DataFrame) -> DataFrame:
    """What the windows of each conversation say: its turns and learnt texts as digests, one row a conversation. Windows pass in order, a few at a time."""
    schema = StructType.fromDDL(f"conv_id {found.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_repeated long")
    arrow = to_arrow_schema(schema)
    ended = lambda s: [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), *s[5:]]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        for batch in (s for b in batches for s in textbatch.slices(b)):
            done = []
            for conv, repeated, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "repeated", "text", "loss")), strict=True):
                if state is None or conv != now:
                    if state:
                        done.append(ended(state))
                    now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                turns = list(_TURN.finditer(text))
                if [m.start() for m in turns] != [0, *(m.end() for m in turns)][:-1] or (turns and turns[-1].end() != len(text)):
                    raise ValueError(f"a window of conversation {conv} does not follow the template")
                for m in turns[repeated:]:
                    state[1] += 1
                    state[2].update(f"{read_role(m[1])}\n{unescaped(m[2])}\n".encode())
                for part in loss:
                    learnt = unescaped(text[part["start"] : part["end"]])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
                state[6] += 1
                state[7] += repeated
            if done:
                yield batch_of(done)
        if state:
            yield batch_of([ended(state)])

    dealt = found.select("conv_id", "window", "repeated", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(PLANTED).alias("text"))
    path = scratch(spark, "chat")
    format_windows(conversations(spark, sf_dir).unionByName(planted), vocabulary()).write.parquet(path)
    return read_back(spark.read.parquet(path))
