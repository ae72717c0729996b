"""Operators whose result depends on an order of choices: each group is decided by itself."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def decided(rows: DataFrame, keys: list[str], order: list[str | Column], schema: str | StructType, decide: Callable[[list], list[tuple]]) -> DataFrame:
    """What decide() makes of each group's rows, which come to it in order.

    Spark deals the rows by their keys and sorts them, and a task reads group after group off its sorted
    rows: it holds one group at a time, and many small groups cost no more than their rows.
    """
    return followed(rows, keys, order, schema, lambda group: decide(list(group)))


def followed(rows: DataFrame, keys: list[str], order: list[str | Column], schema: str | StructType, follow: Callable[[Iterator], Iterable[tuple]]) -> DataFrame:
    """decided() for groups that are too large to hold: follow() gets a group's rows one by one and keeps what it needs of them."""
    rows = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    names, n = rows.columns, len(keys)
    kinds = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, out = namedtuple("Row", names, rename=True), []
        flat = (row(*x) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        as_batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)
        for _, group in groupby(flat, key=lambda r: r[:n]):
            for x in follow(group):
                out.append(x)
                if len(out) >= 4096:
                    yield as_batch(out)
                    out = []
        if out:
            yield as_batch(out)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def title_words(title: str) -> frozenset:
    import re

    return frozenset(w for w in re.split("[^a-z0-9_]+", (title or "").lower()) if len(w) > 2)


def similarity(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


#: Lines of a block in which kept findings are looked up.
BLOCK = 32


def dedupe(findings: DataFrame, keys: list[str], slack: int = 2, at_least: float = 0.5, same_span: float = 0.15) -> DataFrame:
    """findings (keys, start, end, category, title, confidence) without duplicates of a stronger one, by file.

    A finding is one if its range overlaps a kept one's within the slack and their titles are similar:
    at_least in general, same_span if range and category agree. It joins the first such one, the surest
    first. Kept ones count what they stand for in `merged`; of the columns chunks and skills (arrays) they
    take the union, of non_rejectable the or, of tool the first that is not null, where there are such.
    Kept ones are looked up by blocks of lines, so that a file of many findings isn't compared all with all.
    """
    names, unions = findings.columns, [c for c in ("chunks", "skills") if c in findings.columns]
    order = [F.desc("confidence"), *(c for c in ("start", "end", "title", "id") if c in names)]
    fields = [*keys, *(c for c in names if c not in keys)]

    def decide(rows: list) -> list[tuple]:
        kept, by_block = [], {}
        for r in rows:
            words = title_words(r.title)
            blocks = range((r.start - slack) // BLOCK, (r.end + slack) // BLOCK + 1)
            for j in sorted({j for b in blocks for j in by_block.get(b, ())}):
                x = kept[j]
                bar = same_span if (r.start, r.end, r.category) == x["span"] else at_least
                if r.start <= x["span"][1] + slack and r.end >= x["span"][0] - slack and similarity(words, x["words"]) >= bar:
                    x["rows"].append(r)
                    break
            else:
                for b in range(r.start // BLOCK, r.end // BLOCK + 1):
                    by_block.setdefault(b, []).append(len(kept))
                kept.append({"span": (r.start, r.end, r.category), "words": words, "rows": [r]})
        out = []
        for group in (x["rows"] for x in kept):
            one = group[0]._asdict() | {c: sorted({v for r in group for v in getattr(r, c)}) for c in unions}
            if "non_rejectable" in names:
                one["non_rejectable"] = any(r.non_rejectable for r in group)
            if "tool" in names:
                one["tool"] = next((r.tool for r in group if r.tool is not None), None)
            out.append((*(one[c] for c in fields), len(group)))
        return out

    return decided(findings, keys, order, StructType([*(findings.schema[c] for c in fields), StructField("merged", LongType())]), decide)


def match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy one-to-one choice among pairs (keys, finding, defect, similarity, gap, iou, confidence): on topic first, then near ones."""
    fields = [*keys, *(c for c in pairs.columns if c not in keys)]

    def decide(rows: list) -> list[tuple]:
        used_f, used_d, out = set(), set(), []
        for r in rows:
            if r.finding not in used_f and r.defect not in used_d:
                used_f.add(r.finding)
                used_d.add(r.defect)
                out.append(tuple(r))
        return out

    order = [F.desc(F.col("similarity") >= 0.15), "gap", F.desc("iou"), F.desc("confidence"), "finding", "defect"]
    return decided(pairs, keys, order, StructType([pairs.schema[c] for c in fields]), decide)


def skip_fill(items: DataFrame, keys: list[str], size: str, order: list[str], budget: int) -> DataFrame:
    """items with `taken`: in order, each that still fits the group's budget; one that doesn't is skipped and later ones are still tried."""
    fields = [*keys, *(c for c in items.columns if c not in keys)]

    def decide(rows: list) -> list[tuple]:
        left, out = budget, []
        for r in rows:
            n = getattr(r, size)
            out.append((*r, n <= left))
            left -= n if n <= left else 0
        return out

    return decided(items, keys, order, StructType([*(items.schema[c] for c in fields), StructField("taken", BooleanType())]), decide)


def reset_fill(items: DataFrame, keys: list[str], size: str, order: list[str], budget: int) -> DataFrame:
    """items with `chunk`: filled in order, a new chunk from 0 on wherever the next item would overflow the budget."""
    fields = [*keys, *(c for c in items.columns if c not in keys)]

    def decide(rows: list) -> list[tuple]:
        chunk, used, out = 0, 0, []
        for r in rows:
            n = getattr(r, size)
            if used and used + n > budget:
                chunk, used = chunk + 1, 0
            used += n
            out.append((*r, chunk))
        return out

    return decided(items, keys, order, StructType([*(items.schema[c] for c in fields), StructField("chunk", LongType())]), decide)
