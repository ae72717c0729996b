"""Versions as arrays of whole numbers, and ranges of them as predicates built when the plan is."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts that are compared; further ones are none in practice and count as equal.
PARTS = 6


def parse(text: Column) -> Column:
    """The leading numbers of a version ('v15.1.0-rc.1' is 15, 1, 0), padded with zeros; null without any."""
    found = F.nullif(F.regexp_extract(text, r"^\s*v?([0-9]+(?:\.[0-9]+)*)", 1), F.lit(""))
    parts = F.transform(F.split(found, r"\.", -1), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0).cast("bigint"), PARTS)), 1, PARTS)


def _key(version: list[int]) -> Column:
    return F.array(*(F.lit(n).cast("bigint") for n in (version + [0] * PARTS)[:PARTS]))


def _bumped(version: list[int]) -> list[int]:
    return [*version[:-1], version[-1] + 1]


def _one(token: str, key: Column) -> Column:
    m = re.fullmatch(r"(>=|<=|>|<|=|\^|~)?\s*v?([\dxX*]+(?:\.[\dxX*]+)*)", token)
    if not m:
        raise ValueError(f"no version range: {token!r}")
    numbers: list[int] = []
    parts = m[2].split(".")
    for part in parts:
        if part in ("x", "X", "*"):
            break
        numbers.append(int(part))
    if not numbers:
        return F.lit(True)
    whole = len(numbers) == len(parts) and len(numbers) >= 3  # a partial version stands for all its releases
    low, after = key >= _key(numbers), _key(_bumped(numbers))
    match m[1]:
        case ">=":
            return low
        case ">":
            return key > _key(numbers) if whole else key >= after
        case "<=":
            return key <= _key(numbers) if whole else key < after
        case "<":
            return key < _key(numbers)
        case "^":
            first = next((k for k, n in enumerate(numbers) if n), len(numbers) - 1)
            return low & (key < _key(_bumped(numbers[: first + 1])))
        case "~":
            return low & (key < _key(_bumped(numbers[:2])))
    return low & (key < after)


def lies(key: Column, range_: str) -> Column:
    """Whether a version that parse() made lies in a range: >= > <= < = ^ ~, wildcards, spaces for and, || for or. Each bound looks at key anew, so it should be a column of its own."""
    out = F.lit(False)
    for choice in range_.split("||"):
        tokens = [t for t in re.split(r"[\s,]+", re.sub(r"(>=|<=|>|<|=|\^|~)\s+", r"\1", choice.strip())) if t]
        if not tokens:
            raise ValueError(f"an empty version range: {range_!r}")
        every = F.lit(True)
        for token in tokens:
            every = every & _one(token, key)
        out = out | every
    return F.coalesce(out, F.lit(False))


def satisfies(version: Column, range_: str) -> Column:
    """Whether a version text lies in a range, as in lies(); the text is read once, whatever the number of bounds."""
    return F.get(F.transform(F.array(parse(version)), lambda key: lies(key, range_)), F.lit(0))


def least_of(spec: Column) -> Column:
    """The least version that a dependency's specification allows, as text; null for tags, addresses and bare upper bounds."""
    s = F.regexp_replace(F.regexp_replace(F.trim(spec), "^workspace:", ""), "^npm:(?:@[^/@]+/)?[^@]+@", "")
    named = s.rlike(r"(?i)^(?:latest|next|canary|beta|alpha|rc|catalog:|git\+|git:|github:|file:|link:|https?:|portal:|patch:)")
    bound = r"(>=|<=|!=|===|==|~>|~=|>|<|=|\^|~)?\s*v?([0-9]+(?:\.[0-9]+)*)"
    # a version with its padded numbers, which come first and so decide the order
    known = lambda v: F.struct(parse(v).alias("key"), v.alias("text"))

    def lower(choice: Column) -> Column:
        each = F.zip_with(F.regexp_extract_all(choice, F.lit(bound), F.lit(1)), F.regexp_extract_all(choice, F.lit(bound), F.lit(2)), lambda o, v: F.struct(o.alias("o"), v.alias("v")))
        lows = F.transform(F.filter(each, lambda x: ~x["o"].isin("<", "<=", "!=")), lambda x: known(x["v"]))
        maven = F.regexp_extract(choice, r"^[\[(]\s*v?([0-9]+(?:\.[0-9]+)*)", 1)
        return F.when(choice.rlike(r"^[\[(]"), F.when(maven != "", known(maven))).otherwise(F.array_max(lows))

    choices = F.transform(F.split(s, r"\s*\|\|?\s*", -1), lower)
    return F.when((s != "") & ~named, F.array_min(F.filter(choices, lambda x: x.isNotNull()))["text"])
