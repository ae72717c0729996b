"""Skills of a review: which of them a chunk activates, how they score, and which fit its budget.

Skills are a configured table: id, priority, tokens, always_on, languages (an array, null: any), techs (an
array, null: any), globs and contents (regular expressions for paths and for added code, null: none), depth.
A skill's patterns become part of the plan, so that chunks are matched without a Python call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions.paths import matches_any
from gleanline.operators.greedy import decided

# What a match of each kind adds to a skill's priority.
CONTENT, FILES, STACK, LANGUAGE, DEPTH, ALWAYS = 40, 30, 20, 10, 3, 1000
PROSE = ("markdown", "text")


@dataclass(frozen=True)
class Skill:
    id: str
    priority: int
    tokens: int
    languages: tuple[str, ...] = ()
    techs: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()
    contents: tuple[str, ...] = ()
    always_on: bool = False
    depth: int = 0
    extends: tuple[str, ...] = ()


def gates(skill: Skill) -> tuple[Column, Column]:
    """Whether a file passes a skill's gates, and what they add to its score; unknown technologies pass only with a signal."""
    passes, score = F.lit(True), F.lit(skill.priority + DEPTH * skill.depth)
    if skill.languages:
        passes, score = passes & F.col("language").isin(*skill.languages), score + LANGUAGE
    if skill.techs:
        known = F.col("techs").isNotNull()
        passes = passes & (~known | F.arrays_overlap("techs", F.array(*map(F.lit, skill.techs))))
        score = score + F.when(known, STACK).otherwise(0)
    return passes, score


def match(files: DataFrame, skills: list[Skill]) -> DataFrame:
    """(chunk, skill, score): the skills that a chunk activates, by its best file. files: chunk, path, language, techs (null: unknown), code."""
    found = []
    for s in skills:
        passes, score = gates(s)
        by_path = matches_any(F.col("path"), list(s.globs))
        prose = F.col("language").isin(*PROSE) & F.lit(not set(s.languages) & set(PROSE))
        by_code = ~prose & F.col("code").rlike("|".join(f"(?:{c})" for c in s.contents)) if s.contents else F.lit(False)
        score = score + F.when(by_path, FILES).otherwise(0) + F.when(by_code, CONTENT).otherwise(0)
        if s.always_on:
            score = score + ALWAYS
        else:
            if s.globs or s.contents:
                passes = passes & (by_path | by_code)
            elif s.techs:
                passes = passes & F.col("techs").isNotNull()
        found.append(F.when(passes, F.struct(F.lit(s.id).alias("skill"), score.cast("long").alias("score"))))
    each = files.select("chunk", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return each.groupBy("chunk", F.col("m.skill").alias("skill")).agg(F.max("m.score").alias("score"))


def status(files: DataFrame, skills: list[Skill], excluded: list[str]) -> DataFrame:
    """(skill, status) over a whole repository: excluded, always-on, active (its gates pass and any own path fits), on-match (only its code could decide) or inactive."""
    seen, gated = [], []
    for s in skills:
        passes, _ = gates(s)
        gated.append(F.bool_or(passes).alias(f"g_{s.id}"))
        seen.append(F.bool_or(passes & (matches_any(F.col("path"), list(s.globs)) if s.globs else F.lit(not s.contents))).alias(f"s_{s.id}"))
    one = files.agg(*gated, *seen)
    rows = []
    for s in skills:
        ladder = F.when(F.lit(s.id in excluded), "excluded").when(F.lit(s.always_on) & F.col(f"g_{s.id}"), "always-on").when(F.col(f"s_{s.id}"), "active").when(F.col(f"g_{s.id}") & F.lit(bool(s.contents)), "on-match").otherwise("inactive")
        rows.append(F.struct(F.lit(s.id).alias("skill"), ladder.alias("status")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def select(matches: DataFrame, skills: list[Skill], budget: int) -> DataFrame:
    """(chunk, skill, via): the skills that fit a chunk's budget, the best first; one that doesn't is skipped, and what the picked ones extend comes in while there is room.

    A chunk has at most as many rows as there are skills; each choice depends on the earlier ones.
    """
    tokens, parents = {s.id: s.tokens for s in skills}, {s.id: s.extends for s in skills}

    def decide(rows: list) -> list[tuple]:
        used, picked = 0, {}
        for r in rows:
            if used + tokens[r.skill] <= budget:
                picked[r.skill] = "match"
                used += tokens[r.skill]
        queue = list(picked)
        for child in queue:
            for parent in parents[child]:
                if parent in tokens and parent not in picked and used + tokens[parent] <= budget:
                    picked[parent] = f"extends:{child}"
                    used += tokens[parent]
                    queue.append(parent)
        return [(rows[0].chunk, skill, via) for skill, via in picked.items()]

    kind = matches.schema["chunk"].dataType.simpleString()
    return decided(matches, ["chunk"], [F.desc("score"), "skill"], f"chunk {kind}, skill string, via string", decide)


def skills_for_hits(hits: DataFrame, table: dict[str, str]) -> DataFrame:
    """(chunk, skill): the skills that the rules of a chunk's hits belong to. hits: chunk, rule_id."""
    of_rule = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return hits.select("chunk", F.try_element_at(of_rule, F.col("rule_id")).alias("skill")).filter("skill IS NOT NULL").distinct()


def rules_for_files(files: DataFrame, rules: list[tuple[str, str, int]], budget: int) -> DataFrame:
    """(file, rule): the path-scoped rule texts (id, glob, tokens) of each file within a budget, in order; one that doesn't fit is skipped.

    The rules are a configured list, so a file's fill is one fold over it.
    """
    state = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"))
    wanted = F.array_compact(F.array(*(F.when(matches_any(F.col("path"), [g]), F.struct(F.lit(r).alias("rule"), F.lit(n).alias("n"))) for r, g, n in rules)))
    step = lambda s, x: F.when(s["used"] + x["n"] <= budget, F.struct((s["used"] + x["n"]).alias("used"), F.concat(s["taken"], F.array(x["rule"])).alias("taken"))).otherwise(s)
    return files.select("file", F.explode(F.aggregate(wanted, state, step)["taken"]).alias("rule"))


def top_per_kind(files: DataFrame, kind: str, order: list[Column], most: int) -> DataFrame:
    """The first files of each kind: at most so many."""
    n = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    return files.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")
