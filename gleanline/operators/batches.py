"""Work cut into batches, windows and parts, and what a pass over it claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleanline.functions import text as T
from gleanline.operators.greedy import decided
from gleanline.operators.intervals import overlap_join

#: Lines that windows of a long file share; least tokens of a context excerpt and most files that give one.
OVERLAP, MIN_CONTEXT, MAX_CONTEXT = 15, 300, 6


def batches(items: DataFrame, keys: list[str], size: str, order: list[str], budget: int, most: int) -> DataFrame:
    """items with `batch`: in order, a new one where the next item would be one too many or overflow the budget."""
    fields = [*keys, *(c for c in items.columns if c not in keys)]

    def decide(rows: list) -> list[tuple]:
        batch, count, used, out = 0, 0, 0, []
        for r in rows:
            n = getattr(r, size)
            if count and (count >= most or used + n > budget):
                batch, count, used = batch + 1, 0, 0
            count, used = count + 1, used + n
            out.append((*r, batch))
        return out

    return decided(items, keys, order, StructType([*(items.schema[c] for c in fields), StructField("batch", LongType())]), decide)


def windows(lines: DataFrame, keys: list[str], at: str, size: str, limit: int) -> DataFrame:
    """(keys, part, first, last): windows of a file's lines, filled line by line up to the limit, each sharing its last lines with the next."""

    def decide(rows: list) -> list[tuple]:
        out, start = [], 0
        sizes = [getattr(r, size) for r in rows]
        while start < len(rows):
            end, used = start, 0
            while end < len(rows) and (end == start or used + sizes[end] <= limit):
                used += sizes[end]
                end += 1
            out.append((*(getattr(rows[0], k) for k in keys), len(out) + 1, getattr(rows[start], at), getattr(rows[end - 1], at)))
            if end >= len(rows):
                break
            start = max(start + 1, end - OVERLAP)
        return out

    schema = StructType([*(lines.schema[k] for k in keys), *(StructField(n, LongType()) for n in ("part", "first", "last"))])
    return decided(lines.select(*keys, F.col(at).cast("long").alias(at), size), keys, [at], schema, decide)


def balanced(groups: DataFrame, keys: list[str], size: str, name: str, parts: int) -> DataFrame:
    """groups with `part`: the largest first, each to the part that holds least so far."""
    fields = [*keys, *(c for c in groups.columns if c not in keys)]

    def decide(rows: list) -> list[tuple]:
        load, out = [0] * parts, []
        for r in rows:
            k = load.index(min(load))
            load[k] += getattr(r, size)
            out.append((*r, k))
        return out

    return decided(groups, keys, [F.desc(size), name], StructType([*(groups.schema[c] for c in fields), StructField("part", LongType())]), decide)


def claims(findings: DataFrame, hints: DataFrame, slack: int = 3) -> DataFrame:
    """findings with the analyzer and rule of the hint they claim, where they point at its code.

    findings: chunk, hint, file, start, end; hints: chunk, hint_id, file, start, end, analyzer, rule_id, non_rejectable.
    """
    at = hints.select(F.col("chunk").alias("_chunk"), F.col("hint_id").alias("_hint"), F.col("file").alias("_file"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("analyzer").alias("tool_analyzer"), F.col("rule_id").alias("tool_rule"), F.col("non_rejectable").alias("_firm"))
    here = (F.col("chunk") == F.col("_chunk")) & (F.col("hint") == F.col("_hint")) & (F.col("file") == F.col("_file")) & (F.col("start") <= F.col("_end") + slack) & (F.col("end") >= F.col("_start") - slack)
    return findings.join(at, here, "left").withColumn("must_report", F.coalesce("_firm", F.lit(False))).drop("_chunk", "_hint", "_file", "_start", "_end", "_firm")


def both_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, passes): findings of a first pass, 2 for those that a second one repeats, and the second's others.

    first, second: id, file, start, end, title. A repeat overlaps and has a similar title.
    """
    a = first.select("id", "file", "start", "end", T.title_words(F.col("title")).alias("w"))
    b = second.select(F.col("id").alias("id_b"), "file", F.col("start").alias("start_b"), F.col("end").alias("end_b"), T.title_words(F.col("title")).alias("w_b"))
    same = overlap_join(a, b, ["file"], 0, 64).filter(T.similarity(F.col("w"), F.col("w_b")) >= 0.5).select("id", "id_b", "start", "end")
    twin = same.groupBy("id_b").agg(F.min("id").alias("id"))  # the first that is alike
    twice = twin.select("id").distinct().withColumn("_2", F.lit(True))
    kept = first.select("id").join(twice, "id", "left").select("id", F.when(F.col("_2"), 2).otherwise(1).alias("passes"))
    fresh = second.select("id").join(twin.select(F.col("id_b").alias("id")), "id", "left_anti").select("id", F.lit(1).alias("passes"))
    return kept.unionByName(fresh)


def context_files(chunks: DataFrame, imports: DataFrame, room: int) -> DataFrame:
    """(chunk, file, uses, used_by, place): the files of other chunks that give a chunk context, those it imports first, then its callers.

    chunks: chunk, file; imports: a (the importer), b. As many as can get an excerpt worth showing.
    """
    owned = chunks.select("file").distinct()
    known = imports.filter("a <> b").distinct().join(owned.select(F.col("file").alias("b")), "b", "left_semi").join(owned.select(F.col("file").alias("a")), "a", "left_semi")
    uses = chunks.join(known.select(F.col("a").alias("file"), F.col("b").alias("other")), "file").select("chunk", "other", F.lit(1).alias("u"), F.lit(0).alias("d"))
    users = chunks.join(known.select(F.col("b").alias("file"), F.col("a").alias("other")), "file").select("chunk", "other", F.lit(0).alias("u"), F.lit(1).alias("d"))
    score = uses.unionByName(users).groupBy("chunk", F.col("other").alias("file")).agg(F.sum("u").alias("uses"), F.sum("d").alias("used_by"))
    score = score.join(chunks.select("chunk", "file").distinct(), ["chunk", "file"], "left_anti")
    from pyspark.sql import Window

    order = Window.partitionBy("chunk").orderBy(F.desc(F.col("uses") > 0), F.desc(F.col("uses") + F.col("used_by")), "file")
    return score.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= min(MAX_CONTEXT, room // MIN_CONTEXT))


def share_context(candidates: DataFrame, room: int) -> DataFrame:
    """candidates (chunk, file, place, tokens) with `share`: what each file gets of a chunk's room for context.

    In their order, each may take its equal part of what is left (MIN_CONTEXT at least), and what a short file does
    not need goes to those behind it; files that less than MIN_CONTEXT is left for are left out. A chunk has at most
    MAX_CONTEXT candidates, so its files are one short array.
    """
    rows = candidates.filter(F.col("place") <= min(MAX_CONTEXT, room // MIN_CONTEXT)).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("place", "file", "tokens"))).alias("c"))
    kept = F.array().cast(f"array<struct<file:{candidates.schema['file'].dataType.simpleString()},place:int,tokens:bigint,share:bigint>>")

    def give(state, x):
        left = F.size("c") - state["i"]
        part = F.least(x["tokens"].cast("long"), F.greatest(F.lit(MIN_CONTEXT).cast("long"), F.floor(state["left"] / left)), state["left"])
        fits = state["left"] >= MIN_CONTEXT
        out = F.concat(state["out"], F.array(F.struct(x["file"].alias("file"), x["place"].cast("int").alias("place"), x["tokens"].cast("long").alias("tokens"), part.alias("share"))))
        return F.struct(F.when(fits, state["left"] - part).otherwise(state["left"]).alias("left"), (state["i"] + 1).alias("i"), F.when(fits, out).otherwise(state["out"]).alias("out"))

    shared = F.aggregate("c", F.struct(F.lit(room).cast("long").alias("left"), F.lit(0).alias("i"), kept.alias("out")), give)["out"]
    return rows.select("chunk", F.inline(shared))
