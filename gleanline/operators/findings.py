"""The life of a finding: validation, severity rules, critique verdicts, hit lists, fingerprints, publication.

Findings are rows with file, start, end, severity, category, confidence, title and non_rejectable; files
are rows with file, n_lines and their changed ranges as an array of (a, b). A file's ranges are as many as
its hunks, so they travel in its row, and a test against them needs no join by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanline.functions.text import half_up, severity_rank

#: Lines that a finding and a hit may lie off the changed lines; hits of a rule in a file; least length of a failure path.
FINDING_SLACK, HIT_SLACK, PER_RULE, MIN_PATH = 20, 3, 10, 20
#: Most lines that a replacement may cover and hold.
MAX_REPLACED, MAX_REPLACEMENT = 30, 60


def near(ranges: Column, start: Column, end: Column, slack: int) -> Column:
    """Whether start..end lies within so many lines of any range."""
    return F.exists(ranges, lambda r: (start <= r["b"] + slack) & (end >= r["a"] - slack))


def validate(findings: DataFrame, files: DataFrame, slack: int = FINDING_SLACK) -> DataFrame:
    """findings with end clamped to the file, and `reason`: why one is dropped, or null."""
    end = F.least("end", "n_lines")
    off = (F.size("ranges") > 0) & ~near(F.col("ranges"), F.col("start"), end, slack)
    reason = F.when(F.col("n_lines").isNull(), "unknown-file").when(F.col("start") > F.col("n_lines"), "line-out-of-range").when(off, "outside-changed-lines")
    return findings.join(files.select("file", "n_lines", "ranges"), "file", "left").withColumn("reason", reason).withColumn("end", F.coalesce(end, "end")).drop("n_lines", "ranges")


def require_path(findings: DataFrame, path: str = "failure_path", origin: str = "origin") -> DataFrame:
    """findings whose severity is one level lower where a model claims a critical or major defect without saying how it is reached; `lowered` marks them."""
    short = F.length(F.trim(F.coalesce(F.col(path), F.lit("")))) < MIN_PATH
    lowered = F.col("severity").isin("critical", "major") & (F.col(origin) != "static") & short
    return findings.withColumn("lowered", lowered).withColumn("severity", F.when(lowered & (F.col("severity") == "critical"), "major").when(lowered, "minor").otherwise(F.col("severity")))


def usable_replacement(replacement: Column, start: Column, end: Column, lines: Column) -> Column:
    """Whether a text may replace the lines start..end: few lines on either side, no fence or carriage return, and a change."""
    text = F.regexp_replace(replacement, "\n\\z", "")
    span = end - start + 1
    fits = span.between(1, MAX_REPLACED) & ~F.contains(text, F.lit("```")) & ~F.contains(text, F.lit("\r")) & (F.size(F.split(text, "\n", -1)) <= MAX_REPLACEMENT)
    old = F.array_join(F.slice(lines, F.greatest(start, F.lit(1)).cast("int"), F.greatest(span, F.lit(0)).cast("int")), "\n")
    return replacement.isNull() | (fits & (text != old))


def merge_verdicts(findings: DataFrame, first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """findings with the critic's verdict, severity, confidence and whether they stay.

    first, second: (id, verdict, v_confidence, v_severity); a second opinion replaces the first. A finding
    without a verdict is uncertain; one that must not be dismissed stays when rejected, as uncertain.
    """
    verdicts = first
    if second is not None:
        names = ["verdict", "v_confidence", "v_severity"]
        again = second.select("id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_again"))
        verdicts = first.join(again, "id", "full").select("id", *(F.when(F.col("_again"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names))
    rows = findings.join(verdicts, "id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("uncertain")))
    saved = (F.col("verdict") == "rejected") & F.col("non_rejectable")
    confidence = F.coalesce("v_confidence", "confidence")
    return (
        rows.withColumn("kept", (F.col("verdict") != "rejected") | F.col("non_rejectable"))
        .withColumn("severity", F.when(saved, F.coalesce("v_severity", F.lit("info"))).otherwise(F.coalesce("v_severity", "severity")))
        .withColumn("confidence", F.when(saved, F.greatest(confidence, F.lit(0.5))).otherwise(confidence))
        .withColumn("verdict", F.when(saved, "uncertain").otherwise(F.col("verdict")))
        .drop("v_confidence", "v_severity")
    )


def second_opinion(confidence: Column, bar: float) -> Column:
    """Whether a confidence lies so close to the bar that a second opinion is asked for."""
    return (confidence >= max(0.0, bar - 0.1)) & (confidence < min(1.0, bar + 0.15))


def strongest_first() -> list[Column]:
    return [severity_rank(F.col("severity")), F.desc("confidence"), F.desc("non_rejectable"), F.concat_ws(":", "analyzer", "rule_id"), F.col("end"), F.col("message")]


def finalize_hits(hits: DataFrame, files: DataFrame, per_rule: int = PER_RULE) -> DataFrame:
    """The hits that stay: in known files, near changed lines (where ranges are given), capped by rule, of each spot the strongest.

    hits: file, start, end, analyzer, rule_id, severity, category, confidence, message, non_rejectable,
    dedupe_key (null: analyzer and rule); files: file, n_lines, ranges (null: the whole file), is_test.
    The cap counts a rule's hits in a file in order of lines and leaves out those that cannot be dismissed; of
    hits with one range and message the strongest come first.
    """
    rows = hits.join(files.select("file", "n_lines", "ranges", "is_test"), "file")
    rows = rows.withColumn("start", F.greatest("start", F.lit(1))).filter("start <= n_lines").withColumn("end", F.least("n_lines", F.greatest("start", "end")))
    rows = rows.filter(F.col("ranges").isNull() | near(F.col("ranges"), F.col("start"), F.col("end"), HIT_SLACK))
    sure = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("confidence"))) * F.when(~F.col("is_test"), 1.0).when(F.col("category") == "security", 0.5).otherwise(0.8)
    rows = rows.withColumn("confidence", half_up(F.greatest(F.lit(0.05), sure), 2)).drop("n_lines", "ranges", "is_test")
    by_rule = Window.partitionBy("file", "analyzer", "rule_id", "non_rejectable").orderBy("start", "end", "message", *strongest_first())
    capped = rows.withColumn("_n", F.row_number().over(by_rule)).filter(F.col("non_rejectable") | (F.col("_n") <= per_rule))
    spot = Window.partitionBy("file", "start", F.coalesce("dedupe_key", F.concat_ws(":", "analyzer", "rule_id"))).orderBy(*strongest_first())
    return capped.withColumn("_n", F.row_number().over(spot)).filter("_n = 1").drop("_n", "dedupe_key")


def number_hits(hits: DataFrame, run: str) -> DataFrame:
    """hits with ids H1, H2 ... within each run."""
    order = Window.partitionBy(run).orderBy("file", "start", "analyzer", "rule_id", "end", "message")
    return hits.withColumn("hit_id", F.concat(F.lit("H"), F.row_number().over(order).cast("string")))


def unique_fingerprints(findings: DataFrame, run: str, version: str = "1") -> DataFrame:
    """findings of which no two of a run share a fingerprint: the first by severity, line, title and id keeps it, the others mix in their title and a number."""
    order = [severity_rank(F.col("severity")), F.col("start"), F.col("title"), F.col("id")]
    rows = findings.withColumn("_first", F.row_number().over(Window.partitionBy(run, "fingerprint").orderBy(*order)) == 1)
    title = F.substring(F.trim(F.regexp_replace(F.lower("title"), "\\s+", " ")), 1, 500)
    rows = rows.withColumn("_title", title)
    n = F.row_number().over(Window.partitionBy(run, "fingerprint", "_title", "_first").orderBy(*order))
    other = F.substring(F.sha2(F.concat_ws("\u0000", F.lit(version), F.lit("dup"), "fingerprint", "_title", n.cast("string")), 256), 1, 32)
    return rows.withColumn("unique_fp", F.when(F.col("_first"), F.col("fingerprint")).otherwise(other)).drop("_first", "_title")


def hints_for_chunk(hits: DataFrame, chunk: str, most: int) -> DataFrame:
    """hits with `place`: shown for the first `most` of a chunk, overflow for later ones that must not be dropped; others go."""
    order = Window.partitionBy(chunk).orderBy(F.desc("non_rejectable"), severity_rank(F.col("severity")), F.desc("confidence"), "file", "start", "rule_id", "end", "message")
    rows = hits.withColumn("_n", F.row_number().over(order))
    place = F.when(F.col("_n") <= most, "shown").when(F.col("non_rejectable"), "overflow")
    return rows.withColumn("place", place).filter("place IS NOT NULL").drop("_n")


def anchor(start: Column, end: Column, hunks: Column, added: Column) -> Column:
    """The line that a comment on start..end hangs on: the first added one, else the start; null if no hunk holds the whole range."""
    last = F.greatest(start, end)
    inside = (start >= 1) & F.exists(hunks, lambda h: (start >= h["a"]) & (last <= h["b"]))
    adds = F.transform(F.filter(added, lambda r: (r["a"] <= last) & (r["b"] >= start)), lambda r: F.greatest(r["a"], start))
    return F.when(inside, F.coalesce(F.array_min(adds), start))


def plan_publication(findings: DataFrame, run: str, most: int, floor: str) -> DataFrame:
    """findings with `placement`: already-posted, stale, severity, no-diff, outside-diff, limit or inline.

    findings carry posted, stale and has_diff flags and their anchor line (null: none). Only findings
    that could be posted inline count towards the limit, the worst first.
    """
    rank = severity_rank(F.col("severity"))
    lowest = {"critical": 0, "major": 1, "minor": 2, "info": 3}[floor]
    reason = F.when(F.col("posted"), "already-posted").when(F.col("stale"), "stale").when(rank > lowest, "severity").when(~F.col("has_diff"), "no-diff").when(F.col("anchor").isNull(), "outside-diff")
    rows = findings.withColumn("_reason", reason).withColumn("_free", F.col("_reason").isNull())
    order = Window.partitionBy(run, "_free").orderBy(rank, F.desc("confidence"), "file", "start", "id")
    placed = F.coalesce("_reason", F.when(F.row_number().over(order) > most, "limit").otherwise("inline"))
    return rows.withColumn("placement", placed).drop("_reason", "_free")


def map_line(hunks: Column, line: Column) -> Column:
    """Where an old line stands behind hunks (old_start, old_lines, new_start, new_lines): a changed one at its hunk's beginning."""
    inside = F.filter(hunks, lambda h: (h["old_lines"] > 0) & (h["old_start"] <= line) & (line < h["old_start"] + h["old_lines"]))
    before = F.filter(hunks, lambda h: F.when(h["old_lines"] == 0, h["old_start"] < line).otherwise(h["old_start"] + h["old_lines"] - 1 < line))
    shift = F.aggregate(before, F.lit(0).cast("long"), lambda s, h: s + h["new_lines"] - h["old_lines"])
    return F.coalesce(F.get(inside, F.lit(0))["new_start"], line + shift)


def touches(hunks: Column, start: Column, end: Column) -> Column:
    """Whether any hunk changed the old lines start..end; an insertion between two of them counts."""
    return F.exists(hunks, lambda h: F.when(h["old_lines"] == 0, (h["old_start"] >= start) & (h["old_start"] < end)).otherwise((h["old_start"] <= end) & (h["old_start"] + h["old_lines"] - 1 >= start)))


def fixed_threads(threads: DataFrame, current: DataFrame, files: DataFrame) -> DataFrame:
    """(id, reason) of the threads whose finding was fixed.

    threads: id, file, start, end, fingerprint; current: file, start, end, fingerprint of this run's
    findings; files: file, status (changed, removed or gone from the change), complete (reviewed in full), hunks. A
    thread stays open if its fingerprint came up again, if its file was not reviewed in full, if no hunk touches
    its lines, or if a finding stands within three lines of where they went.
    """
    from gleanline.operators.intervals import overlap_join

    rows = threads.join(current.select("fingerprint").distinct(), "fingerprint", "left_anti").join(files, "file")
    away = rows.filter("status = 'gone'").select("id", F.lit("no-longer-changed").alias("reason"))
    seen = rows.filter("status <> 'gone' AND complete")
    removed = seen.filter("status = 'removed'").select("id", F.lit("removed").alias("reason"))
    moved = seen.filter("status = 'changed'").filter(touches(F.col("hunks"), F.col("start"), F.col("end")))
    low = map_line(F.col("hunks"), F.col("start"))
    moved = moved.select("id", "file", low.alias("start"), F.greatest(low, map_line(F.col("hunks"), F.col("end"))).alias("end"))
    spots = current.select("file", F.col("start").alias("start_b"), F.greatest("start", "end").alias("end_b"))
    changed = overlap_join(moved, spots, ["file"], 3, 64, "left_anti").select("id", F.lit("changed").alias("reason"))
    return away.unionByName(removed).unionByName(changed)


def since_last(previous: DataFrame, current: DataFrame, resolved: DataFrame) -> DataFrame:
    """(run, fp, state) of two reviews' fingerprints: open, added, fixed (its thread was resolved) or gone."""
    both = previous.select("run", "fp").distinct().withColumn("was", F.lit(True)).join(current.select("run", "fp").distinct().withColumn("is", F.lit(True)), ["run", "fp"], "full")
    rows = both.join(resolved.select("run", "fp").distinct().withColumn("done", F.lit(True)), ["run", "fp"], "left")
    state = F.when(F.col("was").isNull(), "added").when(F.col("is"), "open").when(F.col("done"), "fixed").otherwise("gone")
    return rows.select("run", "fp", state.alias("state"))
