"""Readers of version control texts: unified diffs, name lists, commit logs, blame.

Each text is one row; its lines become rows, and the parsers' states (the file, the hunk, what is left of
it, the line numbers) are running sums and counts over them, so no parser runs line by line. The lines of
one text meet in one task, as their numbers depend on each other; texts are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"
_ESCAPES = {"n": "0A", "t": "09", '"': "22", "\\": "5C", "a": "07", "b": "08", "f": "0C", "r": "0D", "v": "0B"}


def unquote(path: Column) -> Column:
    """A path without Git's quoting: C escapes and octal bytes, which together are UTF-8."""
    tokens = F.regexp_extract_all(F.substring(path, F.lit(2), F.length(path) - 2), F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))

    def raw(token: Column) -> Column:
        rest = F.substring(token, 2, 3)
        named = F.coalesce(*(F.when(rest == c, F.lit(h)) for c, h in _ESCAPES.items()), F.hex(F.encode(rest, "UTF-8")))
        octal = F.right(F.lpad(F.conv(rest, 8, 16), 2, "0"), F.lit(2))
        return F.when(~F.startswith(token, F.lit("\\")), F.hex(F.encode(token, "UTF-8"))).when(rest.rlike("^[0-7]{3}$"), octal).otherwise(named)

    quoted = F.startswith(path, F.lit('"')) & F.endswith(path, F.lit('"')) & (F.length(path) >= 2)
    return F.when(quoted, F.decode(F.unhex(F.array_join(F.transform(tokens, raw), "")), "UTF-8")).otherwise(path)


def _side(path: Column, prefix: str) -> Column:
    """A path of a header line without its prefix; null for /dev/null."""
    bare = unquote(F.regexp_replace(path, "\t$", ""))
    return F.when(bare != "/dev/null", F.when(F.startswith(bare, F.lit(prefix)), F.substr(bare, F.lit(len(prefix) + 1))).otherwise(bare))


def _lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    return texts.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))


def diff_rows(diffs: DataFrame, key: str = "diff_id", text: str = "text") -> DataFrame:
    """(key, pos, line, file_no, hunk_no, head, body, old_line, new_line) of the lines of unified diffs that belong to a file.

    head: the hunk's four numbers as strings; body: whether the line is part of a hunk. A hunk ends where its
    counts are used up, so a deleted line that looks like a header is none. The lines of other kinds are headers.
    """
    by = Window.partitionBy(key).orderBy("pos")
    rows = _lines(diffs, key, text)
    is_file, is_hunk = F.startswith("line", F.lit("diff --git ")), F.col("line").rlike(HUNK)
    rows = rows.withColumn("file_no", F.count_if(is_file).over(by)).withColumn("hunk_no", F.count_if(is_file | is_hunk).over(by)).filter("file_no > 0")
    rows = rows.withColumn("_head", F.when(is_hunk, F.array(*(F.regexp_extract("line", HUNK, k) for k in range(1, 5)))))
    part = Window.partitionBy(key, "hunk_no").orderBy("pos")
    whole = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("head", F.first("_head", ignorenulls=True).over(whole))
    kind = F.when(F.startswith("line", F.lit("+")), "add").when(F.startswith("line", F.lit("-")), "del").when((F.col("line") == "") | F.startswith("line", F.lit(" ")), "ctx")
    rows = rows.withColumn("kind", F.when(F.col("head").isNotNull() & F.col("_head").isNull(), kind))
    before = part.rowsBetween(Window.unboundedPreceding, -1)
    number = lambda k: F.when(F.get("head", F.lit(k)) == "", 1).otherwise(F.get("head", F.lit(k)).cast("long"))
    rows = rows.withColumn("_old", F.coalesce(F.count_if(F.col("kind").isin("del", "ctx")).over(before), F.lit(0))).withColumn("_new", F.coalesce(F.count_if(F.col("kind").isin("add", "ctx")).over(before), F.lit(0)))
    body = F.col("kind").isNotNull() & ((F.col("_old") < number(1)) | (F.col("_new") < number(3)))
    rows = rows.withColumn("body", body)
    old = F.when(F.col("body") & F.col("kind").isin("del", "ctx"), number(0) + F.col("_old"))
    new = F.when(F.col("body") & F.col("kind").isin("add", "ctx"), number(2) + F.col("_new"))
    return rows.select(key, "pos", "line", "file_no", "hunk_no", "head", "body", F.when(F.col("body"), F.col("kind")).alias("kind"), old.alias("old_line"), new.alias("new_line"))


def diff_lines(rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, file_no, hunk_no, kind, old_line, new_line, content) of the lines inside hunks."""
    return rows.filter("body").select(key, "file_no", "hunk_no", "kind", "old_line", "new_line", F.substr("line", F.lit(2)).alias("content"))


def diff_files(rows: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, file_no, path, old_path, status, is_binary, submodule, hunks) of the files of diffs; hunks: (old_start, old_lines, new_start, new_lines)."""
    line, head = F.col("line"), ~F.col("body") & F.col("head").isNull()
    starts = lambda s: head & F.startswith(line, F.lit(s))
    rest = lambda s: F.substr(line, F.lit(len(s) + 1))
    # 'a/X b/X': where both sides are alike the middle parts them; else the first ' b/' does
    both = rest("diff --git ")
    middle = ((F.length(both) - 1) / 2).cast("int")
    left, right = F.substring(both, F.lit(1), middle), F.substr(both, middle + 2)
    alike = (F.length(both) % 2 == 1) & (F.substr(left, F.lit(3)) == F.substr(right, F.lit(3)))
    at = F.instr(both, F.lit(" b/"))
    named_old = F.when(alike, F.regexp_replace(left, "^a/", "")).when(at > 1, F.regexp_replace(F.substring(both, F.lit(1), at - 1), "^a/", ""))
    named_new = F.when(alike, F.regexp_replace(right, "^b/", "")).when(at > 1, F.regexp_replace(F.substr(both, at + 1), "^b/", ""))
    quoted = r'^("(?:[^"\\]|\\.)*")\s+(.*)$'
    is_quoted = both.rlike(quoted)
    named_old = F.when(is_quoted, F.regexp_replace(unquote(F.regexp_extract(both, quoted, 1)), "^a/", "")).otherwise(named_old)
    named_new = F.when(is_quoted, F.regexp_replace(unquote(F.regexp_extract(both, quoted, 2)), "^b/", "")).otherwise(named_new)
    new = F.when(starts("diff --git "), F.coalesce(named_new, named_old)).when(starts("rename to "), unquote(rest("rename to "))).when(starts("+++ "), _side(rest("+++ "), "b/"))
    old = F.when(starts("diff --git "), named_old).when(starts("rename from "), unquote(rest("rename from "))).when(starts("--- "), _side(rest("--- "), "a/"))
    status = F.when(starts("new file mode"), "added").when(starts("deleted file mode"), "deleted").when(starts("rename from ") | starts("rename to "), "renamed")
    module = head & (line.rlike(r"^(?:new file|deleted file|old|new) mode 160000\b") | line.rlike(r"^index \S+ 160000$"))
    last = lambda c: F.max(F.when(c.isNotNull(), F.struct("pos", c.alias("v"))))["v"]
    n = lambda k: F.when(F.get("head", F.lit(k)) == "", 1).otherwise(F.get("head", F.lit(k)).cast("long"))
    hunk = F.when(line.rlike(HUNK) & ~F.col("body"), F.struct("pos", n(0).alias("old_start"), n(1).alias("old_lines"), n(2).alias("new_start"), n(3).alias("new_lines")))
    files = rows.groupBy(key, "file_no").agg(
        last(new).alias("_new"), last(old).alias("_old"), F.coalesce(last(status), F.lit("modified")).alias("status"),
        F.bool_or(starts("Binary files ") | starts("GIT binary patch")).alias("is_binary"), F.bool_or(module).alias("submodule"), F.array_sort(F.collect_list(hunk)).alias("_hunks"),
    )
    path = F.when(F.col("status") == "deleted", F.coalesce("_old", "_new")).otherwise(F.col("_new"))
    old_path = F.when((F.col("status") == "added") | ((F.col("status") == "modified") & (F.col("_old") == path)), None).otherwise(F.col("_old"))
    hunks = F.transform("_hunks", lambda h: F.struct(h["old_start"].alias("old_start"), h["old_lines"].alias("old_lines"), h["new_start"].alias("new_start"), h["new_lines"].alias("new_lines")))
    return files.select(key, "file_no", path.alias("path"), old_path.alias("old_path"), "status", "is_binary", "submodule", hunks.alias("hunks"))


def diff_units(files: DataFrame, excluded: Column) -> DataFrame:
    """files with `skipped` (why a file is not reviewed, or null) and `focus`: the new lines that its hunks cover."""
    empty = F.size("hunks") == 0
    reason = F.when(excluded, "excluded").when(F.col("submodule"), "submodule").when(F.col("is_binary"), "binary").when(F.col("status") == "deleted", None)
    reason = reason.when(empty & (F.col("status") == "renamed"), "rename-only").when(empty, "no-content-change")
    focus = F.transform("hunks", lambda h: F.struct(F.greatest(h["new_start"], F.lit(1)).alias("a"), F.greatest(h["new_start"], h["new_start"] + h["new_lines"] - 1).alias("b")))
    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return files.withColumn("skipped", reason).withColumn("focus", F.when(F.col("status") == "deleted", none).otherwise(focus))


def name_list(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path) of lists of names separated by NUL."""
    return texts.select(key, F.explode(F.filter(F.split(text, "\u0000", -1), lambda p: p != "")).alias("path"))


def name_log(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, commit, path) of logs: blocks that begin with NUL and a commit's hash, then a name a line."""
    blocks = texts.select(key, F.explode(F.split(text, "\u0000", -1)).alias("block")).select(key, F.split("block", "\n", -1).alias("ls"))
    commit = F.trim(F.get("ls", F.lit(0)))
    named = blocks.filter(commit.rlike("^[0-9a-f]{7,64}$")).select(key, commit.alias("commit"), F.filter(F.slice("ls", 2, F.size("ls")), lambda p: F.length(p) > 0).alias("ls"))
    return named.select(key, "commit", F.explode("ls").alias("path")).withColumn("path", unquote(F.col("path")))


def blame(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, commit, author, author_time, summary) of porcelain blames; a commit's data stand at its first line only and hold for all."""
    header = r"^([0-9a-f]{40}) [0-9]+ ([0-9]+)"
    by = Window.partitionBy(key).orderBy("pos")
    rows = _lines(texts, key, text)
    is_head = F.col("line").rlike(header)
    rows = rows.withColumn("part", F.count_if(is_head).over(by)).filter("part > 0")
    field = lambda name: F.max(F.when(F.startswith("line", F.lit(f"{name} ")), F.substr("line", F.lit(len(name) + 2))))
    parts = rows.groupBy(key, "part").agg(
        F.max(F.when(is_head, F.regexp_extract("line", header, 1))).alias("commit"), F.max(F.when(is_head, F.regexp_extract("line", header, 2).cast("long"))).alias("number"),
        field("author").alias("author"), field("author-time").cast("long").alias("author_time"), field("summary").alias("summary"), F.bool_or(F.startswith("line", F.lit("\t"))).alias("whole"),
    )
    of_commit = Window.partitionBy(key, "commit")
    full = parts.select(key, F.col("number").alias("line"), "commit", "whole", *(F.max(c).over(of_commit).alias(c) for c in ("author", "author_time", "summary")))
    return full.filter("whole").drop("whole")


def dominant_blame(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, commit, author, n): the commit of most lines, the latest among equals; uncommitted lines don't count."""
    counts = lines.filter(~F.col("commit").rlike("^0+$")).groupBy(*keys, "commit").agg(F.count(F.lit(1)).alias("n"), F.max("author_time").alias("time"), F.max("author").alias("author"))
    return counts.groupBy(*keys).agg(F.max(F.struct("n", F.coalesce("time", F.lit(0)).alias("time"), "commit", "author")).alias("m")).select(*keys, "m.commit", "m.author", "m.n")
