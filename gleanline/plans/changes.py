"""Queries over diffs, logs and blames made from documents; the twins compute what must come out without the detour through these texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanline.operators import intervals
from gleanline.plans.facts import table
from gleanline.plans.registry import query
from gleanline.sources import diffs as read

#: Files of a diff by doc_id % 6: added, deleted, renamed with changes, binary, modified, renamed only.
_KIND = "CASE doc_id % 6 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'renamed' WHEN 3 THEN 'binary' WHEN 4 THEN 'modified' ELSE 'moved' END"
_TWIN = f"""d AS (SELECT doc_id, doc_id // 10 AS diff_id, doc_id % 10 + 1 AS file_no, {_KIND} AS kind, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, diff_id, kind, unnest(ls) AS content, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE kind NOT IN ('binary', 'moved')),
k AS (SELECT *, CASE kind WHEN 'added' THEN 'add' WHEN 'deleted' THEN 'del' ELSE CASE i % 5 WHEN 1 THEN 'del' WHEN 2 THEN 'add' ELSE 'ctx' END END AS type FROM l),
n AS (SELECT *, CASE WHEN type <> 'add' THEN count(*) FILTER (type <> 'add') OVER w END AS old_line, CASE WHEN type <> 'del' THEN count(*) FILTER (type <> 'del') OVER w END AS new_line FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def made_diffs(spark, sf_dir):
    """(diff_id, text): unified diffs of ten documents each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_KIND).alias("kind"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    sign = F.transform("ls", lambda x, i: F.when(F.col("kind") == "added", "+").when(F.col("kind") == "deleted", "-").otherwise(F.when(i % 5 == 0, "-").when(i % 5 == 1, "+").otherwise(" ")))
    rows = rows.withColumn("sign", sign)
    body = F.array_join(F.zip_with("sign", "ls", lambda s, x: F.concat(s, x)), "\n")
    n_old, n_new = (F.size(F.filter("sign", lambda s: s != not_)).cast("string") for not_ in ("+", "-"))
    start = lambda n: F.when(n == "0", "0,0").when(n == "1", "1").otherwise(F.concat(F.lit("1,"), n))
    hunk = F.concat(F.lit("@@ -"), start(n_old), F.lit(" +"), start(n_new), F.lit(" @@ here\n"), body, F.lit("\n\\ No newline at end of file"))
    a, b = (F.concat(F.lit(f'"{s}/src/\\303\\251'), F.col("doc_id").cast("string"), F.lit('.txt"')) for s in "ab")
    moved = F.concat(F.lit("b/new dir/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    same = F.concat(F.lit("diff --git "), a, F.lit(" "), b, F.lit("\n"))
    other = F.concat(F.lit("diff --git "), a, F.lit(" "), moved, F.lit("\nsimilarity index 90%\nrename from "), F.concat(F.lit('"src/\\303\\251'), F.col("doc_id").cast("string"), F.lit('.txt"')), F.lit("\nrename to "), F.substr(moved, F.lit(3)))
    head = F.concat(F.lit("--- "), a, F.lit("\n+++ "), b, F.lit("\n"))
    text = (
        F.when(F.col("kind") == "added", F.concat(same, F.lit("new file mode 100644\n--- /dev/null\n+++ "), b, F.lit("\n"), hunk))
        .when(F.col("kind") == "deleted", F.concat(same, F.lit("deleted file mode 100644\n--- "), a, F.lit("\n+++ /dev/null\n"), hunk))
        .when(F.col("kind") == "renamed", F.concat(other, F.lit("\n--- "), a, F.lit("\n+++ "), moved, F.lit("\n"), hunk))
        .when(F.col("kind") == "binary", F.concat(same, F.lit("Binary files "), a, F.lit(" and "), b, F.lit(" differ")))
        .when(F.col("kind") == "modified", F.concat(same, F.lit("index 1..2 100644\n"), head, hunk))
        .otherwise(other)
    )
    files = rows.select(F.expr("doc_id div 10").alias("diff_id"), F.struct("doc_id", text.alias("text")).alias("f"))
    return files.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["text"]), "\n").alias("text"))


@query("diff_lines", f"WITH {_TWIN} SELECT diff_id, type AS kind, old_line, new_line, md5(content) AS digest FROM n")
def diff_lines(spark, sf_dir):
    return read.diff_lines(read.diff_rows(made_diffs(spark, sf_dir))).select("diff_id", "kind", "old_line", "new_line", F.md5("content").alias("digest"))


_FILES = f"""{_TWIN}, c AS (SELECT doc_id, count(*) FILTER (type <> 'del') AS n FROM n GROUP BY doc_id),
p AS (SELECT d.*, concat('src/é', doc_id, '.txt') AS here, concat('new dir/', doc_id, '.txt') AS there, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (doc_id))"""


@query("diff_files", f"WITH {_FILES} SELECT diff_id, CASE WHEN kind IN ('renamed', 'moved') THEN there ELSE here END AS path, CASE WHEN kind IN ('renamed', 'moved', 'deleted') THEN here END AS old_path, CASE kind WHEN 'moved' THEN 'renamed' WHEN 'binary' THEN 'modified' ELSE kind END AS status, kind = 'binary' AS is_binary, CASE WHEN kind IN ('binary', 'moved') THEN 0 ELSE 1 END AS hunks FROM p")
def diff_files(spark, sf_dir):
    return read.diff_files(read.diff_rows(made_diffs(spark, sf_dir))).select("diff_id", "path", "old_path", "status", "is_binary", F.size("hunks").alias("hunks"))


@query("diff_units", f"WITH {_FILES} SELECT diff_id, CASE WHEN kind IN ('renamed', 'moved') THEN there ELSE here END AS path, CASE WHEN kind IN ('renamed', 'moved') AND doc_id % 7 = 0 THEN 'excluded' WHEN kind = 'binary' THEN 'binary' WHEN kind = 'moved' THEN 'rename-only' END AS skipped, CASE WHEN kind NOT IN ('binary', 'moved', 'deleted') THEN n END AS last_line FROM p")
def diff_units(spark, sf_dir):
    """Which files of the diffs are reviewed, and the last line of their focus; paths of a vendored kind are excluded."""
    files = read.diff_files(read.diff_rows(made_diffs(spark, sf_dir)))
    number = F.regexp_extract("path", "^new dir/([0-9]+)[.]txt$", 1)
    units = read.diff_units(files, F.coalesce((number != "") & (number.try_cast("long") % 7 == 0), F.lit(False)))
    return units.select("diff_id", "path", "skipped", F.get("focus", F.lit(0))["b"].alias("last_line"))


@query("added_ranges", f"WITH {_TWIN}, g AS (SELECT doc_id, diff_id, new_line, new_line - row_number() OVER (PARTITION BY doc_id ORDER BY new_line) AS g FROM n WHERE type = 'add') SELECT diff_id, concat(CASE WHEN doc_id % 6 = 2 THEN 'new dir/' ELSE 'src/é' END, doc_id, '.txt') AS path, min(new_line) AS first_line, max(new_line) AS last_line FROM g GROUP BY doc_id, diff_id, g")
def added_ranges(spark, sf_dir):
    rows = read.diff_rows(made_diffs(spark, sf_dir))
    added = intervals.islands(read.diff_lines(rows).filter("kind = 'add'"), ["diff_id", "file_no"], "new_line")
    return added.join(read.diff_files(rows).select("diff_id", "file_no", "path"), ["diff_id", "file_no"]).select("diff_id", "path", F.col("start").alias("first_line"), F.col("end").alias("last_line"))


@query("quoted_paths", "SELECT doc_id, left(coalesce(text, ''), 60) AS path FROM documents")
def quoted_paths(spark, sf_dir):
    """Beginnings of texts quoted as Git does, and read back."""
    raw = F.regexp_extract_all(F.hex(F.encode(F.left(F.coalesce("text", F.lit("")), F.lit(60)), "UTF-8")), F.lit("(..)"), F.lit(1))
    names = {"0A": "\\n", "09": "\\t", "22": '\\"', "5C": "\\\\"}
    quoted = F.transform(raw, lambda h: F.coalesce(*(F.when(h == k, F.lit(v)) for k, v in names.items()), F.when(F.conv(h, 16, 10).cast("int").between(32, 126), F.decode(F.unhex(h), "UTF-8")), F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"'), F.array_join(quoted, ""), F.lit('"')).alias("q"))
    return rows.select("doc_id", read.unquote(F.col("q")).alias("path"))


@query("name_lists", "SELECT DISTINCT l_orderkey AS k, concat('f', l_partkey) AS path FROM lineitem")
def name_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.concat(F.array_join(F.collect_set(F.concat(F.lit("f"), F.col("l_partkey").cast("string"))), "\u0000"), F.lit("\u0000")).alias("text"))
    return read.name_list(rows, "k", "text")


@query("commit_files", "SELECT DISTINCT l_orderkey % 20 AS k, md5(l_orderkey::VARCHAR) AS commit_, concat('dir é/f', l_partkey) AS path FROM lineitem")
def commit_files(spark, sf_dir):
    """Commit logs of many commits each, and the files of every commit."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.md5(F.col("l_orderkey").cast("string")), F.lit("\n\n"), F.array_join(F.collect_set(F.concat(F.lit('"dir \\303\\251/f'), F.col("l_partkey").cast("string"), F.lit('"'))), "\n"), F.lit("\n")).alias("b"))
    logs = one.groupBy(F.expr("l_orderkey % 20").alias("k")).agg(F.concat(F.lit("\u0000"), F.array_join(F.collect_list("b"), "\u0000")).alias("text"))
    return read.name_log(logs, "k", "text").withColumnRenamed("commit", "commit_")


_BLAME = """b AS (SELECT conv_id, turn + 1 AS line, CASE WHEN turn % 5 = 4 THEN repeat('0', 40) ELSE concat(md5(concat(conv_id, '-', turn % 3)), '01234567') END AS commit_, concat('A ', conv_id, '-', turn % 3) AS author, 1000 + conv_id * 3 % 17 + turn % 3 AS t FROM (SELECT DISTINCT conv_id, turn FROM conversations))"""


def made_blames(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    k = F.expr("turn % 3").cast("string")
    who = F.concat_ws("-", F.col("conv_id").cast("string"), k)
    commit = F.when(F.expr("turn % 5 = 4"), "0" * 40).otherwise(F.concat(F.md5(who), F.lit("01234567")))
    rows = turns.withColumn("commit", commit).withColumn("first", F.row_number().over(Window.partitionBy("conv_id", "commit").orderBy("turn")) == 1)
    n = (F.col("turn") + 1).cast("string")
    meta = F.concat(F.lit("\nauthor A "), who, F.lit("\nauthor-mail <a@b.c>\nauthor-time "), F.expr("1000 + conv_id * 3 % 17 + turn % 3").cast("string"), F.lit("\nsummary s "), who)
    block = F.concat(F.col("commit"), F.lit(" "), n, F.lit(" "), n, F.when(F.col("first"), meta).otherwise(F.lit("")), F.lit("\nfilename f\n\tauthor of code"))
    rows = rows.select("conv_id", F.struct("turn", block.alias("b")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["b"]), "\n").alias("text"))


@query("blame_lines", f"WITH {_BLAME} SELECT conv_id, line, commit_, CASE WHEN commit_ LIKE '0000%' THEN first_value(author) OVER (PARTITION BY conv_id, commit_ ORDER BY line) ELSE author END AS author FROM b")
def blame_lines(spark, sf_dir):
    return read.blame(made_blames(spark, sf_dir), "conv_id", "text").select("conv_id", "line", F.col("commit").alias("commit_"), "author")


@query("blame_owner", f"WITH {_BLAME}, c AS (SELECT conv_id, commit_, author, count(*) AS n, max(t) AS t FROM b WHERE commit_ NOT LIKE '0000%' GROUP BY ALL) SELECT conv_id, commit_, author, n FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, t DESC, commit_ DESC) = 1")
def blame_owner(spark, sf_dir):
    lines = read.blame(made_blames(spark, sf_dir), "conv_id", "text")
    return read.dominant_blame(lines, ["conv_id"]).withColumnRenamed("commit", "commit_")
