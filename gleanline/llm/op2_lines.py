"""Line dedup over windows of three lines.

A document's content lines are its \\n-split lines that hold anything but white space; a window is
three of them in a row. Windows are compared over the whole corpus by a 128-bit hash of their exact
lines. Of each repeated window the first occurrence, by (doc_id, line number), stays; all lines that
any later occurrence covers are removed, overlapping windows being merged, and the remaining lines
are joined again. The first copy of every line always survives, as a removed line has an equal one
earlier. Shorter repeats and lines without content are left alone.

Edge cases: a null text stays null; texts of fewer than three content lines stay as they are; rows
that repeat a (doc_id, text) are one document and all get its result; a null doc_id sorts first; an
empty table gives an empty result; dedup() gives n_lines and n_removed beside the text, keyed like
its input, and stage() keeps all further columns whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import documents

WINDOW = 3
#: A line with content.
CONTENT = r"[^\x20\x09-\x0D]"


def _row_key() -> Column:
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("x"))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, x, h1, h2, lines): each window's document, hash, and zero-based line numbers."""
    lines = F.split("text", "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    content = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("x"), F.filter(numbered, lambda s: s["line"].rlike(CONTENT)).alias("c")).filter(F.size("c") >= WINDOW)
    at = content.select("doc_id", "x", "c", F.explode(F.sequence(F.lit(0), F.size("c") - WINDOW)).alias("k"))
    text = [F.col("c")[F.col("k") + j]["line"] for j in range(WINDOW)]
    numbers = F.array(*(F.col("c")[F.col("k") + j]["i"] for j in range(WINDOW)))
    return at.select("doc_id", "x", F.xxhash64(*text).alias("h1"), F.xxhash64(F.lit(7), *text).alias("h2"), numbers.alias("lines"))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, x, cut): the line numbers to be removed from a document, for documents that have any."""
    found = windows(docs)
    occurrence = F.struct("doc_id", F.col("lines")[0].alias("i"), "x")
    # one row a window hash, pre-aggregated before the shuffle: a window in a third of all rows is no hot key here
    first = found.groupBy("h1", "h2").agg(F.min(occurrence).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).filter(~F.struct("doc_id", F.col("lines")[0].alias("i"), "x").eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "x").agg(F.array_distinct(F.flatten(F.collect_set("lines"))).alias("cut"))


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, doc): each row's text rewritten; doc is the row as it was, in a struct."""
    cuts = covered(docs).select(F.col("doc_id").alias("_id"), F.col("x").alias("_x"), F.col("cut").alias("_cut"))
    rows = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc"))
    joined = rows.withColumn("_key", F.xxhash64("text")).join(cuts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_x")), "left")
    lines = F.split("text", "\n", -1)
    # a line and its mark sort side by side (the mark first), so one look at the neighbour decides: linear in the lines
    marks = F.transform(F.coalesce("_cut", F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"), F.lit("").alias("line")))
    whole = F.transform(lines, lambda line, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), line.alias("line")))
    joined = joined.withColumn("_all", F.when(F.col("_cut").isNotNull(), F.array_sort(F.concat(marks, whole))))
    kept = F.filter("_all", lambda s, k: (s["kind"] == 1) & ((k == 0) | (F.get("_all", k - 1)["i"] != s["i"])))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["line"]), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return joined.select("doc_id", text.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.when(F.col("_cut").isNotNull(), F.size("_cut")), F.lit(0)).cast("long").alias("n_removed"), "doc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents without their later copies of three-line windows; one that loses all its lines goes. n_chars follows the text."""
    out = dedup(docs).filter((F.col("n_removed") == 0) | F.coalesce(F.col("text"), F.lit("")).rlike(CONTENT))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    return out.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


#: What dedup() does to a table of documents, as a WITH list that ends in `dedup` (doc_id, n_lines, n_removed, text).
def sql(table: str = "documents", prefix: str = "ld") -> str:
    return f"""
{prefix}_rows AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {table}),
{prefix}_lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM {prefix}_rows WHERE text IS NOT NULL),
{prefix}_content AS (SELECT *, row_number() OVER w AS k, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2
  FROM {prefix}_lines WHERE regexp_matches(line, '[^ \\t-\\r]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{prefix}_ranked AS (SELECT *, row_number() OVER (PARTITION BY line, l1, l2 ORDER BY doc_id, i) AS r FROM {prefix}_content WHERE l2 IS NOT NULL),
{prefix}_cut AS (SELECT doc_id, list(DISTINCT c) AS cut FROM (SELECT doc_id, unnest([i, i1, i2]) AS c FROM {prefix}_ranked WHERE r > 1) GROUP BY doc_id),
{prefix}_out AS (SELECT d.doc_id, coalesce(len(d.ls), 0) AS n_lines, coalesce(len(c.cut), 0) AS n_removed,
  CASE WHEN c.cut IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(len(d.ls)), lambda j: NOT list_contains(c.cut, j)), lambda j: d.ls[j + 1]), chr(10)) END AS text
  FROM {prefix}_rows d LEFT JOIN {prefix}_cut c USING (doc_id))"""


ORACLE = f"WITH {sql().strip()} SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, text FROM ld_out"
