"""Benchmark decontamination by winnowing.

Words are runs of digits, a-z and characters beyond ASCII, after A-Z were lower-cased. A gram is K
words in a row; of each SPAN - K + 1 grams in a row the one with the least hash is a fingerprint. A
span of SPAN words that a document shares with a benchmark item holds the same grams on both sides
and so the same fingerprint: no shared span is missed. Each pair of equal fingerprints is extended
word by word in both directions, by at most as far as a window that holds the gram can reach, so
that chance hits and shorter runs fall away; what is left are the windows' exact occurrences.

Items of fewer than SPAN words are one window each. Those of at least K words are found by their
first gram among all the grams of a document, shorter ones by all the words they have.

A fingerprint carries the words around its gram that a window can reach, not the whole item. The
benchmark's are broadcast while there are at most `broadcast_rows` of them and BROADCAST_BYTES of
words; beyond that both sides are shuffled by fingerprint, the document side salted, since a passage may
stand in a third of all documents.

Edge cases: a null or empty text has no words, no hits and the digest of ''; items without words are
ignored; repeated rows with one doc_id count as one document (its longest word count, all its
hits); repeated items and item_ids count once; without documents or items nothing is hit; further
columns are left out of the report, and kept by stage().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import ascii_lower, cut, documents

SPAN, K = 13, 5
#: Benchmark fingerprints up to which they are broadcast, and bytes of the words that they carry.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32_000_000
SALTS = 16
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _GAP, -1), "")


def _gram(at: Column, n: int = K, of: str = "w") -> Column:
    return F.xxhash64(*(F.get(F.col(of), at + j) for j in range(n)))


def _positions(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def fingerprints(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, w, p, f: per window of grams its least hash f, the rightmost of equals, at place p in the word list w."""
    width = SPAN - K + 1
    # rows of fewer words have no grams (null) and so no windows; a filter on the number of words would split all texts twice
    hashed = rows.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    grams = hashed.select(*keep, "w", F.transform(F.when(F.size("h") >= SPAN, F.sequence(F.lit(0), F.size("h") - K)), lambda i: _gram(i, of="h")).alias("g"))
    least = grams.select(*keep, "w", "g", F.transform(F.sequence(F.lit(0), F.size("g") - width), lambda s: F.least(*(F.get("g", s + j) for j in range(width)))).alias("m"))
    # a computed input: for a plain column a filter on its size would be derived, and that would take the lambdas in one another's place
    start = least.select(*keep, "w", "g", "m", F.posexplode(F.slice("m", 1, F.size("g") - width + 1)).alias("s", "f"))
    # a window whose least gram is also the one before's adds nothing, unless a later equal has come in
    found = start.filter((F.col("s") == 0) | (F.get("m", F.col("s") - 1) != F.col("f")) | (F.get("g", F.col("s") + width - 1) == F.col("f")))
    place = F.col("s") + width - F.array_position(F.reverse(F.slice("g", F.col("s") + 1, width)), F.col("f"))
    return found.select(*keep, "w", place.cast("int").alias("p"), "f")


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, w, n) of the items with words, once for each item_id and text."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    return rows.filter(F.size("w") > 0).distinct().withColumn("n", F.size("w"))


def _reach(a: Column, b: Column) -> Column:
    """How many words in a row agree from the beginning of both lists on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _before(words_: str, at: str) -> Column:
    """The words before a place, the nearest first, as far as a window that holds the gram there can reach."""
    return F.reverse(F.slice(words_, F.greatest(F.col(at) - (SPAN - K), F.lit(0)) + 1, F.least(F.col(at), F.lit(SPAN - K))))


def _after(words_: str, at: str) -> Column:
    return F.slice(words_, F.col(at) + K + 1, SPAN - K)


def hits(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, lo, hi): ranges of words [lo, hi) of a document that are occurrences of windows of an item."""
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    bench = items(benchmark)
    # only a gram's neighbourhood is carried along
    from_ = F.greatest(F.col("p") - (SPAN - K), F.lit(0))
    marks = cut(fingerprints(bench, ["item_id"]).select("f", "item_id", F.slice("w", from_ + 1, 2 * SPAN - K + 1).alias("iw"), (F.col("p") - from_).alias("q")))
    short = bench.filter(F.col("n") < SPAN)
    lengths = sorted(r.n for r in short.select("n").distinct().collect())  # at most SPAN - 1 numbers
    small = lambda rows: (lambda r: (r.n, r.n <= broadcast_rows and (r.size or 0) <= BROADCAST_BYTES))(rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("iw", " "))).alias("size")).first())
    n_marks, fits = small(marks)
    found = []
    doc_marks = fingerprints(rows, ["doc_id"]).withColumn("o", F.lit(0))
    if not fits:
        # o: the place in the document of the first word that is shuffled
        doc_marks = doc_marks.select("doc_id", "f", F.slice("w", from_ + 1, 2 * SPAN - K + 1).alias("w"), (F.col("p") - from_).alias("p"), from_.alias("o"))
        salted = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = doc_marks.withColumn("salt", F.pmod(F.xxhash64("doc_id", "o"), F.lit(SALTS)).cast("int")).join(salted, ["f", "salt"])
    else:
        pairs = doc_marks.join(F.broadcast(marks), "f")
    if n_marks:
        ends = F.struct(_reach(_before("w", "p"), _before("iw", "q")).alias("left"), _reach(_after("w", "p"), _after("iw", "q")).alias("right"))
        # as a generator, so that no part of it becomes a join condition: the join then hands on matches alone, without copying word lists
        long = F.explode(F.filter(F.array(ends), lambda x: x["left"] + x["right"] + K >= SPAN)).alias("e")
        reach = pairs.filter(F.slice("w", F.col("p") + 1, K) == F.slice("iw", F.col("q") + 1, K)).select("doc_id", "item_id", (F.col("p") + F.col("o")).alias("p"), long)
        found.append(reach.select("doc_id", "item_id", (F.col("p") - F.col("e.left")).alias("lo"), (F.col("p") + K + F.col("e.right")).alias("hi")))
    for size in sorted({min(n, K) for n in lengths}):
        first = short.filter(F.least("n", F.lit(K)) == size).select(_gram(F.lit(0), size).alias("f"), "item_id", F.col("w").alias("iw"))
        at = rows.filter(F.size("w") >= size).select("doc_id", "w", F.explode(_positions(F.size("w") - (size - 1))).alias("p")).withColumn("f", _gram(F.col("p"), size))
        if small(first)[1]:
            both = at.join(F.broadcast(first), "f")
        else:
            near = at.select("doc_id", "f", F.slice("w", F.col("p") + 1, SPAN).alias("w"), F.lit(0).alias("p"), F.col("p").alias("o"))
            both = near.withColumn("salt", F.pmod(F.xxhash64("doc_id", "o"), F.lit(SALTS)).cast("int")).join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["f", "salt"])
        o = F.col("o") if "o" in both.columns else F.lit(0)
        found.append(both.filter(F.slice("w", F.col("p") + 1, F.size("iw")) == F.col("iw")).select("doc_id", "item_id", (F.col("p") + o).alias("lo"), (F.col("p") + o + F.size("iw")).alias("hi")))
    if not found:
        return docs.select("doc_id", F.lit("").alias("item_id"), F.lit(0).alias("lo"), F.lit(0).alias("hi")).limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_hit, n_items, items_sha256) of the documents with hits."""
    ranges = found.groupBy("doc_id", "lo", "hi").agg(F.collect_set("item_id").alias("ids"))
    by_doc = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids"))
    covered = F.aggregate("r", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["hi"]).alias("end")))
    return by_doc.select("doc_id", covered["n"].cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def report(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per doc_id: n_words, n_hit, n_items, items_sha256, contaminated."""
    counts = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("string").alias("items_sha256"))
    both = counts.unionByName(summary(hits(docs, benchmark, broadcast_rows)).withColumn("n_words", F.lit(0).cast("long")))
    out = both.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("n_words", "n_hit", "n_items")), F.coalesce(F.max("items_sha256"), F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that aren't contaminated."""
    narrow = docs.select("doc_id", "text")
    counts = narrow.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    found = summary(hits(narrow, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    longest = counts.groupBy(F.col("doc_id").alias("_id")).agg(F.max("n_words").alias("n_words"))
    tainted = found.join(longest, found["doc_id"].eqNullSafe(F.col("_id"))).filter("20 * n_hit >= n_words").select("_id")
    return docs.join(tainted, docs["doc_id"].eqNullSafe(F.col("_id")), "left_anti").select(*docs.columns)
