"""Queries over texts: scans, findings, thresholds, metrics, publication and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanline.functions import text as T
from gleanline.operators import greedy, intervals
from gleanline.operators import textrules as rules
from gleanline.plans.registry import query

SCAN = rules.scan_sql()
#: A finding's place among the reasons of the publication ladder: hits a document may post.
INLINE_LIMIT = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.finalize(rules.scan(rules.line_table(table(spark, sf_dir, "documents").select("doc_id", "text"))))


@query("rule_scan_counts", f"WITH {SCAN} SELECT rule_id, severity, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM final GROUP BY ALL")
def rule_scan_counts(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@query("rule_scan_hits", f"WITH {SCAN} SELECT doc_id, line::INT AS line, rule_id, severity, category, confidence FROM final")
def rule_scan_hits(spark, sf_dir):
    return hits(spark, sf_dir).select("doc_id", "line", "rule_id", "severity", "category", "confidence")


@query("severity_pivot", f"WITH {SCAN} SELECT lang, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'major') AS major, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'info') AS info FROM final JOIN documents USING (doc_id) GROUP BY lang")
def severity_pivot(spark, sf_dir):
    per_doc = hits(spark, sf_dir).groupBy("doc_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in T.SEVERITIES))
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(per_doc, "doc_id").groupBy("lang").agg(*(F.sum(s).alias(s) for s in T.SEVERITIES))


@query("hit_ranges", f"WITH {SCAN}, p AS (SELECT DISTINCT doc_id, line FROM hits), g AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM p) SELECT doc_id, min(line)::INT AS start_line, max(line)::INT AS end_line FROM g GROUP BY doc_id, g")
def hit_ranges(spark, sf_dir):
    lines = rules.scan(rules.line_table(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return intervals.islands(lines, ["doc_id"], "line").select("doc_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"))


@query("near_hits", f"WITH {SCAN} SELECT a.doc_id, a.line::INT AS line_a, b.line::INT AS line_b, a.rule_id AS rule_a, b.rule_id AS rule_b FROM final a JOIN final b ON a.doc_id = b.doc_id AND a.severity IN ('critical', 'major') AND b.severity IN ('minor', 'info') AND abs(a.line - b.line) <= 3")
def near_hits(spark, sf_dir):
    found = hits(spark, sf_dir)
    a = found.filter("severity IN ('critical', 'major')").select("doc_id", F.col("line").alias("start"), F.col("line").alias("end"), F.col("rule_id").alias("rule_a"))
    b = found.filter("severity IN ('minor', 'info')").select("doc_id", F.col("line").alias("start_b"), F.col("line").alias("end_b"), F.col("rule_id").alias("rule_b"))
    return intervals.overlap_join(a, b, ["doc_id"], 3, 64).select("doc_id", F.col("start").alias("line_a"), F.col("start_b").alias("line_b"), "rule_a", "rule_b")


@query("unreported_spots", f"WITH {SCAN} SELECT doc_id, line::INT AS line, rule_id FROM final a WHERE severity IN ('minor', 'info') AND NOT EXISTS (SELECT 1 FROM final b WHERE b.doc_id = a.doc_id AND b.severity IN ('critical', 'major') AND abs(a.line - b.line) <= 2)")
def unreported_spots(spark, sf_dir):
    found = hits(spark, sf_dir)
    a = found.filter("severity IN ('minor', 'info')").select("doc_id", F.col("line").alias("start"), F.col("line").alias("end"), "rule_id")
    b = found.filter("severity IN ('critical', 'major')").select("doc_id", F.col("line").alias("start_b"), F.col("line").alias("end_b"))
    return intervals.overlap_join(a, b, ["doc_id"], 2, 64, "left_anti").select("doc_id", F.col("start").alias("line"), "rule_id")


_TAG = "CASE WHEN category = 'security' THEN 'kept' WHEN confidence < 0.5 THEN 'below-threshold' WHEN severity = 'info' THEN 'below-severity' ELSE 'kept' END"


@query("threshold_funnel", f"WITH {SCAN}, t AS (SELECT *, {_TAG} AS reason FROM final) SELECT (SELECT count(*) FROM hits) AS scanned, (SELECT count(*) FROM capped) AS capped, count(*) AS strongest, count(*) FILTER (reason = 'below-threshold') AS below_threshold, count(*) FILTER (reason = 'below-severity') AS below_severity, count(*) FILTER (reason = 'kept') AS kept, count(*) FILTER (reason = 'kept' AND category <> 'security' AND confidence < 0.7) AS advisory FROM t")
def threshold_funnel(spark, sf_dir):
    found = rules.scan(rules.line_table(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ranked = found.withColumn("capped", rules.capped(found))
    strong = Window.partitionBy("doc_id", "line", rules.spot_key(F.col("rule_id"))).orderBy(F.desc("capped"), T.severity_rank(F.col("severity")), F.desc("confidence"), "rule_id")
    tagged = ranked.withColumn("final", F.col("capped") & (F.row_number().over(strong) == 1)).withColumn("reason", F.expr(_TAG))
    of = lambda r: F.count_if(F.col("final") & (F.col("reason") == r))
    return tagged.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if("capped").alias("capped"), F.count_if("final").alias("strongest"), of("below-threshold").alias("below_threshold"), of("below-severity").alias("below_severity"), of("kept").alias("kept"),
        F.count_if(F.col("final") & (F.col("reason") == "kept") & (F.col("category") != "security") & (F.col("confidence") < 0.7)).alias("advisory"),
    )


@query("publication_plan", f"""WITH {SCAN}, t AS (SELECT f.*, CASE WHEN confidence < 0.5 THEN 'below-threshold' WHEN severity = 'info' THEN 'severity' WHEN line > 200 THEN 'outside-diff' END AS reason FROM final f),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, reason IS NULL ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 ELSE 2 END, confidence DESC, line, rule_id) AS k FROM t)
SELECT doc_id, line::INT AS line, rule_id, coalesce(reason, CASE WHEN k > {INLINE_LIMIT} THEN 'limit' ELSE 'inline' END) AS placement FROM r""")
def publication_plan(spark, sf_dir):
    reason = F.when(F.col("confidence") < 0.5, "below-threshold").when(F.col("severity") == "info", "severity").when(F.col("line") > 200, "outside-diff")
    rows = hits(spark, sf_dir).withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())
    k = F.row_number().over(Window.partitionBy("doc_id", "eligible").orderBy(T.severity_rank(F.col("severity")), F.desc("confidence"), "line", "rule_id"))
    return rows.withColumn("k", k).select("doc_id", "line", "rule_id", F.coalesce("reason", F.when(F.col("k") > INLINE_LIMIT, "limit").otherwise("inline")).alias("placement"))


@query("document_fingerprints", "SELECT doc_id, sha256(concat(coalesce(lang, ''), chr(1), coalesce(source, ''), chr(1), coalesce(text, '')))[1:32] AS fingerprint FROM documents")
def document_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fingerprint(F.col("lang"), F.col("source"), F.col("text")).alias("fingerprint"))


@query("redacted_documents", "SELECT doc_id, sha256(r)[1:32] AS digest, length(r)::BIGINT AS n FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', '[REDACTED]', 'g'), '(AKIA|ghp_|xox[bp]-|sk-)[A-Za-z0-9_-]{8,}', '[REDACTED]', 'g'), '[0-9a-f]{32,}', '[REDACTED]', 'g') AS r FROM documents)")
def redacted_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("r")).select("doc_id", F.substring(F.sha2("r", 256), 1, 32).alias("digest"), F.length("r").cast("long").alias("n"))


@query("turn_similarity", "WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda x: length(x) > 2)) AS w FROM conversations), p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS v FROM w) SELECT conv_id, turn, CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0.0 ELSE floor(len(list_intersect(w, v)) / (len(w) + len(v) - len(list_intersect(w, v))) * 10000 + 0.5) / 10000 END::DOUBLE AS similarity FROM p WHERE v IS NOT NULL")
def turn_similarity(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.title_words(F.col("text")).alias("w"))
    pairs = rows.withColumn("v", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("v IS NOT NULL")
    return pairs.select("conv_id", "turn", T.half_up(T.similarity(F.col("w"), F.col("v")), 4).alias("similarity"))


_METRICS = "count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic = 0) AS fn"


@query("label_metrics", f"WITH m AS (SELECT coalesce(lang, 'all') AS lang, n, tp, fp, fn FROM (SELECT lang, {_METRICS} FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang))) SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS precision_, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM m")
def label_metrics(spark, sf_dir):
    """Toxic as prediction, quality as truth: counts are summed first and the ratios made from the sums."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    is_ = lambda q, t: F.count_if((F.col("quality") == q) & (F.col("toxic") == t))
    sums = rows.rollup("lang").agg(F.count(F.lit(1)).alias("n"), is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn")).withColumn("lang", F.coalesce("lang", F.lit("all")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("lang", "n", "tp", "fp", "fn", T.ratio(tp, tp + fp).alias("precision_"), T.ratio(tp, tp + fn).alias("recall"), T.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("calibration", f"WITH {SCAN}, b AS (SELECT CASE WHEN confidence >= 0.9 THEN '0.90' WHEN confidence >= 0.75 THEN '0.75' WHEN confidence >= 0.6 THEN '0.60' WHEN confidence >= 0.45 THEN '0.45' ELSE '0.00' END AS bucket, quality FROM final JOIN labels USING (doc_id)) SELECT bucket, count(*) AS n, count(*) FILTER (quality = 1) AS n_real, count(*) FILTER (quality = 1)::DOUBLE / count(*) AS share FROM b GROUP BY bucket")
def calibration(spark, sf_dir):
    c = F.col("confidence")
    bucket = F.when(c >= 0.9, "0.90").when(c >= 0.75, "0.75").when(c >= 0.6, "0.60").when(c >= 0.45, "0.45").otherwise("0.00")
    rows = hits(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("bucket", bucket)
    n, real = F.count(F.lit(1)), F.count_if(F.col("quality") == 1)
    return rows.groupBy("bucket").agg(n.alias("n"), real.alias("n_real"), T.ratio(real, n).alias("share"))


@query("compare_runs", "WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source), b AS (SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY source) SELECT coalesce(a.source, b.source) AS source, a.n AS before, b.n AS after, b.n - a.n AS delta, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.source = b.source")
def compare_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "lang")
    a = docs.filter("lang = 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("before"))
    b = docs.filter("lang <> 'en'").groupBy("source").agg(F.count(F.lit(1)).alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, "source", "full").select("source", "before", "after", (F.col("after") - F.col("before")).alias("delta"), status.alias("status"))


@query("since_last_review", "WITH f AS (SELECT doc_id, sha256(coalesce(text, ''))[1:32] AS fp, doc_id % 2 AS half FROM documents), p AS (SELECT fp, count(*) AS n FROM f WHERE half = 0 GROUP BY fp), c AS (SELECT fp, count(*) AS n FROM f WHERE half = 1 GROUP BY fp) SELECT coalesce(p.fp, c.fp) AS fp, CASE WHEN p.fp IS NULL THEN 'added' WHEN c.fp IS NULL THEN 'gone' ELSE 'open' END AS state FROM p FULL JOIN c ON p.fp = c.fp")
def since_last_review(spark, sf_dir):
    """The two halves of a table stand for two reviews; findings are followed by fingerprint."""
    rows = table(spark, sf_dir, "documents").select(T.fingerprint(F.col("text")).alias("fp"), (F.col("doc_id") % 2).alias("half"))
    sides = rows.groupBy("fp").agg(F.max(F.col("half") == 0).alias("was"), F.max(F.col("half") == 1).alias("is"))
    return sides.select("fp", F.when(~F.col("was"), "added").when(~F.col("is"), "gone").otherwise("open").alias("state"))


@query("finding_dedupe")
def finding_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = rules.line_table(docs).withColumnRenamed("content", "title")
    found = hits(spark, sf_dir).join(lines, ["doc_id", "line"]).select("doc_id", F.col("line").alias("start"), F.col("line").alias("end"), "category", "title", "confidence")
    return greedy.dedupe(found, ["doc_id"])


@query("finding_match", f"""WITH RECURSIVE {SCAN}, q AS (SELECT a.doc_id, b.line::INT AS finding, a.line::INT AS defect, abs(a.line - b.line)::INT AS gap, CASE WHEN a.line = b.line THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS iou,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(a.line - b.line), b.line, a.line) AS k FROM final a JOIN final b ON a.doc_id = b.doc_id AND a.severity IN ('critical', 'major') AND b.severity IN ('minor', 'info') AND abs(a.line - b.line) <= 3),
g AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, []::INT[] AS fs, []::INT[] AS ds, false AS taken FROM q UNION ALL
  SELECT q.doc_id, q.k, CASE WHEN list_contains(fs, finding) OR list_contains(ds, defect) THEN fs ELSE list_append(fs, finding) END, CASE WHEN list_contains(fs, finding) OR list_contains(ds, defect) THEN ds ELSE list_append(ds, defect) END, NOT (list_contains(fs, finding) OR list_contains(ds, defect)) FROM g JOIN q ON q.doc_id = g.doc_id AND q.k = g.k + 1)
SELECT doc_id, finding, defect, 1.0::DOUBLE AS similarity, gap, iou, 0.5::DOUBLE AS confidence FROM g JOIN q USING (doc_id, k) WHERE taken""")
def finding_match(spark, sf_dir):
    """Weak hits as findings, strong ones of the same document as expected defects."""
    pairs = near_hits(spark, sf_dir)
    scored = pairs.select("doc_id", F.col("line_b").alias("finding"), F.col("line_a").alias("defect"), F.lit(1.0).alias("similarity"), F.abs(F.col("line_a") - F.col("line_b")).alias("gap"), F.when(F.col("line_a") == F.col("line_b"), 1.0).otherwise(0.0).alias("iou"), F.lit(0.5).alias("confidence"))
    return greedy.match(scored, ["doc_id"])


_TURNS = "t AS (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


@query("turn_budget", f"""WITH RECURSIVE {_TURNS}, r AS (SELECT conv_id, turn, n, k, n <= 2000 AS taken, 2000 - CASE WHEN n <= 2000 THEN n ELSE 0 END AS room FROM t WHERE k = 1
UNION ALL SELECT t.conv_id, t.turn, t.n, t.k, t.n <= room, room - CASE WHEN t.n <= room THEN t.n ELSE 0 END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1) SELECT conv_id, turn, n, taken FROM r""")
def turn_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return greedy.skip_fill(rows, ["conv_id"], "n", ["turn"], 2000)


@query("turn_chunks", f"""WITH RECURSIVE {_TURNS}, r AS (SELECT conv_id, turn, n, k, 0::BIGINT AS chunk, n AS used FROM t WHERE k = 1
UNION ALL SELECT t.conv_id, t.turn, t.n, t.k, chunk + CASE WHEN used > 0 AND used + t.n > 1000 THEN 1 ELSE 0 END, CASE WHEN used > 0 AND used + t.n > 1000 THEN t.n ELSE used + t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1) SELECT conv_id, turn, n, chunk FROM r""")
def turn_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return greedy.reset_fill(rows, ["conv_id"], "n", ["turn"], 1000)


@query("turn_prefix", "SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 2000")
def turn_prefix(spark, sf_dir):
    used = F.sum(F.length(F.coalesce("text", F.lit("")))).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", used.alias("used")).filter("used <= 2000").select("conv_id", "turn")


@query("role_usage", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, sum(length(coalesce(text, '')))::BIGINT AS chars FROM conversations GROUP BY role")
def role_usage(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("conv_id").alias("conversations"), F.sum(F.length(F.coalesce("text", F.lit("")))).cast("long").alias("chars"))


@query("chunk_split", "WITH r AS (SELECT conv_id, turn, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS acc, sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id) AS total FROM conversations) SELECT conv_id, turn AS split_after FROM r QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY abs(2 * acc - total), turn) = 1")
def chunk_split(spark, sf_dir):
    by, n = Window.partitionBy("conv_id"), F.length(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(n).over(by.orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)).alias("acc"), F.sum(n).over(by).alias("total"))
    return rows.groupBy("conv_id").agg(F.min(F.struct(F.abs(2 * F.col("acc") - F.col("total")), "turn"))["turn"].alias("split_after"))


@query("page_paths", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''))::INT AS depth FROM pages")
def page_paths(spark, sf_dir):
    path = F.split(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "/", -1)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.filter(path, lambda x: x != "")).alias("depth"))
